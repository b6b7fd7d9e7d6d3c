"""Writers: report log, report documents, run output."""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_PARTS = ("repos", "leaderboard", "results")


def without_nulls(value: Column, kind: T.DataType) -> Column:
    """``value`` without NULL array items and map values at any depth; NULL fields go when it becomes JSON."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*(without_nulls(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: without_nulls(x, kind.elementType))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda k, v: v.isNotNull())
        return F.transform_values(kept, lambda k, v: without_nulls(v, kind.valueType))
    return value


def pruned_json(df: DataFrame, *columns: str) -> Column:
    """JSON of columns of ``df`` without NULLs at any depth."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.to_json(F.struct(*(without_nulls(F.col(c), kinds[c]).alias(c) for c in columns)))


def report_json(reports: DataFrame) -> DataFrame:
    """One JSON text per report, NULLs left out."""
    return reports.select(F.col("repo.owner").alias("owner"), pruned_json(reports, *reports.columns).alias("value"))


def write_report_log(reports: DataFrame, path: str, batch: str | None = None) -> None:
    """Add a batch of reports to a log of JSON lines.

    A batch has a folder of its own, so one that is written again after a failure takes the place of
    what was there. Without a name it is a new one.
    """
    name = quote(batch or uuid.uuid4().hex, safe="")
    report_json(reports).select("value").write.mode("overwrite").text(f"{path}/batch={name}")


def write_reports(reports: DataFrame, path: str) -> None:
    """Report documents by owner."""
    report_json(reports).write.mode("overwrite").partitionBy("owner").text(path)


def run_lines(repos: DataFrame, board: DataFrame, reports: DataFrame) -> DataFrame:
    """``(section, value)``: every row of a run as a JSON line of its section."""
    frames = zip(RUN_PARTS, (repos, board, reports))
    lines = [
        df.select(F.lit(section).alias("section"), pruned_json(df, *df.columns).alias("value"))
        for section, df in frames
    ]
    return reduce(DataFrame.unionByName, lines)


def run_header(reports: DataFrame, params: dict) -> DataFrame:
    """One row: the query parameters and the count of results; parts of one report count once."""
    typed = [F.lit(v).alias(k) for k, v in params.items()]
    whole = F.coalesce(F.col("part"), F.lit(0)) == 0 if "part" in reports.columns else F.lit(True)
    return reports.agg(F.count_if(whole).alias("count")).select(*typed, "count")


def write_run(repos: DataFrame, board: DataFrame, reports: DataFrame, params: dict, path: str) -> None:
    """The aggregate document of a run, as one folder per section.

    The sections stay distributed: a single document would pass the whole run through
    one task. The readers of this package take the folders as they take documents.
    """
    run_header(reports, params).write.mode("overwrite").json(f"{path}/run")
    run_lines(repos, board, reports).write.mode("overwrite").partitionBy("section").text(f"{path}/sections")
