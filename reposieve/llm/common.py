"""Input tables, intermediate tables in the shared folder, and Arrow batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposieve.session import shared_folder

#: Maps A-Z to a-z and leaves every other byte, so UTF-8 stays UTF-8.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Intermediate tables of one run, as Parquet in the folder that all executors share.

    A written table cuts the lineage: a lost executor costs the tasks it ran, not the
    steps before. ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def land(self, df: DataFrame, step: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{step}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{step}")

    def drop(self, *steps: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for step in steps:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{step}")
            path.getFileSystem(conf).delete(path, True)


#: Texts of a batch that are Python objects at a time.
TEXTS = 64


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """A string column as UTF-8 bytes; the batch is not copied as a whole."""
    for k in range(0, len(column), TEXTS):
        yield from column.slice(k, TEXTS).cast(pa.binary()).to_pylist()


def per_row(df: DataFrame, keep: list[str], column: str, make: Callable[[bytes | None], tuple], schema: str) -> DataFrame:
    """``keep`` as it is, and the fields of ``schema`` that ``make`` returns for each text of ``column``."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    types = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            rows = [make(t) for t in texts(batch.column(len(keep)))]
            columns = list(zip(*rows)) if rows else [()] * len(types.fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))]
                + [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, types.fields)],
                names=[*keep, *types.names],
            )

    return df.select(*keep, column).mapInArrow(run, f"{kept}, {schema}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, also not in other case."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made


def one_of_group(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each group of ``groups(_id, text_hash, root)``: the smallest by id, NULL last, then by hash of the text."""
    key, digest, times = fresh(docs, "_kept", "_hash", "_n")
    each = groups.groupBy("root", "_id", "text_hash").agg(F.count(F.lit(1)).alias("_n"))
    least = each.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "text_hash", "_n")).alias("one"))
    kept = least.select(F.col("one._id").alias(key), F.col("one.text_hash").alias(digest), F.col("one._n").alias(times))
    kept = Workspace(docs.sparkSession, "one-of-group").land(kept, "ids")
    rows = docs.join(kept, docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(digest)))
    again = rows.filter(F.col(times) > 1).dropDuplicates([key, digest])
    return rows.filter(F.col(times) == 1).unionByName(again).drop(key, digest, times)
