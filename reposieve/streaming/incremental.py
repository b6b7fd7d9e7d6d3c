"""Incremental scans: new files are scanned as they arrive, findings go to a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reposieve.operators.select import REPO
from reposieve.plans.scan import ScanConfig, scan

FILES = "owner string, name string, path string, length bigint, content string"


def stream_files(
    spark: SparkSession, path: str, schema: str | StructType = FILES, max_files: int | None = None
) -> DataFrame:
    """Stream of the file tables that land in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Stream without the repositories of an earlier run (stream-static anti join)."""
    return files.join(seen.select(*REPO).distinct(), REPO, "left_anti")


def scan_stream(
    files: DataFrame, out: str, checkpoint: str, config: ScanConfig = ScanConfig()
) -> StreamingQuery:
    """Append the findings of new files to a JSON log. The rules are stateless: same plan as batch."""
    return (
        scan(files, config).writeStream.format("json").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def rollup(findings: DataFrame) -> DataFrame:
    """Running counts per repository."""
    return findings.groupBy(*REPO).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("severe"),
    )


#: Batches whose changes are kept apart before they are folded into one table.
KEEP = 16


def rollup_writer(out: str, keep: int = KEEP) -> Callable[[DataFrame, int], None]:
    """Writes the counts that a batch changed; every ``keep`` batches the changes are folded into a new base.

    What a base replaces goes. A batch that is replayed overwrites its own folder, or is left out if it was folded in.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, last = batch.sparkSession, f"version={batch_id:010d}"
        before = _versions(spark, f"{out}/base")
        if last in before:
            return
        batch.write.mode("overwrite").parquet(f"{out}/changes/{last}")
        if batch_id % keep == keep - 1:
            read_rollup(spark, out, batch_id).write.mode("overwrite").parquet(f"{out}/base/{last}")
            done = [f"base/{v}" for v in before] + [f"changes/{v}" for v in _versions(spark, f"{out}/changes")]
            for folder in done:
                if folder.rpartition("/")[2] < last:
                    _delete(spark, f"{out}/{folder}")

    return write


def rollup_stream(findings: DataFrame, out: str, checkpoint: str, keep: int = KEEP) -> StreamingQuery:
    """Keep per-repository counts of a findings stream; ``read_rollup`` gives the newest of each.

    State is one small row per repository, and a batch writes only those it changed.
    """
    return (
        rollup(findings).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(rollup_writer(out, keep))
        .start()
    )


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Versions in a folder that were written to the end: Spark marks these."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = (s.getPath() for s in fs.listStatus(path) if s.isDirectory())
    return sorted(p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_rollup(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The newest counts of every repository: those of the last base and the changes after it."""
    wanted = lambda v: upto is None or v <= f"version={upto:010d}"
    base = [v for v in _versions(spark, f"{out}/base") if wanted(v)][-1:]
    changes = [v for v in _versions(spark, f"{out}/changes") if wanted(v) and v > (base or [""])[0]]
    schema = "owner string, name string, findings long, severe long"
    found = spark.createDataFrame([], f"{schema}, version string")
    # At most one base and ``KEEP`` sets of changes.
    for folder, versions in (("base", base), ("changes", changes)):
        for v in versions:
            found = found.unionByName(spark.read.schema(schema).parquet(f"{out}/{folder}/{v}").withColumn("version", F.lit(v)))
    newest = found.groupBy(*REPO).agg(F.max_by(F.struct("findings", "severe"), "version").alias("now"))
    return newest.select(*REPO, "now.findings", "now.severe")
