"""Session defaults and reliable materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import warnings

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "reposieve", **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # A scan is thousands of column calls: recording each call site doubles planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for data that must outlive an executor: the one ``spark.checkpoint.dir`` names.

    Only a local master may fall back to a temporary folder: on a cluster it would not
    be shared. It says so, and the folder goes when the process ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.getCheckpointDir() is not None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="reposieve-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        warnings.warn(f"spark.checkpoint.dir is not set: intermediate data go to {named} until this process ends", stacklevel=2)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors do not lose it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input of fewer splits than cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
