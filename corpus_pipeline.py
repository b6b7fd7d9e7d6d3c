"""The cleaning pipeline over ``documents``: each stage reads what its predecessor kept.

Empty tables pass through all stages; NULL texts are neither toxic, nor contaminated, nor cut, form one group of
near-duplicates and are never taken by the mix. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposieve.llm import decontam, mixing, resemblance, substrings, toxicity
from reposieve.llm.common import Workspace, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression calls toxic go."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word similarity of 0.8 or more stays: the one with the smallest id."""
    return resemblance.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur elsewhere are cut from the texts; texts of nothing else go."""
    kind = docs.schema["n_chars"].dataType
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast(kind))


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to one edit in ten characters, go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with the words ``taken`` of each, repeats counted."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", contaminated),
    ("mixing", mixed),
]

#: SQL can't express the trained model of the first stage; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    work, docs, last = Workspace(spark, "pipeline"), read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = work.land(stage(spark, docs, sf_dir), name)
        if last:
            work.drop(last)
        last = name
    return docs
