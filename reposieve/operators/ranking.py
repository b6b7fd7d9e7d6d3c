"""Ranks and offsets over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposieve.session import reliable

_LOW = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add a 1-based row number in a total order.

    The sort is range-partitioned. Its result is materialised once, so that partition
    sizes and positions agree, and each position is shifted by the sizes before it:
    only one row per partition meets in one task.
    """
    placed = reliable(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    # One row per sort partition: bounded by spark.sql.shuffle.partitions.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_id").bitwiseAND(_LOW) + F.col("_before") + 1)
        .drop("_id", "_part", "_before")
    )


def skip_first(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Everything after the first ``n`` rows of a total order."""
    if n <= 0:
        return df
    return number_rows(df, order, "_rank").filter(F.col("_rank") > n).drop("_rank")
