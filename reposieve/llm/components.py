"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposieve.llm.common import Workspace


def _state(links: DataFrame) -> tuple:
    # xxhash64 summed as decimals: equal sums mean that the set of links did not change.
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(work: Workspace, links: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of ``links(u, v)`` that is not its own root.

    ``root`` is the smallest vertex reachable. Alternates two steps until the links are
    stars: the large step hangs the larger neighbours of a vertex on the smallest one of its
    neighbourhood, the small step does so with the smaller ones. Minima are partial aggregates,
    so a vertex with very many links is combined before the shuffle.
    """
    now = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = work.land(now, "links0")
    state, k = _state(now), 0
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        k += 1
        now = work.land(now, f"links{k}")
        work.drop(f"links{k - 1}")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
