"""Approximate nearest neighbours by a permutation index.

A vector is represented by the ordered list of its nearest pivots. The lists are posted in one inverted
file per pivot; a query ranks what its own nearest pivots post by the footrule distance of the
two orders, and the best share is ranked again by the true inner product in double precision.

Inner products grow with length, which an order of pivots does not show. So indexed vectors and pivots get one more
component that makes all as long as the longest, and queries get a zero there: inner products with queries stay what
they are, and the nearest by distance are those with the largest inner product.

Pivots are a sample of ``PIVOTS`` vectors; every vector is indexed. Queries meet all vectors in blocks: an index
block holds about ``BLOCK`` vectors, and each block of queries visits each index block. Per query a block gives
back the best ``k + 1``, so what is merged does not grow with the block.

Equal vectors are one entry with its ``k + 1`` smallest ids: as ties go to the smaller id, no other copy can
be among the nearest ``k`` of any query. Vectors that are NULL, empty, zero or hold NULL or non-finite
components take no part, nor do NULL ids and vectors of another size than most. Rows with equal id and
vector count once. Fewer than ``k`` candidates are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposieve.llm.common import Workspace

PIVOTS = 256
#: Nearest pivots under which a vector is posted, and those a query looks up.
POSTED, LOOKED_UP = 128, 64
#: Share of an index block that is ranked again, and the least number.
SHARE, LEAST = 0.08, 1500
BLOCK, QUERIES = 32_768, 2_048


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def lift(v: np.ndarray, longest: float) -> np.ndarray:
    """The component that makes vectors as long as the longest; ``longest`` is its square."""
    return np.sqrt(np.maximum(0.0, longest - (v * v).sum(axis=1)))


def orders(pivots: np.ndarray, n: int, longest: float | None):
    """Adds the numbers of the ``n`` nearest pivots, nearest first; for queries ``longest`` is None."""
    lifted = None if longest is None else lift(pivots, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            close = v @ pivots.T if lifted is None or not len(v) else v @ pivots.T + np.outer(lift(v, longest), lifted)
            near = np.argsort(-close, axis=1, kind="stable")[:, :n].astype(np.int16)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["cls", "v", "near"])

    return run


class Block:
    """Inverted files of the vectors of one block."""

    def __init__(self, near: np.ndarray, pivots: int):
        self.size, self.posted = near.shape
        order = np.argsort(near.ravel(), kind="stable")
        self.entry, self.rank = (order // self.posted).astype(np.int32), (order % self.posted).astype(np.int32)
        self.first = np.searchsorted(near.ravel()[order], np.arange(pivots + 1))

    def footrule(self, near: np.ndarray) -> np.ndarray:
        """Distance of each vector's order to a query's; an absent pivot counts as rank ``posted``."""
        rank = np.arange(len(near), dtype=np.int32)
        far = np.full(self.size, int(np.abs(self.posted - rank).sum()), np.int32)
        for r, p in zip(rank, near):
            a, b = self.first[p], self.first[p + 1]
            far[self.entry[a:b]] += np.abs(self.rank[a:b] - r) - (self.posted - r)
        return far


def _search(k: int, pivots: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        empty = {"q": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not vectors.num_rows or not queries.num_rows:
            return pa.table(empty)
        vectors, queries = vectors.combine_chunks(), queries.combine_chunks()
        cls = np.asarray(vectors["cls"])
        v = matrix(vectors["v"].combine_chunks())
        index = Block(np.asarray(vectors["near"].combine_chunks().flatten()).reshape(len(cls), -1), pivots)
        n = min(len(cls), max(LEAST, int(SHARE * len(cls))))
        near = np.asarray(queries["near"].combine_chunks().flatten()).reshape(queries.num_rows, -1)
        found = []
        for q, w, order in zip(np.asarray(queries["cls"]), matrix(queries["v"].combine_chunks()), near):
            some = np.argpartition(index.footrule(order[:LOOKED_UP]), n - 1)[:n]
            score = (v[some] * w).sum(axis=1)  # one order of summation, whatever the block
            best = np.lexsort((cls[some], -score))[:k + 1]
            found.append((np.full(len(best), q), cls[some][best], score[best]))
        q, c, s = (np.concatenate(x) for x in zip(*found))
        return pa.table({"q": q, "cls": c, "score": s})

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every query row."""
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "ann")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = work.land(rows.filter(F.size("v") == sizes.d), "rows")
    first = Window.partitionBy("v").orderBy("id")
    few = rows.groupBy("v", "id").agg(F.lit(1)).select("v", "id", F.row_number().over(first).alias("n")).filter(F.col("n") <= k + 1)
    entries = work.land(
        few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "v", "ids"), "entries"
    )
    # The bounded sample that fits the index.
    sample = entries.orderBy(F.xxhash64("cls"), "cls").limit(PIVOTS).select("v").collect()
    pivots = np.array([r.v for r in sample])
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n_entries, longest = entries.agg(F.count(F.lit(1)), F.max(square)).first()
    blocks = max(1, -(-n_entries // BLOCK))
    n_near, schema = min(POSTED, len(pivots)), "cls long, v array<double>, near array<short>"
    indexed = work.land(entries.select("cls", "v").mapInArrow(orders(pivots, n_near, longest), schema), "indexed")
    asking = rows.filter("asks").select("id", "v").join(entries.select("cls", F.col("v").alias("u")), F.col("v") == F.col("u")).select("id", "cls")
    asking = work.land(asking, "asking")
    asked = entries.select("cls", "v").join(asking.select("cls").distinct(), "cls", "left_semi")
    asked = work.land(asked.mapInArrow(orders(pivots, n_near, None), schema), "asked")
    parts = max(1, -(-asking.select("cls").distinct().count() // QUERIES))
    vector_blocks = indexed.select("*", F.pmod(F.xxhash64(F.lit("block"), "cls"), F.lit(blocks)).cast("int").alias("b")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("a"))
    query_blocks = asked.select("*", F.pmod(F.xxhash64(F.lit("query"), "cls"), F.lit(parts)).cast("int").alias("a")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    met = vector_blocks.groupBy("a", "b").cogroup(query_blocks.groupBy("a", "b")).applyInArrow(
        _search(k, len(pivots)), "q long, cls long, score double"
    )
    met = work.land(met, "met")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    top = met.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    # k + 1 entries with up to k + 1 copies each: a bounded list for each different query vector.
    listed = top.join(entries.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("id"))
    lists = work.land(listed.groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("id").alias("vec_id")))).alias("found")), "lists")
    answers = asking.join(lists, asking["cls"] == lists["q"]).select(
        F.col("id").alias("query_id"),
        F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)).alias("pos", "one"),
    )
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.far")).alias("score"))
