"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are range-sorted by source and key, prefix sums
of token counts are taken per range partition and shifted by the sums of the partitions before,
and every source is cut where its budget is spent. A budget above the source's size repeats
the source in whole epochs first.

NULL and blank texts have size 0 and are never taken; NULL is a source of its own, the last one.
Rows that repeat an id are documents of their own. A mix of no tokens takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposieve.llm.common import Workspace, fresh
from reposieve.operators.ranking import number_rows

EPOCHS = 3
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Runs of other than ASCII white space, without building an array of them."""
    bare = F.ltrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.length(F.regexp_replace(bare, f"{_WORD}++{_SPACE}*+", "x")), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """60 random bits that any engine with MD5 can compute."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Add ``target``: shares by weight of all tokens, at most ``epochs`` times the source's size.

    What the limit cuts off is shared again by weight. Each round is one aggregate of the table
    of sources; the limited sources only grow in number, so it ends.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = sources.withColumn("_w", w).withColumn("_most", F.col("source_size") * epochs)
    total, parts = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    left, n = total, 0
    while parts:
        # A number that fits 32 bits would be an int, and int times int an error from 2^31 on.
        full = F.lit(left).cast("long") * F.col("_w") / F.lit(parts) >= F.col("_most")
        limited, spent, weight = table.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0)),
        ).first()
        if limited == n:
            break
        left, parts, n = total - spent, weight, limited
    share = F.lit(float(left)) * F.col("_w") / F.lit(parts) if parts else F.col("_most")
    return table.withColumn("target", F.least(F.col("_most").cast("double"), share.cast("double"))).drop("_w", "_most")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, seed: str = "mix", row_col: str | None = None,
) -> DataFrame:
    """``(id, size, source_size, target, taken)`` of every row; ``taken`` counts repeats.

    ``row_col`` is a column that is returned besides.
    """
    work = Workspace(docs.sparkSession, "mixing")
    sized = work.land(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("size"),
        random_key(F.col(id_col), seed).alias("_key"), F.xxhash64(text_col).alias("_hash"),
        F.monotonically_increasing_id().alias("_at"), *([F.col(row_col).alias("_row")] if row_col else []),
    ), "sized")
    sizes = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sizes, [F.col("_source").asc_nulls_last()], "_rank")
    sources = work.land(targets(ranked, weights, epochs), "sources")
    named = sources.withColumnRenamed("_source", "_name")
    placed = sized.join(named, sized["_source"].eqNullSafe(named["_name"])).drop("_name", "_source")
    # The last two spread rows that repeat an id over partitions.
    order = ["_key", "_id", "size", "_hash", "_at"]
    placed = work.land(
        placed.repartitionByRange("_rank", *order).sortWithinPartitions("_rank", *order)
        .withColumn("_part", F.spark_partition_id()), "placed",
    )
    earlier = Window.partitionBy("_rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_rank", "_part").agg(F.sum("size").alias("_n")).select(
        "_rank", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_rank", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor(F.col("target") + 1e-6)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("_before")
    return (
        placed.withColumn("_before", before).join(offsets, ["_rank", "_part"])
        .withColumn("_before", F.col("_before") + F.col("_offset"))
        .select(
            F.col("_id").alias(id_col), "size", "source_size", "target",
            (whole * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))).cast("long").alias("taken"),
            *([F.col("_row").alias(row_col)] if row_col else []),
        )
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that the mix takes, with the tokens taken of each as ``taken``, in place of a column of that name."""
    docs = docs.drop("taken")
    (row,) = fresh(docs, "_mix_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    rows = Workspace(docs.sparkSession, "mixed").land(numbered, "rows")  # the numbers stay what they are
    part = mix(rows, id_col, row_col=row, **how).filter("taken > 0").select(row, "taken")
    return rows.join(part, row).drop(row)


#: The same mix for ``documents`` in SQL.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, 1 + (r - 1) % 3 AS w, sum(n) OVER () AS total FROM s),
p AS (SELECT *, sum(3 * n) OVER o - 3 * n AS spent, sum(w) OVER () - (sum(w) OVER o - w) AS parts FROM w
      WINDOW o AS (ORDER BY 3 * n / w, r ROWS UNBOUNDED PRECEDING)),
l AS (SELECT (total - spent)::DOUBLE AS lft, parts FROM p WHERE (total - spent) * w / parts <= 3 * n
      ORDER BY 3 * n / w, r LIMIT 1),
t AS (SELECT source, n, least((3 * n)::DOUBLE, coalesce((SELECT lft FROM l) * w / (SELECT parts FROM l), 3 * n)) AS target FROM w),
b AS (SELECT source, n, target, floor(target + 1e-6)::BIGINT AS budget,
             CASE WHEN n > 0 THEN floor(target + 1e-6)::BIGINT // n ELSE 0 END AS whole FROM t),
q AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, n AS source_size, target,
       (whole * size + greatest(0, least(budget - whole * n - before, size)))::BIGINT AS taken
FROM q JOIN b ON q.source IS NOT DISTINCT FROM b.source
"""
