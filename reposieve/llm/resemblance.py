"""Near-copies by SimHash of word shingles, every link verified by their exact Jaccard similarity.

1. Each text has a 64-bit fingerprint of its five-word shingles. Fingerprints that differ in ``DISTANCE`` bits at most meet in
   buckets on pairs of ``DISTANCE + 2`` blocks (``simhash.links``). The pairs found there are verified on the whole
   sets and contracted to components. Texts of one fingerprint are compared with one of them.
2. Pairs at 0.8 differ in about ten bits, which blocks of 64 bits do not reach, so an exact search follows for what the
   fingerprints left apart. Texts that may have a partner come from minhashes: they share a bucket if the ``ROWS`` minhashes of one of ``BANDS`` bands
   agree. A pair of similarity ``s`` does with probability ``1 - (1 - s**ROWS)**BANDS``, whatever the length of
   the texts: all but 6 in a million pairs at 0.8, and fewer above.
3. Among these texts the search is exact. Their shingles are ordered by how many of the texts have them, and each text is posted
   under the rarest fifth of its own: texts at 0.8 share one of these (prefix filter). At a shared shingle the ranks bound
   how many can follow in common (positional filter). So texts that share a long common passage but not enough do not
   meet, and texts of which more than a fifth is their own are not posted at all.
4. Of each posting list the text that is most typical of it is the pivot; all others outside its component are compared with it, in
   proportion to the list. What is linked by then counts as one. Lists that still hold several components are joined with
   themselves, only those outside the pivot's component with the rest, and only where the ranks allow a link.

Every link is decided on the whole sets of shingles. Texts with equal sets are one unit. Texts below ``words`` words are
one shingle; NULL, empty and white space have none and are one unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reposieve.llm import simhash
from reposieve.llm.common import LOWER, Workspace, one_of_group, per_row, texts
from reposieve.llm.components import components

WORDS = 5
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
#: Bits in which linked fingerprints may differ; wider pairs come from the search that follows.
DISTANCE = 7
BANDS, ROWS = 40, 6
_CHUNK = 1 << 10
_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included."""
    import xxhash

    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start, n = end - size, max(1, len(tokens) - words + 1)
    spans = zip(start[:n].tolist(), end[-n:].tolist())
    return np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, n)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    return np.unique(hashes(text, words))


def bands(found: np.ndarray) -> list[int]:
    """Bucket of each band, for the set of shingles of one text."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), _CHUNK):
        least = np.minimum(least, ((found[k:k + _CHUNK] ^ _XOR) * _TIMES).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key + column + np.uint64(1)) * _BASE
        key ^= key >> np.uint64(29)
    return key.view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _verify(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            yes = []
            for u, a, b in zip(batch.column(0).to_pylist(), texts(batch.column(2)), texts(batch.column(3))):
                if u != last:
                    last, own = u, shingles(a, words)
                yes.append(alike(own, shingles(b, words)))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["u", "v"]).filter(pa.array(yes, pa.bool_()))

    return run


def _shingle_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words).view(np.int64) for t in texts(batch.column(1))]
            n = np.array([len(f) for f in found], np.int64)
            columns = [np.repeat(np.asarray(batch.column(0)), n), np.repeat(n, n), np.concatenate([np.empty(0, np.int64), *found])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["unit", "n", "shingle"])

    return run


def postings(work: Workspace, held: DataFrame, words: int) -> DataFrame:
    """``(shingle, unit, n, r)``: the units that can have a link under their rarest shingles, of rank ``r`` from 0."""
    rows = work.land(held.select("unit", "_text").mapInArrow(_shingle_rows(words), "unit long, n long, shingle long"), "shingles")
    # Landed, so that both sides of the join are plain exchanges and a frequent shingle can be split.
    common = work.land(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "common")
    one = Window.partitionBy("unit")
    ranked = rows.join(common, "shingle").select(
        "shingle", "unit", "n", F.count(F.lit(1)).over(one).alias("shared"),
        F.row_number().over(one.orderBy("df", "shingle")).alias("k"),
    )
    a, b = LEAST
    least = F.ceil(F.col("n") * a / b)  # shingles that a partner must have
    rank = F.col("n") - F.col("shared") + F.col("k") - 1  # those of no other unit are the rarest
    found = ranked.filter(F.col("shared") >= least).withColumn("r", rank).filter(F.col("r") <= F.col("n") - least)
    found = work.land(found.select("shingle", "unit", "n", "r"), "postings")
    work.drop("shingles", "common")
    return found


def _may_link(n: str, r: str, other_n: str, other_r: str) -> Column:
    """Two units that meet at ranks of theirs can have enough in common."""
    (a, b), c = LEAST, F.col
    need = F.ceil((c(n) + c(other_n)) * a / (a + b))
    return (F.least(n, other_n) * b >= F.greatest(n, other_n) * a) & (need <= F.least(c(n) - c(r), c(other_n) - c(other_r)))


def _verified(work: Workspace, pairs: DataFrame, held: DataFrame, words: int, step: str) -> DataFrame:
    """The pairs ``(u, v)`` whose similarity is large enough."""
    pairs = work.land(pairs.select(F.least("unit", "other").alias("u"), F.greatest("unit", "other").alias("v")).distinct(), f"pairs_{step}")
    with_u = pairs.join(held.select(F.col("unit").alias("u"), F.col("_text").alias("a")), "u")
    both = with_u.join(held.select(F.col("unit").alias("v"), F.col("_text").alias("b")), "v").select("u", "v", "a", "b")
    return work.land(both.mapInArrow(_verify(words), "u long, v long"), f"found_{step}")


def fingerprint_pairs(work: Workspace, units: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(unit, other)``: pairs to verify, of fingerprints within the distance; enough to connect all of them."""
    some = units.filter("n > 0").select("unit", "fp")
    firsts = work.land(some.groupBy("fp").agg(F.min("unit").alias("first")), "firsts")
    near = work.land(simhash.links(work, firsts, distance), "near")
    u, v = (firsts.select(F.col("fp").alias(x), F.col("first").alias(name)) for x, name in (("u", "unit"), ("v", "other")))
    pairs = near.join(u, "u").join(v, "v").select("unit", "other")
    same = some.join(firsts, "fp").filter("unit <> first").select("unit", F.col("first").alias("other"))
    return work.land(pairs.unionByName(same), "by_fingerprint")


def _rooted(df: DataFrame, roots: DataFrame, unit: str, root: str) -> DataFrame:
    """``df`` with the root of the component that ``unit`` is in."""
    named = roots.select(F.col("v").alias(unit), F.col("root").alias("_root"))
    return df.join(named, unit, "left").withColumn(root, F.coalesce("_root", unit)).drop("_root")


def links(work: Workspace, units: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(v, root)`` of the units that are linked to a smaller one; ``docs`` has ``text_hash`` and ``_text``."""
    close = fingerprint_pairs(work, units)
    rows = units.select(F.explode("keys").alias("key"), "unit")
    twice = work.land(rows.groupBy("key").agg(F.count(F.lit(1)).alias("of")).filter("of > 1").select("key"), "twice")
    some = rows.join(twice, "key", "left_semi").select("unit")
    some = some.unionByName(close.select("unit")).unionByName(close.select(F.col("other").alias("unit"))).distinct()
    wanted = work.land(units.join(some, "unit", "left_semi").select("unit", "text_hash"), "wanted")
    held = work.land(docs.join(wanted, "text_hash").groupBy("unit").agg(F.first("_text").alias("_text")), "held")
    first = work.land(components(work, _verified(work, close, held, words, "fingerprints")), "first_roots")
    posted = postings(work, held, words)
    # The most typical unit of a list has the fewest shingles that are rarer than this one.
    pivots = work.land(
        posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("of"), F.min(F.struct(F.col("r") / F.col("n"), "unit", "n", "r")).alias("p"))
        .filter("of > 1").select("shingle", F.col("p.unit").alias("other"), F.col("p.n").alias("other_n"), F.col("p.r").alias("other_r")),
        "pivots",
    )
    met = posted.join(pivots, "shingle").filter((F.col("unit") != F.col("other")) & _may_link("n", "r", "other_n", "other_r"))
    met = _rooted(_rooted(met.select("unit", "other").distinct(), first, "unit", "a"), first, "other", "b").filter("a <> b")
    found = _verified(work, met, held, words, "pivots")
    roots = work.land(components(work, found.unionByName(first.select(F.col("v").alias("u"), F.col("root").alias("v")))), "roots")
    named = work.land(_rooted(posted, roots, "unit", "root"), "named")
    mains = _rooted(pivots.select("shingle", F.col("other").alias("unit")), roots, "unit", "main").select("shingle", "main")
    # What the pivot has not been linked with, in lists that have such.
    apart = work.land(named.join(mains, "shingle").filter(F.col("root") != F.col("main")).drop("main"), "apart")
    if not apart.isEmpty():
        left = apart.select("shingle", *(F.col(c).alias(f"other{x}") for c, x in (("unit", ""), ("n", "_n"), ("r", "_r"), ("root", "_root"))))
        met = named.join(left, "shingle").filter((F.col("root") != F.col("other_root")) & _may_link("n", "r", "other_n", "other_r"))
        more = _verified(work, met, held, words, "rest")
        # Only links between components are new: their roots are the vertices.
        for end in ("u", "v"):
            more = more.join(roots.select(F.col("v").alias(end), F.col("root").alias(f"{end}r")), end, "left").withColumn(
                end, F.coalesce(f"{end}r", end)).drop(f"{end}r")
        higher = work.land(components(work, more), "higher").select(F.col("v").alias("root"), F.col("root").alias("top"))
        lower = roots.join(higher, "root", "left").select("v", F.coalesce("top", "root").alias("root"))
        roots = work.land(lower.unionByName(higher.select(F.col("root").alias("v"), F.col("top").alias("root"))), "all_roots")
    work.drop("firsts", "near", "by_fingerprint", "first_roots", "twice", "wanted", "held", "postings", "pivots", "named", "apart")
    return roots


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(_id, text_hash, root)`` of every row; rows with the same root are connected by links."""
    work = Workspace(docs.sparkSession, "resemblance")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))

    def of(text):
        import xxhash

        every = hashes(text, words)
        found = np.unique(every)
        unit = int.from_bytes(xxhash.xxh64_digest(found.tobytes()), "big", signed=True)
        return unit, len(found), simhash.majority(every), bands(found)

    prints = work.land(per_row(rows, ["_id", "text_hash"], "_text", of, "unit long, n long, fp long, keys array<long>"), "prints")
    # Equal sets may have other repeats, so other fingerprints: any of them will do, the smallest is the same in each run.
    units = work.land(prints.groupBy("unit").agg(
        F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "units")
    roots = links(work, units, rows.select("text_hash", "_text"), words)
    named = work.land(units.select("unit").join(roots.withColumnRenamed("v", "unit"), "unit", "left").select(
        "unit", F.coalesce("root", "unit").alias("root")), "named")
    work.drop("units")
    return prints.select("_id", "text_hash", "unit").join(named, "unit").select("_id", "text_hash", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The document with the smallest id of every group; rows that repeat id and text are one document."""
    return one_of_group(docs, groups(docs, id_col, text_col, words), id_col, text_col)
