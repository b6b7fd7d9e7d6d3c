"""Removal of long repeated substrings, at byte level and exact.

A suffix array would be sorted to the depth of ``length`` bytes only: what counts is which starts share
a prefix that long. Suffix order and the comparison of adjacent prefixes are replaced by grouping: nothing is
sorted or ranked; ranges of starts before sampled positions are grouped by hash and refined:

1. Cover. The sample holds the smallest ``length // 4``-gram of each window of ``length`` bytes, so two equal
   windows have a sampled position at the same offset (what residues of a difference cover
   give with seven times as many positions; see the README for the figures).
2. Names. Sampled grams are named by hashes and counted; a position whose name is met once is dropped.
3. Recursion. A node is a position with a range of window starts before it. Its core is what all these
   windows contain, its outer string what they span. An outer string met twice decides all
   its windows; a core met once drops them; else the range is cut in ``FAN`` parts with names of
   their own. Equal outer strings go on as one witness with a weight, so copies do not multiply.
4. Merge. Ranges of one start each are whole windows: a name met twice is a repeat. Decided ranges are
   merged to byte spans of their text.

Names that decide a repeat have 128 bits. Equal texts are one unit with a count, told apart by SHA-256. NULL
texts are empty; texts shorter than ``length`` lose nothing. Ids may be NULL or repeat.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposieve.llm.common import Workspace, fresh, texts

LENGTH = 200
FAN = 6
#: Bytes of a text that are named at once; longer texts go in overlapping blocks.
BLOCK = 1 << 20
_RNG = np.random.default_rng(7)
_BYTES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = [int(b) | 1 for b in _RNG.integers(1 << 60, 1 << 63, 2, dtype=np.uint64)]
_PLACE = np.uint64((BLOCK << 1) - 1)
_EMPTY = hashlib.sha256(b"").hexdigest()


@lru_cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    base = _BASES[which]
    make = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
    return make(base), make(pow(base, -1, 1 << 64))


class Names:
    """Hashes of any substring of a block in constant time, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, hashes: int = 2):
        size = 1 << max(12, len(data).bit_length())
        self.powers = [_powers(k, size) for k in range(hashes)]
        self.sums = [
            np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[k][data] * up[:len(data)])])
            for k, (up, _) in enumerate(self.powers)
        ]

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        h = (self.sums[which][end] - self.sums[which][start]) * self.powers[which][1][start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    pad = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:len(x) - width + 1], ahead[width - 1:len(x)])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and names of the sampled grams of a text."""
    gram, found = length // 4, []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(data) - length + 1), BLOCK):
        part = data[at:at + BLOCK + length - 1]  # all windows that start in the block
        if len(part) < length:
            continue
        start = np.arange(len(part) - gram + 1)
        name = Names(part, 1).of(start, start + gram)
        width = length - gram + 1
        # The low bits hold the place, so the least value says where it stands; of equal grams the first counts.
        least = _least((name & ~_PLACE) | start.astype(np.uint64), width) & _PLACE
        pos = least[np.concatenate([[True], least[1:] != least[:-1]])].astype(np.int64)
        found.append((pos + at, name[pos]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pos, name = (np.concatenate(x) for x in zip(*found))
    pos, first = np.unique(pos, return_index=True)
    return pos, name[first].view(np.int64)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t, length) for t in texts(batch.column(3))]
            offset = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in found])]).astype(np.int32))
            flat = [np.concatenate([x[k] for x in found] or [np.empty(0)]).astype(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.ListArray.from_arrays(offset, pa.array(x)) for x in flat)],
                names=["_id", "sha", "n_bytes", "pos", "name"],
            )

    return run


def parts(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges that each range is cut into, and which range each of them is of."""
    size = hi - lo + 1
    step = -(-size // FAN)
    n = -(-size // step)
    of = np.repeat(np.arange(len(n)), n)
    a = lo[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * step[of]
    return a, np.minimum(a + step[of] - 1, hi[of]), of


def _named_rows(length: int, cut: bool):
    """Core and outer names of the nodes of each text, or of the parts they are cut into; those without a window inside the text go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(8)]
            for unit, text, nodes in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2)):
                data = np.frombuffer(text, np.uint8)
                p, lo, hi, w = map(np.asarray, nodes.values.flatten())
                if cut:
                    lo, hi, of = parts(lo, hi)
                    p, w = p[of], w[of]
                for at in range(0, len(data), BLOCK):
                    here = (p >= at) & (p < at + BLOCK)
                    if not here.any():
                        continue
                    base = max(0, at - length)
                    block = Names(data[base:at + BLOCK + length])
                    q, a, b, n = p[here], lo[here], hi[here], w[here]
                    inside = (q - a >= 0) & (q - b + length <= len(data))
                    q, a, b, n = q[inside], a[inside], b[inside], n[inside]
                    core = block.of(np.maximum(q - a - base, 0), q - b + length - base)
                    whole = (q - b >= 0) & (q - a + length <= len(data))
                    start, end = np.maximum(q - b - base, 0), np.minimum(q - a + length, len(data)) - base
                    outer = [block.of(start, end, k).view(np.int64) for k in (0, 1)]
                    # A string cut off by the text's end equals no other: its position stands for it.
                    outer = [np.where(whole, outer[0], unit), np.where(whole, outer[1], ~q)]
                    for c, x in zip(columns, (np.full(len(q), unit), q, a, b, n, core.view(np.int64), *outer)):
                        c.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in columns],
                names=["unit", "p", "lo", "hi", "w", "core", "o1", "o2"],
            )

    return run


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or adjoining spans."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[first, 0], reach[last]], axis=1)


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    edges = np.concatenate([[0], spans.ravel(), [len(text)]]).tolist()
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(texts(batch.column(1)), batch.column(2)):
            spans = _merged(np.stack([np.asarray(c) for c in found.values.flatten()], axis=1))
            rows.append((int((spans[:, 1] - spans[:, 0]).sum()), len(spans),
                         hashlib.sha256(kept_bytes(text, spans)).hexdigest(), spans.ravel().tolist()))
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["sha", "n_removed", "n_spans", "kept_sha256", "edges"],
        )


class Repeats:
    """Repeats of one table: ``meta`` has a row for each document, ``cut`` one for each text that loses bytes."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH):
        self.work, self.length, self.spark = Workspace(docs.sparkSession, "substrings"), length, docs.sparkSession
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.rows = docs.select(
            F.col(id_col).alias("_id"), F.sha2(text.cast("binary"), 256).alias("sha"),
            F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"),
        )
        self.table = f"substrings_{uuid.uuid4().hex}"
        try:
            self._find()
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _find(self) -> None:
        work, length = self.work, self.length
        schema = "_id {}, sha string, n_bytes long, pos array<long>, name array<long>".format(self.rows.schema["_id"].dataType.simpleString())
        found = work.land(self.rows.mapInArrow(_anchor_rows(length), schema), "anchors")
        self.meta = work.land(found.select("_id", "sha", "n_bytes"), "meta")
        units = work.land(
            found.filter(F.col("n_bytes") >= length).groupBy("sha").agg(
                F.count(F.lit(1)).alias("w"), F.min("_id").alias("least"), F.first("pos").alias("pos"), F.first("name").alias("name"),
            ).withColumn("unit", F.monotonically_increasing_id()), "units",
        )
        work.drop("anchors")
        names = units.select("unit", "w", F.explode(F.arrays_zip("pos", "name")).alias("a")).select("unit", "w", "a.pos", "a.name")
        # Landed, so that both sides of the join are plain exchanges and a frequent name can be split.
        twice = work.land(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"), "twice")
        nodes = work.land(
            names.join(twice, "name", "left_semi")
            .select("unit", F.col("pos").alias("p"), F.lit(0).cast("long").alias("lo"),
                    F.lit(length - length // 4).cast("long").alias("hi"), "w"), "nodes0",
        )
        # Texts with sampled names met twice, bucketed: no later step shuffles them.
        wanted = units.join(nodes.select("unit").distinct(), "unit", "left_semi").select("sha", F.col("least").alias("_id"), "unit")
        picked = self.rows.select("sha", "_id", "_text").join(
            wanted.withColumnRenamed("sha", "_sha").withColumnRenamed("_id", "_least"),
            (F.col("sha") == F.col("_sha")) & F.col("_id").eqNullSafe(F.col("_least")),
        ).select("unit", "sha", "_id", "_text").groupBy("unit", "sha").agg(F.first("_text").alias("_text"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        picked.repartition(n, "unit").write.bucketBy(n, "unit").format("parquet").option("path", f"{work.base}/held").saveAsTable(self.table)
        held = self.spark.table(self.table)
        spans, size, k = None, length - length // 4 + 1, 0
        while True:
            # Nodes are cut only where their texts are, so a node is shuffled once and not once for each part.
            of_unit = nodes.groupBy("unit").agg(F.collect_list(F.struct("p", "lo", "hi", "w")).alias("nodes"))
            named = work.land(
                held.select("unit", "_text").join(of_unit, "unit").select("unit", "_text", "nodes").mapInArrow(
                    _named_rows(length, k > 0), "unit long, p long, lo long, hi long, w long, core long, o1 long, o2 long"), f"named{k}",
            )
            work.drop(f"nodes{k}")
            strings = work.land(
                # Any of the equal strings stands for all; columns of their own keep the aggregate a hashed one.
                named.groupBy("lo", "core", "o1", "o2").agg(F.sum("w").alias("w"), *(F.first(c).alias(c) for c in ("unit", "p", "hi"))),
                f"strings{k}",
            )
            single = strings.filter("w = 1").select("unit", "p", "lo")
            again = named.join(single, ["unit", "p", "lo"], "left_anti")
            part = work.land(again.select(
                "unit", (F.col("p") - F.col("hi")).alias("a"), (F.col("p") - F.col("lo") + length).alias("b")), f"spans{k}")
            work.drop(f"named{k}")
            spans = part if spans is None else spans.unionByName(part)
            if size == 1:
                break
            wide = strings.filter("lo < hi")
            mixed = wide.groupBy("lo", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("lo", "core")
            mixed = work.land(mixed, f"mixed{k}")
            nodes = work.land(wide.join(mixed, ["lo", "core"], "left_semi").select("unit", "p", "lo", "hi", "w"), f"nodes{k + 1}")
            work.drop(f"strings{k}", f"mixed{k}")
            size, k = -(-size // FAN), k + 1
        of_unit = spans.groupBy("unit").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
        self.cut = work.land(
            held.join(of_unit, "unit").select("sha", "_text", "spans").mapInArrow(
                _cut_rows, "sha string, n_removed long, n_spans long, kept_sha256 string, edges array<long>"), "cut",
        )
        self.copies = work.land(units.filter("w > 1").select("sha"), "copies")
        work.drop("units", "twice", f"strings{k}", *(f"spans{i}" for i in range(k + 1)))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    found = Repeats(docs, id_col, text_col, length)
    some = found.cut.drop("edges").join(found.copies, "sha", "left_anti")
    copy = F.col("_copy").isNotNull()
    rows = found.meta.join(some, "sha", "left").join(found.copies.withColumn("_copy", F.lit(1)), "sha", "left")
    return rows.select(
        F.col("_id").alias(id_col), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeats cut out of the text; a document of which nothing is left goes.

    A character of which a byte is cut goes whole.
    """
    found = Repeats(docs, id_col, text_col, length)
    own, other, spans = fresh(docs, "_sha", "_cut_sha", "_edges")
    cut = found.cut.select(F.col("sha").alias(other), F.col("edges").alias(spans)).join(
        found.copies.withColumnRenamed("sha", other), other, "left_anti"
    )
    whole = F.array(F.lit(0).cast("long"), F.lit(-1).cast("long"))
    cut = cut.unionByName(found.copies.select(F.col("sha").alias(other), whole.alias(spans)))
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, edges in zip(texts(batch.column(at)), batch.column(len(names)).to_pylist()):
                if edges and text is not None:
                    spans = np.array([len(text) if e < 0 else e for e in edges]).reshape(-1, 2)
                    text = kept_bytes(text, spans).decode("utf-8", "ignore").encode()
                out.append((text, bool(edges) and not text))
            kept = pa.array([t for t, _ in out], pa.binary()).cast(batch.column(at).type)
            whole = pa.RecordBatch.from_arrays([kept if i == at else c for i, c in enumerate(batch.columns[:-1])], names=names)
            yield whole.filter(pa.array([not gone for _, gone in out], pa.bool_()))

    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    joined = docs.withColumn(own, sha).join(cut, F.col(own) == F.col(other), "left").select(*names, spans)
    return joined.mapInArrow(run, docs.schema)
