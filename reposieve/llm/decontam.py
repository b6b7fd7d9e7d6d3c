"""Benchmark decontamination: documents that hold a benchmark item with few edits.

A document holds an item of ``m`` characters if a substring is within ``e = rate * m`` edits of it. By the q-gram
lemma such a substring shares ``m + 1 - q - q * e`` q-grams with the item, all on diagonals (offset in the
text minus offset in the item) within ``e`` of each other. Shared q-grams are counted in diagonal bands that
overlap by ``e``, so one band sees them all; bands that meet the count are verified by banded alignment.
Nothing is missed within the edit budget and nothing beyond it is reported.

Letters are lower-cased and runs of white space count as one space. Items shorter than ``q`` never match; short
items get the budget for which the lemma still counts a q-gram. NULL texts hold nothing. Repeated ids get
the matches of each row; items with equal ids or texts are reported each.

The q-grams of the items go to every task. ``PART`` characters of items are indexed at a time; a larger
benchmark takes a pass for each part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposieve.llm.common import texts

Q, RATE = 8, 0.1
#: Characters of benchmark items indexed for one pass: about 100 MB of index in a task.
PART = 4_000_000
#: Characters of a text searched at once; longer texts go in overlapping blocks.
BLOCK = 1 << 20
_BLANK = re.compile(r"\s+")
_BASE, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 22


def normal(text: bytes | None) -> np.ndarray:
    """Code points of a text in lower case, white space as single spaces."""
    plain = _BLANK.sub(" ", (text or b"").decode("utf-8", "replace").lower()).strip()
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * _BASE + codes[k:k + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Index:
    """Sorted q-grams of benchmark items with where they stand."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, rate: float = RATE):
        kept = [(i, c) for i, c in ((i, normal(t)) for i, t in items) if len(c) >= q]
        self.q, self.ids, self.codes = q, [i for i, _ in kept], [c for _, c in kept]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.minimum((rate * size).astype(np.int64), (size - q) // q)
        self.need = size + 1 - q - q * self.edits
        self.step = np.maximum(self.edits, 4)  # bands start every so many diagonals
        all_grams = [grams(c, q) for c in self.codes]
        flat = np.concatenate(all_grams) if kept else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), [len(g) for g in all_grams])
        at = np.concatenate([np.arange(len(g)) for g in all_grams]) if kept else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first = np.concatenate([first, [len(flat)]])
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[self.keys >> np.uint64(64 - _SLOTS)] = True
        self.reach = int((size + 4 * self.step).max(initial=0))

    def bands(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(item, first diagonal)`` of the bands with enough shared q-grams."""
        h = grams(codes, self.q)
        pos = np.flatnonzero(self.slots[h >> np.uint64(64 - _SLOTS)])
        place = np.searchsorted(self.keys, h[pos])
        known = place < len(self.keys)
        pos, place = pos[known], place[known]
        same = self.keys[place] == h[pos]
        pos, place = pos[same], place[same]
        if not len(pos):
            return
        n = self.first[place + 1] - self.first[place]
        posting = np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[posting]
        diagonal = np.repeat(pos, n) - self.at[posting]
        band, off = np.divmod(diagonal, self.step[item])
        # A band has ``step + edits`` diagonals; the first ``edits`` ones lie in the band before, too.
        before = off < self.edits[item]
        item, band = np.concatenate([item, item[before]]), np.concatenate([band, band[before] - 1])
        least = int(band.min())
        key, count = np.unique(item * np.int64(1 << 40) + (band - least), return_counts=True)
        for k in key[count >= self.need[key >> 40]].tolist():
            yield k >> 40, (k & ((1 << 40) - 1)) + least

    def matches(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """``(item id, edits, end)`` for each item within its edit budget: the best place of each."""
        whole, best = normal(text), {}
        for start in range(0, max(1, len(whole)), BLOCK):
            codes = whole[start:start + BLOCK + self.reach]
            for item, band in self.bands(codes):
                step, e = int(self.step[item]), int(self.edits[item])
                edits, end = align(self.codes[item], codes, band * step - e, band * step + step + 2 * e, e)
                if edits <= e and (item not in best or (edits, start + end) < best[item]):
                    best[item] = (edits, start + end)
        return sorted((self.ids[i], *found) for i, found in best.items())


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """Least edits between the item and a substring on the diagonals ``low`` to ``high``; where it ends."""
    wide = high - low + 1
    step = np.arange(wide)
    row = np.zeros(wide, np.int64)
    row[(low + step < 0) | (low + step > len(text))] = most + 1
    padded = np.full(wide, -1, np.int64)
    for i, c in enumerate(item.tolist()):
        at = i + low
        padded[:] = -1
        a, b = max(at, 0), min(at + wide, len(text))
        if a < b:
            padded[a - at:b - at] = text[a:b]
        new = row + np.where(padded == c, 0, np.where(padded < 0, most + 1, 1))
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
        if row.min() > most:
            return most + 1, 0
    ends = len(item) + low + step
    row = np.where((ends < 0) | (ends > len(text)), most + 1, row)
    k = int(row.argmin())
    return int(row[k]), int(ends[k])


def parts(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in lists of about ``PART`` characters, one after the other."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // PART))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, bytes(r.text)) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, item_id, edits, end_char)``: a row for each item that a document holds."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    item = benchmark.select("item_id").schema[0].dataType.simpleString()
    found = None
    for part in parts(benchmark):
        index = Index(part)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(k, *m) for k, t in enumerate(texts(batch.column(1))) for m in index.matches(t)]
                of, items, edits, end = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of, pa.int64())), pa.array(items, pa.int64()),
                     pa.array(edits, pa.int32()), pa.array(end, pa.int64())],
                    names=[id_col, "item_id", "edits", "end_char"],
                )

        rows = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, item_id long, edits int, end_char long")
        found = rows if found is None else found.unionByName(rows)
    return found.withColumn("item_id", F.col("item_id").cast(item))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item."""
    at = docs.columns.index(text_col)
    for part in parts(benchmark):
        index = Index(part)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t) for t in texts(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
