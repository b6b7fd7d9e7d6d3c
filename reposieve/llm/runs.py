"""Runs of repeated words: stretches with a small period, found exactly in whole texts.

A run is a stretch of words with smallest period ``q`` and at least ``LEAST`` words and ``TIMES`` periods that no
neighbouring word extends. Words are numbered; texts of a batch stand one after the other with a separate number
between each two, so one structure serves them all and no match crosses a text.

1. Cover. Positions whose residue modulo ``MODULUS`` is in a difference cover are sampled: for any two positions there is a
   shift below the modulus that takes both to sampled ones.
2. Order. Only sampled suffixes are sorted: by their first ``MODULUS`` words, then by doubling. The order gives the
   common prefixes of neighbours, and these a sparse table of range minima.
3. Extensions. The longest common extension of two positions compares words up to the synchronising shift and
   takes the rest from the table. The same on reversed texts gives extensions to the left.
4. Grid. A run of period ``q`` holds two grid points ``q`` apart on a grid of step ``(TIMES - 1) * q``; extensions of each such pair in
   both directions give the run. The pairs of all periods are harmonically many. Of equal
   stretches the one with the smallest period stays.

NULL, empty and white-space texts have no words and no runs. Texts are searched whole; memory grows with the longest
text of a task, and short ones are taken together up to ``GROUP`` words. Rows that repeat an id are searched each, a
NULL id is never planted. Empty tables give no rows, other columns take no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposieve.llm.common import texts

#: A perfect difference set: each residue modulo 31 is a difference of two of its members.
COVER, MODULUS = (1, 5, 11, 24, 25, 27), 31
#: A run has this many words, and this many periods, at least.
LEAST, TIMES = 6, 4
#: Words searched together; a longer text is searched alone.
GROUP = 1 << 19
#: Pairs of grid points extended at once.
PAIRS = 1 << 20


@lru_cache
def _shifts() -> np.ndarray:
    """The least shift that takes two residues into the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    table = np.zeros((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            table[a, b] = next(d for d in range(MODULUS) if inside[(a + d) % MODULUS] and inside[(b + d) % MODULUS])
    return table


def _told_apart(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Orders tied places by a key: writes their ranks and returns those that are still tied.

    The rank of a place is how many places come before its group.
    """
    order = np.lexsort((key, rank[tied]))
    tied, key = tied[order], key[order]
    old, at = rank[tied], np.arange(len(tied))
    group = np.ones(len(tied), bool)
    group[1:] = old[1:] != old[:-1]
    new = group.copy()
    new[1:] |= key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new, at, 0))
    rank[tied] = old + first - np.maximum.accumulate(np.where(group, at, 0))
    alone = new.copy()
    alone[:-1] &= new[1:]
    return tied[~alone]


class Extensions:
    """Longest common extensions to the right of any two positions of a sequence of positive numbers."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        blocks = self.n // MODULUS + 2
        # Zeros after the end, so that shifted positions stay inside.
        self.words = np.concatenate([words, np.zeros(blocks * MODULUS + MODULUS - self.n, np.int64)])
        self.order_of = np.full(MODULUS, -1)
        self.order_of[list(COVER)] = np.arange(len(COVER))
        places = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        self._sort(places[places <= self.n])

    def _index(self, position: np.ndarray) -> np.ndarray:
        """Number of a sampled position among the sampled ones."""
        return position // MODULUS * len(COVER) + self.order_of[position % MODULUS]

    def _sort(self, places: np.ndarray) -> None:
        size, width = len(places), len(COVER)
        bits = int(self.words.max()).bit_length()
        packed = 63 // bits  # words that are compared at once
        rank, tied = np.zeros(size, np.int64), np.arange(size)
        for k in range(0, MODULUS, packed):
            key = np.zeros(len(tied), np.int64)
            for d in range(k, min(k + packed, MODULUS)):
                key = key << bits | self.words[places[tied] + d]
            tied = _told_apart(rank, tied, key)
        levels, reach = [rank.copy()], 1  # ranks by the first MODULUS * reach words
        while len(tied):
            later = tied + reach * width
            key = np.where(later < size, rank[np.minimum(later, size - 1)], -1)
            tied = _told_apart(rank, tied, key)
            levels.append(rank.copy())
            reach *= 2
        self.rank = rank
        sorted_places = np.empty(size, np.int64)
        sorted_places[rank] = np.arange(size)
        common = self._common(sorted_places[:-1], sorted_places[1:], levels, places)
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            half, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _common(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Common prefixes of sampled suffixes from the ranks of the doubling steps."""
        a, b, size, width = a.copy(), b.copy(), len(places), len(COVER)
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = 1 << k
            ok = np.flatnonzero((a < size) & (b < size))
            same = ok[levels[k][a[ok]] == levels[k][b[ok]]]
            length[same] += step * MODULUS
            a[same] += step * width
            b[same] += step * width
        left = np.flatnonzero((a < size) & (b < size))
        x, y = places[a[left]], places[b[left]]
        for k in range(MODULUS):
            same = (self.words[x + k] == self.words[y + k]) & (self.words[x + k] > 0)
            left, x, y = left[same], x[same], y[same]
            if not len(left):
                break
            length[left] += 1
        return length

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of each pair ``i < j`` of positions up to the end."""
        shift = _shifts()[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        open_ = np.arange(len(i))
        for k in range(MODULUS):
            here = open_[shift[open_] > k]
            same = self.words[i[here] + k] == self.words[j[here] + k]
            same &= self.words[j[here] + k] > 0
            out[here[same]] += 1
            open_ = np.concatenate([open_[shift[open_] <= k], here[same]])
            if not len(here):
                break
        a, b = self.rank[self._index(i[open_] + shift[open_])], self.rank[self._index(j[open_] + shift[open_])]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            here = np.flatnonzero(level == k)
            least = np.minimum(self.minima[k][low[here]], self.minima[k][high[here] - (1 << k)])
            out[open_[here]] += least
        return out


def _grid(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``(text, period, position)`` of all grid points, about ``PAIRS`` at a time."""
    most = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    # Points 0, step, 2 * step ... whose partner lies in the text.
    points = (sizes[text] - period - 1) // (period * (TIMES - 1)) + 1
    total = np.cumsum(points)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = points[at:end]
        of = np.repeat(np.arange(at, end), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        yield text[of], period[of], starts[text[of]] + k * period[of] * (TIMES - 1)
        at = end


def find(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of each sequence of positive numbers as rows ``start, length, period``, by start and period."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    top = max((int(s.max()) for s in sequences if len(s)), default=0)
    whole = np.empty(int((sizes + 1).sum()), np.int64)
    for k, (s, at) in enumerate(zip(sequences, starts.tolist())):
        whole[at:at + len(s)] = s
        whole[at + len(s)] = top + 1 + k
    none = np.empty((0, 3), np.int64)
    if not len(sizes) or sizes.max() < LEAST:
        return [none] * len(sequences)
    ahead, back, last = Extensions(whole), Extensions(whole[::-1].copy()), len(whole) - 1
    found = []
    for text, period, at in _grid(sizes, starts):
        right = ahead.of(at, at + period)
        left = np.zeros(len(at), np.int64)
        some = np.flatnonzero(at > starts[text])  # what stands before a text is no part of it
        left[some] = back.of(last - (at + period - 1)[some], last - (at - 1)[some])
        length = period + right + left
        ok = np.flatnonzero(length >= np.maximum(LEAST, TIMES * period))
        found.append(np.stack([text[ok], at[ok] - left[ok] - starts[text[ok]], length[ok], period[ok]], axis=1))
    rows = np.concatenate(found)
    # Of a stretch found with several periods, and again from each of its grid points, the smallest period stays.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cut = np.searchsorted(rows[:, 0], np.arange(len(sequences) + 1))
    return [rows[a:b, 1:] for a, b in zip(cut[:-1], cut[1:])]


def numbered(lists: list[list[bytes]]) -> list[np.ndarray]:
    """Words as positive numbers, equal words alike."""
    known: dict[bytes, int] = {}
    return [np.array([known.setdefault(w, len(known) + 1) for w in words], np.int64) for words in lists]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, made periodic from some word on where the hash of its id says so."""
    n = len(words)
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    unit = words[start:start + period]
    return words[:start] + (unit * (-(-(n - start) // period)))[:n - start]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def highest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exponent; of several the first by start, then by period."""
    if not len(runs):
        return None
    share = runs[:, 1] / runs[:, 2]
    near = runs[share >= share.max() * (1 - 1e-9)].tolist()
    return tuple(max(near, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])))


def _groups(rows: list) -> Iterator[list]:
    group, size = [], 0
    for words in rows:
        if group and size + len(words) > GROUP:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def collapse(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False,
) -> DataFrame:
    """``(id, runs, top, collapsed)``: all runs, the one of the greatest exponent and the words that are kept.

    ``runs`` is an array of ``(start, length, period)``. ``plant`` makes a tenth of the documents periodic first.
    """
    schema = docs.select(id_col).schema
    run_type = "struct<start:bigint,length:bigint,period:bigint>"
    out = f"`{id_col}` {schema[0].dataType.simpleString()}, runs array<{run_type}>, top {run_type}, collapsed string"
    fields = [pa.field(k, pa.int64()) for k in ("start", "length", "period")]

    def structs(rows: np.ndarray, mask: np.ndarray | None = None) -> pa.StructArray:
        columns = [pa.array(np.ascontiguousarray(rows[:, k]), pa.int64()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, fields=fields, mask=None if mask is None else pa.array(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            # Split one after the other: only the texts of a group are held as words.
            lists = ((planted(w, i) if plant else w) for i, w in zip(ids, ((t or b"").split() for t in texts(batch.column(1)))))
            done = 0
            for group in _groups(lists):
                found = find(numbered(group))
                sizes = np.cumsum([0] + [len(f) for f in found])
                tops = [highest(f) for f in found]
                left = [b" ".join(w for w, k in zip(words, kept(len(words), f).tolist()) if k) if len(f) else b" ".join(words)
                        for words, f in zip(group, found)]
                flat = structs(np.concatenate(found).reshape(-1, 3))
                top = structs(np.array([t or (0, 0, 0) for t in tops], np.int64).reshape(-1, 3), np.array([t is None for t in tops], bool))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(group)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat), top,
                     pa.array(left, pa.binary()).cast(pa.string())],
                    names=[id_col, "runs", "top", "collapsed"],
                )
                done += len(group)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of planted documents as numbers and hashes, a row for each document."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period")), ))
    lines = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    top = F.col("top")
    return collapse(docs, id_col, text_col, plant=True).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.floor(F.lit(1000) * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
