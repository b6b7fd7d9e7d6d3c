"""SimHash near-duplicate groups.

Fingerprints of word shingles are linked if they differ in few bits. Candidates come from the
pigeonhole rule: 64 bits are cut into ``distance + 2`` blocks; fingerprints within the
distance agree on two blocks at least, so they meet in the bucket of one of the block pairs.
Buckets are searched for links with Hamming distances; a bucket too large for one task is
cut again, by the same rule on the bits it leaves free.

Texts that are NULL, empty or white space have fingerprint zero and are linked like any other.
Rows with equal texts share a fingerprint, so copies never become pairs. NULL ids take part but
never name a group unless they are alone in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposieve.llm.common import LOWER, Workspace, one_of_group, per_row
from reposieve.llm.components import components

SEED = 42
#: Fingerprints of one bucket that one task may compare (800 kB); larger buckets are cut again.
BUCKET = 100_000
#: Buckets up to this size are compared by shifting the sorted table against itself.
SHIFTS = 12
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint of a text's shingles, repeats included."""
    import xxhash

    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_digest
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start, n = end - size, max(1, len(tokens) - words + 1)
    end = end[-n:]
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        spans = zip(start[k:k + _CHUNK].tolist(), end[k:k + _CHUNK].tolist())
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans][:n - k])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: the bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        rows = hashes[k:k + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", words: int = 3) -> DataFrame:
    """``keep`` and ``fp`` of every row, from its whole text."""
    return per_row(docs, keep, text_col, lambda t: (fingerprint(t, words),), "fp long")


def block_masks(free: int, blocks: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` out of ``blocks`` runs of the set bits of ``free``."""
    bits = [b for b in range(64) if free >> b & 1]
    runs = np.array_split(bits, min(blocks, len(bits)))
    parts = [sum(1 << int(b) for b in run) for run in runs]
    return [sum(c) for c in combinations(parts, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near(a: np.ndarray, b, distance: int) -> np.ndarray:
    # Of signed numbers numpy counts the bits of the absolute value.
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance


def forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected in one bucket: each fingerprint is reached once."""
    rest, found = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            top = queue.pop()
            near = _near(rest, top, distance)
            hit = rest[near]
            if len(hit):
                found.append((np.full(len(hit), top), hit))
                queue.extend(hit)
                rest = rest[~near]
    return found


def _links(distance: int):
    """Links within the buckets of a partition that is sorted by bucket."""
    def of(m: np.ndarray, v: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        cut = np.flatnonzero((m[1:] != m[:-1]) | (v[1:] != v[:-1])) + 1
        start = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([start, [len(fp)]]))
        found = []
        of_row = np.repeat(size, size)
        group = np.repeat(np.arange(len(size)), size)
        some = of_row <= SHIFTS
        g, f = group[some], fp[some]
        for k in range(1, min(SHIFTS, int(size[size <= SHIFTS].max(initial=1)))):
            hit = (g[k:] == g[:-k]) & _near(f[k:], f[:-k], distance)
            found.append((f[k:][hit], f[:-k][hit]))
        for s, n in zip(start[size > SHIFTS].tolist(), size[size > SHIFTS].tolist()):
            found += forest(fp[s:s + n], distance)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([a, np.asarray(c)]) for a, c in zip(left, batch.columns)]
            if not len(rows[0]):
                continue
            # The last bucket may go on in the next batch.
            tail = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            k = int(tail[-1]) + 1 if len(tail) else 0
            left = [a[k:] for a in rows]
            if k:
                yield from out(of(*(a[:k] for a in rows)))
        if len(left[0]):
            yield from out(of(*left))

    def out(found):
        if found:
            u, v = (np.concatenate(x).astype(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def links(work: Workspace, fps: DataFrame, distance: int = 3) -> DataFrame:
    """``(u, v)``: links between different fingerprints, enough to connect all within ``distance``.

    A bucket holds what agrees on the bits of mask ``m``. Each cut leaves fewer free bits; a
    bucket with 16 free bits has 65 536 members at most, so cutting always ends.
    """
    spark, blocks = fps.sparkSession, distance + 2
    level, found, depth = fps.select("fp"), [], 0
    masks = {0: block_masks((1 << 64) - 1, blocks, 2)}
    rows = level.withColumn("m", F.lit(0).cast("long"))
    while True:
        # One row for each mask: 10, 100, ... rows, whatever the size of the data. As Arrow, it needs no Python workers.
        table = spark.createDataFrame(pa.table({
            "m": pa.array([_signed(m) for m in masks], pa.int64()),
            "finer": pa.array([[_signed(x) for x in xs] for xs in masks.values()], pa.list_(pa.int64())),
        }))
        rows = rows.join(F.broadcast(table), "m").select("fp", F.explode("finer").alias("m"))
        rows = rows.select("m", F.col("m").bitwiseAND(F.col("fp")).alias("v"), "fp")
        finer = sorted({x for xs in masks.values() for x in xs})
        small = min(64 - m.bit_count() for m in finer) <= 16
        sizes = work.land(rows.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"sizes{depth}")
        hot = sizes.filter(F.col("n") > BUCKET).select("m", "v")
        again = not small and not hot.isEmpty()
        met = rows.join(sizes.filter(F.col("n") <= BUCKET) if again else sizes, ["m", "v"], "left_semi")
        found.append(
            met.repartition("m", "v").sortWithinPartitions("m", "v", "fp").mapInArrow(_links(distance), "u long, v long")
        )
        if not again:
            break
        rows = rows.join(hot, ["m", "v"], "left_semi").select("fp", "m")
        masks, depth = {m: [m | x for x in block_masks(((1 << 64) - 1) & ~m, blocks, 2)] for m in finer}, depth + 1
    all_links = found[0]
    for more in found[1:]:
        all_links = all_links.unionByName(more)
    return all_links


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int) -> DataFrame:
    """``(_id, text_hash, fp, root, component_id)`` of every row; ``root`` tells groups apart, also where ids repeat."""
    work = Workspace(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    prints = work.land(fingerprints(rows, ["_id", "text_hash"], "_text", words), "prints")
    fps = work.land(prints.groupBy("fp").agg(F.min("_id").alias("least")), "fps")
    roots = components(work, links(work, fps, distance))
    placed = work.land(
        fps.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ), "placed",
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = work.land(placed.join(least, "root").select("fp", "root", "component_id"), "named")
    work.drop("fps", "placed")
    return prints.join(named, "fp").select("_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3
) -> DataFrame:
    """``(id, text_hash, fp, component_id)`` of every row; ``component_id`` is the smallest id reachable by links."""
    return _grouped(docs, id_col, text_col, words, distance).select(
        F.col("_id").alias(id_col), "text_hash", "fp", "component_id"
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3
) -> DataFrame:
    """The document with the smallest id of every group, NULL last; one row, also where ids repeat."""
    return one_of_group(docs, _grouped(docs, id_col, text_col, words, distance), id_col, text_col)
