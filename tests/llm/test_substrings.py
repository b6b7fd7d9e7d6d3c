import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reposieve.llm import queries, simhash, substrings
from reposieve.llm.common import texts
from tests.llm.helpers import awkward, docs, prose, with_extra


def brute(table, length):
    data = [(i, (t or "").encode()) for i, t in table]
    seen = Counter(b[s:s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def result(df, length):
    return sorted(map(tuple, substrings.removals(df, length=length).collect()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("length", [200, 60])
def test_against_brute_force(spark, length):
    shared = prose(50, 60)
    texts = [prose(i, 30) + " " + shared[k:k + n] + " " + prose(100 + i, 20) for i, (k, n) in enumerate(
        [(0, 300), (0, 300), (40, 260), (90, 199), (90, 200), (91, 201), (10, 60), (11, 59), (0, 61), (100, 150)])]
    texts += [prose(7, 90)] * 3 + ["abc" * 100, "é" * 150, "ab" * 40 + prose(8, 20), shared[:200], shared[100:300]]
    df = docs(spark, texts)
    assert result(df, length) == brute(pairs(df), length)


def test_awkward_rows(spark):
    df = awkward(spark).filter("doc_id is null or doc_id <> 5")  # brute force is slow on the long text
    assert result(with_extra(df), 200) == brute(pairs(df), 200)


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 700)
    shared = prose(50, 120)
    df = docs(spark, [prose(1, 150) + shared, shared + prose(2, 150), prose(3, 60) + shared[:400] + prose(4, 60)])
    found = [substrings.anchors(t.encode(), 200) for t in (r.text for r in df.collect())]
    monkeypatch.setattr(substrings, "BLOCK", 1 << 20)
    for (p, n), t in zip(found, (r.text for r in df.collect())):
        whole = substrings.anchors(t.encode(), 200)
        assert p.tolist() == whole[0].tolist() and n.tolist() != []
    assert result(df, 200) == brute(pairs(df), 200)


def test_empty_table(spark):
    assert result(docs(spark, []), 200) == []
    assert result(docs(spark, ["short", None]), 200) == brute([(0, "short"), (1, None)], 200)


def test_cut_texts(spark):
    shared = prose(9, 60)
    df = with_extra(docs(spark, ["begin " + shared + " end", shared + "é", prose(3, 90), None, prose(4, 90), prose(4, 90)]))
    kept = {r.doc_id: r.text for r in substrings.without_repeats(df).collect()}
    assert kept[0] == "begin  end" and kept[1] == "é" and kept[2] == prose(3, 90) and kept[3] is None
    assert 4 not in kept and 5 not in kept
    assert substrings.without_repeats(df).columns == df.columns


def test_nodes_are_not_landed_for_each_part(spark, monkeypatch):
    landed, land = {}, substrings.Workspace.land

    def counted(self, df, step):
        out = land(self, df, step)
        landed[step] = out.count()
        return out

    monkeypatch.setattr(substrings.Workspace, "land", counted)
    shared = prose(50, 60)
    df = docs(spark, [prose(i, 30) + shared[7 * i:] + prose(20 + i, 30) for i in range(4)])
    assert result(df, 200) == brute(pairs(df), 200)
    assert landed["nodes1"] and all(landed[f"nodes{k + 1}"] <= landed[f"strings{k}"] for k in range(3))


def test_parts():
    size = np.arange(1, 60)
    lo = 3 * size
    a, b, of = substrings.parts(lo, lo + size - 1)
    for k, n in enumerate(size):
        own = of == k
        assert np.concatenate([np.arange(x, y + 1) for x, y in zip(a[own], b[own])]).tolist() == list(range(lo[k], lo[k] + n))
        assert own.sum() <= substrings.FAN and (b[own] - a[own]).max() + 1 == -(-n // substrings.FAN)


def test_no_rows_go_through_python_workers_from_the_driver(spark, monkeypatch):
    def fail(*_, **__):
        raise AssertionError("a table made of Python rows starts Python workers of its own")

    df = docs(spark, [prose(1, 90), prose(1, 60) + prose(2, 40)])
    want = brute(pairs(df), 200)
    fps = df.select(F.xxhash64("text").alias("fp")).localCheckpoint()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", fail)
    assert result(df, 200) == want
    assert simhash.links(substrings.Workspace(spark, "masks"), fps).collect() == []


def test_texts_are_not_copied_as_a_whole():
    column = pa.array(["x" * 10_000] * 1_000 + [None])
    tracemalloc.start()
    n = sum(len(t or b"") for t in texts(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000_000 and peak < 2_000_000


def test_query(spark):
    found = queries.QUERIES["op6_substrings"](spark, "/root/testdata/sf0.001")
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, r.text) for r in table], 200)
    assert sorted(map(tuple, found.collect()), key=repr) == want
