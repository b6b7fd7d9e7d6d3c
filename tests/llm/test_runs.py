import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from reposieve.llm import runs
from reposieve.llm.queries import QUERIES
from tests.llm.helpers import awkward, docs, prose, with_extra

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def all_runs(w):
    """Every run, by comparing each word with the one ``q`` later."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = (sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))),
              sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *digest


def test_cover():
    assert {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER} == set(range(runs.MODULUS))


@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_runs_against_comparison(monkeypatch, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    r = random.Random(2)
    for _ in range(120):
        seqs = []
        for _ in range(r.randint(1, 8)):
            n, kind = r.randint(0, 180), r.random()
            if kind < 0.6:
                unit = [r.randint(1, 4) for _ in range(r.randint(1, 40))]
                s = [r.randint(1, 3) for _ in range(r.randint(0, 40))] + (unit * 200)[:n] + unit[:r.randint(0, 9)]
            else:
                s = [r.randint(1, r.choice((1, 2, 500))) for _ in range(n)]
            seqs.append(np.array(s, np.int64))
        assert [list(map(tuple, f.tolist())) for f in runs.find(seqs)] == [all_runs(s.tolist()) for s in seqs]


def test_extensions_against_comparison():
    r = random.Random(5)
    for n in (1, 5, 31, 62, 400):
        w = np.array([r.randint(1, 2) for _ in range(n // 2)] * 2 + [3], np.int64)
        ext = runs.Extensions(w)
        pairs = [(i, j) for i in range(len(w)) for j in range(i + 1, len(w))]
        if not pairs:
            continue
        i, j = map(np.array, zip(*pairs))
        def common(a, b):
            k = 0
            while b + k < len(w) and w[a + k] == w[b + k]:
                k += 1
            return k
        assert ext.of(i, j).tolist() == [common(a, b) for a, b in pairs]


def test_long_texts_with_long_periods():
    unit = prose(1, 4000).split()
    words = [x.encode() for x in prose(2, 3000).split() + unit * 4 + unit[:100] + ["x"] * 9]
    assert runs.find(runs.numbered([words]))[0].tolist() == [[3000, 16100, 4000], [19100, 9, 1]]


def test_query_against_definition(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = QUERIES["op13_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r) for r in got.collect()}
    assert got == {r.doc_id: brute(r.doc_id, r.text) for r in rows}
    assert sum(r[1] for r in got.values()) > 5


def test_planted_documents(spark, tmp_path):
    docs(spark, [prose(k, 5 + 7 * k % 300) for k in range(300)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_runs"](spark, str(tmp_path)).collect()}
    assert got == {r.doc_id: brute(r.doc_id, r.text) for r in rows}


def test_awkward_rows(spark, tmp_path):
    table = with_extra(awkward(spark)).withColumnRenamed("source", "top")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op13_runs"](spark, str(tmp_path)).collect()]
    short = [r for r in table.collect() if r.text is None or len(r.text) < 50_000]
    want = [brute(r.doc_id, r.text) for r in short]
    assert len(got) == table.count() and all(w in got for w in want)
    assert runs.collapse(docs(spark, [])).collect() == []


def test_collapsed_text(spark):
    out = runs.collapse(docs(spark, ["a b " * 4 + "c", "one  two"])).orderBy("doc_id").collect()
    assert [(r.collapsed, r.top and tuple(r.top)) for r in out] == [("a b c", (0, 8, 2)), ("one two", None)]
