import random

import numpy as np

from reposieve.llm import decontam, queries
from tests.llm.helpers import awkward, docs, prose, with_extra


def plain(text):
    return " ".join((text or "").lower().split())


def distance(item, text):
    """Least edits between an item and any substring."""
    row = np.zeros(len(text) + 1, int)
    letters = np.array([ord(c) for c in text])
    step = np.arange(len(text) + 1)
    for c in item:
        new = row + 1
        if len(text):
            new[1:] = np.minimum(new[1:], row[:-1] + (letters != ord(c)))
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def edited(text, n, seed):
    r = random.Random(seed)
    for _ in range(n):
        k = r.randrange(len(text))
        text = r.choice([text[:k] + text[k + 1:], text[:k] + "q" + text[k:], text[:k] + "z" + text[k + 1:]])
    return text


def brute(table, items):
    found = []
    for i, t in table:
        for k, x in items:
            m = len(plain(x))
            if x is not None and m >= decontam.Q:
                e = min(int(decontam.RATE * m), (m - decontam.Q) // decontam.Q)
                d = distance(plain(x), plain(t))
                if d <= e:
                    found.append((i, k, d))
    return sorted(found, key=repr)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def result(df, bench):
    return sorted(((r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(df, bench).collect()), key=repr)


def test_against_brute_force(spark):
    items = [(k, prose(k, 12 + 5 * k)) for k in range(6)] + [(6, "short"), (7, None), (8, prose(0, 12)), (9, "just eleven")]
    texts = [prose(50 + i, 40) + " " + edited(items[i % 6][1], i, i).upper() + " " + prose(80 + i, 30) for i in range(24)]
    df = docs(spark, texts + ["  Just   ELEVEN ", "just elfen", "aaaa " * 300])
    bench = benchmark(spark, items)
    assert result(df, bench) == brute([(r.doc_id, r.text) for r in df.collect()], items)


def test_parts_and_blocks(spark, monkeypatch):
    items = [(k, prose(k, 30)) for k in range(8)]
    df = docs(spark, [prose(90, 200) + items[k][1] + prose(91, 200) for k in range(8)])
    bench, want = benchmark(spark, items), [(k, k, 0) for k in range(8)]
    monkeypatch.setattr(decontam, "PART", 300)
    assert len(list(decontam.parts(bench))) > 2 and result(df, bench) == want
    assert decontam.clean(df, bench).count() == 0
    index = decontam.Index([(k, t.encode()) for k, t in items])
    monkeypatch.setattr(decontam, "BLOCK", 150)
    assert [index.matches(r.text.encode())[0][:2] for r in df.collect()] == [(k, 0) for k in range(8)]


def test_awkward_rows(spark):
    bench = benchmark(spark, [(1, prose(2, 80)), (1, prose(3, 50))])
    df = with_extra(awkward(spark))
    assert {r[0] for r in result(df, bench)} == {3, 4, 77, None}
    assert decontam.clean(df, bench).columns == df.columns
    assert decontam.clean(df, bench).count() == df.count() - 5


def test_empty_tables(spark):
    assert result(docs(spark, []), benchmark(spark, [(1, prose(1, 20))])) == []
    assert result(docs(spark, [prose(1, 20)]), benchmark(spark, [])) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontamination"](spark, sf).collect()}
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert {(r.doc_id, x.item_id) for r in d for x in b if plain(x.text) in plain(r.text)} <= got
    bodies = {r.doc_id: plain(r.text) for r in d}
    texts = {x.item_id: plain(x.text) for x in b}
    assert all(distance(texts[k], bodies[i]) <= 0.1 * len(texts[k]) for i, k in got)
