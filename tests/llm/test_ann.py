import numpy as np
from pyspark.sql import functions as F

from reposieve.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], SCHEMA)


def brute(vectors, is_query, k=20):
    kept = {(i, tuple(np.float32(v).tolist())) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in sorted(kept):
        if is_query(q):
            scored = sorted((-float(np.dot(np.array(v), np.array(w))), i) for i, w in kept if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def result(df, k=20):
    return sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, k=k).collect()))


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)


def vectors(n, d=8, seed=0):
    r = np.random.default_rng(seed)
    return [(i, r.integers(-8, 9, d).astype(float).tolist()) for i in range(n)]


def test_ties_copies_and_unusable_vectors(spark):
    some = vectors(150)
    some += [(1000 + i, some[3][1]) for i in range(60)] + [some[5]]
    some += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] * 8),
             (2080, [float("inf")] * 8), (None, some[4][1]), (2100, [])]
    same(result(frame(spark, some)), brute(some, lambda i: i % 20 == 0))


def test_few_rows(spark):
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(20, [1.0, 2.0])])) == []
    some = vectors(6)
    same(result(frame(spark, some)), brute(some, lambda i: i % 20 == 0))


def test_other_sizes_take_no_part(spark):
    some = vectors(50)
    same(result(frame(spark, some + [(60, [1.0, 2.0])])), brute(some, lambda i: i % 20 == 0))


def test_blocks_give_the_same(spark, monkeypatch):
    some = vectors(400, seed=2)
    monkeypatch.setattr(ann, "BLOCK", 90)
    monkeypatch.setattr(ann, "QUERIES", 7)
    same(result(frame(spark, some), 5), brute(some, lambda i: i % 20 == 0, 5))


def test_footrule():
    near = np.array([[2, 0, 1], [0, 1, 2], [3, 4, 5]], np.int16)
    index = ann.Block(near, 6)
    # Ranks of the query's pivots in each order; 3 where they are absent.
    assert index.footrule(np.array([0, 1])).tolist() == [abs(1 - 0) + abs(2 - 1), 0, 3 + 2]


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    found = queries.QUERIES["op9_neighbours"](spark, sf).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = found[found.query_id == ids[i]]
        assert mine["rank"].tolist() == sorted(mine["rank"]) and len(mine) == 20
        hits, total = hits + len(best & set(mine.vec_id)), total + 20
    assert hits / total >= 0.9


def test_recall_on_vectors_of_mixed_length(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST", 400)  # a fifth of the table is ranked again
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    r = np.random.default_rng(4)
    v = (np.stack(e.embedding) * np.exp(0.5 * r.standard_normal(len(e)))[:, None]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for i in range(0, len(v), 20):
        s = v @ v[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(found[found.query_id == i].vec_id))
    assert hits / len(found) >= 0.9
