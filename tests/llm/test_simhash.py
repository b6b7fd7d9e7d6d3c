import numpy as np
import xxhash

from reposieve.llm import queries, simhash
from tests.llm.helpers import awkward, docs, prose, with_extra

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, k=3):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(table):
    """Smallest id reachable over links of 3 bits, by brute force over ``(id, text)``."""
    prints = [fingerprint(t) for _, t in table]
    part = list(range(len(table)))
    for _ in table:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    part[i] = part[j] = min(part[i], part[j])
    least = {p: min((table[i][0] for i in range(len(table)) if part[i] == p and table[i][0] is not None), default=None) for p in part}
    return sorted(((table[i][0], f"{prints[i]:016x}", least[p]) for i, p in enumerate(part)), key=repr)


def result(df):
    found = simhash.near_duplicates(df).collect()
    return sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in found), key=repr)


def near(seed, edits):
    words = prose(seed, 300).split()
    for e in range(edits):
        words[(e * 37 + 11) % len(words)] = f"edit{e}"
    return " ".join(words)


def test_groups_against_brute_force(spark):
    df = docs(spark, [near(5, e % 4) for e in range(12)] + [prose(i, 40) for i in range(20, 30)] + [near(6, 0)] * 5)
    assert result(df) == groups([(r.doc_id, r.text) for r in df.collect()])


def test_awkward_rows(spark):
    df = awkward(spark)
    assert result(with_extra(df)) == groups([(r.doc_id, r.text) for r in df.collect()])


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    assert simhash.one_of_each(docs(spark, [])).collect() == []


def test_large_buckets_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    df = docs(spark, [near(5, e % 7) + f" tail{e}" for e in range(40)] + [prose(i, 30) for i in range(20, 24)])
    assert result(df) == groups([(r.doc_id, r.text) for r in df.collect()])


def test_forest_connects_what_is_near():
    r = np.random.default_rng(1)
    fps = np.unique(np.int64(12345) ^ (np.int64(1) << r.integers(0, 30, 300)) ^ (np.int64(1) << r.integers(0, 30, 300)))
    part = {int(f): int(f) for f in fps}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for u, v in simhash.forest(fps, 3):
        for a, b in zip(u.tolist(), v.tolist()):
            assert (a ^ b).bit_count() <= 3
            part[top(a)] = top(b)
    assert len({top(int(f)) for f in fps}) == 1


def test_one_of_each_keeps_whole_rows(spark):
    df = with_extra(awkward(spark))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 4 not in ids and 77 not in ids


def test_one_of_each_keeps_one_row_where_ids_repeat_or_are_null(spark):
    table = [(1, near(5, 0), "en", "a", 1), (1, near(5, 0).upper(), "en", "a", 1), (1, prose(9, 60), "en", "a", 1),
             (None, near(6, 0), "en", "a", 1), (None, near(6, 0).upper(), "en", "a", 1)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text.lower()) for r in simhash.one_of_each(df).collect()]
    assert sorted(kept, key=repr) == sorted([(1, near(5, 0)), (1, prose(9, 60)), (None, near(6, 0))], key=repr)


def test_query(spark):
    df = queries.QUERIES["op2_simhash"](spark, "/root/testdata/sf0.001")
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, df.collect()), key=repr) == groups([(r.doc_id, r.text) for r in table])
