import corpus_pipeline
import xxhash

from reposieve.llm import resemblance
from tests.llm.helpers import SCHEMA, awkward, docs, prose, with_extra


def kept(table):
    """Ids that stay, by brute force over ``(id, text)`` with the Jaccard similarity of five-word shingles."""
    sets = []
    for _, text in table:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(table)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                part[top(i)] = top(j)
    by = {}
    for i, (key, text) in enumerate(table):
        by.setdefault(top(i), []).append((key is None, key or 0, key))
    return sorted((min(v)[2] for v in by.values()), key=repr)


def edited(seed, edits, words=200):
    w = prose(seed, words).split()
    for e in range(edits):
        w[(e * 31 + 7) % words] = f"edit{seed}x{e}"
    return " ".join(w)


def stays(df):
    return sorted((r.doc_id for r in resemblance.one_of_each(df).collect()), key=repr)


def test_stage_joins_edited_copies(spark):
    # Four edits of 200 words leave a similarity of 0.81, six leave 0.73; the distance in bits does not matter.
    found = [edited(s, e) for s in range(60) for e in (0, 4)] + [edited(s, e) for s in range(100, 110) for e in (0, 6)]
    df = docs(spark, found)
    want = kept([(r.doc_id, r.text) for r in df.collect()])
    assert len(want) == 80
    assert sorted((r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=repr) == want


def test_large_groups_against_brute_force(spark):
    # A chain of edits, a template with much of its text in common and exact copies.
    chain = [edited(5, e) for e in range(30)] + [edited(5, 0)] * 4
    template = [prose(8, 150) + " " + prose(200 + e, 50 - e) for e in range(40)]
    df = docs(spark, chain + template + [prose(i, 3) for i in range(9)])
    assert stays(df) == kept([(r.doc_id, r.text) for r in df.collect()])


def test_awkward_rows(spark):
    df = with_extra(awkward(spark))
    assert stays(df) == kept([(r.doc_id, r.text) for r in df.collect()])
    out = resemblance.one_of_each(df)
    assert out.columns == df.columns
    assert resemblance.one_of_each(docs(spark, [])).collect() == []


def test_repeated_and_null_ids(spark):
    table = [(1, edited(1, 0), "en", "a", 1), (1, edited(1, 2), "en", "a", 1), (1, prose(9, 60), "en", "a", 1),
             (None, edited(2, 0), "en", "a", 1), (None, edited(2, 2), "en", "a", 1)]
    assert stays(spark.createDataFrame(table, SCHEMA)) == [1, 1, None]


def test_fingerprints_link_on_their_own(spark, monkeypatch):
    # Without the search that follows, what is alike and within seven bits is joined, and nothing else.
    def fingerprint(text):
        w = text.encode().split()
        found = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))

    monkeypatch.setattr(resemblance, "postings", lambda work, held, words: spark.createDataFrame([], "shingle long, unit long, n long, r long"))
    pairs = [(edited(s, 0), edited(s, e)) for s in range(12) for e in (1, 3)]
    near = [(fingerprint(a) ^ fingerprint(b)).bit_count() <= 7 for a, b in pairs]
    assert 4 < sum(near) < len(near)
    for e, want in ((1, near[0::2]), (3, near[1::2])):
        df = docs(spark, [t for s in range(12) for t in (edited(s, 0), edited(s, e))])
        assert stays(df) == sorted([*range(0, 24, 2), *(2 * k + 1 for k, n in enumerate(want) if not n)], key=repr)
