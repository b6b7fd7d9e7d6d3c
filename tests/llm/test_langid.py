import zlib
from math import log

import numpy as np

from reposieve.llm import langid, queries
from tests.llm.helpers import SCHEMA, awkward, docs, prose, with_extra
from pyspark.sql import functions as F

LETTERS = {"xx": "abcdefgh", "yy": "efghijkl", "zz": "äöüßabcd"}


def corpus(spark, n=180):
    kinds = list(LETTERS)
    table = [(i, prose(i, 40 + i % 50, LETTERS[kinds[i % 3]]), kinds[i % 3], "a", 0) for i in range(n)]
    return spark.createDataFrame(table, SCHEMA)


def test_held_out_accuracy(spark):
    df = corpus(spark)
    held = langid.fold(F.col("doc_id")) == 1
    models = langid.fit(df, ~held)
    found = langid.identify(df, models, ["doc_id", "lang"]).collect()
    out = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(out) > 40 and all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in out)
    strange = langid.identify(docs(spark, ["ящик " * 40, prose(1, 50, LETTERS["xx"])]), models, ["doc_id"]).collect()
    assert [r.rejected for r in sorted(strange)] == [True, False]


def direct(texts, gram):
    """Interpolated Kneser-Ney probability of the last character of ``gram``, straight from the definition."""
    n = langid.ORDER
    counts = {}
    for t in texts:
        s = " " * (n - 1) + t + " "
        for i in range(len(s) - n + 1):
            counts[s[i:i + n]] = counts.get(s[i:i + n], 0) + 1
    orders = {n: counts}
    for k in range(n - 1, 0, -1):
        orders[k] = {}
        for g in orders[k + 1]:
            orders[k][g[1:]] = orders[k].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / langid.CHARACTERS
        c = orders[len(g)]
        n1, n2 = (sum(v == x for v in c.values()) for x in (1, 2))
        d = min(max((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.1), 0.95)
        same = [v for h, v in c.items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(c.get(g, 0) - d, 0) / sum(same) * (g in c) + d * len(same) / sum(same) * p(g[1:])

    return p(gram)


def test_probabilities_against_the_definition():
    texts = ["abab abba", "baab aabb ab", "abc abc"]
    counts = {}
    for t in texts:
        s = " " * 4 + t + " "
        for i in range(len(s) - 4):
            counts[s[i:i + 5]] = counts.get(s[i:i + 5], 0) + 1
    grams = np.array([[ord(c) for c in g] for g in counts])
    models = langid.kneser_ney(["q"], np.zeros(len(counts), int), grams, np.array(list(counts.values())))
    for text in ("abab", "cab", "bbbb aab"):
        s = " " * 4 + text + " "
        want = -sum(log(direct(texts, s[i:i + 5])) for i in range(len(s) - 4)) / (len(s) - 4)
        assert abs(models.entropy(text)[0] - want) < 1e-5
    for key in (models.grams, models.contexts):
        assert all((np.diff(v.astype(float)) >= 0).all() for v in key.values())


def test_awkward_rows(spark):
    models = langid.fit(corpus(spark, 60), F.lit(True))
    found = {r.doc_id: r for r in langid.identify(with_extra(awkward(spark)), models, ["doc_id"]).collect()}
    assert [found[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4 and found[0].score == 0
    assert found[3].lang_pred in LETTERS and found[5].lang_pred in LETTERS


def test_nothing_to_learn(spark):
    assert langid.fit(docs(spark, []), F.lit(True)) is None
    assert langid.fit(docs(spark, [None, "12"]), F.lit(True)) is None
    assert langid.identify(docs(spark, ["abc"]), None, ["doc_id"]).first().lang_pred == "und"


def test_languages_of_one_document_are_learned(spark):
    table = [(i, prose(i, 30), f"l{i:02}", "a", 0) for i in range(24)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.fit(df, F.lit(True)).langs == [r[2] for r in table]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op3_language"](spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    x = found.merge(table, on="doc_id")
    assert len(x) == len(table) and (x.lang == x.lang_pred)[x.held_out].mean() > 0.97
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(x.doc_id, x.held_out))
