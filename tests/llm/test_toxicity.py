import random

from reposieve.llm import queries, toxicity
from tests.llm.helpers import SCHEMA, awkward, docs, prose, with_extra

INSULTS = ["brutkopf", "wormling", "snotgoblin"]


def corpus(spark, n=400):
    r, table, labels = random.Random(3), [], []
    for i in range(n):
        words, bad = prose(i, r.randint(30, 400)).split(), i % 5 == 0
        for _ in range(r.randint(2, 9) if bad else 0):
            # Endings vary, so whole words alone would not do.
            words.insert(r.randrange(len(words)), r.choice(INSULTS) + r.choice(["", "en", "ish", "ly", "ax", "um"]))
        table.append((i, " ".join(words), "en", "a", 0))
        if i % 2:
            labels.append((i, 1, 0 if not bad else 1))
        elif i % 10 == 0 and i % 20 == 0:
            labels.append((i, 1, 1))
    return spark.createDataFrame(table, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_order(spark):
    df, labels = corpus(spark)
    model = toxicity.fit(df, labels)
    known = {r.doc_id for r in labels.collect()}
    rows = [r for r in toxicity.score(df, model, ["doc_id"]).collect() if r.doc_id not in known]
    assert len(rows) > 100
    assert all(r.toxic == (r.doc_id % 5 == 0) for r in rows)
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) == toxicity.GRADES
    assert all(0 <= r.severity <= toxicity.GRADES for r in rows)
    kept = toxicity.accepted(with_extra(df), labels)
    assert abs(kept.count() - df.count() * 4 // 5) <= 2 and kept.columns == with_extra(df).columns


def test_severity_grows_with_the_share_of_insults(spark):
    df, labels = corpus(spark)
    model = toxicity.fit(df, labels)
    s = toxicity.Scorer(model)
    clean = prose(999, 100)
    steps = [s((clean + " " + " ".join(x + e for x in INSULTS for e in ("", "en", "um")[:n])).encode()) for n in range(4)]
    assert steps == sorted(steps) and steps[0] < model.reject <= steps[1]


def test_awkward_rows(spark):
    _, labels = corpus(spark)
    df = awkward(spark)
    model = toxicity.fit(corpus(spark)[0], labels)
    rows = toxicity.score(with_extra(df), model, ["doc_id"]).collect()
    assert len(rows) == df.count() and not any(r.toxic for r in rows)


def test_without_labels_nothing_is_rejected(spark):
    df, labels = corpus(spark, 40)
    for some in (labels.filter("false"), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert toxicity.accepted(df, some).count() == 40
    assert toxicity.accepted(docs(spark, []), labels).count() == 0


def test_the_sample_is_bounded_in_rows(spark):
    df, labels = corpus(spark, 40)
    one = labels.filter("toxic = 0").first().doc_id
    more = df.limit(0).union(spark.createDataFrame([(one, prose(5000 + i % 50, 30), "en", "a", 1) for i in range(200)], df.schema))
    found = toxicity.sample(df.unionByName(more), labels, "doc_id", "text", 10).collect()
    assert all(sum(r.toxic == v for r in found) <= 10 for v in (0, 1)) and len(found) > 10


def test_query(spark):
    found = queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.001")
    assert found.columns[0] == "doc_id" and found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
