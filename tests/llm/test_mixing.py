import duckdb
import pytest

from reposieve.llm import mixing, queries
from tests.llm.helpers import SCHEMA, awkward, docs, prose, with_extra


def by_sql(df):
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT doc_id, text, source FROM documents")
    return sorted(con.sql(mixing.MIX_SQL).fetchall(), key=repr)


def result(df):
    return sorted(map(tuple, mixing.mix(df).collect()), key=repr)


def test_awkward_rows(spark):
    df = awkward(spark)
    got, want = result(with_extra(df)), by_sql(df)
    assert [(*r[:3], round(r[3], 6), r[4]) for r in got] == [(*r[:3], round(r[3], 6), r[4]) for r in want]


def test_budgets_are_exact_and_limited(spark):
    table = [(i, prose(i, 5 + i % 40), "en", s, 0) for i, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["tiny"] * 4 + [None] * 30)]
    df = spark.createDataFrame(table, SCHEMA)
    found = mixing.mix(df).toPandas().merge(df.select("doc_id", "source").toPandas(), on="doc_id")
    assert (found.taken <= 3 * found["size"]).all() and (found.target <= 3 * found.source_size).all()
    for _, part in found.groupby("source", dropna=False):
        assert part.taken.sum() == int(part.target.iloc[0] + 1e-6)
    assert abs(sum(p.target.iloc[0] for _, p in found.groupby("source", dropna=False)) - found["size"].sum()) < 1e-6
    assert result(df) == result(df.repartition(7))


def test_empty_and_blank_tables(spark):
    assert result(docs(spark, [])) == []
    assert {r[4] for r in result(docs(spark, [None, "", "  "]))} == {0}


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" \t\r\n\x0b\x0c", 0), ("a", 1), (" a  b\tc ", 3), ("é ü x", 2)])
def test_words(spark, text, n):
    df = docs(spark, [text])
    assert df.select(mixing.n_words(df["text"])).first()[0] == n


def test_mixed_keeps_columns(spark):
    df = with_extra(docs(spark, [prose(i, 20) for i in range(30)]))
    kept = mixing.mixed(df)
    assert set(kept.columns) == set(df.columns) and kept.filter("taken <= 0").count() == 0


def test_rows_that_repeat_an_id_have_their_own_share(spark):
    table = [(i % 3, prose(i, 10 + i), "en", "ab"[i % 2], 0) for i in range(12)] + [(0, prose(0, 10), "en", "a", 0)]
    df = spark.createDataFrame(table, SCHEMA)
    kept = mixing.mixed(df).collect()
    assert sum(r.taken for r in kept) == sum(r.taken for r in mixing.mix(df).collect())
    assert all(0 < r.taken <= 3 * len(r.text.split()) for r in kept)


@pytest.mark.parametrize("sizes", [(900_000_000, 500_000_000, 4), (1_200_000_000, 800_000_000, 140_000_000), (3_000_000_000, 9, 2_000_000_000)])
def test_sizes_of_billions(spark, sizes):
    sources = spark.createDataFrame([(s, n, k) for k, (s, n) in enumerate(zip("abc", sizes), 1)], "_source string, source_size long, _rank long")
    found = [r.target for r in mixing.targets(sources, (1, 2, 3), 3).orderBy("_rank").collect()]
    # By hand: what is full stays at three times its size, the others share the rest by weight.
    weights, left, full = {0: 1, 1: 2, 2: 3}, sum(sizes), set()
    while True:
        open_ = {k: w for k, w in weights.items() if k not in full}
        rest = left - sum(3 * sizes[k] for k in full)
        more = {k for k, w in open_.items() if rest * w / sum(open_.values()) >= 3 * sizes[k]}
        if not more:
            break
        full |= more
    want = [3 * sizes[k] if k in full else rest * w / sum(open_.values()) for k, w in weights.items()]
    assert found == pytest.approx(want)


def test_weights_of_billions(spark):
    df = docs(spark, [prose(i, 5 + i) for i in range(40)])
    small, large = (sorted((r.doc_id, r.taken) for r in mixing.mix(df, weights=w).collect()) for w in ((1, 2), (10**9, 2 * 10**9)))
    assert small == large and sum(n for _, n in small) > 0


def test_query(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op7_mixing"](spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in by_sql(d)]
