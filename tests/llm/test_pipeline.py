"""Stages of the pipeline, each on its own input."""

import corpus_pipeline
from tests.llm.helpers import awkward, docs, prose, with_extra
from tests.llm.test_decontam import plain
from tests.llm.test_resemblance import kept as near_copies
from tests.llm.test_substrings import brute

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "mixing"]
    at = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in at.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        rows = {r.doc_id: r.text for r in out.collect()}
        assert rows.keys() <= kept.keys()
        table = sorted(kept.items())
        if name == "near_duplicates":
            assert set(rows) == set(near_copies(table))
        if name == "repeated_passages":
            gone = {i for i, n, removed, *_ in brute(table, 200) if n and n == removed}
            cut = {i for i, _, removed, *_ in brute(table, 200) if removed} - gone
            assert rows.keys() == kept.keys() - gone
            assert all((rows[i] != kept[i]) == (i in cut) for i in rows)
        if name == "decontamination":
            items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(x in plain(t) for t in rows.values() for x in items)
        if name != "mixing":
            assert out.columns == at.columns and out.schema == at.schema
        at, kept = spark.createDataFrame(out.collect(), out.schema), rows


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("taken <= 0").count() == 0


def test_awkward_tables(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    with_extra(awkward(spark)).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) >= set(with_extra(awkward(spark)).columns)
    docs(spark, []).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs(spark, [prose(1, 9)]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
