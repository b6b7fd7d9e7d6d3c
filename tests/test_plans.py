"""Plans stay the ones that were wanted: one pass, no shuffle, pruned reads."""

from reposieve.operators import select
from reposieve.plans.scan import ScanConfig, findings_of, repo_stats, repo_summary, scan_files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def landed(make_files, tmp_path):
    path = str(tmp_path / "files")
    make_files(("a.py", "eval(1)"), ("b.js", "eval(1)")).write.parquet(path)
    return path


def test_scan_is_one_pass_without_shuffle(spark, make_files, tmp_path):
    files = spark.read.parquet(landed(make_files, tmp_path))
    text = plan(findings_of(scan_files(files)))
    assert "Exchange" not in text and text.count("FileScan") == 1
    # The gate, the matches and the gaps: no second copy of a rule anywhere.
    assert text.count(r"\bAKIA[0-9A-Z]") == 3
    assert "LessThanOrEqual(length,500000)" in text


def test_disabled_extractors_are_not_planned(spark, make_files, tmp_path):
    files = spark.read.parquet(landed(make_files, tmp_path))
    assert "EvalPython" not in plan(findings_of(scan_files(files, ScanConfig(enabled=("secrets", "yara")))))


def test_summary_shuffles_counters_once(spark, make_files, tmp_path):
    files = spark.read.parquet(landed(make_files, tmp_path))
    text = plan(repo_summary(scan_files(files)))
    assert text.count("Exchange hashpartitioning") == 1


def test_stats_and_caps_do_not_move_bodies(spark, make_files, tmp_path):
    files = spark.read.parquet(landed(make_files, tmp_path))
    assert "content" not in plan(repo_stats(files))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capped = plan(select.cap_files(files.drop("content"), 5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "WindowGroupLimit" in capped and "content" not in capped


def test_merging_reads_reports_once(spark, tmp_path):
    from reposieve.plans.portfolio import DOCUMENT, merge_reports, portfolio_totals

    path = str(tmp_path / "reports")
    spark.createDataFrame([], DOCUMENT).write.parquet(path)
    merged = merge_reports(spark.read.parquet(path))
    for frame in (merged.repos, merged.findings, merged.flags, merged.globs, portfolio_totals(merged)):
        text = plan(frame)
        assert text.count("FileScan") == 1 and "Join" not in text


def test_deep_pages_do_not_meet_in_one_task(spark, tmp_path):
    from reposieve.operators.repos import search_repos

    columns = "owner string, name string, full_name string, html_url string, stargazers_count int, default_branch string"
    rows = [("o", f"r{k:05}", f"o/r{k:05}", "", k // 7, None) for k in range(3000)]
    found = spark.createDataFrame(rows, columns).repartition(5)
    want = [r[2] for r in sorted(rows, key=lambda r: (-r[4], r[2]))]
    for start, pages in ((1, 2), (2, 1), (29, 3), (31, 1)):
        deep = search_repos(found, 100, pages, start)
        assert sorted(r["full_name"] for r in deep.collect()) == sorted(want[(start - 1) * 100:(start - 1 + pages) * 100])
        assert start == 1 or not any(x in plan(deep) for x in ("GlobalLimit", "CollectLimit", "TakeOrdered"))
