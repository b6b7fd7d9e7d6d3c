import json
import zipfile

import pytest
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.operators import repos as rp
from reposieve.operators.ranking import number_rows, skip_first
from reposieve.plans import portfolio as pf
from reposieve.plans import reports as rt
from reposieve.plans.scan import classify, repo_summary
from reposieve.session import shared_folder
from reposieve.sources import documents as docs
from reposieve.sources import files as fs
from reposieve.sources import sinks

FINDING = "owner string, name string, path string, scanner string, rule_id string, severity string, reason string, evidence string, ord int"


def findings(spark, *rows):
    full = [("o", n, p, s, "r", sev, "why", None, i) for i, (n, p, s, sev) in enumerate(rows)]
    return spark.createDataFrame(full, FINDING)


def test_classification(spark):
    f = findings(
        spark, ("doc", "docs/a.py", "entropy_secrets", "medium"), ("doc", "b.MD", "entropy_secrets", "medium"),
        ("mixed", "docs/a.py", "entropy_secrets", "medium"), ("mixed", "a.py", "entropy_secrets", "medium"),
        ("bad", "docs/a.py", "secrets", "high"), ("low", "a.py", "todo", "low"), ("crit", "a.py", "x", "critical"))
    names = ["doc", "mixed", "bad", "low", "crit", "none"]
    repos = spark.createDataFrame([("o", n) for n in names], "owner string, name string")
    got = {r["name"]: (r["findings"], r["classification"], r["summary"]) for r in classify(f, repos).collect()}
    assert got == {
        "doc": (2, "Safe", fixed.SUMMARY_DOCS), "mixed": (2, "Potential Threat", fixed.SUMMARY_TOKENS),
        "bad": (1, "Threat", fixed.SUMMARY_THREAT), "low": (1, "Potential Threat", fixed.SUMMARY_LOW),
        "crit": (1, "Threat", fixed.SUMMARY_THREAT), "none": (0, "Safe", fixed.SUMMARY_NONE)}


def scanned(spark, *rows):
    items = "array<struct<scanner:string,rule_id:string,severity:string,reason:string,evidence:string,ord:int>>"
    return spark.createDataFrame(
        [("o", n, p, 10, [], [("s", "r", sev, "why", None, i) for i, sev in enumerate(sevs)]) for n, p, sevs in rows],
        f"owner string, name string, path string, length bigint, scanners array<string>, findings {items}")


def test_reports_in_parts_are_whole(spark):
    sc = scanned(spark, *(("big", f"f{i}.py", ["high"] * 5) for i in range(40)), ("small", "a.py", []))
    repos = spark.createDataFrame([("o", "big"), ("o", "small"), ("o", "none")], "owner string, name string")
    heads = repo_summary(sc, repos)
    f = sc.select("owner", "name", "path", F.inline_outer("findings")).filter("rule_id is not null")
    whole = rt.build_reports(heads, f)
    parts = rt.build_reports(heads, f, part_rows=30)
    assert whole.count() == 3 and parts.count() == 3 + 6
    assert max(len(r["findings"]) for r in parts.collect()) < 200
    rows = lambda r: sorted(tuple(x) for x in rt.report_rows(r).drop("scanners_used").collect())
    assert rows(whole) == rows(parts)
    from reposieve.sources.sinks import run_header

    assert run_header(parts, {}).first()["count"] == run_header(whole, {}).first()["count"] == 3
    per = lambda r: sorted(x["flagged"] for x in pf.flagged_per_repo(r).collect())
    assert per(whole) == per(parts)
    a, b = pf.merge_reports(whole), pf.merge_reports(parts)
    assert sorted(map(tuple, a.repos.select("repo", "files_scanned", "flagged").collect())) == sorted(
        map(tuple, b.repos.select("repo", "files_scanned", "flagged").collect()))
    unscanned = {r["name"]: r["classification"] for r in repo_summary(sc, repos, unscanned=True).collect()}
    assert unscanned == {"big": "Threat", "small": "Safe", "none": "Unscanned"}


# Stored run of 13 repositories: files, bytes, findings.
RUN = [(137, 3804580), (1, 34115), (7, 62309), (30, 281093), (11, 29645), (31, 248659), (8, 142671), (6, 42083), (0, 0),
       (0, 0), (1, 8156), (6, 46310), (0, 0)]


def golden_lines():
    def f(path, rule, sev="high", scanner="taint_risk"):
        return {"path": path, "scanner": scanner, "rule_id": rule, "severity": sev, "reason": rule}

    per = {
        0: [f("m/T.py", "py_file_op_tainted"), f("m/M.py", "py_file_op_tainted"), f("m/M.py", "py_subprocess_tainted"),
            f("l/D.py", "py_subprocess_tainted"), f("l/P.py", "py_file_op_tainted"), f("l/P.py", "py_file_op_tainted"),
            {**f("g/A.py", "high_entropy_candidate", "medium", "entropy_secrets"), "evidence": fixed.MASK}],
        3: [f("a.py", "py_file_op_tainted"), f("b.py", "py_file_op_tainted")],
        5: [f("a.py", "py_file_op_tainted"), f("b.py", "py_file_op_tainted")],
    }
    for i, (n, size) in enumerate(RUN):
        yield json.dumps({
            "session_id": f"batch-o{i}-r{i}", "started_at": "", "finished_at": f"2025-11-07T12:00:{i:02}.5+00:00",
            "repo": {"owner": f"o{i}", "name": f"r{i}", "ref": "main", "commit": "c" * 40},
            "stats": {"files_scanned": n, "bytes_scanned": size, "scanners_used": ["secrets"]},
            "findings": per.get(i, []), "classification": "Threat" if i in per else "Safe", "summary": "s",
            "policy_flags": [], "status": "ok"})


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "run.jsonl"
    path.write_text("\n".join(golden_lines()))
    return docs.read_reports(spark, str(path))


def test_golden_portfolio(golden):
    m = pf.merge_reports(golden)
    assert tuple(pf.portfolio_totals(m).first()) == (13, 238, 10, 23.08)
    assert tuple(pf.flagged_quantiles(m).first()) == (0.0, 6.0)
    assert [tuple(r) for r in pf.by_category(m).collect()] == [
        ("py_file_op_tainted", 7), ("py_subprocess_tainted", 2), ("high_entropy_candidate", 1)]
    assert [tuple(r) for r in pf.by_severity(m).collect()] == [("high", 9), ("medium", 1)]
    assert {tuple(r) for r in pf.category_share(m).collect()} == {
        ("py_file_op_tainted", 7, 70.0), ("py_subprocess_tainted", 2, 20.0), ("high_entropy_candidate", 1, 10.0)}
    assert [r["flagged"] for r in pf.top_repos(m).collect()] == [6, 2, 2, 0, 0]
    assert {(r["kind"], r["n"]) for r in pf.by_label(m).collect()} == {
        ("category", 7), ("category", 2), ("category", 1), ("severity", 9), ("severity", 1)}


def test_golden_rows_and_validation(golden):
    flagged = [r["flagged"] for r in pf.flagged_per_repo(golden).collect()]
    assert sorted(flagged, reverse=True)[:3] == [7, 2, 2] and len(flagged) == 13
    broken = {(r["field"], r["problem"]) for r in rt.validate_reports(golden).collect()}
    assert broken == {("started_at", "not a date-time")}


def test_empty_portfolio(golden):
    m = pf.merge_reports(golden.limit(0))
    assert tuple(pf.portfolio_totals(m).first()) == (0, 0, 0, 0.0)
    assert tuple(pf.flagged_quantiles(m).first()) == (0.0, 0.0)


def test_merge_keeps_newest_fields_and_globs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([
        '{"repo": {"full_name": "o/r", "html_url": "u1"}, "run": {"id": "x"}, "policy": {"include": ["b", "a"]}, "findings": [{"rule_id": "q", "line": 1}]}',
        '{"repo": {"full_name": "o/r", "commit": "c2"}, "run": {"id": "y"}, "policy": {"include": ["a", "c"]}, "findings": [{"line": 1, "rule_id": "q"}, {"rule_id": "q", "line": 2}, 7]}',
    ]))
    m = pf.merge_reports(docs.read_reports(spark, str(tmp_path)))
    r = m.repos.first()
    assert (r["repo"], r["repo_html_url"], r["repo_commit"], r["run_id"], r["flagged"]) == ("o/r", "u1", "c2", "y", 2)
    order = m.globs.filter("kind = 'include'").orderBy("first_seen").select("glob").collect()
    assert [g[0] for g in order] == ["b", "a", "c"]


def test_tolerant_loader(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"session_id": "doc", "findings": []}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps([{"session_id": "arr1"}, 3, {"session_id": "arr2"}], indent=1))
    (tmp_path / "c.jsonl").write_text(
        '{"session_id": "l1"}\n\n// note\n# {"session_id": "no"}\n{"session_id": "half"\n'
        "{'session_id': 'py', 'status': None, 'part': None}\n[{\"session_id\": \"l2\"}, 5]\n7\n\"text\"\n{\"session_id\": \"l3\"} tail\n")
    (tmp_path / "d.json").write_text(json.dumps({"query": "q", "results": [{"session_id": "r1"}, {"session_id": "r2"}]}))
    got = [r["session_id"] for r in docs.read_reports(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == ["doc", "arr1", "arr2", "l1", "py", "l2", "r1", "r2"]


def test_layouts_give_equal_rows_at_any_size(spark, tmp_path):
    """Split blocks are far smaller than the files, so documents span many of them."""
    reports = [dict(json.loads(x), session_id=f"s{i}-{k}") for k in range(20) for i, x in enumerate(golden_lines())]
    layouts = {
        "lines": "\n".join(map(json.dumps, reports)), "crlf": "// note\r\n" + "\r\n".join(map(json.dumps, reports)),
        "pretty": json.dumps(reports, indent=2), "one": json.dumps(reports), "run": json.dumps({"query": "q", "results": reports}, indent=1),
        "literals": "\n".join(map(repr, reports)),
    }
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for name, body in layouts.items():
            (tmp_path / name).mkdir()
            (tmp_path / name / "a.json").write_bytes(body.encode())
            rows = docs.read_reports(spark, str(tmp_path / name)).orderBy("pos").select("session_id", "classification").collect()
            assert [tuple(r) for r in rows] == [(r["session_id"], r["classification"]) for r in reports], name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_blank_names_fall_back(spark):
    rows = [("", "o", "n", None), ("a/b", "o", "n", None), ("", "", "n", "https://h/x/y"), (None, None, None, None)]
    frame = spark.createDataFrame(
        [(f"s{i}", "2025-01-01T00:00:00Z", r) for i, r in enumerate(rows)],
        "session_id string, finished_at string, repo struct<full_name:string,owner:string,name:string,html_url:string>",
    )
    names_ = {r["repo"] for r in pf.merge_reports(frame).repos.collect()}
    assert {"o/n", "a/b", "https://h/x/y"} <= names_ and "" not in names_


def test_pruning_at_every_depth(spark):
    from reposieve.sources.sinks import pruned_json

    df = spark.createDataFrame([(["x", None], {"k": None, "l": [None, 1]}, [{"a": None, "b": [None, "y"]}])],
                               "a array<string>, m map<string,array<int>>, s array<struct<a:string,b:array<string>>>")
    assert json.loads(df.select(pruned_json(df, "a", "m", "s")).first()[0]) == {"a": ["x"], "m": {"l": [1]}, "s": [{"b": ["y"]}]}


def test_date_times_and_items_are_checked(spark, golden):
    from pyspark.sql import functions as F

    one = golden.limit(1)
    for text, ok in (("2025-11-07T12:38:51Z", True), ("2025-11-07T12:38:51.5+01:00", True), ("2025", False), ("2025-01-01", False), ("2025-13-01T00:00:00Z", False)):
        bad = [r["field"] for r in rt.validate_reports(one.withColumn("finished_at", F.lit(text)).withColumn("started_at", F.lit(text))).collect()]
        assert ("finished_at" not in bad) == ok, text
    item = one.withColumn("stats", F.col("stats").withField("scanners_used", F.array(F.lit(None).cast("string"))))
    assert ("stats.scanners_used", "missing item") in {(r["field"], r["problem"]) for r in rt.validate_reports(item).collect()}


def test_raw_json_is_judged_before_it_is_cast(spark):
    good = {"session_id": "s", "started_at": "2025-01-01T00:00:00Z", "finished_at": "2025-01-01T00:00:01Z",
            "repo": {"owner": "o", "name": "n", "ref": "r", "commit": "c"},
            "stats": {"files_scanned": 1, "bytes_scanned": 2.0, "scanners_used": ["a"]},
            "findings": [{"path": "p", "scanner": "s", "rule_id": "r", "severity": "low", "reason": "x"}],
            "classification": "Safe", "summary": "fine", "policy_flags": [], "more": 1}

    def changed(path, value=None, drop=False):
        doc = json.loads(json.dumps(good))
        *above, key = path.split(".")
        at = doc
        for part in above:
            at = at[int(part)] if part.isdigit() else at[part]
        at.pop(key) if drop else at.__setitem__(key, value)
        return json.dumps(doc)

    cases = [
        (json.dumps(good), []), ("[1]", [("", "not an object")]), ("{", [("", "not an object")]), (None, [("", "not an object")]),
        (changed("stats.files_scanned", "3"), [("stats.files_scanned", "not an integer")]),
        (changed("stats.files_scanned", 1.5), [("stats.files_scanned", "not an integer")]),
        (changed("session_id", 7), [("session_id", "not a string")]), (changed("session_id", None), [("session_id", "not a string")]),
        (changed("summary", drop=True), [("summary", "missing")]), (changed("repo", "o/n"), [("repo", "not an object")]),
        (changed("repo.ref", drop=True), [("repo.ref", "missing")]), (changed("findings", {}), [("findings", "not an array")]),
        (changed("findings", [3]), [("findings", "item not an object")]), (changed("findings.0.path", 1), [("findings.path", "not a string")]),
        (changed("findings.0.severity", "severe"), [("findings.severity", "not allowed")]),
        (changed("findings.0.evidence", []), [("findings.evidence", "not a string")]),
        (changed("findings.0.reason", drop=True), [("findings.reason", "missing")]),
        (changed("started_at", "yesterday"), [("started_at", "not a date-time")]), (changed("started_at", 5), [("started_at", "not a date-time")]),
        (changed("classification", "Error"), [("classification", "not allowed")]),
        (changed("stats.scanners_used", ["a", 1]), [("stats.scanners_used", "item not a string")]),
        (changed("policy_flags", "x"), [("policy_flags", "not an array")]), (changed("policy_flags", drop=True), []),
    ]
    items = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "pos int, item string")
    got = {}
    for r in rt.validate_json(items).collect():
        got.setdefault(r["pos"], []).append((r["field"], r["problem"]))
    assert got == {k: want for k, (_, want) in enumerate(cases) if want}


def test_damaged_member_costs_only_itself(spark, tmp_path):
    path = tmp_path / "own__repo.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(5):
            z.writestr(f"r/f{i}.py", f"x = {i}")
    body = bytearray(path.read_bytes())
    at = body.index(b"x = 1")
    body[at:at + 5] = b"y = 1"  # the checksum no longer fits
    path.write_bytes(body)
    files, errors = fs.read_archives(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["f0.py", "f2.py", "f3.py", "f4.py"]
    assert errors.count() == 1


def test_repo_lists(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([
        {"owner": "a", "name": "x", "stargazers_count": 5}, {"owner": "b", "name": "y", "default_branch": "dev"},
        {"owner": "a", "name": "x", "stargazers_count": 9}]))
    r = docs.read_repos(spark, str(tmp_path))
    assert [tuple(x)[1:] for x in r.orderBy("pos").collect()][1] == ("b", "y", "b/y", "https://github.com/b/y", 0, "dev")
    per = spark.createDataFrame([("a", "x"), ("q", "z")], "owner string, name string")
    assert {(x["name"], x["stars"]) for x in rp.with_stars(per, r).collect()} == {("x", 9), ("z", 0)}
    (tmp_path / "seen").mkdir()
    (tmp_path / "seen" / "1.json").write_text(json.dumps({"results": [{"repo": {"owner": "a", "name": "x"}}], "repos": [{"owner": "", "name": "n"}]}))
    seen = rp.seen_keys(docs.read_runs(spark, str(tmp_path / "seen")))
    assert [tuple(x) for x in seen.collect()] == [("a", "x")]
    assert {x["name"] for x in rp.skip_seen(r, seen).collect()} == {"y"}


def test_search_pages(spark):
    r = spark.createDataFrame([(f"o/r{i:02}", i) for i in range(30)], "full_name string, stargazers_count int").select(
        F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("name"), "full_name",
        F.lit(None).cast("string").alias("html_url"), "stargazers_count", F.lit(None).cast("string").alias("default_branch"))
    stars = lambda **k: sorted((x["stargazers_count"] for x in rp.search_repos(r, **k).collect()), reverse=True)
    assert stars(per_page=5, page_start=2) == [24, 23, 22, 21, 20]
    assert stars(per_page=5, pages=2, page_start=0) == [29, 28, 27, 26, 25]
    assert stars(per_page=5, pages=9, min_stars=27) == [29, 28, 27]
    assert stars(per_page=0, pages=3, max_results=2) == [29, 28] and len(stars(per_page=500)) == 30


@pytest.mark.parametrize("parts", [1, 5])
def test_numbering_is_a_total_order(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(parts)
    got = number_rows(df, [F.col("v").desc()], "n").collect()
    assert sorted((r["n"], r["v"]) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    assert skip_first(df, [F.col("v")], 990).count() == 10 and skip_first(df, [F.col("v")], 0).count() == 1000


def test_archives_and_trees(spark, tmp_path):
    good = tmp_path / "z" / "own__repo.zip"
    good.parent.mkdir()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("repo-abc/", b"")
        z.writestr("repo-abc/src/a.py", b"x = '\xff\xc3\xa9'")
        z.writestr("top.txt", b"t")
        z.writestr("repo-abc/big.bin", b"0" * 2000)
    (tmp_path / "z" / "own__bad.zip").write_bytes(b"PK not a zip")
    files, errors = fs.read_archives(spark, str(tmp_path / "z"), max_bytes=1000)
    got = sorted((r["owner"], r["name"], r["path"], r["length"], r["content"]) for r in files.collect())
    assert got == [("own", "repo", "big.bin", 2000, None), ("own", "repo", "src/a.py", 9, "x = 'é'"), ("own", "repo", "top.txt", 1, "t")]
    assert [(r["owner"], r["name"]) for r in errors.collect()] == [("own", "bad")]
    root = tmp_path / "tree"
    for p, b in {"o/r/src/a.py": b"\xef\xbf\xbdok\xff", "o/r/src/b.bin": b"1", "o/r/big.py": b"0" * 50, "o/x.py": b"1"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b)
    tree = fs.read_tree(spark, str(root), max_bytes=40)
    assert [tuple(r) for r in tree.collect()] == [("o", "r", "src/a.py", 6, "�ok")]


def test_ignore_file(spark, tmp_path):
    (tmp_path / "ignore").write_text("  **/a/** \n\n# no\n\tb/*\n")
    assert fs.read_ignore(spark, str(tmp_path / "ignore")) == ["**/a/**", "b/*"]
    assert fs.read_ignore(spark, str(tmp_path / "missing")) == []


def test_written_reports_read_back(spark, golden, tmp_path):
    log, run = str(tmp_path / "log"), str(tmp_path / "run")
    sinks.write_report_log(golden.drop("pos"), log)
    sinks.write_report_log(golden.drop("pos"), log)
    back = docs.read_reports(spark, log)
    assert back.count() == 26
    m = pf.merge_reports(back)
    assert tuple(pf.portfolio_totals(m).first()) == (13, 476, 10, 23.08)
    assert '"code_span"' not in spark.read.text(log).first()[0]
    sinks.write_reports(golden.drop("pos"), str(tmp_path / "byowner"))
    assert spark.read.text(str(tmp_path / "byowner")).select("owner").distinct().count() == 13
    repos = spark.createDataFrame([("o1/r1", 3)], "full_name string, stargazers_count int")
    board = rt.leaderboard(rt.report_rows(golden), repos)
    sinks.write_run(repos, board, golden.drop("pos"), {"query": "q", "pages": 1}, run)
    assert spark.read.json(f"{run}/run").first().asDict() == {"query": "q", "pages": 1, "count": 13}
    assert docs.read_reports(spark, f"{run}/sections/section=results").count() == 13
    assert [r["findings"] for r in board.orderBy("rank").take(3)] == [7, 2, 2]


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")


def test_report_texts_are_not_searched_for_each_finding(spark):
    from reposieve import catalog

    catalog.load()
    plan = catalog.QUERIES["snk2_report_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, _ = plan.split("Generate explode", 1)
    assert "get_json_object" not in above and "value" not in above
