"""Report, repository-list and portfolio queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposieve import corpus
from reposieve import oracle as o
from reposieve.catalog import query
from reposieve.operators import repos as rp
from reposieve.plans import portfolio as pf
from reposieve.plans import reports as rt
from reposieve.plans.scan import classify, findings_of, repo_summary, scan, scan_files
from reposieve.session import reliable, shared_folder, spread
from reposieve.sources import documents as docs
from reposieve.sources import sinks

LONG = "bigint"


def summary(spark, sf) -> DataFrame:
    return repo_summary(scan_files(corpus.files(spark, sf)), corpus.repos(spark, sf))


def reports(spark, sf, part_rows: int = rt.PART_ROWS) -> DataFrame:
    """Report documents of the corpus. The scan is materialised: two branches read it."""
    scanned = reliable(scan_files(corpus.files(spark, sf)))
    heads = repo_summary(scanned, corpus.repos(spark, sf))
    return rt.build_reports(
        heads, findings_of(scanned), started_at=F.lit("2025-01-01T00:00:00Z"),
        finished_at=F.lit("2025-01-01T00:01:30Z"), commit=F.sha1(F.col("name").cast("binary")), part_rows=part_rows,
    )


def rescanned(spark, sf) -> DataFrame:
    """The reports of two runs over the same repositories."""
    return reports(spark, sf, part_rows=30).withColumn(
        "session_id", F.explode(F.array(F.lit("run-a"), F.lit("run-b")))
    )


def merged(spark, sf) -> pf.Merged:
    return pf.merge_reports(rescanned(spark, sf))


SHA = "sha1(name)"
DISTINCT = "dis AS (SELECT DISTINCT owner, name, path, scanner, rule_id, severity, reason, evidence FROM fnd)"
COUNTS = """cnt AS (SELECT s.owner, s.name, s.files_scanned, COALESCE(d.n, 0) AS flagged
  FROM summary s LEFT JOIN (SELECT owner, name, count(*) AS n FROM dis GROUP BY ALL) d USING (owner, name))"""
MERGED = o.with_(o.FILES, o.SELECTED, o.FINDINGS, o.REPOS, o.SUMMARY.strip(), DISTINCT, COUNTS)


@query("ag2_classify", o.REPORTS + "SELECT owner, name, findings, classification, summary FROM summary")
def ag2(spark, sf):
    return classify(scan(corpus.files(spark, sf)), corpus.repos(spark, sf))


@query("ag2_repo_summary", o.REPORTS + "SELECT * FROM summary")
def ag2b(spark, sf):
    return summary(spark, sf).drop("scanners_used")


_AS_JSON = """array_to_string(list_sort(list(concat_ws('|', path, scanner, rule_id, severity, reason, COALESCE(evidence, '-')))), ';')"""


@query("ag3_build_reports", o.REPORTS + f"""
SELECT concat('batch-', s.owner, '-', s.name) AS session_id, s.owner, s.name, {SHA.replace('name', 's.name')} AS commit,
       s.files_scanned, s.bytes_scanned, s.classification, s.summary, COALESCE(md5(f.body), md5('')) AS body
FROM summary s LEFT JOIN (SELECT owner, name, {_AS_JSON} AS body FROM fnd GROUP BY ALL) f USING (owner, name)""")
def ag3(spark, sf):
    body = F.transform("findings", lambda x: F.concat_ws(
        "|", *(x[c] for c in rt.FINDING[:-1]), F.coalesce(x["evidence"], F.lit("-"))))
    return reports(spark, sf).select(
        "session_id", "repo.owner", "repo.name", "repo.commit", "stats.files_scanned", "stats.bytes_scanned",
        "classification", "summary", F.md5(F.array_join(F.array_sort(body), ";").cast("binary")).alias("body"))


@query("ag3_report_parts", o.REPORTS + "SELECT owner, name, files_scanned, bytes_scanned, findings, classification FROM summary")
def ag3b(spark, sf):
    """Reports in parts of about 20 findings add up to the whole."""
    rows = rt.report_rows(reports(spark, sf, part_rows=20))
    return rows.select("owner", "name", "files_scanned", "bytes_scanned", F.col("findings").cast(LONG).alias("findings"),
                       "classification")


@query("ag4_merge_reports", MERGED + """
SELECT concat(owner, '/', name) AS repo, 2 * files_scanned AS files_scanned, flagged FROM cnt""")
def ag4(spark, sf):
    return merged(spark, sf).repos.select("repo", F.col("files_scanned"), "flagged")


@query("ag5_distinct_findings", MERGED + """
SELECT concat(owner, '/', name) AS repo_key, path, scanner, rule_id, severity, reason, evidence FROM dis""")
def ag5(spark, sf):
    return merged(spark, sf).findings.drop("code_span", "extra")


def legacy(spark, sf) -> DataFrame:
    """Documents as legacy records: flags instead of findings, some with neither."""
    k = F.col("doc_id") % 4
    flag = F.struct(
        F.when(k == 0, F.col("lang")).alias("category"), F.lit("old_rule").alias("rule_id"),
        F.when(k != 1, F.lit("low")).alias("severity"))
    new = F.struct(F.lit("a.py").alias("path"), F.lit("secrets").alias("scanner"), F.lit("new_rule").alias("rule_id"),
                   F.lit("high").alias("severity"), F.col("lang").alias("reason"))
    stats = F.struct(
        F.when(k != 2, F.col("n_chars")).alias("files_scanned"), F.lit(7).cast(LONG).alias("flagged_count"),
        F.lit(2).cast(LONG).alias("safe_count"))
    d = corpus.table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("doc-"), "doc_id").alias("session_id"), F.col("doc_id").alias("pos"),
        F.struct(F.concat(F.lit("legacy/"), "source", F.lit("-"), k.cast("string")).alias("full_name")).alias("repo"),
        stats.alias("stats"),
        F.when(k.isin(0, 1), F.array(flag)).alias("flags"), F.when(k == 3, F.array(new)).alias("findings"))


@query("ag6_flagged_count", """
SELECT concat('legacy/', source, '-', CAST(doc_id % 4 AS VARCHAR)) AS repo_key,
  CASE doc_id % 4 WHEN 2 THEN 2 * count(*) ELSE CAST(sum(n_chars) AS BIGINT) END AS files_scanned,
  CASE doc_id % 4 WHEN 0 THEN count(DISTINCT lang) WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE count(DISTINCT lang) END AS flagged_count
FROM documents GROUP BY source, doc_id % 4""")
def ag6(spark, sf):
    m = pf.merge_reports(legacy(spark, sf))
    return m.repos.select("repo_key", "files_scanned", "flagged_count")


@query("ag11_flagged_per_repo", """
SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS session_id, CAST(CASE doc_id % 4 WHEN 2 THEN 7 ELSE 1 END AS BIGINT) AS flagged FROM documents""")
def ag11(spark, sf):
    return pf.flagged_per_repo(legacy(spark, sf)).select("session_id", "flagged")


@query("ag7_portfolio_totals", MERGED + """
SELECT count(*) AS total_repositories, CAST(2 * sum(files_scanned) AS BIGINT) AS total_files_scanned,
       CAST(sum(flagged) AS BIGINT) AS total_flagged_files,
       round_even(100.0 * count(*) FILTER (flagged > 0) / count(*), 2) AS percent_repos_with_findings FROM cnt""")
def ag7(spark, sf):
    return pf.portfolio_totals(merged(spark, sf))


@query("ag8_flagged_quantiles", MERGED + """
SELECT CAST(quantile_disc(flagged, 0.5) AS DOUBLE) AS median_flagged_per_repo,
       CAST(quantile_disc(flagged, 0.95) AS DOUBLE) AS p95_flagged_per_repo FROM cnt""")
def ag8(spark, sf):
    return pf.flagged_quantiles(merged(spark, sf))


@query("ag9_by_category", MERGED + "SELECT rule_id AS category, count(*) AS n FROM dis GROUP BY ALL")
def ag9(spark, sf):
    return pf.by_category(merged(spark, sf))


@query("ag9_by_category_legacy", """
SELECT category, count(*) AS n FROM (
  SELECT DISTINCT source, doc_id % 4 AS k, CASE WHEN doc_id % 4 = 0 THEN lang END AS l,
         CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN 'old_rule' ELSE 'new_rule' END AS category,
         CASE WHEN doc_id % 4 = 3 THEN lang END AS reason
  FROM documents WHERE doc_id % 4 <> 2) GROUP BY ALL""")
def ag9b(spark, sf):
    return pf.by_category(pf.merge_reports(legacy(spark, sf), legacy_flags=True), legacy_flags=True)


@query("ag10_by_severity", MERGED + "SELECT severity, count(*) AS n FROM dis GROUP BY ALL")
def ag10(spark, sf):
    return pf.by_severity(merged(spark, sf))


@query("ag10_by_label", MERGED + """
SELECT 'category' AS kind, rule_id AS label, count(*) AS n FROM dis GROUP BY ALL
UNION ALL SELECT 'severity', severity, count(*) FROM dis GROUP BY ALL""")
def ag10b(spark, sf):
    return pf.by_label(merged(spark, sf))


@query("ag12_rule_counts", o.SCAN + "SELECT rule_id, count(*) AS n FROM fnd GROUP BY ALL ORDER BY n DESC, rule_id LIMIT 10")
def ag12(spark, sf):
    return pf.rule_counts(scan(corpus.files(spark, sf)))


@query("ag13_entropy_paths", o.SCAN + """
SELECT path, count(*) AS n FROM fnd WHERE rule_id = 'high_entropy_candidate' GROUP BY ALL ORDER BY n DESC, path LIMIT 30""")
def ag13(spark, sf):
    return pf.entropy_paths(scan(corpus.files(spark, sf)))


@query("ag14_ext_distribution", o.SCAN + """
SELECT lower(list_extract(string_split(path, '.'), -1)) AS ext, count(*) AS n FROM fnd
WHERE rule_id = 'high_entropy_candidate' GROUP BY ALL ORDER BY n DESC, ext LIMIT 10""")
def ag14(spark, sf):
    return pf.ext_distribution(scan(corpus.files(spark, sf)))


@query("ag15_category_share", MERGED + """
SELECT rule_id AS category, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM dis GROUP BY ALL""")
def ag15(spark, sf):
    return pf.category_share(merged(spark, sf))


@query("wn4_severity_share", MERGED + """
SELECT severity, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM dis GROUP BY ALL""")
def wn4(spark, sf):
    return pf.category_share(merged(spark, sf), "severity")


@query("ag16_findings_count", o.REPORTS + "SELECT owner, name, findings FROM summary")
def ag16(spark, sf):
    rows = rt.report_rows(reports(spark, sf))
    return rows.select("owner", "name", F.col("findings").cast(LONG).alias("findings"))


_RANK = "CASE classification WHEN 'Threat' THEN 3 WHEN 'Potential Threat' THEN 2 ELSE 1 END"


@query("wn1_leaderboard", o.REPORTS + f"""
SELECT row_number() OVER (ORDER BY findings DESC, {_RANK} DESC, stars DESC, owner, name) AS rank, * FROM (
  SELECT s.owner, s.name, r.stargazers_count AS stars, classification, findings, files_scanned, bytes_scanned
  FROM summary s JOIN repos r USING (owner, name))""")
def wn1(spark, sf):
    return rt.leaderboard(summary(spark, sf), corpus.repos(spark, sf))


@query("wn3_assign_batches", o.with_(o.REPOS) + """
SELECT full_name, CAST(floor((row_number() OVER (ORDER BY full_name) - 1) / 7) + 1 AS BIGINT) AS batch FROM repos""")
def wn3(spark, sf):
    return rp.assign_batches(corpus.repos(spark, sf), 7).select("full_name", "batch")


@query("tk1_search_paging", o.with_(o.REPOS) + """
SELECT owner, name, full_name, stargazers_count AS stars FROM (
  SELECT * FROM (SELECT * FROM repos ORDER BY stargazers_count DESC, full_name LIMIT 45 OFFSET 15) WHERE stargazers_count >= 30
  ORDER BY stargazers_count DESC, full_name LIMIT 40)""")
def tk1(spark, sf):
    page = rp.search_repos(corpus.repos(spark, sf), per_page=15, pages=3, page_start=2, min_stars=30, max_results=40)
    return page.select("owner", "name", "full_name", F.col("stargazers_count").alias("stars"))


@query("flt12_search_filters", o.with_(o.REPOS) + """
SELECT split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS name, stargazers_count AS stars
FROM (SELECT * FROM repos ORDER BY stargazers_count DESC, full_name LIMIT 100) WHERE stargazers_count >= 50""")
def flt12(spark, sf):
    bare = corpus.repos(spark, sf).withColumns({"owner": F.lit(None).cast("string"), "name": F.lit(None).cast("string")})
    page = rp.search_repos(bare, per_page=500, min_stars=50)
    return page.select("owner", "name", F.col("stargazers_count").alias("stars"))


@query("tk2_resume", o.with_(o.REPOS) + "SELECT full_name FROM repos ORDER BY full_name OFFSET 25")
def tk2(spark, sf):
    return rp.resume(corpus.repos(spark, sf), 25).select("full_name")


@query("tk3_top_repos", MERGED + """
SELECT concat(owner, '/', name) AS repo, flagged FROM cnt ORDER BY flagged DESC, repo LIMIT 5""")
def tk3(spark, sf):
    return pf.top_repos(merged(spark, sf))


@query("tk4_top_findings", o.SCAN + """
SELECT owner, name, path, rule_id, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY owner, name ORDER BY path, scanner, rule_id, reason, evidence) AS p FROM fnd) WHERE p <= 10""")
def tk4(spark, sf):
    return rt.top_findings(scan(corpus.files(spark, sf))).select("owner", "name", "path", "rule_id", "severity")


@query("tk5_repo_list", o.with_(o.REPOS) + """
SELECT row_number() OVER (ORDER BY full_name) AS pos, full_name AS repository, stargazers_count AS stars, html_url AS url FROM repos""")
def tk5(spark, sf):
    return rp.repo_list(corpus.repos(spark, sf))


def runs(spark, sf) -> DataFrame:
    """Three shapes of earlier output: bare rows, results and a repository list."""
    r = corpus.repos(spark, sf)
    key = F.struct("owner", "name")
    shape = lambda o_, n, res, rep: (o_.alias("owner"), n.alias("name"), res.alias("results"), rep.alias("repos"))
    no = F.lit(None).cast("string")
    no_res = F.lit(None).cast("array<struct<repo:struct<owner:string,name:string>>>")
    no_rep = F.lit(None).cast("array<struct<owner:string,name:string>>")
    s = F.col("stargazers_count")
    return (
        r.filter(s < 500).select(*shape(F.col("owner"), F.col("name"), no_res, no_rep))
        .unionByName(r.filter(s.between(300, 2000)).select(*shape(no, no, F.array(F.struct(key.alias("repo"))), no_rep)))
        .unionByName(r.filter(s.between(4000, 6000)).select(*shape(no, no, no_res, F.array(key))))
    )


@query("jn1_skip_seen", o.with_(o.REPOS) + """
SELECT full_name FROM repos WHERE NOT (stargazers_count <= 2000 OR stargazers_count BETWEEN 4000 AND 6000)""")
def jn1(spark, sf):
    return rp.skip_seen(corpus.repos(spark, sf), rp.seen_keys(runs(spark, sf))).select("full_name")


@query("ste1_seen_keys", o.with_(o.REPOS) + """
SELECT owner, name FROM repos WHERE stargazers_count <= 2000 OR stargazers_count BETWEEN 4000 AND 6000""")
def ste1(spark, sf):
    return rp.seen_keys(runs(spark, sf))


@query("jn2_with_stars", o.with_(o.FILES, o.REPOS) + """
SELECT f.owner, f.name, count(*) AS files, COALESCE(max(r.stargazers_count), 0) + 1 AS stars
FROM (SELECT owner, CASE WHEN k = 16 THEN concat(name, '-x') ELSE name END AS name FROM files) f
LEFT JOIN repos r ON concat(f.owner, '/', f.name) = r.full_name GROUP BY ALL""")
def jn2(spark, sf):
    """Stars of the last entry of each repeated name; unknown names get 0."""
    r = corpus.repos(spark, sf)
    listed = r.withColumn("pos", F.lit(1)).unionByName(
        r.withColumns({"pos": F.lit(2), "stargazers_count": F.col("stargazers_count") + 1}))
    name = F.when(F.col("k") == 16, F.concat("name", F.lit("-x"))).otherwise(F.col("name"))
    per = corpus.files(spark, sf).withColumn("name", name).groupBy("owner", "name").agg(F.count(F.lit(1)).alias("files"))
    known = rp.with_stars(per, listed)
    unknown = F.col("name").endswith("-x")
    return known.withColumn("stars", F.when(unknown, F.col("stars") + 1).otherwise(F.col("stars")))


@query("prj1_scan_summary", o.REPORTS + f"""
SELECT owner, name, {SHA} AS commit, files_scanned, bytes_scanned, classification, summary, findings AS findings_count FROM summary""")
def prj1(spark, sf):
    s = rt.scan_summary(rt.report_rows(reports(spark, sf)))
    return s.select("repo.owner", "repo.name", "repo.commit", "stats.files_scanned", "stats.bytes_scanned",
                    "classification", "summary", F.col("findings_count").cast(LONG).alias("findings_count"))


@query("prj2_format_summary", o.REPORTS + """
SELECT owner, name, concat('Scan complete for **', owner, '/', name, '** @ **main**', chr(10), '- Files scanned: ', files_scanned,
  chr(10), '- Bytes scanned: ', bytes_scanned, chr(10), '- Findings: ', findings, chr(10), '- Classification: **', classification,
  '**', chr(10), '- Summary: ', summary) AS text FROM summary""")
def prj2(spark, sf):
    return rt.format_summary(rt.scan_summary(rt.report_rows(reports(spark, sf))))


@query("prj3_terminal_summary", o.REPORTS + f"""
SELECT concat('batch-', owner, '-', name) AS session_id, concat(owner, '/', name, ' @ main (', substr({SHA}, 1, 7), ')') AS repo,
  files_scanned, bytes_scanned, classification, summary, {o.SCANNERS} AS scanners, findings AS flagged FROM summary""")
def prj3(spark, sf):
    rows = rt.terminal_summary(rt.report_rows(reports(spark, sf)))
    return rows.withColumn("flagged", F.col("flagged").cast(LONG))


@query("val1_validate_reports", """
SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS session_id, field, problem FROM (SELECT doc_id, unnest([
   CASE WHEN doc_id % 5 = 0 THEN {'field': 'started_at', 'problem': 'not a date-time'} END,
   CASE WHEN doc_id % 7 = 0 THEN {'field': 'classification', 'problem': 'not allowed'} END,
   CASE WHEN doc_id % 3 = 0 THEN {'field': 'findings.severity', 'problem': 'not allowed'} END,
   CASE WHEN doc_id % 11 = 0 THEN {'field': 'findings.reason', 'problem': 'missing'} END,
   CASE WHEN doc_id % 2 = 0 THEN {'field': 'summary', 'problem': 'missing'} END,
   CASE WHEN doc_id % 13 = 0 THEN {'field': 'repo.commit', 'problem': 'missing'} END], recursive := true) FROM documents)
WHERE field IS NOT NULL""")
def val1(spark, sf):
    i = F.col("doc_id")
    t = F.lit("2025-01-01T00:00:00Z")
    finding = F.struct(
        F.lit("a.py").alias("path"), F.lit("secrets").alias("scanner"), F.lit("r").alias("rule_id"),
        F.when(i % 3 == 0, "severe").otherwise(F.lit("high")).alias("severity"),
        F.when(i % 11 != 0, F.col("lang")).alias("reason"))
    r = corpus.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), i.cast("string")).alias("session_id"),
        F.when(i % 5 == 0, "").otherwise(t).alias("started_at"), t.alias("finished_at"),
        F.struct(F.col("lang").alias("owner"), F.col("source").alias("name"), F.lit("main").alias("ref"),
                 F.when(i % 13 != 0, "c0ffee").alias("commit")).alias("repo"),
        F.struct(F.lit(1).alias("files_scanned"), F.col("n_chars").alias("bytes_scanned"),
                 F.array(F.lit("secrets")).alias("scanners_used")).alias("stats"),
        F.array(finding).alias("findings"),
        F.when(i % 7 == 0, "Error").otherwise("Threat").alias("classification"),
        F.when(i % 2 != 0, F.col("source")).alias("summary"))
    return rt.validate_reports(r)


@query("val1_validate_json", """
SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS session_id, field, problem FROM (SELECT doc_id, unnest([
   CASE WHEN doc_id % 3 = 0 THEN {'field': 'stats.files_scanned', 'problem': 'not an integer'} END,
   CASE WHEN doc_id % 5 = 0 THEN {'field': 'summary', 'problem': 'missing'} END,
   CASE WHEN doc_id % 5 = 1 THEN {'field': 'summary', 'problem': 'not a string'} END,
   CASE WHEN doc_id % 7 = 0 THEN {'field': 'repo', 'problem': 'not an object'} END,
   CASE WHEN doc_id % 11 = 0 THEN {'field': 'findings.reason', 'problem': 'not a string'} END], recursive := true) FROM documents)
WHERE field IS NOT NULL""")
def val1_json(spark, sf):
    """Reports with values of wrong types, as text."""
    i = F.col("doc_id")
    quoted = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.lit(1 << 30))
    text = lambda c: F.regexp_replace(quoted(c), r"\}\z", "")
    repo = F.when(i % 7 == 0, F.lit('"o/n"')).otherwise(
        F.concat(F.lit('{"owner": "o", "name": '), text(F.col("source")), F.lit(', "ref": "main", "commit": "c0ffee"}')))
    files = F.when(i % 3 == 0, F.lit('"1"')).otherwise(F.lit("1"))
    reason = F.when(i % 11 == 0, F.lit("[]")).otherwise(text(F.col("text")))
    summary = F.when(i % 5 == 0, F.lit("")).when(i % 5 == 1, F.lit(', "summary": null')).otherwise(F.lit(', "summary": "x"'))
    item = F.concat(
        F.lit('{"session_id": "doc-'), i.cast("string"), F.lit('", "started_at": "2025-01-01T00:00:00Z", "finished_at": "2025-01-01T00:00:00Z", "repo": '),
        repo, F.lit(', "stats": {"files_scanned": '), files, F.lit(', "bytes_scanned": 2, "scanners_used": []}, "findings": [{"path": "p", "scanner": "s", '
        '"rule_id": "r", "severity": "low", "reason": '), reason, F.lit('}], "classification": "Safe"'), summary, F.lit("}"))
    docs_ = corpus.table(spark, sf, "documents").select(i.alias("pos"), item.alias("item"))
    return rt.validate_json(docs_).select("session_id", "field", "problem")


@query("snk1_report_log", o.REPORTS + "SELECT owner, name, files_scanned, findings, classification FROM summary")
def snk1(spark, sf):
    """Reports written as JSON lines and read back by the tolerant reader's parser."""
    lines = sinks.report_json(reports(spark, sf)).select(F.lit(0).alias("pos"), F.col("value").alias("text"))
    back = docs.parse_reports(docs.items_of_lines(lines))
    return back.select("repo.owner", "repo.name", "stats.files_scanned",
                       F.array_size("findings").cast(LONG).alias("findings"), "classification")


@query("snk2_report_json", o.REPORTS + """
SELECT owner, json_extract_string(j, '$.name') AS name, json_extract_string(j, '$.evidence') AS evidence, count(*) AS n FROM (
  SELECT owner, json_object('name', name, 'evidence', evidence) AS j FROM fnd) GROUP BY ALL""")
def snk2(spark, sf):
    """Findings as they stand in the written JSON: NULL evidence has no key."""
    lines = sinks.report_json(reports(spark, sf))
    name = F.get_json_object("value", "$.repo.name").alias("name")
    items = F.from_json(F.get_json_object("value", "$.findings"), "array<map<string,string>>").alias("items")
    # What stands beside a generator is evaluated for each row it makes: the name is taken from the text before.
    flat = lines.select("owner", name, items).select("owner", "name", F.explode_outer("items").alias("f")).filter(F.col("f").isNotNull())
    evidence = F.try_element_at("f", F.lit("evidence")).alias("evidence")
    return flat.groupBy("owner", "name", evidence).agg(F.count(F.lit(1)).alias("n"))


@query("snk3_run_sections", o.REPORTS + """
SELECT 'repos' AS section, full_name AS repo, CAST(stargazers_count AS BIGINT) AS n FROM repos
UNION ALL SELECT 'leaderboard', concat(owner, '/', name), findings FROM summary
UNION ALL SELECT 'results', concat(owner, '/', name), files_scanned FROM summary""")
def snk3(spark, sf):
    repos = corpus.repos(spark, sf)
    rep = reliable(reports(spark, sf))
    rows = rt.report_rows(rep)
    lines = sinks.run_lines(repos, rt.leaderboard(rows, repos), rep)
    get = lambda p: F.get_json_object("value", p)
    repo = F.concat_ws("/", F.coalesce(get("$.owner"), get("$.repo.owner")), F.coalesce(get("$.name"), get("$.repo.name")))
    n = F.coalesce(get("$.stargazers_count"), get("$.findings"))
    n = F.when(F.col("section") == "results", get("$.stats.files_scanned")).otherwise(n)
    return lines.select("section", repo.alias("repo"), n.cast(LONG).alias("n"))


@query("snk4_batch_index", o.with_(o.REPOS) + """
SELECT DISTINCT full_name AS repo, concat(owner, '__', name, '.md') AS path,
  concat('- **', full_name, '** → [', owner, '__', name, '.md](', owner, '__', name, '.md)') AS line FROM repos""")
def snk4(spark, sf):
    from reposieve.functions.names import safe_report_filename

    r = corpus.repos(spark, sf)
    written = r.unionByName(r).select(F.col("full_name").alias("repo"), safe_report_filename(F.col("full_name")).alias("path"))
    return pf.batch_index(written)


@query("stu2_union_of_inputs", o.REPORTS + """
SELECT owner, name, 'ok' AS status, files_scanned FROM summary
UNION ALL SELECT owner, name, 'error', 0 FROM (SELECT DISTINCT owner, name FROM repos)""")
def stu2(spark, sf):
    failed = corpus.repos(spark, sf).select("owner", "name", F.lit("boom").alias("message")).distinct()
    both = rt.all_of([reports(spark, sf), rt.error_reports(failed).drop("part")])
    return both.select("repo.owner", "repo.name", "status", "stats.files_scanned")


@query("udf4_error_reports", o.with_(o.REPOS) + """
SELECT owner, name, 'Error' AS classification, concat('Scan error: no archive for ', name) AS summary, 'error' AS status FROM repos""")
def udf4(spark, sf):
    failed = corpus.repos(spark, sf).select("owner", "name", F.concat(F.lit("no archive for "), "name").alias("message"))
    return rt.error_reports(failed).select("repo.owner", "repo.name", "classification", "summary", "status")


@query("std1_distinct", MERGED + "SELECT rule_id, severity, count(*) AS n, count(DISTINCT path) AS paths FROM dis GROUP BY ALL")
def std1(spark, sf):
    return merged(spark, sf).findings.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"))


@query("snk3_run_header", o.REPORTS + "SELECT 'q' AS query, count(*) AS count FROM summary")
def snk3_run_header(spark, sf):
    """The header counts reports, however many parts they are stored in."""
    return sinks.run_header(reports(spark, sf, part_rows=20), {"query": "q"})


def _framed(before: str, after: str, n: int):
    """Documents of up to ``n`` JSON texts each, between ``before`` and ``after``; without a shuffle."""

    def run(batches):
        import pyarrow as pa

        def document(texts):
            return pa.RecordBatch.from_arrays([pa.array([before + ",\n".join(texts) + after], pa.string())], names=["value"])

        held = []
        for batch in batches:
            texts = batch.column(0)
            while len(texts):
                more = n - len(held)
                held += texts[:more].to_pylist()
                texts = texts[more:]
                if len(held) == n:
                    yield document(held)
                    held = []
        if held:
            yield document(held)

    return run


@query("src5_read_documents", """
SELECT concat(layout, '-', CAST(doc_id AS VARCHAR)) AS session_id, CASE WHEN doc_id % 3 = 0 THEN 'Threat' ELSE 'Safe' END AS classification, text AS summary
FROM documents, (SELECT unnest(['line', 'array', 'run', 'literal']) AS layout)""")
def src5_read_documents(spark, sf):
    """Reports landed as packed lines, arrays over many lines, aggregate documents and literals, through the reader.

    The landed files stay: the result is read from them, not from a copy.
    """
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex[:12]}"
    d = spread(corpus.table(spark, sf, "documents"))  # a packed file is read by one task
    label = F.when(F.col("doc_id") % 3 == 0, "Threat").otherwise("Safe").alias("classification")

    def report(layout):
        return F.struct(F.concat(F.lit(f"{layout}-"), F.col("doc_id").cast("string")).alias("session_id"), label, F.col("text").alias("summary"))

    def land(values, layout, **how):
        # The usual level takes three times as long for files 4 % smaller.
        values.write.options(compression="gzip", **{"zlib.compress.level": "FOUR"}, **how).text(f"{folder}/{layout}")

    land(d.select(F.to_json(report("line")).alias("value")), "line")
    literal = F.to_json(F.struct(report("literal")["session_id"].alias("session_id"), label, F.col("text").alias("summary")))
    land(d.select(F.concat(F.left(literal, F.length(literal) - 1), F.lit(", 'status': None}")).alias("value")), "literal")
    for layout, frame in (("array", "[\n%s\n]"), ("run", '{"query": "q",\n"results": [\n%s\n]}')):
        # A few hundred reports make one document and one file, in the task that has them.
        bodies = d.select(F.to_json(report(layout)).alias("value")).mapInArrow(_framed(*frame.split("%s"), 300), "value string")
        land(bodies, layout, maxRecordsPerFile=1)
    found = docs.read_reports(spark, [f"{folder}/{x}" for x in ("line", "literal", "array", "run")])
    return found.select("session_id", "classification", "summary")


def _written(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("snk1_written_log", o.REPORTS + "SELECT owner, name, files_scanned, findings, classification FROM summary")
def snk1_written(spark, sf):
    """The log as a job leaves it that fails after a batch and writes it again: two batches, one of them twice."""
    log, rep = _written(spark, "log"), reliable(reports(spark, sf))
    half = F.pmod(F.xxhash64("repo.name"), F.lit(2)) == 0
    sinks.write_report_log(rep.filter(half), log, "2025-01-01/0")
    for _ in range(2):
        sinks.write_report_log(rep.filter(~half), log, "2025-01-01/1")
    return docs.read_reports(spark, log).select(
        "repo.owner", "repo.name", "stats.files_scanned", F.array_size("findings").cast(LONG).alias("findings"), "classification")


@query("snk2_written_reports", o.REPORTS + "SELECT owner, owner AS folder, name, files_scanned, classification FROM summary")
def snk2_written(spark, sf):
    """Report documents by owner, from the folders they were written to."""
    path = _written(spark, "reports")
    sinks.write_reports(reports(spark, sf), path)
    rows = spark.read.text(path)
    get = lambda p: F.get_json_object("value", p)
    return rows.select(get("$.repo.owner").alias("owner"), F.col("owner").alias("folder"), get("$.repo.name").alias("name"),
                       get("$.stats.files_scanned").cast(LONG).alias("files_scanned"), get("$.classification").alias("classification"))


@query("snk3_written_run", o.REPORTS + """
SELECT 'run' AS section, 'q' AS repo, count(*) AS n FROM summary
UNION ALL SELECT 'results', concat(owner, '/', name), files_scanned FROM summary""")
def snk3_written(spark, sf):
    """A run that is written twice, header and results read back."""
    path, rep, repos = _written(spark, "run"), reliable(reports(spark, sf)), corpus.repos(spark, sf)
    board = rt.leaderboard(rt.report_rows(rep), repos)
    for _ in range(2):
        sinks.write_run(repos, board, rep, {"query": "q"}, path)
    head = spark.read.json(f"{path}/run").select(F.lit("run").alias("section"), F.col("query").alias("repo"), F.col("count").cast(LONG).alias("n"))
    results = docs.read_reports(spark, f"{path}/sections/section=results")
    return head.unionByName(results.select(
        F.lit("results").alias("section"), F.concat_ws("/", "repo.owner", "repo.name").alias("repo"), F.col("stats.files_scanned").cast(LONG).alias("n")))
