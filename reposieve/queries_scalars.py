"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reposieve import corpus
from reposieve import oracle as o
from reposieve.catalog import query
from reposieve.functions import hosts, names, text


@query("scf2_shannon_entropy", """
SELECT doc_id, round(COALESCE((SELECT entropy(ch) FROM (SELECT unnest(string_split(
  CASE doc_id % 10 WHEN 0 THEN '' ELSE text END, '')) AS ch) WHERE ch <> ''), 0.0), 6) AS bits FROM documents""")
def scf2(spark, sf):
    t = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text"))
    return corpus.table(spark, sf, "documents").select("doc_id", F.round(text.shannon_entropy(t), 6).alias("bits"))


def _classes(text: str) -> str:
    """Letters of any script are told by their other case."""
    some = lambda test: f"CAST(len(list_filter(string_split({text}, ''), lambda c: {test})) > 0 AS BIGINT)"
    other = f"CAST(regexp_matches({text}, '[+/=_-]') AS BIGINT)"
    return " + ".join([some("lower(c) <> c"), some("upper(c) <> c"), some("regexp_matches(c, '[0-9]')"), other])


@query("scf3_char_classes", f"""
SELECT doc_id, {_classes('text')} AS classes, {_classes('rest')} AS rest_classes
FROM (SELECT *, regexp_replace(text, '[A-Za-z]', '', 'g') AS rest FROM documents)""")
def scf3(spark, sf):
    """Classes of each text, and of what is left of it without the letters of ASCII."""
    d = corpus.table(spark, sf, "documents")
    rest = F.regexp_replace("text", "[A-Za-z]", "")
    return d.select("doc_id", text.char_classes(F.col("text")).cast("bigint").alias("classes"),
                    text.char_classes(rest).cast("bigint").alias("rest_classes"))


@query("scf4_mask", """
SELECT doc_id, md5(substr(text, greatest(a - 6, 0) + 1, a - greatest(a - 6, 0)) || '****redacted****'
       || substr(text, a + doc_id % 40 + 1, 6)) AS masked, a AS at_pos
FROM (SELECT doc_id, text, length(text) // 3 AS a FROM documents)""")
def scf4(spark, sf):
    a = F.floor(F.length("text") / 3).cast("int")
    end = (a + F.col("doc_id") % 40).cast("int")
    d = corpus.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.mask(F.col("text"), a, end).cast("binary")).alias("masked"),
                    a.cast("bigint").alias("at_pos"))


def _urls(base: str) -> str:
    return f"""CASE length({base}) % 5 WHEN 0 THEN concat({base}, '/') WHEN 1 THEN concat({base}, '.git')
               WHEN 2 THEN concat({base}, '/tree') WHEN 3 THEN concat({base}, '.git/') ELSE {base} END"""


@query("scf5_parse_repo_url", o.with_(o.REPOS) + f"""
SELECT url, CASE WHEN regexp_matches(url, '{{rx}}') THEN regexp_extract(url, '{{rx}}', 1) END AS owner,
       CASE WHEN regexp_matches(url, '{{rx}}') THEN regexp_extract(url, '{{rx}}', 2) END AS name
FROM (SELECT {_urls('html_url')} AS url FROM repos)""".replace(
    "{rx}", r"^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$"))
def scf5(spark, sf):
    url = F.expr(_urls("html_url"))
    parsed = corpus.repos(spark, sf).select(url.alias("url")).withColumn("p", names.parse_repo_url(F.col("url")))
    return parsed.select("url", "p.owner", "p.name")


@query("scf6_find_repo_url", o.with_(o.MESSAGES) + """
SELECT conv_id, turn, concat('https://github.com/org', CAST(conv_id % 5 AS VARCHAR), '/svc-', CAST(conv_id % 20 AS VARCHAR)) AS url
FROM messages""")
def scf6(spark, sf):
    return corpus.messages(spark, sf).select("conv_id", "turn", names.find_repo_url(F.col("text")).alias("url"))


@query("scf7_url_host", r"""
SELECT page_id, regexp_extract(url, 'https?://([^/\s:]+)', 1) AS host, false AS private FROM pages
UNION ALL SELECT -1 - event_id, host, a IN (0, 10, 127) OR a >= 240 OR (a = 172 AND b BETWEEN 16 AND 31)
   OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 198 AND b IN (18, 19)) OR (a = 192 AND b = 0 AND c IN (0, 2) AND host NOT IN ('192.0.0.9', '192.0.0.10'))
   OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)
FROM (SELECT event_id, a, b, c, concat_ws('.', a, b, c, event_id % 16) AS host FROM (
   SELECT event_id, list_extract([10, 127, 192, 198, 172, 169, 203, 100, 8, 0, 241], CAST(event_id % 11 AS INT) + 1) AS a,
          list_extract([0, 16, 18, 168, 254, 51, 31, 32], CAST(event_id % 8 AS INT) + 1) AS b,
          list_extract([0, 2, 100, 113], CAST(event_id % 4 AS INT) + 1) AS c FROM events))""")
def scf7(spark, sf):
    pages = corpus.table(spark, sf, "pages").select("page_id", hosts.url_host(F.col("url")).alias("host"))
    e = F.col("event_id")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (e % len(xs)).cast("int")).cast("string")
    quad = F.concat_ws(
        ".", pick([10, 127, 192, 198, 172, 169, 203, 100, 8, 0, 241]), pick([0, 16, 18, 168, 254, 51, 31, 32]),
        pick([0, 2, 100, 113]), (e % 16).cast("string"))
    url = F.concat(F.lit("http://"), quad, F.lit(":80/x"))
    made = corpus.table(spark, sf, "events").select((-1 - e).alias("page_id"), hosts.url_host(url).alias("host"))
    return pages.unionByName(made).withColumn("private", hosts.is_private_host(F.col("host")))


_CLASS = "list_extract(['Safe', 'Threat', 'Potential Threat', 'Error', 'Other'], CAST(doc_id % 5 AS INT) + 1)"


@query("scf8_class_rank", f"""
SELECT doc_id, CASE {_CLASS} WHEN 'Threat' THEN 3 WHEN 'Potential Threat' THEN 2 WHEN 'Safe' THEN 1 ELSE 0 END AS class_rank,
       CASE {_CLASS} WHEN 'Threat' THEN 2 WHEN 'Safe' THEN 0 ELSE 1 END AS exit_code FROM documents""")
def scf8(spark, sf):
    kinds = F.array(*map(F.lit, ["Safe", "Threat", "Potential Threat", "Error", "Other"]))
    c = F.get(kinds, (F.col("doc_id") % 5).cast("int"))
    return corpus.table(spark, sf, "documents").select(
        "doc_id", names.class_rank(c).alias("class_rank"), names.exit_code(c).alias("exit_code"))


@query("scf9_session_ids", """
SELECT doc_id, upper(substr(sha1(text), 1, 6)) AS short,
       CASE WHEN doc_id % 3 = 0 THEN source ELSE upper(substr(sha1(lang), 1, 6)) END AS session_id FROM documents""")
def scf9(spark, sf):
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "source")).otherwise(F.lit("  "))
    return corpus.table(spark, sf, "documents").select(
        "doc_id", names.short_hash(F.col("text")).alias("short"),
        names.session_of(given, F.lit(" "), F.col("lang")).alias("session_id"))


@query("scf10_stamp", """
SELECT event_id, concat(strftime(ts, '%Y%m%d_%H%M%SZ'), '-', event_type) AS prefix FROM events""")
def scf10(spark, sf):
    # Stamps are wall-clock UTC: a time without zone is already that.
    e = corpus.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.select("event_id", names.stamp_prefix(F.col("ts"), F.col("event_type")).alias("prefix"))


_NAME_FIELDS = {
    "full_name": (0, "full_name"), "owner": (1, "owner"), "name": (1, "name"),
    "alt": (2, "concat(owner, '__', name)"), "url": (3, "concat(html_url, '/')"),
    "run_id": (4, "concat('batch-', owner, '-', name)"),
}


def _field(f: str) -> str:
    k, sql = _NAME_FIELDS[f]
    return f"CASE WHEN stargazers_count % 6 = {k} THEN {sql} END"


@query("scf11_display_name", o.with_(o.REPOS) + """
SELECT owner, name, CASE WHEN stargazers_count % 6 = 5 THEN 'unknown_repo' ELSE full_name END AS display,
       CASE WHEN stargazers_count % 6 = 5 THEN concat('unknown_repo_', substr(sha1('unknown_repo'), 1, 8), '.md')
            ELSE concat(owner, '__', name, '.md') END AS filename FROM repos""")
def scf11(spark, sf):
    r = corpus.repos(spark, sf).select(
        "owner", "name", *(F.expr(_field(f)).alias(f"f_{f}") for f in _NAME_FIELDS))
    c = lambda f: F.col(f"f_{f}")
    shown = r.withColumn("display", names.repo_display_name(
        c("full_name"), c("owner"), c("name"), [F.lit(" "), c("alt")], c("url"), c("run_id")))
    return shown.select("owner", "name", "display", names.safe_report_filename(F.col("display")).alias("filename"))


@query("scf12_report_filename", o.with_(o.REPOS) + "SELECT full_name, concat(replace(full_name, '/', '__'), '.md') AS filename FROM repos")
def scf12(spark, sf):
    return corpus.repos(spark, sf).select("full_name", names.safe_report_filename(F.col("full_name")).alias("filename"))


@query("scf13_pct", """
SELECT doc_id, CASE WHEN quality = 0 THEN 0.0 ELSE round_even(100.0 * toxic / quality, 2) END AS share FROM labels""")
def scf13(spark, sf):
    d = corpus.table(spark, sf, "labels")
    return d.select("doc_id", names.round2(names.pct(F.col("toxic"), F.col("quality"))).alias("share"))


@query("scf14_duration", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 2) END AS seconds FROM events""")
def scf14(spark, sf):
    """Duration between two ISO-8601 texts; every fifth start is blank."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    end = start + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))
    started = F.when(F.col("event_id") % 5 == 0, "").otherwise(iso(start))
    e = corpus.table(spark, sf, "events")
    return e.select("event_id", F.round(names.seconds_between(started, iso(end)), 2).alias("seconds"))


@query("scf15_prune_nulls", """
SELECT doc_id, concat('{"lang":"', lang, '"', CASE WHEN doc_id % 2 = 0 THEN concat(',"inner":{"id":', CAST(doc_id AS VARCHAR), '}') ELSE '' END,
   ',"items":["', source, '"],"map":{"l":"m"},"rows":[{"deep":[1]}]}') AS json FROM documents""")
def scf15(spark, sf):
    from reposieve.sources.sinks import pruned_json

    even = F.col("doc_id") % 2 == 0
    none = F.lit(None).cast("string")
    rows = corpus.table(spark, sf, "documents").select(
        "doc_id", "lang", none.alias("gone"),
        F.when(even, F.struct(F.col("doc_id").alias("id"), F.lit(None).cast("int").alias("no"))).alias("inner"),
        F.array(none, "source").alias("items"),
        F.create_map(F.lit("k"), none, F.lit("l"), F.lit("m")).alias("map"),
        F.array(F.struct(F.array(F.lit(1), F.lit(None).cast("int")).alias("deep"), none.alias("gone"))).alias("rows"),
    )
    fields = [c for c in rows.columns if c != "doc_id"]
    return rows.select("doc_id", pruned_json(rows, *fields).alias("json"))


