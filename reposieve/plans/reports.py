"""Reports: assembly from a scan, validation, summaries, leaderboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import names
from reposieve.operators.ranking import number_rows
from reposieve.operators.repos import with_stars
from reposieve.operators.select import REPO
from reposieve.sources.documents import FINDING_KEYS

FINDING = ("path", "scanner", "rule_id", "severity", "reason", "evidence")
# A report document holds at most about this many findings; more go to further parts.
PART_ROWS = 10_000


def build_reports(
    summary: DataFrame,
    findings: DataFrame,
    session_id: Column | None = None,
    started_at: Column | None = None,
    finished_at: Column | None = None,
    ref: Column | None = None,
    commit: Column | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Report documents with nested findings.

    A repository with more than ``part_rows`` findings gets several documents instead of
    one unbounded row: the first carries the totals, all carry the verdict, and merging
    them by repository gives the whole report back.
    """
    text = lambda c, default: (F.lit(default) if c is None else c).cast("string")
    parts = F.greatest(F.lit(1), F.ceil(F.col("findings") / part_rows)).cast("int")
    heads = summary.withColumn("parts", parts)
    # Only repositories that need several parts; the rest of the findings miss the join.
    big = heads.filter(F.col("parts") > 1).select(*REPO, F.col("parts").alias("_parts"))
    slot = F.pmod(F.xxhash64("path", "rule_id", "ord"), F.coalesce("_parts", F.lit(1))).cast("int")
    item = F.struct("path", "scanner", "rule_id", "ord", "severity", "reason", "evidence")
    bodies = (
        findings.join(big, REPO, "left")
        .withColumn("part", slot)
        .groupBy(*REPO, "part")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
    )
    public = F.transform("_items", lambda x: F.struct(*(x[c].alias(c) for c in FINDING)))
    first = F.col("part") == 0
    zero = F.lit(0).cast("bigint")
    return (
        heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(bodies, [*REPO, "part"], "left")
        .select(
            text(session_id if session_id is not None
                 else F.concat(F.lit("batch-"), "owner", F.lit("-"), "name"), "").alias("session_id"),
            text(started_at, "").alias("started_at"),
            text(finished_at, "").alias("finished_at"),
            F.struct("owner", "name", text(ref, "main").alias("ref"), text(commit, "?").alias("commit"))
            .alias("repo"),
            F.struct(
                F.when(first, F.col("files_scanned")).otherwise(zero).alias("files_scanned"),
                F.when(first, F.col("bytes_scanned")).otherwise(zero).alias("bytes_scanned"),
                "scanners_used",
            ).alias("stats"),
            F.coalesce(public, F.array().cast(
                "array<struct<" + ",".join(f"{c}:string" for c in FINDING) + ">>"
            )).alias("findings"),
            "classification", "summary",
            F.array().cast("array<string>").alias("policy_flags"),
            F.lit("ok").alias("status"),
            F.when(F.col("parts") > 1, F.col("part")).alias("part"),
        )
    )


def error_reports(failed: DataFrame) -> DataFrame:
    """Reports of repositories that could not be scanned: ``failed(owner, name, message)``."""
    return failed.select(
        F.concat(F.lit("batch-"), "owner", F.lit("-"), "name").alias("session_id"),
        F.lit("").alias("started_at"), F.lit("").alias("finished_at"),
        F.struct("owner", "name", F.lit("?").alias("ref"), F.lit("?").alias("commit")).alias("repo"),
        F.struct(
            F.lit(0).cast("bigint").alias("files_scanned"), F.lit(0).cast("bigint").alias("bytes_scanned"),
            F.array().cast("array<string>").alias("scanners_used"),
        ).alias("stats"),
        F.array().cast("array<struct<" + ",".join(f"{c}:string" for c in FINDING) + ">>").alias("findings"),
        F.lit("Error").alias("classification"),
        F.concat(F.lit("Scan error: "), "message").alias("summary"),
        F.array().cast("array<string>").alias("policy_flags"),
        F.lit("error").alias("status"),
        F.lit(None).cast("int").alias("part"),
    )


def report_rows(reports: DataFrame) -> DataFrame:
    """One flat row per report, parts added up."""
    if "part" not in reports.columns:
        reports = reports.withColumn("part", F.lit(None).cast("int"))
    # A document of one piece keeps to itself; only parts of one report are added up.
    alone = F.when(F.col("part").isNull(), F.monotonically_increasing_id())
    keys = ["session_id", "repo.owner", "repo.name", "_alone"]
    return reports.withColumn("_alone", alone).groupBy(*(F.col(k) for k in keys)).agg(
        F.max("repo.ref").alias("ref"),
        F.max("repo.commit").alias("commit"),
        F.sum("stats.files_scanned").alias("files_scanned"),
        F.sum("stats.bytes_scanned").alias("bytes_scanned"),
        F.max("stats.scanners_used").alias("scanners_used"),
        F.sum(F.coalesce(F.array_size("findings"), F.lit(0))).alias("findings"),
        F.max("classification").alias("classification"),
        F.max("summary").alias("summary"),
    ).drop("_alone")


def scan_summary(rows: DataFrame) -> DataFrame:
    """Short form of a report."""
    return rows.select(
        F.struct("owner", "name", "ref", "commit").alias("repo"),
        F.struct("files_scanned", "bytes_scanned", "scanners_used").alias("stats"),
        "classification", "summary", F.col("findings").alias("findings_count"),
    )


def format_summary(summaries: DataFrame) -> DataFrame:
    """Six lines of text per summary."""
    or_ = lambda c, d: F.coalesce(F.col(c), F.lit(d)).cast("string")
    line = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    ref = F.coalesce(F.nullif(F.col("repo.ref"), F.lit("")), F.lit("default-branch"))
    return summaries.select(
        "repo.owner", "repo.name",
        F.concat_ws(
            "\n",
            line("Scan complete for **", or_("repo.owner", "?"), "/", or_("repo.name", "?"), "** @ **", ref, "**"),
            line("- Files scanned: ", or_("stats.files_scanned", 0)),
            line("- Bytes scanned: ", or_("stats.bytes_scanned", 0)),
            line("- Findings: ", or_("findings_count", 0)),
            line("- Classification: **", or_("classification", "Unscanned"), "**"),
            line("- Summary: ", or_("summary", "")),
        ).alias("text"),
    )


def terminal_summary(rows: DataFrame) -> DataFrame:
    return rows.select(
        "session_id",
        F.concat("owner", F.lit("/"), "name", F.lit(" @ "), "ref", F.lit(" ("), F.left("commit", F.lit(7)), F.lit(")"))
        .alias("repo"),
        "files_scanned", "bytes_scanned", "classification", "summary",
        F.array_join("scanners_used", ", ").alias("scanners"),
        F.col("findings").alias("flagged"),
    )


def top_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` findings of each repository; the rank limit applies before the shuffle."""
    order = ["path", "scanner", "rule_id", "ord", "reason", "evidence"]
    w = Window.partitionBy(*REPO).orderBy(*order)
    return (
        findings.withColumn("pos", F.row_number().over(w))
        .filter(F.col("pos") <= n)
        .select(*REPO, "pos", "path", "rule_id", "severity", "reason")
    )


def leaderboard(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories by findings, verdict and stars."""
    order = [
        F.col("findings").desc(), names.class_rank(F.col("classification")).desc(),
        F.col("stars").desc(), F.col("owner"), F.col("name"),
    ]
    flat = with_stars(rows, repos).select(
        *REPO, "stars", "classification", "findings", "files_scanned", "bytes_scanned"
    )
    return number_rows(flat, order, "rank").select("rank", *flat.columns)


#: RFC 3339: date, time and offset.
_DATE_TIME = r"\A\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z"


def validate_reports(reports: DataFrame) -> DataFrame:
    """``(session_id, field, problem)`` for every rule of the report schema that is broken."""
    def bad(cond: Column, field: str, problem: str) -> Column:
        return F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem")))

    required = [
        "session_id", "started_at", "finished_at", "repo.owner", "repo.name", "repo.ref", "repo.commit",
        "stats.files_scanned", "stats.bytes_scanned", "stats.scanners_used",
        "findings", "classification", "summary",
    ]
    c = F.col
    checks = [bad(c(f).isNull(), f, "missing") for f in required]
    checks += [
        bad(c(f).isNotNull() & (~c(f).rlike(_DATE_TIME) | F.try_to_timestamp(c(f)).isNull()), f, "not a date-time")
        for f in ("started_at", "finished_at")
    ]
    listed = ["stats.scanners_used"] + ["policy_flags"] * ("policy_flags" in reports.columns)
    checks += [bad(F.exists(f, lambda x: x.isNull()), f, "missing item") for f in listed]
    checks.append(bad(~c("classification").isin(*fixed.CLASSES), "classification", "not allowed"))
    item = lambda test: F.exists("findings", test)
    checks.append(bad(item(lambda x: ~x["severity"].isin(*fixed.SEVERITIES)), "findings.severity", "not allowed"))
    lacks = lambda k: item(lambda x: x[k].isNull())
    checks += [
        bad(lacks(k), f"findings.{k}", "missing")
        for k in ("path", "scanner", "rule_id", "severity", "reason")
    ]
    flat = reports.select("session_id", F.array(*checks).alias("u")).select(
        "session_id", F.explode("u").alias("x")
    )
    return flat.filter(c("x").isNotNull()).select("session_id", "x.field", "x.problem")


#: Values of a report, their types, and whether they have to be there. A value is looked at where its parent is an object.
_VALUES = (
    ("session_id", "string", True), ("started_at", "date-time", True), ("finished_at", "date-time", True),
    ("repo", "object", True), ("repo.owner", "string", True), ("repo.name", "string", True), ("repo.ref", "string", True),
    ("repo.commit", "string", True), ("stats", "object", True), ("stats.files_scanned", "integer", True),
    ("stats.bytes_scanned", "integer", True), ("stats.scanners_used", "array", True), ("findings", "array", True),
    ("classification", "string", True), ("summary", "string", True), ("policy_flags", "array", False),
)
_FINDING_VALUES = tuple((k, "string", k not in ("evidence", "code_span")) for k in FINDING_KEYS)


def _is(value: Column, kind: str) -> Column:
    """Whether a variant has a type of JSON."""
    of = F.schema_of_variant(value)
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        return of.rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (number == F.floor(number))
    if kind == "date-time":
        text = F.try_variant_get(value, "$", "string")
        return (of == "STRING") & text.rlike(_DATE_TIME) & F.try_to_timestamp(text).isNotNull()
    return of.startswith({"string": "STRING", "object": "OBJECT", "array": "ARRAY"}[kind])


def validate_json(items: DataFrame) -> DataFrame:
    """``(pos, session_id, field, problem)`` for every rule of the report schema that a JSON text ``(pos, item)`` breaks.

    The text itself is judged, before anything is cast: a value of another type is ``not a ...``, only an absent one
    is ``missing``. Of findings a rule is reported once, whatever number of them breaks it. Text that is no JSON
    object gives one row.
    """
    rows = items.select("pos", F.try_parse_json("item").alias("v"))
    v = F.col("v")

    def bad(cond: Column, field: str, problem: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem")))

    def at(of: Column, path: str) -> Column:
        return F.try_variant_get(of, f"$.{path}", "variant")

    checks = [bad(v.isNull() | ~_is(v, "object"), "", "not an object")]
    for path, kind, needed in _VALUES:
        value, parent = at(v, path), at(v, path.rpartition(".")[0]) if "." in path else v
        judged = parent.isNotNull() & _is(parent, "object")
        if needed:
            checks.append(bad(judged & value.isNull(), path, "missing"))
        article = "an" if kind[0] in "aio" else "a"
        checks.append(bad(judged & value.isNotNull() & ~_is(value, kind), path, f"not {article} {kind}"))
    for path in ("stats.scanners_used", "policy_flags"):
        listed = F.try_variant_get(v, f"$.{path}", "array<variant>")
        checks.append(bad(F.exists(listed, lambda x: x.isNull() | ~_is(x, "string")), path, "item not a string"))
    name = at(v, "classification")
    checks.append(bad(_is(name, "string") & ~F.try_variant_get(name, "$", "string").isin(*fixed.CLASSES), "classification", "not allowed"))
    found = F.try_variant_get(v, "$.findings", "array<variant>")
    some = lambda test: F.exists(found, lambda x: F.coalesce(test(x), F.lit(False)))
    checks.append(bad(some(lambda x: x.isNull() | ~_is(x, "object")), "findings", "item not an object"))
    for key, kind, needed in _FINDING_VALUES:
        if needed:
            checks.append(bad(some(lambda x, key=key: _is(x, "object") & at(x, key).isNull()), f"findings.{key}", "missing"))
        checks.append(bad(some(lambda x, key=key, kind=kind: at(x, key).isNotNull() & ~_is(at(x, key), kind)), f"findings.{key}", f"not a {kind}"))
    severity = lambda x: F.try_variant_get(x, "$.severity", "string")
    checks.append(bad(some(lambda x: _is(at(x, "severity"), "string") & ~severity(x).isin(*fixed.SEVERITIES)), "findings.severity", "not allowed"))
    session = F.when(_is(at(v, "session_id"), "string"), F.try_variant_get(v, "$.session_id", "string")).alias("session_id")
    flat = rows.select("pos", session, F.array_compact(F.array(*checks)).alias("u")).select("pos", "session_id", F.explode_outer("u").alias("x"))
    return flat.filter(F.col("x").isNotNull()).select("pos", "session_id", "x.field", "x.problem")


def all_of(reports: list[DataFrame]) -> DataFrame:
    """Union of reports from several inputs; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
