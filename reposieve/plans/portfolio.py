"""Portfolio statistics: merged rescans, totals, quantiles, counts.

Merged data stays flat - one row per repository and one per distinct finding - so a
repository with most of the findings is never gathered into one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposieve.functions import names

UNCATEGORIZED = "Uncategorized"
UNSPECIFIED = "Unspecified"

DOCUMENT = (
    "session_id string, started_at string, finished_at string, "
    "run struct<id:string,session_id:string,config_hash:string>, "
    "repo struct<full_name:string,owner:string,name:string,html_url:string,ref:string,commit:string>, "
    "stats struct<files_scanned:bigint,bytes_scanned:bigint,flagged_count:bigint,safe_count:bigint,"
    "scanners_used:array<string>>, "
    "policy struct<include:array<string>,exclude:array<string>>, "
    "flags array<struct<category:string,rule_id:string,severity:string,extra:string>>, "
    "findings array<struct<path:string,scanner:string,rule_id:string,severity:string,reason:string,"
    "evidence:string,code_span:string,extra:string>>, "
    "classification string, summary string, status string, policy_flags array<string>, "
    "repo_full_name string, repository string, project string, repo_url string, url string, part int"
)


@dataclass(frozen=True)
class Merged:
    """``repos`` one row per repository, ``findings``/``flags`` distinct, ``globs`` policy globs."""

    repos: DataFrame
    findings: DataFrame
    flags: DataFrame
    globs: DataFrame


def documents(reports: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Reports in the tolerant document shape; fields they lack are NULL. Needs ``pos`` for order."""
    wanted = reports.sparkSession.createDataFrame([], DOCUMENT).schema

    def shaped(field, have: dict, at: Column) -> Column:
        inner = getattr(field.dataType, "fields", None)
        element = getattr(getattr(field.dataType, "elementType", None), "fields", None)
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        mine = have[field.name].dataType
        if inner:
            sub = {f.name: f for f in mine.fields}
            col = F.when(at.isNotNull(), F.struct(*(shaped(f, sub, at[f.name]) for f in inner)))
        elif element:
            sub = {f.name: f for f in mine.elementType.fields}
            col = F.transform(at, lambda x: F.struct(*(shaped(f, sub, x[f.name]) for f in element)))
        else:
            col = at
        return col.cast(field.dataType).alias(field.name)

    have = {f.name: f for f in reports.schema.fields}
    cols = [shaped(f, have, F.col(f.name)) for f in wanted.fields]
    pos = F.col("pos") if "pos" in have else F.struct(
        F.coalesce(F.col("finished_at"), F.lit("")).alias("at"),
        F.coalesce(F.col("session_id"), F.lit("")).alias("session"),
    )
    return reports.select(pos.alias("pos"), *cols, *(extra or []))


def repo_key() -> Column:
    r = F.col("repo")
    blank = lambda c: F.nullif(c, F.lit(""))
    return names.repo_display_name(
        r["full_name"], r["owner"], r["name"],
        [F.col("repo_full_name"), F.col("repository"), F.col("project")],
        F.coalesce(blank(r["html_url"]), blank(F.col("repo_url")), blank(F.col("url"))),
        F.coalesce(blank(F.col("run.id")), blank(F.col("session_id"))),
    )


def _tagged(keyed: DataFrame) -> DataFrame:
    """One row for the head of each report, for each of its findings, flags and globs, told by ``tag``."""
    kinds = {f.name: f.dataType.elementType for f in keyed.schema if f.name in ("findings", "flags")}
    finding, flag = (kinds[k].simpleString() for k in ("findings", "flags"))
    at = f"struct<pos:{keyed.schema['pos'].dataType.simpleString()},i:int>"
    row = f"struct<tag:string,finding:{finding},flag:{flag},kind:string,glob:string,at:{at}>"

    def one(tag: str, **values: Column) -> Column:
        names_ = ("finding", "flag", "kind", "glob", "at")
        return F.struct(F.lit(tag).alias("tag"), *(values.get(n, F.lit(None)).alias(n) for n in names_)).cast(row)

    def listed(array: Column, make) -> Column:
        return F.coalesce(F.transform(array, make), F.array().cast(f"array<{row}>"))

    def globs_of(kind: str) -> Column:
        def make(x: Column, i: Column) -> Column:
            return one("glob", kind=F.lit(kind), glob=x, at=F.struct(F.col("pos").alias("pos"), i.alias("i")))

        return listed(F.col(f"policy.{kind}"), make)

    rows = F.concat(
        F.array(one("head")), listed(F.col("findings"), lambda x: one("finding", finding=x)),
        listed(F.col("flags"), lambda x: one("flag", flag=x)), globs_of("include"), globs_of("exclude"),
    )
    # The outer form keeps the optimizer from evaluating the array twice.
    return keyed.select("repo_key", "pos", "repo", "run", "stats", F.explode_outer(rows).alias("x")).select(
        "repo_key", "pos", "repo", "run", "stats", "x.*")


def merge_reports(reports: DataFrame, legacy_flags: bool = False) -> Merged:
    """Merge all reports of each repository.

    Counts of scanned files add up, findings and flags are de-duplicated by value, later
    ``repo`` and ``run`` fields win. ``legacy_flags=True`` counts flags where no finding exists.
    """
    rows, head = _tagged(documents(reports).withColumn("repo_key", repo_key())), F.col("tag") == "head"
    fields = [f"repo.{c}" for c in ("full_name", "owner", "name", "html_url", "ref", "commit")]
    fields += [f"run.{c}" for c in ("id", "session_id", "config_hash")]

    def latest(c: str) -> Column:
        # The newest value that is there: rows without one are ordered before all others.
        return F.max_by(F.col(c), F.when(head & F.col(c).isNotNull(), F.col("pos"))).alias(c.replace(".", "_"))

    # One pass over the reports: everything is de-duplicated in one aggregate, of which each result is a part.
    parts = rows.groupBy("repo_key", "tag", "finding", "flag", "kind", "glob").agg(
        *map(latest, fields), F.sum(F.when(head, F.col("stats.files_scanned"))).alias("_files"),
        F.sum(F.when(head, F.col("stats.safe_count"))).alias("_safe"), F.min("at").alias("first_seen"),
    )
    present = lambda c: parts.filter((F.col("tag") == c) & F.col(c).isNotNull())
    findings = present("finding").select("repo_key", "finding.*")
    flags = present("flag").select("repo_key", "flag.*")
    globs = present("glob").select("repo_key", "kind", "glob", "first_seen")
    heads = parts.groupBy("repo_key").agg(
        *(F.max(c.replace(".", "_")).alias(c.replace(".", "_")) for c in fields),  # one row of each repository has them
        F.max("_files").alias("_files"), F.max("_safe").alias("_safe"),
        F.count_if((F.col("tag") == "finding") & F.col("finding").isNotNull()).alias("_findings"),
        F.count_if((F.col("tag") == "flag") & F.col("flag").isNotNull()).alias("_flags"),
    )
    zero = F.lit(0).cast("bigint")
    found, flagged = F.coalesce("_findings", zero), F.coalesce("_flags", zero)
    either = F.when(found > 0, found).otherwise(flagged)
    told = lambda c: F.nullif(F.col(c), F.lit(""))
    full = F.coalesce(told("repo_full_name"), F.concat(told("repo_owner"), F.lit("/"), told("repo_name")))
    repos = heads.select(
        "repo_key",
        F.coalesce(full, told("repo_html_url"), F.lit("unknown")).alias("repo"),
        *(f"repo_{c}" for c in ("full_name", "owner", "name", "html_url", "ref", "commit")),
        *(f"run_{c}" for c in ("id", "session_id", "config_hash")),
        F.coalesce(F.col("_files"), F.col("_safe") + either).alias("files_scanned"),
        either.alias("flagged_count"),
        (either if legacy_flags else found).alias("flagged"),
    )
    return Merged(repos, findings, flags, globs)


def portfolio_totals(merged: Merged) -> DataFrame:
    n, hit = F.count(F.lit(1)), F.count_if(F.col("flagged") > 0)
    return merged.repos.agg(
        n.alias("total_repositories"),
        F.coalesce(F.sum("files_scanned"), F.lit(0)).alias("total_files_scanned"),
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("total_flagged_files"),
        names.round2(names.pct(hit, n)).alias("percent_repos_with_findings"),
    )


def _by_name(merged: Merged) -> DataFrame:
    """Flagged count per displayed name; of equal names the later key counts."""
    return merged.repos.groupBy("repo").agg(F.max_by("flagged", "repo_key").alias("flagged"))


def flagged_quantiles(merged: Merged) -> DataFrame:
    """Median and 95th percentile, nearest rank. The aggregate holds distinct counts only."""
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY flagged)")
    out = lambda q, name: F.coalesce(disc(q).cast("double"), F.lit(0.0)).alias(name)
    return _by_name(merged).agg(
        out(0.5, "median_flagged_per_repo"), out(0.95, "p95_flagged_per_repo")
    )


def _filled(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def labelled(merged: Merged, legacy_flags: bool = False) -> DataFrame:
    """``(category, severity)`` of every counted finding."""
    c = F.col
    trim = lambda x: F.trim(x)
    rows = merged.findings.select(
        trim(_filled(c("rule_id"), c("scanner"), F.lit(UNCATEGORIZED))).alias("category"),
        trim(_filled(c("severity"), F.lit(UNSPECIFIED))).alias("severity"),
    )
    if not legacy_flags:
        return rows
    unflagged = merged.flags.join(merged.findings.select("repo_key").distinct(), "repo_key", "left_anti")
    return rows.unionByName(unflagged.select(
        trim(_filled(c("category"), c("rule_id"), F.lit(UNCATEGORIZED))).alias("category"),
        trim(_filled(c("severity"), F.lit(UNSPECIFIED))).alias("severity"),
    ))


def _counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def by_category(merged: Merged, legacy_flags: bool = False) -> DataFrame:
    return _counts(labelled(merged, legacy_flags), "category")


def by_severity(merged: Merged, legacy_flags: bool = False) -> DataFrame:
    return _counts(labelled(merged, legacy_flags), "severity")


def by_label(merged: Merged, legacy_flags: bool = False) -> DataFrame:
    """Counts by category and by severity in one pass."""
    sets = labelled(merged, legacy_flags).groupingSets(
        [["category"], ["severity"]], "category", "severity"
    )
    counted = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping("category").alias("_g"))
    return counted.select(
        F.when(F.col("_g") == 1, "severity").otherwise("category").alias("kind"),
        F.when(F.col("_g") == 1, F.col("severity")).otherwise(F.col("category")).alias("label"),
        "n",
    )


def category_share(merged: Merged, key: str = "category") -> DataFrame:
    """Counts with their share of the total, in percent."""
    counts = labelled(merged).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()  # of the few counts, not of all findings again
    return counts.select(key, "n", names.round2(names.pct(F.col("n"), total)).alias("share"))


def top_repos(merged: Merged, n: int = 5) -> DataFrame:
    return _by_name(merged).orderBy(F.desc("flagged"), "repo").limit(n)


def flagged_per_repo(reports: DataFrame) -> DataFrame:
    """Flagged count of each raw report: findings, else flags, else the stored number, else 0.

    Parts of one report are added up.
    """
    part = F.col("part") if "part" in reports.columns else F.lit(None)
    d = documents(reports.withColumn("_alone", F.when(part.isNull(), F.monotonically_increasing_id())), ["_alone"])
    counted = d.select(
        repo_key().alias("repo_key"), "session_id", "_alone",
        F.when(F.col("findings").isNotNull(), F.array_size("findings"))
        .when(F.col("flags").isNotNull(), F.array_size("flags"))
        .otherwise(F.coalesce("stats.flagged_count", F.lit(0)))
        .cast("bigint").alias("flagged"),
    )
    return counted.groupBy("repo_key", "session_id", "_alone").agg(F.sum("flagged").alias("flagged")).drop("_alone")


def rule_counts(findings: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent rules."""
    return _counts(findings, "rule_id").limit(n)


def _entropy_only(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("rule_id") == "high_entropy_candidate")


def entropy_paths(findings: DataFrame, n: int = 30) -> DataFrame:
    """Paths with most entropy findings."""
    return _counts(_entropy_only(findings), "path").limit(n)


def ext_distribution(findings: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent extensions of entropy findings."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    return _counts(_entropy_only(findings).select(ext.alias("ext")), "ext").limit(n)


def batch_index(written: DataFrame) -> DataFrame:
    """Index lines ``(repo, path, line)`` of written reports, by lower-cased repository name."""
    return (
        written.select("repo", "path").distinct()
        .withColumn("line", F.format_string("- **%s** \u2192 [%s](%s)", "repo", "path", "path"))
        .orderBy(F.lower("repo"), "repo", "path")
    )
