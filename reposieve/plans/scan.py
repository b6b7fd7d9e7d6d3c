"""The scan: files in, one row per scanned file with its findings out.

Every rule is evaluated in one pass over ``content``. Bodies are dropped in the same
stage, so nothing wide is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import paths, text
from reposieve.operators import bytepatterns, entropy, pyfacts, secrets, static, taint, workflows
from reposieve.operators import finding as f
from reposieve.operators.select import REPO, route, select_paths, size_ok
from reposieve.policy import Policy

ERROR = "array<struct<scanner:string,message:string>>"


@dataclass(frozen=True)
class ScanConfig:
    """What to scan and how. ``exclude=None`` means the shipped ignore list."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] | None = None
    max_bytes: int = fixed.MAX_BYTES
    policy: Policy = Policy()
    enabled: tuple[str, ...] = fixed.SCANNERS
    root_aware: bool = False
    entropy: dict = field(default_factory=dict)


def selected_files(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Files that count as scanned: path selection and the raw size guard."""
    return size_ok(
        select_paths(files, config.include, config.exclude, config.root_aware), config.max_bytes
    )


@dataclass(frozen=True)
class TextInputs:
    """Columns of rules on text; costly ones are computed once per file."""

    path: Column
    content: Column
    lower: Column
    has_run: Column


@dataclass(frozen=True)
class FactInputs:
    """Columns of rules on parsed files: resolved calls and workflow steps."""

    path: Column
    calls: Column
    steps: Column


@dataclass(frozen=True)
class Detector:
    """One scanner: columns of findings arrays from text, from facts, or from both."""

    on_text: Callable[[TextInputs, ScanConfig], list[Column]] | None = None
    on_facts: Callable[[FactInputs, ScanConfig], list[Column]] | None = None


def _entropy(i: TextInputs, c: ScanConfig) -> list[Column]:
    scope = entropy.path_in_scope(i.path, c.entropy.get("window", "chars"))
    longer = c.entropy.get("min_len", fixed.TOKEN_MIN_LEN) >= fixed.TOKEN_MIN_LEN
    gate = scope & i.has_run if longer else scope
    return [f.when_any(gate, entropy.entropy(i.content, **c.entropy))]


# Order of the scanner list. deps_audit has routing and an inventory, but no rules.
REGISTRY: dict[str, Detector] = {
    "secrets": Detector(lambda i, _c: secrets.secrets(i.path, i.content, i.lower)),
    "entropy_secrets": Detector(_entropy),
    "static_risk": Detector(
        lambda i, _c: static.text_rules(i.path, i.content, i.lower),
        lambda i, _c: [f.when_any(F.array_size(i.calls) > 0, static.call_rules(i.calls))],
    ),
    "taint_risk": Detector(
        on_facts=lambda i, c: [f.when_any(F.array_size(i.calls) > 0, taint.call_rules(i.calls, c.policy))]
    ),
    "github_actions": Detector(
        on_facts=lambda i, c: [f.when_any(F.array_size(i.steps) > 0, workflows.step_rules(i.steps, c.policy))]
    ),
    "yara": Detector(lambda i, _c: bytepatterns.byte_rules(i.path, i.content, i.has_run)),
}
_PY = ("static_risk", "taint_risk")
_CI = ("github_actions",)


def _all(arrays: list[Column]) -> Column:
    return F.flatten(F.array(*arrays)) if arrays else f.none()


def scan_files(
    files: DataFrame,
    config: ScanConfig = ScanConfig(),
    extra: dict[str, Detector] | None = None,
) -> DataFrame:
    """``(owner, name, path, length, scanners, findings, errors)`` per scanned file.

    ``extra`` adds detectors of the caller; a scanner that is not enabled costs nothing.
    """
    extra = extra or {}
    on = {s: d for s, d in {**REGISTRY, **extra}.items() if s in config.enabled or s in extra}
    parse_py, parse_ci = any(s in on for s in _PY), any(s in on for s in _CI)
    content, path = F.col("content"), F.col("path")
    code = F.array_contains("scanners", "secrets")
    runs = code & (
        paths.any_suffix(path, fixed.ENTROPY_EXTS) | bytepatterns.in_scope(path)
    ) & entropy.has_run(content)

    routed = route(selected_files(files, config), config.include, config.exclude, config.max_bytes)
    prepared = routed.select(
        *REPO, "path", "length", "scanners", "content",
        F.when(code, F.lower(content)).alias("_lower"),
        runs.alias("_run"),
    )
    given = TextInputs(path, content, F.col("_lower"), F.col("_run"))
    by_text = [c for d in on.values() if d.on_text for c in d.on_text(given, config)]
    # From here on only sources that have to be parsed are carried along.
    wanted = F.lit(parse_py) & code & path.endswith(".py") & pyfacts.worth_parsing(content)
    workflow = F.lit(parse_ci) & F.array_contains("scanners", "github_actions")
    texted = prepared.select(
        *REPO, "path", "length", "scanners",
        f.when_any(code, _all(by_text)).alias("_found"),
        F.when(wanted, content).alias("_py"),
        F.when(workflow, content).alias("_yml"),
    )
    py, steps = F.col("_facts"), F.col("_steps")
    if parse_py:
        texted = texted.withColumn("_facts", pyfacts.py_facts("_py"))
        texted = texted.withColumn(
            "_calls", F.when(F.array_size(py["facts"]) > 0, taint.resolved_calls(py["facts"]))
        )
    if parse_ci:
        texted = texted.withColumn("_steps", workflows.workflow_steps("_yml"))
    none = F.lit(None)
    parsed = FactInputs(
        path, F.col("_calls") if parse_py else none, steps["steps"] if parse_ci else none
    )
    by_facts = [c for d in on.values() if d.on_facts for c in d.on_facts(parsed, config)]
    return texted.select(
        *REPO, "path", "length", "scanners",
        _all([F.col("_found"), *by_facts]).alias("findings"),
        _errors(on).alias("errors"),
    )


def _errors(on: dict[str, Detector]) -> Column:
    """Files a fact extractor could not read, instead of silence."""
    sources = [(s, F.col("_facts")["error"]) for s in on if s in _PY]
    sources += [(s, F.col("_steps")["error"]) for s in on if s in _CI]
    if not sources:
        return F.array().cast(ERROR)
    every = F.array(*(F.struct(F.lit(s).alias("scanner"), m.alias("message")) for s, m in sources))
    return F.filter(every, lambda e: e["message"].isNotNull()).cast(ERROR)


def findings_of(scanned: DataFrame) -> DataFrame:
    """Flat findings: the table every statistic works on.

    The outer form matters: the optimizer infers ``size(findings) > 0`` from a plain
    ``inline`` and pushes a second copy of every rule below the scan.
    """
    flat = scanned.select(*REPO, "path", F.inline_outer("findings"))
    return flat.filter(F.col("rule_id").isNotNull())


def errors_of(scanned: DataFrame) -> DataFrame:
    flat = scanned.select(*REPO, "path", F.inline_outer("errors"))
    return flat.filter(F.col("scanner").isNotNull())


def scan(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of all enabled detectors."""
    return findings_of(scan_files(files, config))


def _verdict(n: Column, relaxed: Column, severe: Column, medium: Column) -> list[Column]:
    """Classification and summary text, by precedence."""
    cases = (
        (n == 0, "Safe", fixed.SUMMARY_NONE),
        (relaxed, "Safe", fixed.SUMMARY_DOCS),
        (severe, "Threat", fixed.SUMMARY_THREAT),
        (medium, "Potential Threat", fixed.SUMMARY_TOKENS),
        (F.lit(True), "Potential Threat", fixed.SUMMARY_LOW),
    )
    pick = lambda k: reduce(
        lambda acc, case: F.when(case[0], case[k]).otherwise(acc), reversed(cases), F.lit(None)
    )
    return [pick(1).alias("classification"), pick(2).alias("summary")]


def classify(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Verdict per repository from flat findings; repositories without findings are Safe."""
    sev = F.col("severity")
    per_repo = findings.groupBy(*REPO).agg(
        F.count(F.lit(1)).alias("n"),
        F.every((F.col("scanner") == "entropy_secrets") & paths.is_doc_like(F.col("path"))).alias("relaxed"),
        F.bool_or(sev.isin("high", "critical")).alias("severe"),
        F.bool_or(sev == "medium").alias("medium"),
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    return repos.select(*REPO).join(per_repo, REPO, "left").select(
        *REPO, n.alias("findings"),
        *_verdict(n, F.col("relaxed"), F.col("severe"), F.col("medium")),
    )


def repo_stats(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Files and bytes scanned per repository; reads no bodies."""
    return (
        selected_files(files.select(*REPO, "path", "length"), config)
        .groupBy(*REPO)
        .agg(F.count(F.lit(1)).alias("files_scanned"), F.sum("length").alias("bytes_scanned"))
        .withColumn("scanners_used", scanners_used(config))
    )


def scanners_used(config: ScanConfig) -> Column:
    return F.array(*(F.lit(s) for s in fixed.SCANNERS if s in config.enabled)).cast("array<string>")


def repo_summary(
    scanned: DataFrame,
    repos: DataFrame | None = None,
    config: ScanConfig = ScanConfig(),
    unscanned: bool = False,
) -> DataFrame:
    """Stats and verdict per repository, straight from the scan: one shuffle of partial sums.

    With ``repos`` every listed repository appears, also those without files.
    ``unscanned=True`` marks repositories without scanned files ``Unscanned``.
    """
    fs = F.col("findings")
    entropy_only = F.forall(fs, lambda x: x["scanner"] == "entropy_secrets")
    per_repo = scanned.groupBy(*REPO).agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.sum("length").alias("bytes_scanned"),
        F.sum(F.array_size(fs)).alias("n"),
        F.every((F.array_size(fs) == 0) | (entropy_only & paths.is_doc_like(F.col("path")))).alias("relaxed"),
        F.bool_or(F.exists(fs, lambda x: x["severity"].isin("high", "critical"))).alias("severe"),
        F.bool_or(F.exists(fs, lambda x: x["severity"] == "medium")).alias("medium"),
    )
    if repos is not None:
        per_repo = repos.select(*REPO).distinct().join(per_repo, REPO, "left")
    zero = F.lit(0).cast("bigint")
    n = F.coalesce(F.col("n"), zero)
    files = F.coalesce(F.col("files_scanned"), zero)
    out = per_repo.select(
        *REPO,
        files.alias("files_scanned"),
        F.coalesce(F.col("bytes_scanned"), zero).alias("bytes_scanned"),
        n.alias("findings"),
        *_verdict(n, F.col("relaxed"), F.col("severe"), F.col("medium")),
        scanners_used(config).alias("scanners_used"),
    )
    if unscanned:
        nothing = (F.col("files_scanned") == 0) & (F.col("findings") == 0)
        out = out.withColumn(
            "classification", F.when(nothing, "Unscanned").otherwise(F.col("classification"))
        )
    return out
