"""Secret patterns with masked evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import paths, text
from reposieve.operators import finding as f

SCANNER = "secrets"


def _may_match(rule_id: str, lower: Column) -> Column:
    """Plain substring test that lets most files skip the regex."""
    return reduce(
        lambda a, b: a | b, (F.contains(lower, F.lit(w)) for w in fixed.SECRET_WORDS[rule_id])
    )


def rule_findings(content: Column, rule_id: str, severity: str, reason: str, rx: str) -> Column:
    """All matches of one rule as findings, numbered in text order."""

    def of(sp: Column) -> Column:
        return F.transform(
            sp["toks"],
            lambda _t, i: f.finding(SCANNER, rule_id, severity, reason, text.masked(sp, i), i),
        )

    return text.bind(text.spans(content, rx), of)


def secrets(path: Column, content: Column, lower: Column) -> list[Column]:
    """One findings array per rule. Prose paths run only the two strict rules."""
    light = paths.is_light_path(path)
    out = []
    for rule_id, severity, reason, rx in fixed.SECRET_RULES:
        gate = _may_match(rule_id, lower) & content.rlike(rx)
        if rule_id not in fixed.LIGHT_RULES:
            gate = ~light & gate
        out.append(f.when_any(gate, rule_findings(content, rule_id, severity, reason, rx)))
    return out


def _rule_spans(content: Column, rule_id: str, rx: str) -> Column:
    def of(sp: Column) -> Column:
        return F.zip_with(
            sp["toks"], text.span_starts(sp),
            lambda t, at: F.struct(F.lit(rule_id).alias("rule_id"), at.alias("start"), (at + F.length(t)).alias("end")),
        )

    return F.when(content.rlike(rx), text.bind(text.spans(content, rx), of)).otherwise(
        F.array().cast("array<struct<rule_id:string,start:int,end:int>>")
    )


def secret_spans(files: DataFrame) -> DataFrame:
    """Distinct ``(rule_id, start, end)`` of every match, as offsets only: no secret text."""
    rules = [_rule_spans(F.col("content"), r, rx) for r, _sev, _reason, rx in fixed.SECRET_RULES]
    # Regex iteration never returns the same span twice, so no shuffle is needed.
    flat = files.select("owner", "name", "path", F.inline_outer(F.flatten(F.array(*rules))))
    return flat.filter(F.col("rule_id").isNotNull())
