"""The finding value that every detector returns an array of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = (
    "struct<scanner:string,rule_id:string,severity:string,reason:string,evidence:string,ord:int>"
)
NONE = f"array<{FINDING}>"


def _text(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def finding(
    scanner: str,
    rule_id: Column | str,
    severity: Column | str,
    reason: Column | str,
    evidence: Column | None = None,
    ord: Column | None = None,
) -> Column:
    """One finding. ``ord`` tells repeated findings of a rule in one file apart."""
    return F.struct(
        F.lit(scanner).alias("scanner"),
        _text(rule_id).alias("rule_id"),
        _text(severity).alias("severity"),
        _text(reason).alias("reason"),
        (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence"),
        (F.lit(0) if ord is None else ord).cast("int").alias("ord"),
    )


def none() -> Column:
    return F.array().cast(NONE)


def when_any(cond: Column, found: Column) -> Column:
    """``found`` where the condition holds, else no findings."""
    return F.when(cond, found).otherwise(none())


def once(cond: Column, one: Column) -> Column:
    """At most one finding per file."""
    return when_any(cond, F.array(one))


def by_rule(scanner: str, rules: dict[str, tuple[str, str]], hits: list[tuple[str, Column]],
            ord: Column, *args: Column) -> Column:
    """Findings of the rules that hit. ``rules`` maps rule id to (severity, reason format).

    The texts sit in one constant map, which keeps the generated code small.
    """
    meta = F.create_map(*(
        x for rule_id, (severity, reason) in rules.items()
        for x in (F.lit(rule_id), F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason")))
    ))
    hit = F.filter(F.array(*(F.when(cond, F.lit(r)) for r, cond in hits)), lambda r: r.isNotNull())
    return F.transform(hit, lambda r: finding(
        scanner, r, F.element_at(meta, r)["severity"],
        F.call_function("format_string", F.element_at(meta, r)["reason"], *args), ord=ord,
    ))
