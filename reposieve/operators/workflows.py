"""CI workflow rules. YAML is read in Python; the rules are columns."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.operators import finding as f
from reposieve.policy import Policy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCANNER = "github_actions"
STEP = "struct<doc:int,job:string,step:int,uses:string,run:string>"
RESULT = f"struct<steps:array<{STEP}>,error:string>"
_ARROW = pa.struct([
    ("steps", pa.list_(pa.struct([
        ("doc", pa.int32()), ("job", pa.string()), ("step", pa.int32()),
        ("uses", pa.string()), ("run", pa.string()),
    ]))),
    ("error", pa.string()),
])


#: Collections inside each other beyond this are refused: composing them recurses in C and may crash.
MAX_DEPTH = 500


def _text(v) -> str | None:
    return v if isinstance(v, str) else None


def _check_depth(source: str, loader) -> None:
    """Raise on deep nesting. Events come one by one, so counting them needs no recursion."""
    import yaml

    depth = 0
    for event in yaml.parse(source, Loader=loader):
        depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
        if depth > MAX_DEPTH:
            raise RecursionError(f"nested more than {MAX_DEPTH} deep")


def steps_of(source: str) -> list[dict]:
    """Steps of every job of every document. Anything of the wrong shape raises."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    # Each level takes one bracket, dash, colon or question mark at least.
    if sum(map(source.count, "[{-:?")) > MAX_DEPTH:
        _check_depth(source, loader)
    jobs = (
        (number, str(name), body or {})
        for number, document in enumerate(list(yaml.load_all(source, Loader=loader)))
        if isinstance(document, dict)
        for name, body in (document.get("jobs") or {}).items()
    )
    return [
        {"doc": number, "job": name, "step": at, "uses": _text(step.get("uses")), "run": _text(step.get("run"))}
        for number, name, body in jobs
        for at, step in enumerate(body.get("steps") or [])
    ]


def _row(source: str | None) -> dict | None:
    if source is None:
        return None
    try:
        return {"steps": steps_of(source), "error": None}
    except Exception as e:
        return {"steps": [], "error": f"{type(e).__name__}: {e}"}


def _fits(row: dict | None) -> dict | None:
    """The row, or an error row if Arrow can't hold it (a lone surrogate, for instance)."""
    try:
        pa.array([row], _ARROW)
        return row
    except Exception as e:
        return {"steps": [], "error": f"{type(e).__name__}: {e}"}


def _batch(sources: pa.Array) -> pa.Array:
    rows = [_row(s.as_py()) for s in sources]
    try:
        return pa.array(rows, _ARROW)
    except Exception:
        return pa.array([_fits(r) for r in rows], _ARROW)


def workflow_steps(source: Column | str) -> Column:
    """``struct(steps, error)`` of a workflow file; NULL sources are not parsed."""
    return F.arrow_udf(_batch, RESULT)(source)


def step_rules(steps: Column, policy: Policy) -> Column:
    """Findings of all workflow rules."""
    r = fixed.REASONS
    rules = {
        "gha_uses_not_sha": ("medium", r["ci.sha"]),
        "gha_uses_floating": ("medium", r["ci.floating"]),
        "gha_uses_unpinned": ("medium", r["ci.unpinned"]),
        "gha_secrets_exfil": ("high", r["ci.exfil"]),
    }

    def of(s: Column, i: Column) -> Column:
        ref = F.substring_index(s["uses"], "@", -1)
        at = F.contains(s["uses"], F.lit("@"))
        hits = []
        if policy.require_sha_pin:
            # With SHA pinning on, a floating ref is already reported as not a SHA.
            hits.append(("gha_uses_not_sha", at & ~ref.rlike(fixed.SHA_PIN)))
        elif policy.require_pinned:
            hits.append(("gha_uses_floating", at & ref.isin(*fixed.FLOATING_REFS)))
        if policy.require_pinned:
            hits.append(("gha_uses_unpinned", ~at))
        hits.append((
            "gha_secrets_exfil",
            s["run"].rlike(fixed.RISKY_RUN) & s["run"].rlike(fixed.SECRET_IN_RUN),
        ))
        return f.by_rule(SCANNER, rules, hits, i, s["uses"], ref)

    return F.flatten(F.transform(steps, of))
