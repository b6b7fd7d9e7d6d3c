"""Shell globs over whole paths: case-sensitive, ``*`` also crosses ``/``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed


def _class(glob: str, i: int) -> tuple[str, int] | None:
    """Java character class for the ``[`` at ``i`` and the index after it."""
    j = i + 1
    if glob[j : j + 1] == "!":
        j += 1
    end = glob.find("]", j + 1)
    if end < 0:
        return None
    body = glob[j:end]
    items = []
    k = 0
    while k < len(body):
        if k + 2 < len(body) and body[k + 1] == "-":
            if body[k] <= body[k + 2]:
                items.append(f"{re.escape(body[k])}-{re.escape(body[k + 2])}")
            k += 3
        else:
            items.append(re.escape(body[k]))
            k += 1
    negated = j > i + 1
    if not items:
        return (r"[\s\S]" if negated else r"[^\s\S]"), end + 1
    return f"[{'^' if negated else ''}{''.join(items)}]", end + 1


def glob_regex(glob: str) -> str:
    """Java regex that finds exactly the texts the glob matches.

    Anchors stand only where the glob does not begin or end with ``*``.
    """
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        cls = _class(glob, i) if ch == "[" else None
        if cls:
            out.append(cls[0])
            i = cls[1]
            continue
        out.append(".*" if ch == "*" else "." if ch == "?" else re.escape(ch))
        i += 1
    parts = [p for k, p in enumerate(out) if p != ".*" or k == 0 or out[k - 1] != ".*"]
    if parts == [".*"]:
        return ".*"
    lead, trail = parts[:1] == [".*"], parts[-1:] == [".*"]
    body = parts[lead : len(parts) - trail]
    return ("" if lead else r"\A") + "".join(body) + ("" if trail else r"\z")


def globs_regex(globs: Iterable[str]) -> str:
    return "(?s)(?:" + "|".join(map(glob_regex, globs)) + ")"


def root_variants(globs: Iterable[str]) -> list[str]:
    """Globs plus, for each leading ``**/``, the form that also hits the repository root."""
    out: list[str] = []
    for g in globs:
        out.append(g)
        if g.startswith("**/"):
            out.append(g[3:])
    return list(dict.fromkeys(out))


def glob_match(path: Column | str, globs: Iterable[str], root_aware: bool = False) -> Column:
    """True where the path matches any glob.

    The list is plan-time configuration: all of it becomes one regex literal, compiled
    once per task, and the path is looked at once.
    """
    path = F.col(path) if isinstance(path, str) else path
    globs = root_variants(globs) if root_aware else list(dict.fromkeys(globs))
    return path.rlike(globs_regex(globs)) if globs else F.lit(False)


def parse_globs(col: Column | str) -> Column:
    """Comma-separated text to a glob array: trimmed, no blanks, first occurrence kept."""
    col = F.col(col) if isinstance(col, str) else col
    trimmed = F.transform(F.split(col, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def effective_ignores(
    configured: Iterable[str] | None = None,
    extend: Iterable[str] = (),
    env_extra: str = "",
    ignore_file: Iterable[str] = (),
) -> list[str]:
    """Ignore globs in force. A configured list replaces everything else."""
    if configured is not None:
        chosen = list(configured)
    else:
        chosen = [*fixed.DEFAULT_IGNORES, *extend, *env_extra.split(","), *ignore_file]
    return list(dict.fromkeys(g for g in (str(x).strip() for x in chosen) if g))
