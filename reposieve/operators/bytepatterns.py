"""Byte-pattern rules: at most one finding per file and rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import paths
from reposieve.operators import finding as f

SCANNER = "yara"


def rules(content: Column, has_run: Column) -> tuple[tuple[str, str, Column], ...]:
    """``(name, severity, condition)``. ``has_run`` says whether a run of 40 token characters exists."""
    nul_pair = F.substr(content, F.lit(1), F.lit(2)) == F.lit("\0\0")
    return (
        ("HighEntropyTokenLike", "medium", has_run),
        (
            "Suspicious_Python_Exec",
            "medium",
            content.rlike(fixed.EXEC_BYTES) & (F.octet_length(content) >= 2) & ~nul_pair,
        ),
    )


def in_scope(path: Column) -> Column:
    return paths.any_suffix(path, fixed.BYTE_RULE_EXTS)


def byte_rules(path: Column, content: Column, has_run: Column) -> list[Column]:
    return [
        f.once(in_scope(path) & cond, f.finding(SCANNER, name, sev, fixed.REASONS["bytes"] % name))
        for name, sev, cond in rules(content, has_run)
    ]
