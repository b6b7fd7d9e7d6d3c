"""Static risk rules on call facts and on script text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import paths
from reposieve.operators import finding as f

SCANNER = "static_risk"


def text_rules(path: Column, content: Column, lower: Column) -> list[Column]:
    script = paths.any_suffix(path, fixed.STATIC_TEXT_EXTS)
    node = F.contains(lower, F.lit("child_process.exec(")) | F.contains(
        lower, F.lit("child_process.execsync(")
    )
    return [
        f.once(
            script & F.contains(content, F.lit("eval(")),
            f.finding(SCANNER, "text_eval_call", "medium", fixed.REASONS["static.text_eval"]),
        ),
        f.once(
            script & node,
            f.finding(SCANNER, "node_exec_call", "medium", fixed.REASONS["static.node_exec"]),
        ),
    ]


RULES = {
    "py_eval": ("medium", fixed.REASONS["static.py_eval"]),
    "py_exec": ("medium", fixed.REASONS["static.py_exec"]),
    "py_subprocess_shell_true": ("high", fixed.REASONS["static.shell"]),
}


def is_call_of(c: Column, name: str) -> Column:
    """Call of a bare name."""
    return ~c["attr"] & (c["fn"] == name)


def call_rules(calls: Column) -> Column:
    """``eval``/``exec`` by bare name, and ``shell=True`` on any receiver."""

    def of(c: Column) -> Column:
        return f.by_rule(SCANNER, RULES, [(f"py_{n}", is_call_of(c, n)) for n in fixed.CODE_RUNNERS], c["seq"])

    def shells(c: Column) -> Column:
        hit = c["attr"] & c["fn"].isin(*fixed.SHELL_CALLS)
        one = f.by_rule(SCANNER, RULES, [("py_subprocess_shell_true", hit)], c["seq"])
        # One finding per shell=True keyword, also when it is repeated.
        return F.flatten(F.array_repeat(one, c["shell"]))

    return F.flatten(F.transform(calls, lambda c: F.concat(of(c), shells(c))))
