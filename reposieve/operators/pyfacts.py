"""Facts about Python source. Only parsing happens in Python; the rules are columns.

One Arrow batch of sources in, one array of facts per source out. A fact is a
parameter, a ``name = name`` assignment, or a call of a watched function, in the
order a parent-first walk meets them. The walk keeps a table of tainted names, so a fact that
taints a name first says so, and a call has for each argument the position since which it is tainted.
"""

from __future__ import annotations

import ast
import sys
import warnings
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed

# Ship this module with the function, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A source without any of these words has no watched call.
MENTIONS = ("eval", "exec", "open", "shell", "subprocess", "remove", "unlink", "rmtree", "requests")
WATCHED = frozenset(
    (*fixed.CODE_RUNNERS, *fixed.SHELL_CALLS, *fixed.HTTP_CALLS, "open", *(fn for _m, fn in fixed.FILE_CALLS))
)
FACT = (
    "struct<kind:string,seq:int,name:string,src:string,mod:string,fn:string,attr:boolean,"
    "args:array<string>,lit:string,shell:int,taints:boolean,since:array<int>>"
)
RESULT = f"struct<facts:array<{FACT}>,error:string>"
_ARROW = pa.struct([
    ("facts", pa.list_(pa.struct([
        ("kind", pa.string()), ("seq", pa.int32()), ("name", pa.string()), ("src", pa.string()),
        ("mod", pa.string()), ("fn", pa.string()), ("attr", pa.bool_()),
        ("args", pa.list_(pa.string())), ("lit", pa.string()), ("shell", pa.int32()),
        ("taints", pa.bool_()), ("since", pa.list_(pa.int32())),
    ]))),
    ("error", pa.string()),
])


def _name(node) -> str | None:
    return node.id if isinstance(node, ast.Name) else None


def _call(node: ast.Call, seq: int, since: dict[str, int]) -> dict | None:
    attr = isinstance(node.func, ast.Attribute)
    fn = node.func.attr if attr else _name(node.func)
    if fn not in WATCHED:
        return None
    first = node.args[0] if node.args else None
    lit = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None
    shell = sum(
        k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True
        for k in node.keywords
    )
    args = [_name(a) for a in node.args]
    return {
        "kind": "call", "seq": seq, "fn": fn, "attr": attr, "lit": lit, "shell": shell,
        "mod": _name(node.func.value) if attr else None,
        "args": args, "since": [since.get(a) for a in args],
    }


def facts_of(source: str) -> list[dict]:
    """Facts of one source; sources without a watched call give none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        todo = [ast.parse(source)]
    out: list[dict] = []
    since: dict[str, int] = {}  # where a name was tainted first
    calls = seq = 0

    def flow(kind: str, name: str, tainted: bool, src: str | None = None) -> None:
        taints = tainted and name not in since
        if taints:
            since[name] = seq
        out.append({"kind": kind, "seq": seq, "name": name, "src": src, "taints": taints})

    while todo:
        node = todo.pop()
        seq += 1
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for a in node.args.args:
                flow("param", a.arg, True)
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Name):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    flow("copy", t.id, node.value.id in since, node.value.id)
        elif isinstance(node, ast.Call) and (fact := _call(node, seq, since)):
            out.append(fact)
            calls += 1
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    return out if calls else []


def _row(source: str | None) -> dict | None:
    if source is None:
        return None
    try:
        return {"facts": facts_of(source), "error": None}
    except Exception as e:
        return {"facts": [], "error": f"{type(e).__name__}: {e}"}


def _batch(sources: pa.Array) -> pa.Array:
    rows = [_row(s.as_py()) for s in sources]
    try:
        return pa.array(rows, _ARROW)
    except Exception:
        # A string literal that is not valid UTF-8 (a lone surrogate) loses only its own file.
        safe = []
        for r in rows:
            try:
                pa.array([r], _ARROW)
                safe.append(r)
            except Exception as e:
                safe.append({"facts": [], "error": f"{type(e).__name__}: {e}"})
        return pa.array(safe, _ARROW)


def py_facts(source: Column | str) -> Column:
    """``struct(facts, error)`` of a Python source; NULL sources are not parsed."""
    return F.arrow_udf(_batch, RESULT)(source)


def worth_parsing(content: Column) -> Column:
    """Watched names appear in the text, or could be spelled with folded non-ASCII letters.

    Substring tests: several are still cheaper than one regex with alternatives.
    """
    mentioned = reduce(lambda a, b: a | b, (F.contains(content, F.lit(w)) for w in MENTIONS))
    return mentioned | (F.octet_length(content) != F.length(content))
