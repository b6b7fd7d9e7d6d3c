import pytest
import fnmatch
import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import paths, text
from reposieve.functions.globs import effective_ignores, glob_match, glob_regex
from reposieve.operators import select
from reposieve.plans.scan import ScanConfig, selected_files


@settings(max_examples=400, deadline=None)
@given(st.text("ab/.*?[]!-", max_size=8), st.text("ab/.-[]!", max_size=8))
def test_glob_regex_equals_fnmatch(glob, path):
    import re

    found = re.search("(?s)" + glob_regex(glob).replace(r"\z", r"\Z"), path)
    assert bool(found) == fnmatch.fnmatchcase(path, glob)


def test_globs_in_spark(spark):
    cases = ["docs/a.py", "x/docs/a.py", "a\n.py", "setup.py", "x/setup.py", "A.PY", "a.lock", "x/a.lock", "a+b.py"]
    globs = ["**/docs/**", "**/*.py", "*.lock", "[!a]*", "a?*", "a+b*"]
    df = spark.createDataFrame([(c,) for c in cases], "path string")
    for g in globs:
        got = {r[0]: r[1] for r in df.select("path", glob_match("path", [g])).collect()}
        assert got == {c: fnmatch.fnmatchcase(c, g) for c in cases}, g
    assert df.filter(glob_match("path", ["**/docs/**"], root_aware=True)).count() == 2
    assert df.filter(glob_match("path", [])).count() == 0


def test_extensions(spark):
    cases = ["a.py", ".env", "x/.env", "a.b/c", "..py", "a.", "x/a.tar.GZ", "Makefile", "x.y/.z.w", ""]
    df = spark.createDataFrame([(c,) for c in cases], "path string")
    p = F.col("path")
    for r in df.select("path", paths.splitext(p).alias("a"), paths.last_dot_ext(p).alias("b")).collect():
        assert r["a"] == os.path.splitext(r["path"].lower())[1], r
        low = r["path"].lower()
        assert r["b"] == ("." + low.rsplit(".", 1)[1] if "." in low else ""), r


def test_include_exclude_precedence(make_files):
    files = make_files(("src/a.py", "x"), ("src/b.md", "x"), ("docs/c.py", "x"), ("z/docs/d.py", "x"), ("e.bin", "x"))
    paths_of = lambda df: sorted(r["path"] for r in df.collect())
    assert paths_of(select.select_paths(files)) == ["docs/c.py", "src/a.py"]
    assert paths_of(select.select_paths(files, exclude=())) == ["docs/c.py", "src/a.py", "z/docs/d.py"]
    assert paths_of(select.select_paths(files, ("src/*",), ("*.md",))) == ["src/a.py"]
    assert paths_of(select.select_paths(files, root_aware=True)) == ["src/a.py"]


def test_size_guard_and_routing(make_files):
    big = "x" * 500_001
    files = make_files(
        ("a.py", "x = 1"), ("big.py", big), ("empty.py", ""), ("bin.py", "a\0b"), ("ctl.py", "\x01" * 7 + "abc"),
        ("yarn.lock", "x"), ("setup.py", "x"), (".github/workflows/ci.yml", ""), ("notes.xyz", "x"), ("Makefile", "x"),
    )
    assert selected_files(files, ScanConfig(include=("*",), exclude=())).count() == 9
    routed = {r["path"]: r["scanners"] for r in select.route(files, ignore=()).collect()}
    code = ["secrets", "entropy_secrets", "static_risk", "taint_risk", "yara"]
    assert routed["a.py"] == code and routed["Makefile"] == code
    assert routed["setup.py"] == code[:4] + ["deps_audit", "yara"]
    assert routed["yarn.lock"] == ["deps_audit"] and routed[".github/workflows/ci.yml"] == ["github_actions"]
    assert all(routed[p] == [] for p in ("big.py", "empty.py", "bin.py", "ctl.py", "notes.xyz"))
    assert {r["path"]: r["scanners"] for r in select.route(files, ("*",)).collect()}["yarn.lock"] == ["deps_audit"]


def test_binary_matches_isprintable(spark):
    cases = ["", "abc", "\x01", "\x01\x01ab", "é" * 9 + "\x02", "a​ ", "　" * 3 + "abc", "퟿x", "\n\r\t", "a\0"]
    def want(s):
        if not s:
            return False
        return "\0" in s or sum(c.isprintable() or c in "\r\n\t" for c in s) / len(s) < 0.7
    df = spark.createDataFrame([(c,) for c in cases], "content string")
    for r in df.select("content", text.is_binary(F.col("content"))).collect():
        assert r[1] == want(r[0]), repr(r[0])


def test_cap_files(make_files):
    files = make_files(*((f"f{i:03}.py", "x") for i in range(40))).union(make_files(("a.py", "y"), name="small"))
    with pytest.raises(ValueError):
        select.cap_files(files, 7)
    again = files.drop("content").union(files.drop("content"))  # equal paths count, too
    assert [n for _, n in again.transform(select.cap_files, 7).groupBy("name").count().orderBy("name").collect()] == [7, 2]
    kept = select.cap_files(files.drop("content"), 7).collect()
    assert sorted(r["path"] for r in kept if r["name"] == "r") == [f"f{i:03}.py" for i in range(7)]
    assert [r["path"] for r in kept if r["name"] == "small"] == ["a.py"]


def test_effective_ignores():
    assert effective_ignores([" a ", "a", "", "b"], ["c"], "d", ["e"]) == ["a", "b"]
    merged = effective_ignores(None, ["x/**"], " y , ,x/**", ["z"])
    assert merged[: len(fixed.DEFAULT_IGNORES)] == list(fixed.DEFAULT_IGNORES) and merged[-3:] == ["x/**", "y", "z"]
    assert select.configured_excludes(None) == list(fixed.CONFIGURED_IGNORES) and select.configured_excludes([]) == []
