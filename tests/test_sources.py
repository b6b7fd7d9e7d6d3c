"""Archives by ranges, trees by listing: what is not selected is never read."""

import zipfile

import pytest

from reposieve.sources import files as fs


def archive(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, body in members.items():
            z.writestr(name, body)


def test_an_archive_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fs, "RANGE", 1 << 12)
    members = {f"top/src/f{k}.py": bytes((k * 7 + i * i) % 251 for i in range(500)) for k in range(400)}
    inner = tmp_path / "inner.zip"
    archive(inner, {"x/y.py": "nested"}, zipfile.ZIP_STORED)
    members["top/lib.zip"] = inner.read_bytes()  # signatures inside a member are no members
    archive(tmp_path / "own__big.zip", members, zipfile.ZIP_STORED)
    inner.unlink()
    from pyspark.sql import functions as F

    files, errors = fs.read_archives(spark, str(tmp_path))
    assert files.select(F.spark_partition_id()).distinct().count() > 8
    got = {r["path"]: r["content"] for r in files.collect()}
    assert got == {n.split("/", 1)[1]: b.decode("utf-8", "ignore") for n, b in members.items()} and errors.count() == 0


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_methods_and_damage(spark, tmp_path, method):
    archive(tmp_path / "o__good.zip", {"t/a b+c%20é.py": "print('é')", "t/big.bin": b"0" * 999, "t/d/": b"", "t/empty": b""}, method)
    archive(tmp_path / "o__cut.zip", {"t/a.py": "x" * 5000}, method)
    (tmp_path / "o__cut.zip").write_bytes((tmp_path / "o__cut.zip").read_bytes()[:-30])
    (tmp_path / "o__none.zip").write_bytes(b"P")
    files, errors = fs.read_archives(spark, str(tmp_path), max_bytes=500)
    got = sorted((r["name"], r["path"], r["length"], r["content"]) for r in files.collect())
    bad = {r["name"] for r in errors.collect()}
    if method == zipfile.ZIP_LZMA:  # listed, but not unpacked
        assert got == [("good", "big.bin", 999, None)] and bad == {"good", "cut", "none"}
    else:
        assert got == [("good", "a b+c%20é.py", 11, "print('é')"), ("good", "big.bin", 999, None), ("good", "empty", 0, "")]
        assert bad == {"cut", "none"}


def test_members_that_are_not_selected_are_not_fetched(spark, tmp_path):
    archive(tmp_path / "o__r.zip", {"t/keep.py": "x = 1", "t/drop.py": "y = 2" * 50}, zipfile.ZIP_STORED)
    body = bytearray((tmp_path / "o__r.zip").read_bytes())
    at = body.index(b"y = 2")
    body[at:at + 5] = b"z = 3"  # reading it would be an error
    (tmp_path / "o__r.zip").write_bytes(body)
    for wanted, failed in ((lambda p: ~p.endswith("drop.py"), 0), (None, 1)):
        files, errors = fs.read_archives(spark, str(tmp_path), wanted=wanted)
        assert [r["path"] for r in files.collect()] == ["keep.py"] and errors.count() == failed


def test_no_archives(spark, tmp_path):
    files, errors = fs.read_archives(spark, str(tmp_path))
    assert files.count() == 0 and errors.count() == 0


def test_files_of_a_tree_that_are_not_selected_are_not_opened(spark, tmp_path):
    tree = {"o/r/src/a+b%20c.py": "x = 1", "o/r/src/long.py": "y" * 80, "o/r/docs/é f.py": "z", "o/stray.py": "y" * 80,
            "o/r/src/__init__.py": "", "o/r/.github/workflows/ci.yml": "on: push", "p/q/_x.py": "p"}
    for p, b in tree.items():
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text(b)
    log = str(tmp_path / "opened")

    def counted(uri):
        with open(log, "a") as f:
            f.write(uri.rsplit("/", 1)[-1] + "\n")
        return fs.open_uri(uri)

    files = fs.read_tree(spark, str(tmp_path / "t"), max_bytes=50, exclude=("docs/**",), open_file=counted)
    assert sorted((r["owner"], r["path"], r["content"]) for r in files.collect()) == [
        ("o", ".github/workflows/ci.yml", "on: push"), ("o", "src/__init__.py", ""), ("o", "src/a+b%20c.py", "x = 1"), ("p", "_x.py", "p")]
    with open(log) as f:
        assert sorted(f.read().split("\n")[:-1]) == ["__init__.py", "_x.py", "a+b%20c.py", "ci.yml"]
    (tmp_path / "none").mkdir()
    assert fs.read_tree(spark, str(tmp_path / "none")).count() == 0
