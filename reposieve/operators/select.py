"""File selection: which files of a repository are scanned, and by which scanners."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import paths, text
from reposieve.functions.globs import glob_match

REPO = ["owner", "name"]


def configured_excludes(exclude: Iterable[str] | None) -> list[str]:
    """``None`` means the shipped ignore list, an empty list means no ignores."""
    return list(fixed.CONFIGURED_IGNORES if exclude is None else exclude)


def path_selected(
    path: Column, include: Iterable[str] = (), exclude: Iterable[str] = (), root_aware: bool = False
) -> Column:
    """Excludes always drop; includes, when given, must match; else only code extensions."""
    include, exclude = list(include), list(exclude)
    keep = glob_match(path, include, root_aware) if include else paths.is_code_path(path)
    return ~glob_match(path, exclude, root_aware) & keep


def select_paths(
    files: DataFrame,
    include: Iterable[str] = (),
    exclude: Iterable[str] | None = None,
    root_aware: bool = False,
) -> DataFrame:
    return files.filter(
        path_selected(F.col("path"), include, configured_excludes(exclude), root_aware)
    )


def not_ignored(path: Column, include: Iterable[str], ignore: Iterable[str]) -> Column:
    """Includes win over ignores."""
    return glob_match(path, include) | ~glob_match(path, ignore)


def size_ok(files: DataFrame, max_bytes: int = fixed.MAX_BYTES) -> DataFrame:
    """Raw size guard on ``length``, which Parquet row groups can be skipped by."""
    return files.filter(F.col("length") <= max_bytes)


def skipped_files(
    files: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] | None = None,
    max_bytes: int = fixed.MAX_BYTES, root_aware: bool = False,
) -> DataFrame:
    """``(owner, name, path, length, reason)`` of the files that selection leaves out, by the first rule that does."""
    path, include = F.col("path"), list(include)
    reason = (
        F.when(F.col("length").isNull() | (F.col("length") > max_bytes), "size")
        .when(glob_match(path, configured_excludes(exclude), root_aware), "excluded")
        .when(~path_selected(path, include, (), root_aware), "not included" if include else "extension")
    )
    return files.select(*REPO, "path", "length", reason.alias("reason")).filter(F.col("reason").isNotNull())


def route(
    files: DataFrame,
    include: Iterable[str] = (),
    ignore: Iterable[str] | None = None,
    max_bytes: int = fixed.MAX_BYTES,
) -> DataFrame:
    """Add ``scanners``: the names of the scanners that look at the file."""
    include, path, content = list(include), F.col("path"), F.col("content")
    names = lambda keep: F.array(*(F.lit(s) for s in fixed.SCANNERS if keep(s)))
    ext_ok = F.lit(True) if include else paths.runner_ext_ok(path)
    scannable = (
        not_ignored(path, include, configured_excludes(ignore))
        & (content != "")
        & (F.octet_length(content) <= max_bytes)
        & ext_ok
        & ~text.is_binary(content)
    )
    return files.withColumn(
        "scanners",
        F.when(paths.is_workflow(path), names(lambda s: s == "github_actions"))
        .when(~F.coalesce(scannable, F.lit(False)), F.array().cast("array<string>"))
        .when(paths.is_lockfile(path), names(lambda s: s == "deps_audit"))
        .when(paths.is_manifest(path), names(lambda s: s != "github_actions"))
        .otherwise(names(lambda s: s not in ("github_actions", "deps_audit"))),
    )


def manifest_files(files: DataFrame) -> DataFrame:
    """Dependency manifests and lockfiles."""
    path = F.col("path")
    return files.filter(paths.is_manifest(path)).select(
        *REPO, "path", paths.basename(path).alias("basename"), paths.is_lockfile(path).alias("lockfile")
    )


def cap_files(files: DataFrame, n: int = fixed.MAX_FILES_PER_REPO) -> DataFrame:
    """First ``n`` rows of each repository of a listing, in path order; equal paths in the order of their other columns.

    A listing has no bodies: it is capped before they are read. The rank limit is applied before
    the shuffle, so of a repository that holds most files only ``n`` rows a task move.
    """
    if "content" in files.columns:
        raise ValueError("cap a listing without content, before the bodies are read")
    rest = [c for c in files.columns if c not in (*REPO, "path")]
    w = Window.partitionBy(*REPO).orderBy("path", *(F.to_json(F.struct(c)) for c in rest))
    return files.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
