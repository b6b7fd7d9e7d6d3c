"""Path columns: extensions, basenames, path classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed


def any_suffix(path: Column, exts: tuple[str, ...]) -> Column:
    """Case-sensitive ``endswith`` any of the extensions."""
    return path.rlike("(" + "|".join(re.escape(e) for e in exts) + r")\z")


def any_part(path: Column, snippets: tuple[str, ...]) -> Column:
    return path.rlike("(" + "|".join(re.escape(s) for s in snippets) + ")")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def last_dot_ext(path: Column) -> Column:
    """Lower-cased text from the last dot of the whole path: ``a.b/c`` gives ``.b/c``."""
    return F.regexp_extract(F.lower(path), r"(?s)(\.[^.]*)\z", 1)


def splitext(path: Column) -> Column:
    """Lower-cased extension of the basename; leading dots are part of the name."""
    return F.regexp_extract(F.lower(path), r"(?s)(?:\A|/)\.*[^/.][^/]*?(\.[^./]*)\z", 1)


def is_code_path(path: Column) -> Column:
    return splitext(path).isin(*fixed.CODE_EXTS)


def is_lockfile(path: Column) -> Column:
    return basename(path).isin(*fixed.LOCKFILES)


def is_manifest(path: Column) -> Column:
    return basename(path).isin(*fixed.MANIFESTS)


def is_workflow(path: Column) -> Column:
    return path.startswith(fixed.WORKFLOW_DIR) & any_suffix(path, fixed.WORKFLOW_EXTS)


def runner_ext_ok(path: Column) -> Column:
    ext = last_dot_ext(path)
    return (ext == "") | ext.isin(*fixed.CODE_EXTS) | is_manifest(path)


def is_doc_like(path: Column) -> Column:
    low = F.lower(path)
    return any_suffix(low, fixed.DOC_EXTS) | any_part(low, fixed.DOC_DIRS)


def is_noisy_path(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return basename(low).isin(*fixed.NOISY_BASENAMES) | any_part(low, fixed.NOISY_SNIPPETS)


def is_light_path(path: Column) -> Column:
    return path.rlike(fixed.LIGHT_PATHS)
