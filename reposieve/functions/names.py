"""Repository names, URLs, session ids, stamps and small report scalars."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed

# Fixed patterns and texts of names.
REPO_URL = r"\Ahttps?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?\n?\z"
REPO_URL_IN_TEXT = r"https?://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
REPO_URL_TAIL = r"https?://[^/]+/([^/]+)/([^/]+)/?$"
RUN_ID_PAIR = r"([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
UNKNOWN_REPO = "unknown_repo"
STAMP = "yyyyMMdd_HHmmss'Z'"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{fixed.WS}]+|[{fixed.WS}]+\z", "")


def filled(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(_strip(c), F.lit(""))


def parse_repo_url(url: Column) -> Column:
    """``struct(owner, name)`` of a repository URL; NULL when it is not one."""
    return F.when(
        url.rlike(REPO_URL),
        F.struct(
            F.regexp_extract(url, REPO_URL, 1).alias("owner"),
            F.regexp_extract(url, REPO_URL, 2).alias("name"),
        ),
    )


def find_repo_url(text: Column) -> Column:
    """Canonical repository URL mentioned in free text; sub-paths, ``.git`` and final dots go."""
    name = F.regexp_replace(F.regexp_extract(text, REPO_URL_IN_TEXT, 2), r"(\.git)?\.*\z", "")
    return F.when(
        text.rlike(REPO_URL_IN_TEXT),
        F.concat(
            F.lit("https://github.com/"), F.regexp_extract(text, REPO_URL_IN_TEXT, 1), F.lit("/"), name
        ),
    )


def class_rank(classification: Column) -> Column:
    m = F.create_map(*map(F.lit, chain.from_iterable(fixed.CLASS_RANK.items())))
    return F.coalesce(F.try_element_at(m, classification), F.lit(0))


def exit_code(classification: Column) -> Column:
    m = F.create_map(*map(F.lit, chain.from_iterable(fixed.EXIT_CODES.items())))
    return F.coalesce(F.try_element_at(m, classification), F.lit(1))


def short_hash(s: Column, n: int = 6) -> Column:
    return F.upper(F.left(F.sha1(s.cast("binary")), F.lit(n)))


def infer_session_id(*candidates: Column) -> Column:
    """Short hash of the first candidate that is not blank."""
    return short_hash(F.coalesce(*(filled(c) for c in candidates)))


def session_of(session_id: Column, run_id: Column, config_hash: Column) -> Column:
    """Explicit session id, else the hash of the run id or the configuration hash."""
    return F.coalesce(filled(session_id), infer_session_id(run_id, config_hash))


def stamp(ts: Column) -> Column:
    """UTC stamp of a timestamp (session time zone UTC)."""
    return F.date_format(ts, STAMP)


def stamp_prefix(ts: Column, session_id: Column) -> Column:
    return F.concat(stamp(ts), F.lit("-"), session_id)


def seconds_between(started: Column, finished: Column) -> Column:
    """Duration of two ISO-8601 texts; NULL when either is not a timestamp."""
    a, b = F.try_to_timestamp(started), F.try_to_timestamp(finished)
    return F.unix_micros(b) / 1e6 - F.unix_micros(a) / 1e6


def pct(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n * 100.0, d), F.lit(0.0))


def round2(c: Column) -> Column:
    """Two decimals, ties to even."""
    return F.bround(c, 2)


def repo_display_name(
    full_name: Column,
    owner: Column,
    name: Column,
    alternates: list[Column],
    url: Column,
    run_id: Column,
) -> Column:
    """``owner/name`` of a report, from the best field it has."""
    alt = F.coalesce(*(filled(a) for a in alternates))
    alt_name = F.when(
        F.contains(alt, F.lit("__")) & ~F.contains(alt, F.lit("/")),
        F.concat(
            F.substring_index(alt, "__", 1),
            F.lit("/"),
            F.substr(alt, F.locate("__", alt) + 2),
        ),
    ).otherwise(alt)
    from_url = F.when(
        url.rlike(REPO_URL_TAIL),
        F.concat(F.regexp_extract(url, REPO_URL_TAIL, 1), F.lit("/"), F.regexp_extract(url, REPO_URL_TAIL, 2)),
    )
    pieces = F.filter(F.split(F.regexp_replace(run_id, r"\Abatch[-_]", ""), "-"), lambda t: t != "")
    from_run = F.when(
        run_id.rlike(RUN_ID_PAIR),
        F.concat(F.regexp_extract(run_id, RUN_ID_PAIR, 1), F.lit("/"), F.regexp_extract(run_id, RUN_ID_PAIR, 2)),
    ).when(
        F.array_size(pieces) >= 2,
        F.concat(F.get(pieces, F.lit(0)), F.lit("/"), F.array_join(F.slice(pieces, 2, 2147483646), "-")),
    )
    both = F.when((owner != "") & (name != ""), F.concat(owner, F.lit("/"), name))
    return F.coalesce(
        F.nullif(full_name, F.lit("")), both, alt_name, from_url, from_run, F.lit(UNKNOWN_REPO)
    )


def safe_report_filename(display_name: Column) -> Column:
    return F.when(
        display_name == UNKNOWN_REPO,
        F.concat(
            F.lit("unknown_repo_"), F.left(F.sha1(display_name.cast("binary")), F.lit(8)), F.lit(".md")
        ),
    ).otherwise(F.concat(F.replace(display_name, F.lit("/"), F.lit("__")), F.lit(".md")))
