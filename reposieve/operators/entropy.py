"""High-entropy tokens near secret-ish context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import paths, text
from reposieve.operators import finding as f

SCANNER = "entropy_secrets"
RULE = "high_entropy_candidate"


def token_regex(min_len: int = fixed.TOKEN_MIN_LEN) -> str:
    """Maximal runs that can still pass the length test."""
    return f"{fixed.TOKEN_CLASS}{{{max(min_len, fixed.TOKEN_MIN_RUN)},}}"


def has_run(content: Column, n: int = fixed.TOKEN_MIN_LEN) -> Column:
    """A run of ``n`` token characters exists. The look-behind spares rescans inside words."""
    return content.rlike(f"(?<!{fixed.TOKEN_CLASS}){fixed.TOKEN_CLASS}{{{n},}}")


def is_candidate(
    tok: Column, min_len: int = fixed.TOKEN_MIN_LEN, min_bits: float = fixed.TOKEN_MIN_BITS
) -> Column:
    """Guardrails, character classes, length and entropy, cheapest first."""
    low = F.lower(tok)
    safe = reduce(lambda a, b: a | b, (F.startswith(low, F.lit(p)) for p in fixed.SAFE_PREFIXES))
    return (
        (F.length(tok) >= min_len)
        & (F.length(tok) <= fixed.TOKEN_MAX_LEN)
        & ~safe
        & ~tok.rlike(fixed.UUID_SHAPE)
        & ~tok.rlike(fixed.HEX_SHAPE)
        & (text.char_classes(tok, ascii_only=True) >= fixed.TOKEN_MIN_CLASSES)
        & (text.shannon_entropy(tok) >= min_bits)
    )


def path_in_scope(path: Column, window: str = "chars") -> Column:
    if window == "line":
        return paths.any_suffix(path, fixed.ENTROPY_LINE_EXTS) & ~path.rlike(
            fixed.ENTROPY_LINE_LOCKFILES
        )
    return paths.any_suffix(path, fixed.ENTROPY_EXTS) & ~paths.is_noisy_path(path)


def char_window(sp: Column, tok: Column, i: Column, radius: int, min_len: int) -> Column:
    before, after = text.around(sp, i, radius, max(min_len, fixed.TOKEN_MIN_RUN))
    return F.concat(before, tok, after)


def line_window(sp: Column, tok: Column, i: Column, radius: int, min_len: int) -> Column:
    """Up to ``radius`` characters each side, but not past the line of the token."""
    before, after = text.around(sp, i, radius, max(min_len, fixed.TOKEN_MIN_RUN))
    return F.concat(F.substring_index(before, "\n", -1), tok, F.substring_index(after, "\n", 1))


def in_context(sp: Column, tok: Column, i: Column, radius: int, window: str, min_len: int) -> Column:
    if window == "line":
        near = line_window(sp, tok, i, radius, min_len)
        return near.rlike(fixed.CONTEXT_HINTS) & near.rlike(fixed.ASSIGNMENT)
    near = char_window(sp, tok, i, radius, min_len)
    return near.rlike(fixed.CONTEXT_WORDS) | near.rlike(fixed.ASSIGNMENT)


def entropy(
    content: Column,
    min_len: int = fixed.TOKEN_MIN_LEN,
    min_bits: float = fixed.TOKEN_MIN_BITS,
    radius: int = fixed.CONTEXT_RADIUS,
    window: str = "chars",
) -> Column:
    """Findings array. Contexts are put together only for tokens that pass every other test."""
    reason = fixed.ENTROPY_LINE_REASON if window == "line" else fixed.ENTROPY_REASON

    def of(sp: Column) -> Column:
        numbered = F.transform(sp["toks"], lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        passing = F.filter(numbered, lambda x: is_candidate(x["t"], min_len, min_bits))
        near = F.filter(
            passing,
            lambda x: in_context(sp, x["t"], x["i"], radius, window, min_len),
        )

        def one(x: Column) -> Column:
            # Rounded half to even first: printf would round ties up.
            bits = F.bround(F.round(text.shannon_entropy(x["t"]), 12), 2)
            return f.finding(
                SCANNER, RULE, "medium",
                F.format_string(reason, bits, F.length(x["t"])), F.lit(fixed.MASK), x["i"],
            )

        return F.transform(near, one)

    return text.bind(text.spans(content, token_regex(min_len)), of)
