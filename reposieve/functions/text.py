"""Text columns: regex spans without offsets, masking, entropy, byte decoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, regex: str) -> Column:
    """``struct(toks, gaps)``: the matches and the text around them, in order.

    ``gaps[i]`` precedes ``toks[i]`` and ``gaps[i + 1]`` follows it, so
    neighbourhoods come from neighbours and offsets from lengths, in code points.
    """
    return F.struct(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("toks"),
        F.split(text, regex, -1).alias("gaps"),
    )


def span_starts(sp: Column) -> Column:
    """Offsets of all matches (0-based, in code points), in one pass over the lengths."""
    def step(done: Column, x: Column) -> Column:
        at = done["at"] + F.length(x["gaps"])
        return F.struct(
            (at + F.coalesce(F.length(x["toks"]), F.lit(0))).alias("at"),
            F.when(x["toks"].isNull(), done["starts"]).otherwise(F.array_append(done["starts"], at)).alias("starts"),
        )

    # The gap after the last match has no match beside it.
    pairs = F.arrays_zip(sp["gaps"].alias("gaps"), sp["toks"].alias("toks"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(pairs, start, step, lambda done: done["starts"])


def around(sp: Column, i: Column, radius: int, min_len: int) -> tuple[Column, Column]:
    """Up to ``radius`` characters before and after match ``i``, from the pieces next to it.

    Matches have ``min_len`` characters at least, so few pieces make up the radius: the cost of a
    match does not depend on where in the text it stands.
    """
    piece = lambda c, j, cut: F.coalesce(cut(F.get(sp[c], j), F.lit(radius)), F.lit(""))
    before, after = [piece("gaps", i, F.right)], [piece("gaps", i + 1, F.left)]
    for k in range(1, radius // max(1, min_len) + 2):
        before = [piece("gaps", i - k, F.right), piece("toks", i - k, F.right), *before]
        after = [*after, piece("toks", i + k, F.left), piece("gaps", i + k + 1, F.left)]
    return F.right(F.concat(*before), F.lit(radius)), F.left(F.concat(*after), F.lit(radius))


def masked(sp: Column, i: Column, radius: int = fixed.MASK_RADIUS) -> Column:
    """Text around match ``i`` with the match replaced by the mask.

    Neighbouring matches are longer than the radius, so one of them on each side
    is all the context there can be.
    """
    none = F.lit("")
    before = F.concat(F.coalesce(F.get(sp["toks"], i - 1), none), sp["gaps"][i])
    after = F.concat(sp["gaps"][i + 1], F.coalesce(F.get(sp["toks"], i + 1), none))
    return F.concat(F.right(before, F.lit(radius)), F.lit(fixed.MASK), F.left(after, F.lit(radius)))


def mask(text: Column, start: Column, end: Column, radius: int = fixed.MASK_RADIUS) -> Column:
    """Mask the 0-based range ``[start, end)`` of ``text``, keeping ``radius`` characters around."""
    lo = F.greatest(F.lit(0), start - radius)
    return F.concat(
        F.substr(text, lo + 1, start - lo),
        F.lit(fixed.MASK),
        F.substr(text, end + 1, F.lit(radius)),
    )


#: Digits that are no decimal digits: superscripts, circled and the like.
DIGITS = "".join(c for c in map(chr, range(0x20, 0x1F200)) if c.isdigit() and not c.isdecimal())


def shannon_entropy(s: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    n = F.length(s).cast("double")

    def step(acc: Column, ch: Column) -> Column:
        p = (F.length(s) - F.length(F.replace(s, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(s == "", F.lit(0.0)).otherwise(
        F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), step)
    )


def char_classes(s: Column, ascii_only: bool = False) -> Column:
    """How many of upper, lower, digit and ``+/=_-`` occur, letters and digits of any script.

    ``ascii_only`` is for text that is known to be ASCII: the same number from smaller classes.
    """
    letters = ("[A-Z]", "[a-z]", "[0-9]") if ascii_only else (r"\p{IsUppercase}", r"\p{IsLowercase}", f"[\\p{{Nd}}{DIGITS}]")
    return sum((s.rlike(rx).cast("int") for rx in letters), s.rlike("[+/=_-]").cast("int"))


def is_binary(text: Column) -> Column:
    """Any NUL, or fewer than 70 % printable characters. Empty text is not binary.

    Printable ASCII is dropped first: what is left of ordinary source is tiny, and
    only that remainder is looked up in the Unicode categories.
    """
    rest = F.regexp_replace(text, r"[\x20-\x7e\r\n\t]+", "")
    unprintable = F.length(F.regexp_replace(rest, r"[^\p{C}\p{Z}]+", ""))
    n = F.length(text)
    share = (n - unprintable) / F.greatest(F.lit(1), n)
    return F.when(text == "", F.lit(False)).otherwise(
        F.contains(text, F.lit("\0")) | (share < fixed.MIN_PRINTABLE_SHARE)
    )


def decode_utf8(body: Column) -> Column:
    """Bytes to text; undecodable bytes are dropped, a U+FFFD really present is kept."""
    bad, stand_in = F.lit("\ufffd"), F.lit("\U0010fffe\U0010ffff")
    # A real U+FFFD (EF BF BD, on a byte boundary) hides behind noncharacters
    # while the replacement characters of broken bytes are removed.
    hidden = F.unhex(F.regexp_replace(F.hex(body), r"\G((?:..)*?)EFBFBD", "$1F48FBFBEF48FBFBF"))
    kept = F.replace(F.make_valid_utf8(hidden.cast("string")), bad, F.lit(""))
    return (
        F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
        .when(F.contains(F.hex(body), F.lit("EFBFBD")), F.replace(kept, stand_in, bad))
        .otherwise(F.replace(F.make_valid_utf8(body.cast("string")), bad, F.lit("")))
    )


def decode_blob(encoding: Column, content: Column) -> Column:
    """Body of a listed file: base64 when it says so, as it is when it says nothing, else empty."""
    clean = F.regexp_replace(content, "[^A-Za-z0-9+/=]", "")
    body = F.try_to_binary(clean, F.lit("base64"))
    return (
        F.when(encoding == "base64", F.coalesce(decode_utf8(body), F.lit("")))
        .when(encoding.isNull(), F.coalesce(content, F.lit("")))
        .otherwise(F.lit(""))
    )
