"""License scans with columns only: ordered regex rules over the words of whole texts.

Words are runs of digits, ``a-z`` and non-ASCII characters after A-Z are lower-cased. Rules are gated twice: texts
without any keyword are done at once, and a rule is tried only if its keyword occurs. Each match is an
interval of words with a priority. An interval inside another of the same or a higher priority is suppressed,
as is one around another of a higher priority; equal ones are decided by the order of the rules.

The base phrases are counted apart and never suppressed. NULL texts have no words. Rows may repeat; all columns
come from the row alone, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposieve.llm.license_rules import rules

#: Phrases that are always reported, with their labels.
BASE = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 1.0}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AT = "struct<first:int,past:int,priority:int,rule:int,label:string>"


def words(text: Column) -> Column:
    """The words of a text, each between single spaces: `` w0 w1 ... ``; one space if there are none."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS, " ")
    return F.when(F.trim(plain) == "", " ").otherwise(F.concat(F.lit(" "), F.trim(plain), F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(text: Column, pattern: Column, priority: Column, rule: Column, label: Column) -> Column:
    """Word intervals of all matches, counted along the pieces between them."""
    between = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("spaces"), F.array().cast(f"array<{_AT}>").alias("found"))

    def step(done, x):
        before = done["spaces"] + _spaces(x["gap"])
        inner = _spaces(x["hit"])
        at = F.struct(
            (before - 1).alias("first"), (before + inner).alias("past"), priority.cast("int").alias("priority"),
            rule.cast("int").alias("rule"), label.cast("string").alias("label"),
        )
        return F.struct((before + inner).alias("spaces"), F.concat(done["found"], F.array(at)).alias("found"))

    # After the last match there is a gap without a hit.
    return F.aggregate(F.filter(between, lambda x: x["hit"].isNotNull()), start, step, lambda done: done["found"])


def _unsuppressed(found: Column) -> Column:
    """Intervals that survive; two passes that carry the furthest end of each priority."""
    def order(back):
        # Outer intervals first; equal ones by priority, then by the order of the rules.
        def compare(a, b):
            keys = [(a["first"], b["first"]), (b["past"], a["past"]), (b["priority"], a["priority"]), (a["rule"], b["rule"])]
            out = F.lit(0)
            for x, y in reversed(keys):
                out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
            return -out if back else out
        return compare

    levels = sorted(CONFIDENCE)
    empty = F.array().cast(f"array<{_AT}>")

    def inside(done, x):
        held = F.lit(False)
        for p in levels:
            held = held | ((x["priority"] <= p) & (done[f"p{p}"] >= x["past"]))
        ends = [F.when(x["priority"] == p, F.greatest(done[f"p{p}"], x["past"])).otherwise(done[f"p{p}"]).alias(f"p{p}") for p in levels]
        return F.struct(*ends, F.when(held, done["kept"]).otherwise(F.concat(done["kept"], F.array(x))).alias("kept"))

    def around(done, x):
        held = F.lit(False)
        for p in levels:
            held = held | ((x["priority"] < p) & (done[f"p{p}"] <= x["past"]))
        ends = [F.when(x["priority"] == p, F.least(done[f"p{p}"], x["past"])).otherwise(done[f"p{p}"]).alias(f"p{p}") for p in levels]
        return F.struct(*ends, F.when(held, done["kept"]).otherwise(F.concat(done["kept"], F.array(x))).alias("kept"))

    low = F.struct(*(F.lit(-1).alias(f"p{p}") for p in levels), empty.alias("kept"))
    high = F.struct(*(F.lit(1 << 30).alias(f"p{p}") for p in levels), empty.alias("kept"))
    outer = F.aggregate(F.array_sort(found, order(False)), low, inside, lambda done: done["kept"])
    return F.aggregate(F.array_sort(outer, order(True)), high, around, lambda done: F.reverse(done["kept"]))


def gates() -> list[str]:
    """Words of which a text must hold one for any rule to be tried: keywords that hold no other one."""
    words = {r.keyword for r in rules()}
    return sorted(w for w in words if not any(v != w and v in w for v in words))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with the word count, places of base phrases, detections and labels of every row.

    ``detections`` are the surviving intervals: first word, word past the last, priority, rule and label.
    """
    text = F.col("_words")
    table = F.array(*(
        F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"),
                 F.lit(r.number).alias("rule"), F.lit(r.label).alias("label")) for r in rules()
    ))
    gated = F.lit(False)
    for gate in gates():
        gated = gated | F.contains(text, F.lit(gate))
    tried = F.filter(table, lambda r: F.contains(text, r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: _places(text, r["pattern"], r["priority"], r["rule"], r["label"])))
    base = F.concat(*(
        F.when(F.contains(text, F.lit(f" {phrase} ")), _places(text, F.lit(f"(?<= ){phrase}(?= )"), F.lit(2), F.lit(-1), F.lit(label)))
        .otherwise(F.array().cast(f"array<{_AT}>")) for phrase, label in BASE.items()
    ))
    named = docs.select(*keep, words(F.col(text_col)).alias("_words"))
    scanned = named.select(
        *keep, (_spaces(text) - 1).cast("long").alias("n_words"), base.alias("_base"),
        F.when(gated, _unsuppressed(found)).otherwise(F.array().cast(f"array<{_AT}>")).alias("detections"),
    )
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.array_max(F.transform("detections", lambda x: x["priority"]))
    return scanned.select(
        *keep, "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["first"])).cast("long").alias("last_word"),
        joined(labels(F.col("_base"))).alias("base_labels"),
        joined(F.concat(labels(F.col("_base")), labels(F.col("detections")))).alias("labels"),
        F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), best),
                   F.when(F.size("_base") > 0, CONFIDENCE[2]), F.lit(0.0)).alias("score"),
        "detections",
    )
