"""Small tables with the awkward rows that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use inside.
EXTRA = [
    "fp", "size", "taken", "_id", "unit", "component_id", "toxic", "severity", "_n", "_hash", "_kept", "_sha", "_cut_sha", "_edges", "_of", "_mix_row",
    "_text", "text_hash", "root", "_key", "_rank", "_part", "_source", "_at", "_row", "_before", "hits", "item_id", "edits", "n", "form", "runs", "secrets", "spans",
]


def prose(seed: int, words: int, alphabet: str = "abcdefghijklmnop") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 7))) for _ in range(words))


def rows(texts, sources=("a", "b")):
    return [(i, t, "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]


def docs(spark, texts, **how):
    return spark.createDataFrame(rows(texts, **how), SCHEMA)


def awkward(spark):
    """NULLs, empty and long texts, ties, repeated rows, unusual characters."""
    long = prose(1, 30_000)
    table = rows([None, "", " \t\n", prose(2, 80), prose(2, 80), long, "aaaa " * 900, "x", "Ünïcödé ☃ 漢字 \U0001F600 " * 30, "\x00\x01  "])
    table += [table[3], (None, prose(3, 50), None, None, None), (None, None, None, None, None), (77, prose(2, 80), "de", None, 1)]
    return spark.createDataFrame(table, SCHEMA)


def with_extra(df):
    from pyspark.sql import functions as F

    for name in EXTRA:
        df = df.withColumn(name, F.lit("extra"))
    return df
