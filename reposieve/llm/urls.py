"""URL filters with columns only: allow and block rules first, then a trained classifier.

A rule names a host, which covers its subdomains, and the start of a path; of the rules that fit, the longest
wins. Where none fits, logistic regression on hashed character n-grams of host and path decides.
It is fitted on a small labelled table by the ML library of Spark; scoring is an expression over the
row, so the pages are neither shuffled nor sent to Python.

NULL urls and urls without ``://`` have an empty host and path, fit no rule and are judged by the classifier.
Rows may repeat. Rule lists are part of the plan, so they may hold hundreds of rules, not millions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposieve.llm.url_table import ALLOWED, BLOCKED

#: Slots of the hashed n-grams, and their lengths.
SLOTS, LENGTHS = 4096, (3, 4, 5)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def slots(host: Column, path: Column) -> Column:
    """Distinct hash slots of the n-grams of host and path; the two never share an n-gram."""
    def grams(text: Column, n: int) -> Column:
        start = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(start, lambda i: F.substring(text, i, F.lit(n)))

    texts = (F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit(" "), F.lower(path), F.lit("\n")))
    found = F.concat(*(grams(t, n) for t in texts for n in LENGTHS))
    return F.array_distinct(F.transform(found, lambda g: F.pmod(F.xxhash64(g), F.lit(SLOTS)).cast("int")))


class Model(NamedTuple):
    weights: list[float]
    intercept: float

    def probability(self, host: Column, path: Column) -> Column:
        """Probability that a URL is to be blocked."""
        table = F.split(F.lit(" ".join(map(repr, self.weights))), " ").cast("array<double>")
        total = F.aggregate(slots(host, path), F.lit(self.intercept), lambda s, i: s + F.get(table, i))
        return 1 / (1 + F.exp(-total))


def train(spark: SparkSession, penalty: float = 0.003) -> Model:
    rows = [(1.0, f"https://{u}") for u in BLOCKED] + [(0.0, f"https://{u}") for u in ALLOWED]
    table = spark.createDataFrame(rows, "label double, url string").coalesce(1)
    hits = table.select("label", slots(host_of(F.col("url")), path_of(F.col("url"))).alias("hits")).collect()  # the fixed table
    sparse = spark.createDataFrame([(r.label, Vectors.sparse(SLOTS, {i: 1.0 for i in r.hits})) for r in hits], ["label", "features"])
    fitted = LogisticRegression(regParam=penalty, standardization=False, maxIter=100).fit(sparse.coalesce(1))
    return Model([float(w) for w in fitted.coefficients.toArray()], float(fitted.intercept))


def judge(
    pages: DataFrame, model: Model, keep: list[str], url_col: str = "url", rules: tuple[Rule, ...] = RULES, limit: float = 0.5
) -> DataFrame:
    """``keep`` with ``host``, ``path``, the ``rule`` that decided, the ``verdict`` and the classifier's ``p_block``."""
    host, path = F.col("host"), F.col("path")
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    url = F.col(url_col)
    split = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    return split.withColumn("p_block", model.probability(host, path)).select(
        *keep, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("p_block") >= limit, "block").otherwise("allow")).alias("verdict"), "p_block",
    )
