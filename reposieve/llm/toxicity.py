"""Toxicity as an ordinal grade: cumulative-link regression over sparse text features.

Features of a text are its distinct words and their first letters, hashed. One weight vector is
shared by all thresholds: ``P(grade > k) = sigmoid(w.x - t[k])`` with ``t[0] < t[1] < ...``; the expected
severity is the sum of these probabilities. Weights are not negative and kept sparse by an L1 penalty: a
long clean text does not gather a score from many neutral words, nor does a toxic one lose it.

The labels have two values only. Grades are derived from them: 0 is not toxic; toxic documents are
graded 1 to ``GRADES`` by the rank of the share of their words that speak for toxicity.
The model is fitted on ``SAMPLE`` labelled documents of each value at most, chosen by a hash of the id;
it is scored on whole texts of all documents.

NULL or wordless texts have severity below the threshold. Ids that occur repeatedly get one row
each. Labels that contradict each other count as toxic. Without labels of both values the
model is empty and rejects nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposieve.llm.common import per_row, texts

#: Labelled documents of each value that the model is fitted on, at most.
SAMPLE = 3000
#: Features that may get a weight, by their association with the labels.
FEATURES = 4096
GRADES = 3
#: First letters of a word that are features besides the word.
PREFIXES = (4, 5)
#: Least z-score of a feature's association with toxicity; high, as hundreds of thousands are tried.
TELLING = 5.0
#: Least ratio of a feature's shares of toxic and of clean documents.
LIFT = 8
PENALTY, ROUNDS = 0.003, 400
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: bytes | None) -> set[str]:
    return set(_WORDS.findall((text or b"").decode("utf-8", "replace").lower()))


def features(word: str) -> list[int]:
    """Hashed features of one word."""
    import xxhash

    named = ["w" + word] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n]
    return [xxhash.xxh32_intdigest(x.encode()) for x in named]


@dataclass(frozen=True)
class Model:
    """Weights by feature, thresholds between grades, and the severity from which a text is toxic."""

    weights: dict[int, float]
    cuts: tuple[float, ...]
    reject: float

    def severity(self, score: float) -> float:
        return sum(1 / (1 + np.exp(min(700.0, t - score))) for t in self.cuts)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``(toxic, hits, n)`` of at most ``n`` different documents of each value, among those of ``n`` labelled ids.

    Rows with equal features are merged before the limit, so neither copies nor repeated ids add to it.
    """
    votes = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("_of")).agg(F.max("toxic").alias("toxic"))
    some = None
    for value in (0, 1):
        part = votes.filter(F.col("toxic") == value).orderBy(F.xxhash64("_of"), "_of").limit(n)
        some = part if some is None else some.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_of")

    def count(text):
        found = [features(w) for w in words(text)]
        hits = np.sort(np.array([x for xs in found for x in xs], np.uint32))
        return hits.tobytes(), len(found)

    found = per_row(rows, ["toxic"], "_text", count, "hits binary, n long")
    found = found.groupBy("toxic", F.sha2("hits", 256).alias("_sha")).agg(F.first("hits").alias("hits"), F.max("n").alias("n"))
    some = None
    for value in (0, 1):
        part = found.filter(F.col("toxic") == value).orderBy("_sha").limit(n).drop("_sha")
        some = part if some is None else some.unionByName(part)
    return some


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted array, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _fit(toxic: np.ndarray, docs: list[np.ndarray], sizes: np.ndarray) -> Model:
    empty = Model({}, tuple(range(1, GRADES + 1)), float("inf"))
    if not (toxic == 1).any() or not (toxic == 0).any():
        return empty
    held = np.arange(len(docs)) % 5 == 4
    if len(set(toxic[~held])) < 2 or len(set(toxic[held])) < 2:
        held = np.zeros(len(docs), bool)
    n1, n0 = (~held & (toxic == 1)).sum(), (~held & (toxic == 0)).sum()
    told_by = [np.concatenate([np.unique(docs[k]) for k in np.flatnonzero(~held & (toxic == v))]) for v in (1, 0)]
    keys, in1 = np.unique(told_by[0], return_counts=True)  # features of clean documents only can't tell
    clean, times = np.unique(told_by[1], return_counts=True)
    at, known = _find(clean, keys)
    in0 = np.where(known, times[at], 0)
    # Association: z-score of the difference between the shares of toxic and clean documents.
    share = (in1 + in0 + 1) / (n1 + n0 + 2)
    z = (in1 / n1 - in0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-9)
    z[in1 / n1 < LIFT * in0 / n0] = 0
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[z[chosen] > TELLING])
    if not len(chosen):
        return empty
    # Only the chosen features of each document are kept: the table that is fitted stays small.
    found = [np.unique(at[hit], return_counts=True) for at, hit in (_find(keys[chosen], x) for x in docs)]
    row = np.repeat(np.arange(len(docs)), [len(f) for f, _ in found])
    col, times = np.concatenate([f for f, _ in found]), np.log1p(np.concatenate([c for _, c in found]))
    # Severity grades of the toxic documents: rank of the share of telling words.
    strong = in0[chosen] <= 0.02 * in1[chosen]
    told = np.bincount(row[strong[col]], minlength=len(docs)) / np.maximum(sizes, 1)
    grade = np.zeros(len(docs), int)
    bad = np.flatnonzero(toxic == 1)
    grade[bad[np.argsort(told[bad], kind="stable")]] = 1 + np.arange(len(bad)) * GRADES // len(bad)
    weights, cuts = _descend(row, col, times, grade, ~held, len(chosen))
    score = np.bincount(row, weights[col] * times, minlength=len(docs))
    model = Model({int(f): float(w) for f, w in zip(keys[chosen], weights) if w}, tuple(cuts), 0.0)
    at = np.array([model.severity(s) for s in score])
    judge = held if held.any() else np.ones(len(docs), bool)
    return Model(model.weights, model.cuts, _threshold(at[judge], toxic[judge]))


def _descend(row, col, x, grade, learn, n) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient (FISTA) for the weights; the gaps between thresholds stay positive."""
    use = learn[row]
    row, col, x = row[use], col[use], x[use]
    value = np.where(np.bincount(grade[learn], minlength=GRADES + 1) > 0, 1.0, 0.0)
    even = learn / np.maximum(np.bincount(grade[learn], minlength=GRADES + 1)[grade], 1) / value.sum()
    above = grade[:, None] > np.arange(GRADES)
    top = np.ones(n)  # power iteration for the largest curvature
    for _ in range(20):
        top = np.bincount(col, (even * np.bincount(row, top[col] * x, minlength=len(grade)))[row] * x, minlength=n)
        most = float(np.linalg.norm(top))
        top = top / max(most, 1e-12)
    step = 1.0 / max(0.25 * GRADES * most, 1e-3)
    w, cuts = np.zeros(n), np.arange(1.0, GRADES + 1)
    w_old, t = w, 1.0
    for _ in range(ROUNDS):
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        point = w + (t - 1) / t_new * (w - w_old)
        score = np.bincount(row, point[col] * x, minlength=len(grade))
        off = (1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -30, 30))) - above) * even[:, None]
        slope = np.bincount(col, off.sum(axis=1)[row] * x, minlength=n)
        w_old, w, t = w, point - step * slope, t_new
        w = np.maximum(w - step * PENALTY, 0)
        cuts = np.maximum.accumulate(cuts + 2.0 * off.sum(axis=0) + 1e-3 * np.arange(GRADES))
    return w, cuts


def _threshold(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best balanced accuracy."""
    order = np.unique(severity)
    if len(order) < 2:
        return float("inf")
    cut = (order[1:] + order[:-1]) / 2
    bad, good = np.sort(severity[toxic == 1]), np.sort(severity[toxic == 0])
    right = (1 - np.searchsorted(bad, cut) / len(bad)) + np.searchsorted(good, cut) / len(good)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cut[best[np.argmax((order[1:] - order[:-1])[best])]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLE) -> Model:
    """Model from a bounded sample: at most ``2 n`` documents reach the driver, as hashed features."""
    rows = {(bytes(r.hits), r.toxic): r.n for r in sample(docs, labels, id_col, text_col, n).collect()}
    if not rows:
        return Model({}, tuple(range(1, GRADES + 1)), float("inf"))
    found = sorted(rows.items(), key=lambda r: (hashlib.md5(r[0][0]).digest(), r[0][1]))
    return _fit(
        np.array([t for (_, t), _ in found]), [np.frombuffer(h, np.uint32) for (h, _), _ in found], np.array([n for _, n in found])
    )


class Scorer:
    """Severity of texts under a model; remembers the features of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, text: bytes | None) -> float:
        weights, known, total = self.model.weights, self.known, {}
        if len(known) > 200_000:
            known.clear()
        for w in words(text):
            hits = known.get(w)
            if hits is None:
                known[w] = hits = [f for f in features(w) if f in weights]
            for f in hits:
                total[f] = total.get(f, 0) + 1
        return float(self.model.severity(sum(weights[f] * np.log1p(c) for f, c in sorted(total.items()))))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with ``severity`` (0 to ``GRADES``), ``grade`` and ``toxic`` of every row, from its whole text."""
    severity = Scorer(model)

    def of(text):
        s = severity(text)
        return s, int(round(s)), s >= model.reject

    return per_row(docs, keep, text_col, of, "severity double, grade int, toxic boolean")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model calls toxic."""
    model, at = fit(docs, labels, id_col, text_col), docs.columns.index(text_col)
    severity = Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([severity(t) < model.reject for t in texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
