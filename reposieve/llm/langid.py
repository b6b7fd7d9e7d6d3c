"""Language identification by character language models.

One interpolated Kneser-Ney model per language. All n-grams that any language has seen stand in one
sorted array of hashes for each order, with a row of log probabilities, one for each language; contexts likewise
with their back-off weights. A text gets the language with the lowest cross-entropy per character. ``score``
is the calibrated posterior; ``rejected`` says that even the best language explains the text worse than
nearly all of its own calibration texts.

Letters are lower-cased, everything else counts as one space. The models are fitted on about ``SAMPLE`` documents
of each language, picked by a hash of the id, and calibrated on other documents of the same size; texts
are scored whole. NULL texts and texts without a letter are ``und`` with score 0; so is all if nothing
could be learned. Repeated rows get a row each; ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposieve.llm.common import per_row, texts

ORDER = 5
#: Documents of each language that its model is fitted on, about; a fifth as many calibrate.
SAMPLE = 1500
#: Languages of fewer documents are learned from all of them and calibrated on those of other languages.
SPLIT = 30
FOLDS = 3
#: A text is rejected if it is this many deviations above the mean cross-entropy of its language.
REJECT = 6.0
#: Characters that the lowest order spreads its rest over.
CHARACTERS = 1 << 16
_OTHER = re.compile(r"[\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BREAK = "\n"


def letters(text: bytes | None) -> str:
    return _OTHER.sub(" ", (text or b"").decode("utf-8", "replace").lower()).strip()


def _codes(plain: str) -> np.ndarray:
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)


def _padded(plain: str) -> np.ndarray:
    return _codes(" " * (ORDER - 1) + plain + " ")


def _hash(windows: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as arrays of their first, second, ... characters."""
    h = np.zeros(len(windows[0]), np.uint64)
    for c in windows:
        h = (h + c + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(29)
    return h


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


@dataclass
class Models:
    """``grams[k]`` and ``contexts[k]`` are sorted hashes of order ``k``, ``logp`` and ``backoff`` their rows."""

    langs: list[str]
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoff: dict[int, np.ndarray] = field(default_factory=dict)
    unseen: float = 0.0
    sharpness: float = 10.0
    limit: np.ndarray | None = None

    def entropy(self, plain: str) -> np.ndarray:
        """Cross-entropy per character under each language."""
        codes = _padded(plain)
        n = len(codes) - ORDER + 1
        at, total = np.arange(n), np.zeros(len(self.langs))
        for k in range(ORDER, 0, -1):
            windows = [codes[at + j] for j in range(ORDER - k, ORDER)]
            place, hit = _find(self.grams[k], _hash(windows))
            total += self.logp[k][place[hit]].sum(axis=0, dtype=np.float64)
            at = at[~hit]
            if not len(at):
                break
            if k > 1:
                place, known = _find(self.contexts[k], _hash([w[~hit] for w in windows[:-1]]))
                total += self.backoff[k][place[known]].sum(axis=0, dtype=np.float64)
        else:
            total += len(at) * self.unseen
        return -total / n


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def kneser_ney(langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Models:
    """Models from ``counts`` of ``grams`` (a row of ``ORDER`` characters each) of language number ``lang``."""
    models, n = Models(langs), len(langs)
    types = {ORDER: (lang, grams, counts)}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different characters before a gram
        above, rows, _ = types[k + 1]
        key, times = np.unique(np.column_stack([above, rows[:, 1:]]), axis=0, return_counts=True)
        types[k] = (key[:, 0], key[:, 1:], times)
    models.unseen = -np.log(CHARACTERS)
    below = None
    for k in range(1, ORDER + 1):
        of, rows, c = types[k]
        rows = rows.astype(np.uint64)
        window = list(rows.T)
        key = _hash(window)
        keys, first, place = np.unique(key, return_index=True, return_inverse=True)
        ctx = _hash(window[:-1]) if k > 1 else np.zeros(len(rows), np.uint64)
        ctxs, ctx_place = np.unique(ctx, return_inverse=True)
        n1, n2 = (np.bincount(of[c == x], minlength=n) for x in (1, 2))
        discount = np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.1, 0.95)
        cell = ctx_place * n + of
        total = np.bincount(cell, c, minlength=len(ctxs) * n)
        kinds = np.bincount(cell, minlength=len(ctxs) * n)
        seen = total > 0
        gamma = np.where(seen, np.tile(discount, len(ctxs)) * kinds / np.maximum(total, 1), 1.0).reshape(-1, n)
        own = np.zeros((len(keys), n))
        own[place, of] = np.maximum(c - discount[of], 0) / total[cell]
        of_ctx = ctx_place[first]
        if k == 1:
            lower = np.full((len(keys), n), np.exp(models.unseen))
        else:
            at, hit = _find(models.grams[k - 1], _hash([w[first] for w in window[1:]]))
            assert hit.all()
            lower = below[at]
        below = own + gamma[of_ctx] * lower
        models.grams[k], models.logp[k] = keys, np.log(below).astype(np.float32)
        models.contexts[k], models.backoff[k] = ctxs, np.log(np.maximum(gamma, 1e-12)).astype(np.float32)
    # A character that nobody has seen backs off from the empty context.
    models.unseen += float(models.backoff[1].mean())
    return models


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            plain = letters(text)
            if plain:
                by.setdefault(lang, []).append(" " * (ORDER - 1) + plain + " ")
        for lang, found in by.items():
            joined = _BREAK.join(found)
            codes = _codes(joined)
            n = len(codes) - ORDER + 1
            h = _hash([codes[j:j + n] for j in range(ORDER)])
            _, first, times = np.unique(h, return_index=True, return_counts=True)
            grams = [joined[i:i + ORDER] for i in first.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(times.astype(np.int64))],
                names=["lang", "gram", "n"],
            )


def fit(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = SAMPLE
) -> Models | None:
    """Models from labelled rows for which ``usable`` holds; None if there are none."""
    rows = docs.filter(usable & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("_text")
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(sizes.items()) for x in (k, min(1.0, 1.2 * n / v)))), F.col("lang"))
    spot = F.pmod(F.xxhash64(F.lit("langid"), "_id"), F.lit(1 << 30)) / (1 << 30)
    picked = rows.withColumn("_at", spot / share).filter("_at < 1")
    # Too few to spare a part for calibration: such a language is learned from all its rows.
    split = ~F.col("lang").isin([x for x, v in sizes.items() if v < SPLIT])
    held = split & (F.col("_at") >= 1 / 1.2)
    learn = picked.filter(~held).select("lang", "_text")
    counted = (
        learn.mapInArrow(_count_rows, "lang string, gram string, n long")
        .filter(~F.col("gram").contains(_BREAK)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    table = counted.toPandas().sort_values(["lang", "gram"], kind="stable")  # bounded by the sample
    if not len(table):
        return None
    langs = sorted(table.lang.unique())
    grams = _codes("".join(table.gram)).reshape(-1, ORDER).astype(np.int64)
    number = table.lang.map({x: i for i, x in enumerate(langs)}).to_numpy()
    models = kneser_ney(langs, number, grams, table.n.to_numpy())

    def entropies(text):
        plain = letters(text)
        return (models.entropy(plain).tolist() if plain else None,)

    check = per_row(picked.filter(held), ["lang"], "_text", entropies, "ce array<double>")
    check = check.filter("ce is not null").collect()
    return calibrate(models, [r.lang for r in check if r.lang in langs], np.array([r.ce for r in check if r.lang in langs]))


def calibrate(models: Models, lang: list[str], entropy: np.ndarray) -> Models:
    """Sharpness of the posterior by likelihood, and the limit of each language, on texts not learned from."""
    models.limit = np.full(len(models.langs), np.inf)
    if not len(lang):
        return models
    true = np.array([models.langs.index(x) for x in lang])
    row = np.arange(len(true))

    def loss(s):
        z = -s * entropy
        return (np.logaddexp.reduce(z, axis=1) - z[row, true]).mean()

    models.sharpness = min((2.0 ** e for e in range(0, 8)), key=loss)
    right = entropy.argmin(axis=1) == true
    for k in range(len(models.langs)):
        own = entropy[right & (true == k), k]
        own = own if len(own) >= 5 else entropy[right].min(axis=1)  # too few of its own: those of all
        if len(own) >= 5:
            models.limit[k] = own.mean() + REJECT * own.std()
    return models


def identify(docs: DataFrame, models: Models | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected`` of every row."""
    def of(text):
        plain = letters(text)
        if models is None or not any(map(str.isalpha, plain)):
            return "und", 0.0, None, True
        ce = models.entropy(plain)
        k = int(ce.argmin())
        z = np.exp(-models.sharpness * (ce - ce[k]))
        return models.langs[k], float(1 / z.sum()), float(ce[k]), bool(ce[k] > models.limit[k])

    return per_row(docs, keep, text_col, of, "lang_pred string, score double, cross_entropy double, rejected boolean")
