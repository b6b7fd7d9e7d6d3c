"""Fill-in-the-middle transformation of whole texts.

A text is a list of units (a word with the white space before it; trailing white space is one). Two cut ranks, drawn
from a hash of the id, divide it into prefix, middle and suffix, which change places around
sentinels: ``psm`` is prefix, suffix, middle, ``spm`` is suffix, prefix, middle, ``plain`` is the text.

Cuts are found in an indexable skip list: every link of an express lane carries how many units and how many
code points it skips, so a descent that adds up widths ends exactly at the rank and knows the code points before it.

NULL and empty texts are plain and give an empty output; so are texts that hold a sentinel, since such an output could
not be taken apart. Very long texts cost memory in proportion to their own length. Rows that repeat an id are cut at
ranks of their own lengths; NULL ids are hashed as an empty id. Empty tables give none. Columns of other names never
take part: only ``keep``, the id and the text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposieve.llm.common import texts

SEED = 42
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, and of those that put the suffix first.
RATE, SPM_RATE = 50, 80
#: A lane keeps about one node in so many of the lane below.
FAN = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def units(text: bytes) -> np.ndarray:
    """Byte offsets of the units' ends in UTF-8."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.empty(0, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(data))


def code_points(text: bytes, ends: np.ndarray) -> np.ndarray:
    """Code points of each unit."""
    if not len(ends):
        return ends
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.add.reduceat(first, np.concatenate([[0], ends[:-1]]), dtype=np.int64)


class SkipList:
    """Indexable skip list over units of given widths in code points.

    ``lanes`` go from the bottom to the top; a lane has, for each of its nodes, the node of the lane below and the units
    and code points up to its next node. Which nodes rise is decided by a hash of their rank, so reruns agree.
    """

    def __init__(self, widths: np.ndarray):
        rank = np.arange(len(widths), dtype=np.uint64)
        self.lanes = [(np.arange(len(widths)), np.ones(len(widths), np.int64), widths)]
        while len(rank) > FAN:
            mixed = (rank + np.uint64(len(self.lanes))) * _MIX
            rises = (mixed ^ (mixed >> np.uint64(32))) * _MIX >> np.uint64(40)
            up = np.flatnonzero(rises % np.uint64(FAN) == 0)
            if not len(up) or up[0]:
                up = np.concatenate([[0], up])  # the head is in every lane
            if len(up) == len(rank):
                break
            _, steps, chars = self.lanes[-1]
            self.lanes.append((up, np.add.reduceat(steps, up), np.add.reduceat(chars, up)))
            rank = rank[up]

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        at, passed, chars = 0, 0, 0
        for down, steps, widths in reversed(self.lanes):
            while at < len(steps) and passed + steps[at] <= rank:
                passed, chars, at = passed + int(steps[at]), chars + int(widths[at]), at + 1
            if passed == rank:
                return chars
            at = int(down[at])
        return chars


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """The first four 32-bit numbers of the hash of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def infill(
    doc_id: object, text: bytes | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> tuple[int, str, int | None, int | None, bytes]:
    """``(units, form, code points of prefix and middle, output)`` of one text."""
    text = text or b""
    ends = units(text)
    n, (a, b, c, d) = len(ends), draws(doc_id, seed)
    before_prefix, before_suffix, before_middle = (s.encode() for s in sentinels)
    if not n or c % 100 >= rate or any(s.encode() in text for s in sentinels):
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    found = SkipList(code_points(text, ends))
    first, second = found.chars_before(low), found.chars_before(high)
    plain = text.decode()
    prefix, middle, suffix = (x.encode() for x in (plain[:first], plain[first:second], plain[second:]))
    if d % 100 < spm_rate:
        output = before_suffix + suffix + before_prefix + prefix + before_middle + middle
        return n, "spm", first, second - first, output
    return n, "psm", first, second - first, before_prefix + prefix + before_suffix + suffix + before_middle + middle


def transform(
    docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
    rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """``keep`` (the id) and ``n, form, prefix_chars, middle_chars, output`` of every row."""
    keep = [id_col] if keep is None else keep
    kept = docs.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(keep)).to_pylist()
            rows = [infill(i, t, seed, rate, spm_rate, sentinels) for i, t in zip(ids, texts(batch.column(len(keep) + 1)))]
            made = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, types)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *made], names=[*keep, *names])

    rows = docs.select(*keep, F.col(id_col).alias("_infill_id"), F.col(text_col).alias("_infill_text"))
    return rows.mapInArrow(run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text an output was made from."""
    cut = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    one, two, middle = (F.get(cut, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)


def restore(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """``restored`` of one output."""
    if form == "plain":
        return output
    _, one, two, middle = re.split("|".join(map(re.escape, sentinels)), output)
    return one + middle + two if form == "psm" else two + middle + one


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
INFILL_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
             CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c,
             CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS s FROM d),
f AS (SELECT *, CASE WHEN t = '' OR c >= {RATE} OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                     WHEN s < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
             array_to_string(u[greatest(a, b) + 1:n], '') AS x FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
              ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
