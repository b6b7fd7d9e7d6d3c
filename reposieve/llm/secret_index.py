"""Secret scans through a trigram inverted index.

Every rule is a regex. From its syntax a Boolean query over trigrams is derived: a disjunction of conjunctions that holds for
each text with a match (``trigram_query``). Texts are indexed in shards, so that postings, their intersections and the verified texts stay
in one task and nothing is shuffled: a shard is a bounded number of texts, its posting lists hold the rows of
every trigram that some rule asks for. Postings are intersected per conjunction and united per rule, and the regex runs on
those candidates only. Rules without mandatory trigrams scan all texts.

Trigrams are taken from bytes with A-Z lower-cased, for all rules, so the query of a case-blind rule
is no different. Matches of a rule are leftmost and do not overlap; those of different rules may. What is shorter than the
rule asks for is dropped after matching. Offsets are code points, ends exclusive.

NULL and empty texts have no spans. Very long texts are indexed in blocks and searched whole. Repeated ids and texts are
searched each, empty tables give no rows, and other columns than ``keep`` and the text take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposieve.llm.common import LOWER, texts


@dataclass(frozen=True)
class Rule:
    """``group`` (0: the whole match) must have ``least`` characters; ``flags`` are those of ``re``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = 0


#: What every scan finds; more kinds follow in ``MORE``. Spans that start together come in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 and more: where a run starts, a shorter one can't match, so these are the long ones of all runs.
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"\bbearer\x20+([A-Za-z0-9._~+/-]{16,}=*)", 0, 0, re.I),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@"),
    Rule("host_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("mail_key", r"\bSG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}"),
    Rule("package_token", r"\b(?:npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,})"),
)
RULES = BASE + MORE

#: Strings that one piece of a regex may spell before it counts as anything, and conjunctions of one query.
SPELLED, CLAUSES = 48, 64
#: Bytes and texts of one shard, bytes looked up at once.
SHARD, ROWS, BLOCK = 1 << 23, 1 << 14, 1 << 20

Query = frozenset  # of conjunctions, each a frozenset of trigrams; a query with an empty one holds for every text
ALL: Query = frozenset([frozenset()])


def _absorbed(clauses: set) -> Query:
    """Without conjunctions that another one implies."""
    found = frozenset(c for c in clauses if not any(d < c for d in clauses))
    return found if len(found) <= CLAUSES else ALL


def _either(a: Query, b: Query) -> Query:
    return _absorbed(a | b)


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > CLAUSES:  # one of them is implied by both
        return max(a, b, key=lambda q: (min(map(len, q)), -len(q)))
    return _absorbed({x | y for x in a for y in b})


def _of_strings(spelled: set[bytes]) -> Query:
    return _absorbed({frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in spelled})


def _spelled(node: tuple) -> set[bytes] | None:
    """All strings an element matches, lower-cased; None if they are too many."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).encode().translate(LOWER)}
    if kind is op.AT:
        return {b""}
    if kind is op.IN:
        found = set()
        for k, v in value:
            if k is op.LITERAL:
                found.add(chr(v).encode().translate(LOWER))
            elif k is op.RANGE and v[1] - v[0] < SPELLED:
                found |= {chr(c).encode().translate(LOWER) for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= SPELLED // 4 else None
    if kind is op.SUBPATTERN:
        return _spelled_all(value[-1])
    if kind is op.BRANCH:
        each = [_spelled_all(b) for b in value[1]]
        return None if None in each or sum(map(len, each)) > SPELLED else set().union(*each)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 4:
        inner = _spelled_all(value[2])
        if inner is None:
            return None
        found, power = set(), {b""}
        for k in range(value[1] + 1):
            found |= power if k >= value[0] else set()
            power = {a + b for a in power for b in inner}
            if len(power) + len(found) > SPELLED:
                return None
        return found
    return None


def _spelled_all(nodes: list) -> set[bytes] | None:
    found = {b""}
    for node in nodes:
        one = _spelled(node)
        if one is None or len(one) * len(found) > SPELLED:
            return None
        found = {a + b for a in found for b in one}
    return found


def _query_of(node: tuple) -> Query:
    """What the inside of an element asks for that can't be spelled out."""
    kind, value = node
    if kind is op.SUBPATTERN:
        return _query(value[-1])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
        return _query(value[2])
    if kind is op.BRANCH:
        found = frozenset()
        for branch in value[1]:
            found = _either(found, _query(branch))
        return found
    return ALL


def _query(nodes: list) -> Query:
    found, current = ALL, {b""}
    for node in nodes:
        one = _spelled(node)
        if one is not None and len(one) * len(current) <= SPELLED:
            current = {a + b for a in current for b in one}
            continue
        found = _both(found, _of_strings(current))
        if one is None:
            found, current = _both(found, _query_of(node)), {b""}
        else:
            current = one
    return _both(found, _of_strings(current))


def trigram_query(rule: Rule) -> Query:
    """Conjunctions of trigrams of which one must hold in every text with a match, A-Z lower-cased."""
    return _query(list(syntax.parse(rule.pattern.encode(), rule.flags)))


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Shard:
    """Inverted index of some texts: for each wanted trigram the rows it occurs in."""

    def __init__(self, rows: list[bytes], wanted: np.ndarray, is_wanted: np.ndarray):
        # No UTF-8 has the byte 255, so no wanted trigram crosses two texts.
        data = np.frombuffer(b"\xff".join(rows).translate(LOWER), np.uint8)
        starts = np.cumsum([0] + [len(r) + 1 for r in rows[:-1]])
        found = [np.empty(0, np.int64)]
        for at in range(0, len(data) - 2, BLOCK):
            part = data[at:at + BLOCK + 2].astype(np.int32)
            codes = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            hit = np.flatnonzero(is_wanted[codes])
            row = np.searchsorted(starts, hit + at, "right") - 1
            found.append(np.unique(np.searchsorted(wanted, codes[hit]) * np.int64(len(rows)) + row))
        pairs = np.unique(np.concatenate(found))
        self.rows, self.wanted = pairs % len(rows), wanted
        self.first = np.searchsorted(pairs // len(rows), np.arange(len(wanted) + 1))

    def postings(self, trigram: bytes) -> np.ndarray:
        k = int(np.searchsorted(self.wanted, _code(trigram)))
        return self.rows[self.first[k]:self.first[k + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        """Rows that meet one of the conjunctions."""
        found = [np.empty(0, np.int64)]
        for clause in query:
            lists = sorted((self.postings(t) for t in clause), key=len)
            rows = lists[0]
            for more in lists[1:]:
                rows = np.intersect1d(rows, more, assume_unique=True)
            found.append(rows)
        return np.unique(np.concatenate(found))


def matches(rule: Rule, regex: re.Pattern, text: bytes) -> list[tuple[int, int]]:
    """Byte spans of one rule, leftmost and not overlapping."""
    return [m.span() for m in regex.finditer(text) if len(m[rule.group] or b"") >= rule.least]


class Scanner:
    """The compiled rules with their queries."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern.encode(), r.flags), trigram_query(r)) for r in rules]
        codes = {_code(t) for _, _, q in self.rules if q != ALL for clause in q for t in clause}
        self.wanted = np.array(sorted(codes), np.int64)
        self.is_wanted = np.zeros(1 << 24, bool)
        self.is_wanted[self.wanted] = True

    def spans(self, rows: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """``(kind, start, end)`` in code points of each text of a shard, by start and then as the rules are listed."""
        shard = Shard(rows, self.wanted, self.is_wanted)
        found: list[list] = [[] for _ in rows]
        for k, (rule, regex, query) in enumerate(self.rules):
            for row in range(len(rows)) if query == ALL else shard.candidates(query).tolist():
                found[row] += [(a, k, b) for a, b in matches(rule, regex, rows[row])]
        out = []
        for text, spans in zip(rows, found):
            if spans and not text.isascii():
                before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                spans = [(int(before[a]), k, int(before[b])) for a, k, b in spans]
            out.append([(self.rules[k][0].kind, a, b) for a, k, b in sorted(spans)])
        return out


def _shards(rows: list[bytes]) -> Iterator[list[bytes]]:
    shard, size = [], 0
    for text in rows:
        if shard and (size + len(text) > SHARD or len(shard) >= ROWS):
            yield shard
            shard, size = [], 0
        shard.append(text)
        size += len(text)
    if shard:
        yield shard


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` and ``secrets``, an array of ``(kind, start, end)``, of every row."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = [s for shard in _shards([t or b"" for t in texts(batch.column(len(keep)))]) for s in scanner.spans(shard)]
            offsets = pa.array(np.cumsum([0] + [len(s) for s in found]), pa.int32())
            kinds, starts, ends = zip(*(x for s in found for x in s)) if any(found) else ((), (), ())
            flat = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.ListArray.from_arrays(offsets, flat)], names=[*keep, "secrets"])

    return docs.select(*keep, text_col).mapInArrow(run, f"{kept}, secrets array<struct<kind:string,start:bigint,end:bigint>>")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers of the base kinds, the hash of their spans and all spans of every row."""
    names, spans = [r.kind for r in BASE], F.col("secrets")

    def of(*kinds: str) -> Column:
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    return scan(docs, [id_col], text_col).select(
        id_col, *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in names),
        F.sha2(listed(of(*names)).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"),
    )
