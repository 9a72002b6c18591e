"""Secret scanning over a trigram inverted index.

Each rule is a regular expression. From its parse tree comes a Boolean query
over lower-case trigrams that any match must contain. Documents are indexed in
segments (one Arrow batch each): for the trigrams that some rule asks for, a
segment has a posting bitmap over its documents. A rule's candidates are the
intersection and union of postings that its query names; only these are
searched with the expression itself. A rule without mandatory trigrams, such
as a run of hexadecimal digits, scans every document.

No shuffle and no state between segments, so a lost task is simply run again.
Every rule takes time in proportion to the text, also on the texts that are
worst for it.

Defined cases: a null or empty text has no spans, and base_sha256 is that of
the empty string; repeated rows are scanned one by one; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre  # the standard library's own parse tree; a test pins what is used of it
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.session import bound_arrow_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, the least length of a group of each match, and the group that is the secret's span."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    span: int = 0


#: The base kinds.
BASE = (
    Rule(
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
        "[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Kinds added to the base.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "sk_live_[A-Za-z0-9]{16,}"),
    # The first eyJ of a run leaves the most, so it alone decides; what is glued before it is passed over once, from
    # where the run starts. Possessive, so that no run is looked at more than three times.
    Rule(
        "jwt",
        "(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+"
        "(eyJ[A-Za-z0-9_-]{8,}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+)",
        span=1,
    ),
)
RULES = BASE + MORE

#: A set of strings larger than this is no longer followed exactly.
EXACT = 64

#: A query is a set of alternatives, each a set of trigrams that must all occur;
#: the empty alternative matches everything.
Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])


def _simplify(q) -> Query:
    """Drop alternatives that contain another one."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(a: Query, b: Query) -> Query:
    joined = _simplify({x | y for x in a for y in b})
    return joined if len(joined) <= EXACT else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    return _simplify({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _characters(items) -> set[str] | None:
    """The characters of a small set, lower-cased; None if large or negated."""
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < EXACT:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _analyse(tree) -> tuple[set[str] | None, Query]:
    """(exact strings or None, query) of a parsed sequence, in lower case."""
    exact: set[str] = {""}
    query, whole = ALL, True
    for op, value in tree:
        part, inner = None, ALL
        if op is sre.LITERAL:
            part = {chr(value).lower()}
        elif op is sre.IN:
            part = _characters(value)
        elif op is sre.SUBPATTERN:
            part, inner = _analyse(value[3])
        elif op is sre.BRANCH:
            found = [_analyse(t) for t in value[1]]
            inner = _simplify(frozenset().union(*[q for _, q in found]))
            if all(e is not None for e, _ in found):
                part = set().union(*[e for e, _ in found])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = value
            part, inner = _analyse(body)
            if (low, high) == (0, 1) and part is not None:
                part = part | {""}
            elif (low, high) != (1, 1):
                part = None
            if low == 0:
                inner = ALL
        elif op is sre.AT or op is sre.ASSERT_NOT:
            part = {""}
        if part is not None and len(exact) * len(part) <= EXACT:
            exact = {a + b for a in exact for b in part}
            continue
        query, whole = _both(query, _of_strings(exact)), False
        query = _both(query, inner if part is None else _of_strings(part))
        exact = {""}
    query = _both(query, _of_strings(exact))
    return (exact if whole else None), query


def trigram_query(pattern: str) -> Query:
    """Trigrams that a match of the pattern must contain, by alternatives."""
    return _analyse(sre_parser.parse(pattern))[1]


_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


class Segment:
    """Postings of the wanted trigrams over one batch of texts."""

    def __init__(self, texts: list[str], slots: np.ndarray, names: dict[str, int]):
        self.names, self.n = names, len(texts)
        raw = [t.encode().translate(_LOWER) for t in texts]
        starts = np.cumsum([0] + [len(r) + 2 for r in raw])[:-1]
        data = np.frombuffer(b"\xff\xff".join(raw) + b"\xff\xff", np.uint8)
        self.bits = np.zeros((len(names), self.n), bool)
        step = 1 << 22
        for at in range(0, max(0, len(data) - 2), step):
            b = data[at : at + step + 2].astype(np.uint32)
            slot = slots[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            hit = np.flatnonzero(slot)
            doc = np.searchsorted(starts, hit + at, side="right") - 1
            self.bits[slot[hit] - 1, doc] = True

    def candidates(self, query: Query) -> np.ndarray:
        out = np.zeros(self.n, bool)
        for alternative in query:
            every = np.ones(self.n, bool)
            for trigram in alternative:
                every &= self.bits[self.names[trigram]]
            out |= every
        return np.flatnonzero(out)


class Scanner:
    """Compiled rules, their queries, and the index of the trigrams they want."""

    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        wanted = sorted({t for _, _, q in self.rules for a in q for t in a if len(t.encode()) == 3})
        self.names = {t: i for i, t in enumerate(wanted)}
        self.slots = np.zeros(1 << 24, np.uint8)
        for t, i in self.names.items():
            self.slots[int.from_bytes(t.encode(), "big")] = i + 1
        if len(wanted) > 255:
            self.slots = self.slots.astype(np.uint16)
            for t, i in self.names.items():
                self.slots[int.from_bytes(t.encode(), "big")] = i + 1
        # A trigram of other than three bytes is not indexed: it asks for nothing.
        self.queries = [
            frozenset(frozenset(t for t in a if t in self.names) for a in q) for _, _, q in self.rules
        ]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of all spans of each text, in order."""
        segment = Segment(texts, self.slots, self.names)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, ((rule, pattern, _), query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in segment.candidates(query).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(rule.span), k, m.end(rule.span)))
        return [sorted(spans) for spans in found]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    kinds = [r.kind for r in rules]
    base = {r.kind for r in BASE}

    def written(spans) -> str:
        return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = scanner.scan([t or "" for t in batch.column("text").to_pylist()])
            counts = [[sum(kinds[k] == r.kind for _, k, _ in s) for s in found] for r in BASE]
            digest = [
                hashlib.sha256(written([x for x in s if kinds[x[1]] in base]).encode()).hexdigest()
                for s in found
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(digest, pa.string()),
                    pa.array([written(s) for s in found], pa.string()),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    bound_arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
