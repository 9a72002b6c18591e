"""Harmonic packing of documents into sequences of fixed capacity.

A length in (C/(k+1), C/k] is of class k: k such pieces fill a bin, whatever
they are, so a worker keeps one open bin per class and needs to know nothing of
the other workers. Documents may be cut, and are, so that classes fill their
bins: full sequences first, then the longest reciprocal C/k that fits, until
what is left is a small tail. What bins are open when a worker ends is poured,
piece by piece, into sequences of its own, cutting where one is full. So the
padding is a few tokens a bin and one sequence a worker.

One narrow pass: no shuffle. A sequence's number is its task's number and a
count, the same when a lost task is run again over the same split.

Tokens are those of the tokenizer file given, and then the end id. A word, as
the file splits text, always has the same ids, so each worker remembers them, in
a store of bounded size; texts with characters outside a checked set are
tokenized whole. Defined cases: a null or blank text is the end id alone;
repeated rows are packed one by one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempora.session import bound_arrow_batches

CAPACITY = 4096
END_ID = 2
#: A tail of this many tokens or fewer is not cut again.
TAIL = 128
#: A piece this close below its class's size, in parts of it, is not cut either.
SLACK = 64
#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 800_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)

_SPANS = (
    range(0x21, 0x7F),
    range(0xA1, 0x130),
    range(0x131, 0x250),
    range(0x2010, 0x2028),
    range(0x2030, 0x205F),
    range(0x20AC, 0x20AD),
)
#: Characters whose words need no more of the tokenizer than lower-casing: no
#: composition, one lower case each that is of these characters too, and only tab,
#: line feed, return and space as blanks.
_SIMPLE = [
    chr(c)
    for span in _SPANS
    for c in span
    if len(chr(c).lower()) == 1 and any(ord(chr(c).lower()) in s for s in _SPANS)
]


def _of_category(kind: str) -> str:
    return "".join(re.escape(c) for c in _SIMPLE if unicodedata.category(c)[0] == kind)


_LETTERS, _NUMBERS = _of_category("L"), _of_category("N")
_NOT_SIMPLE = re.compile(rf"[^\t\n\r\x20{''.join(map(re.escape, _SIMPLE))}]|<\|")
#: Fixed value: how the tokenizer file splits lower-cased text into words.
_WORDS = re.compile(
    rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+"
)


class WordTokens:
    """ids(texts) by a tokenizer file, remembering the ids of words."""

    def __init__(self, path: str, remembered: int | None = None):
        self.remembered = REMEMBERED if remembered is None else remembered
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Encode many words in one call; each ends in a token of a kind of its own."""
        ids = self.encode(" ".join(words))
        stops = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(stops) != len(words):
            raise ValueError("the tokenizer splits words in another way than expected")
        raw, start = ids.tobytes(), 0
        for word, stop in zip(words, stops, strict=True):
            self.known[word] = raw[4 * start : 4 * stop]
            start = stop

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if _NOT_SIMPLE.search(t) else _WORDS.findall(t.lower()) for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        known = self.known
        if new := list(set().union(*filter(None, split)).difference(known)):
            self.learn(new)
        get = known.__getitem__
        return [
            self.encode(t) if words is None else np.frombuffer(b"".join(map(get, words)), "<u4")
            for t, words in zip(texts, split, strict=True)
        ]

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, learning new words from about a million characters at once."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars > 1_000_000:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)


@functools.lru_cache(maxsize=2)
def worker_tokens(path: str, remembered: int) -> WordTokens:
    """One store for all tasks of a Python worker."""
    return WordTokens(path, remembered)


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    left = n % capacity
    while left:
        k = capacity // left  # left is in (C/(k+1), C/k]
        fit = capacity // k
        if left <= tail or fit - left <= fit // SLACK:
            out.append((left, k))
            break
        out.append((capacity // (k + 1), k + 1))
        left -= capacity // (k + 1)
    return out


class Packer:
    """Open bins by class; pieces are (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.open = capacity, first_sequence, {}
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        for length, k in cuts(len(ids), self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, ids[start : start + length].copy(), len(ids)))
            start += length
            if len(bin_) == k:
                self.emit(self.open.pop(k))

    def finish(self) -> None:
        """Pour the open bins, fullest pieces first, into whole sequences."""
        rest, filled, used = [p for k in sorted(self.open) for p in self.open[k]], [], 0
        self.open = {}
        for doc_id, start, ids, total in rest:
            while len(ids):
                room = self.capacity - used
                filled.append((doc_id, start, ids[:room], total))
                used += len(filled[-1][2])
                start, ids = start + len(filled[-1][2]), ids[room:]
                if used == self.capacity:
                    self.emit(filled)
                    filled, used = [], 0
        if filled:
            self.emit(filled)

    def take(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = list(zip(*self.rows)) or [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    remembered bounds a worker's store of words; a smaller one costs time, no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(tokenizer_path, remembered)
        packer = Packer(TaskContext.get().partitionId() << 36, capacity)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.ids(texts), strict=True):
                packer.add(doc_id, np.concatenate([ids, end]))
            yield packer.take()
        packer.finish()
        yield packer.take()

    bound_arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
