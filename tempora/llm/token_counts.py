"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the vocabulary's word-begin mark before it. Under a
unigram model the segmentation of least cost is found by a forward pass over
its characters, and the pass over a prefix is the same for every word that
begins with it. So the distinct new words of a group of texts are walked in
sorted order, which is a depth-first walk of their trie: the path holds, for
each character of the current prefix, its forward score and the pieces that are
still unfinished there, a word starts where it leaves the one before it, and the
count at its last node is stored. The vocabulary is a trie too, so a piece is
followed only as long as the vocabulary goes on. Only the path is kept, so
memory is bounded by the longest word; counts of words up to KEEP_CHARS
characters are remembered by each worker, in a store of bounded size.

The public vocabulary has an order and no probabilities, so a piece's cost is
that of Zipf's law at its rank, ln(2 + rank); characters outside it fall back to
bytes, as costly as the last rank each. Equal costs take fewer tokens.

No shuffle. Defined cases: a null or blank text has no pre-tokens and no tokens;
repeated rows are counted one by one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.session import bound_arrow_batches

MARK = "▁"
KEEP_CHARS = 48
REMEMBERED = 500_000
GROUP_CHARS = 2_000_000


class Unigram:
    """Piece costs, and counts of words by the trie walk."""

    def __init__(self, pieces: list[str]):
        self.cost = {p: math.log(2 + rank) for rank, p in reversed(list(enumerate(pieces)))}
        self.byte = math.log(2 + len(pieces))
        #: A node is what follows it by character, and its piece's cost (None: no piece ends here).
        self.trie: list = [{}, None]
        for piece, cost in self.cost.items():
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = cost
        self.known: dict[str, int] = {}

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        return cls(
            [
                model.id_to_piece(i)
                for i in ids
                if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
            ]
        )

    def walk(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """(word, tokens) of sorted distinct words, each prefix scored once."""
        root, byte = self.trie[0], self.byte
        # For each prefix: cost, tokens, and the pieces that go on, as (what follows, cost, tokens at their start).
        path: list[tuple[float, int, list]] = [(0.0, 0, [])]
        before = ""
        for word in words:
            marked = MARK + word
            shared = len(commonprefix((before, marked)))
            del path[shared + 1 :]
            cost, tokens, going = path[-1]
            for c in marked[shared:]:
                n = 1 if c < "\x80" else len(c.encode())
                low, fewest = cost + n * byte, tokens + n
                on = []
                for follows, so_far, used in (*going, (root, cost, tokens)):
                    node = follows.get(c)
                    if node is None:
                        continue
                    if node[1] is not None:
                        option = so_far + node[1]
                        if option < low or (option == low and used + 1 < fewest):
                            low, fewest = option, used + 1
                    if node[0]:
                        on.append((node[0], so_far, used))
                cost, tokens, going = low, fewest, on
                path.append((cost, tokens, going))
            before = marked
            yield word, tokens

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(pre-tokens, distinct pre-tokens, tokens) of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        counted = [Counter(t.split()) for t in texts]
        new = sorted({w for c in counted for w in c if w not in known})
        local = {}
        for word, tokens in self.walk(new):
            (known if len(word) <= KEEP_CHARS else local)[word] = tokens
        out = []
        for c in counted:
            tokens = sum(n * (known[w] if w in known else local[w]) for w, n in c.items())
            out.append((c.total(), len(c), tokens))
        return out


@functools.lru_cache(maxsize=2)
def worker_model(path: str) -> Unigram:
    """One model and store for all tasks of a Python worker."""
    return Unigram.from_file(path)


SCHEMA = "doc_id long, n_pretokens long, n_distinct long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: pre-tokens, distinct ones, and tokens of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(vocabulary_path)
        for batch in batches:
            rows, group, chars = [], [], 0
            for text in batch.column("text").to_pylist():
                group.append(text or "")
                chars += len(group[-1])
                if chars > GROUP_CHARS:
                    rows += model.count(group)
                    group, chars = [], 0
            rows += model.count(group)
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    bound_arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
