"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the words of
a text; each model also sees the log-odds that the chain gave the categories
before it. Later models are trained on out-of-fold log-odds: the rows are split
in FOLDS by a hash of doc_id, and a row's earlier probabilities come from models
that did not see it, as they will for new rows.

The models are fitted in numpy on a bounded sample, the MAX_TRAIN labelled
documents with the smallest hash of doc_id, over the VOCABULARY most frequent
words of the sample that are in at least MIN_DF and at most MAX_SHARE of its
documents. Near copies in the sample with the same labels, told by the SIGNATURE
smallest hashes of their words, teach once. Each model takes only words whose frequencies in the
two classes of its training rows differ by MIN_Z standard errors, so that it
does not learn wrong labels by heart. A word counts once per text, so a long
text is judged by what it contains, not diluted by its length. A category's threshold is THRESHOLD, or the
lower one of best F1 on the out-of-fold scores that keeps their precision at
PRECISION. Prediction covers every word of every text.

Defined cases: a null or blank text has no words and gets the chain's base
rates; rows without labels are predicted only; a labelled doc_id without a
document teaches nothing, one with several rows of labels teaches the least of
them in the chain's order, and of several documents of one doc_id the one whose
text has the smallest hash teaches; without labels every probability
is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.plans.materialize import broadcast_if_small, materialize
from tempora.session import bound_arrow_batches

#: Bound of the training sample, in labelled documents.
MAX_TRAIN = 12_000
VOCABULARY = 20_000
MIN_DF = 8
MAX_SHARE = 0.2
FOLDS = 5
STEPS = 120
L2 = 0.2
MIN_Z = 5.0
#: Texts with as many words in common as agree in so many smallest hashes differ in a few words at most.
SIGNATURE = 16
#: Precision that a threshold below THRESHOLD must keep on out-of-fold scores.
PRECISION = 0.98
THRESHOLD = 0.5
#: The chain: category, and the SQL condition on labels that defines it.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))

#: ASCII letters lower-cased, other ASCII but digits blanked, the rest as it is.
_WORD_BYTES = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)
)
_DENSE = 3


def tokens(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_WORD_BYTES).split())


def measures(text: str, found: set[bytes]) -> list[float]:
    """Shares of distinct words, of symbols, and of line ends, about 0 to 1 each."""
    words = text.split()
    n = max(1, len(words))
    symbols = sum(map(text.count, "#*$%&|<>"))
    return [min(1.0, len(found) / n), min(1.0, symbols / n), min(1.0, text.count("\n") / n)]


def signature(found: set[bytes]) -> str:
    """Equal for most near copies: the smallest hashes of the words."""
    return ",".join(map(str, sorted(map(zlib.crc32, found))[:SIGNATURE]))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Rows:
    """Binary word features in compressed rows, and dense columns."""

    index: np.ndarray
    begin: np.ndarray
    dense: np.ndarray
    width: int

    @classmethod
    def build(cls, lists: list[np.ndarray], dense: np.ndarray, width: int) -> Rows:
        lengths = np.array([len(x) for x in lists], np.int64)
        index = np.concatenate(lists).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
        return cls(index, np.concatenate([[0], lengths.cumsum()]), dense, width)

    def take(self, rows: np.ndarray, dense: np.ndarray) -> Rows:
        parts = [self.index[self.begin[r] : self.begin[r + 1]] for r in rows]
        return Rows.build(parts, dense[rows], self.width)

    def dot(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.index])])
        return sums[self.begin[1:]] - sums[self.begin[:-1]] + self.dense @ v

    def back(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = np.repeat(g, np.diff(self.begin))
        return np.bincount(self.index, spread, self.width), self.dense.T @ g


@dataclass
class Linear:
    w: np.ndarray
    v: np.ndarray
    bias: float

    def logits(self, x: Rows) -> np.ndarray:
        return x.dot(self.w, self.v) + self.bias


def telling(x: Rows, y: np.ndarray, min_z: float = MIN_Z) -> np.ndarray:
    """Words whose frequencies in the two classes differ by min_z standard errors."""
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    row_y = np.repeat(y, np.diff(x.begin))
    c1 = np.bincount(x.index, row_y, x.width)
    c0 = np.bincount(x.index, 1.0 - row_y, x.width)
    p = (c1 + c0) / (n1 + n0)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    return np.flatnonzero(np.abs(c1 / n1 - c0 / n0) >= min_z * error)


def fit(x: Rows, y: np.ndarray, steps: int = STEPS, l2: float = L2) -> Linear:
    """Logistic regression over the telling words, by full-batch Adam; deterministic."""
    chosen = telling(x, y)
    place = np.full(x.width, -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[x.index] >= 0
    before = np.concatenate([[0], np.cumsum(kept)])
    narrow = Rows(place[x.index][kept], before[x.begin], x.dense, len(chosen))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m = Linear(np.zeros(narrow.width), np.zeros(x.dense.shape[1]), float(np.log(rate / (1 - rate))))
    first = np.zeros(narrow.width + len(m.v) + 1)
    second = np.zeros_like(first)
    for t in range(1, steps + 1):
        g = _sigmoid(m.logits(narrow)) - y
        gw, gv = narrow.back(g)
        grad = np.concatenate([gw + l2 * m.w, gv + l2 * m.v, [g.sum()]])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        step = 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        m.w -= step[: narrow.width]
        m.v -= step[narrow.width : -1]
        m.bias -= float(step[-1])
    wide = np.zeros(x.width)
    wide[chosen] = m.w
    return Linear(wide, m.v, m.bias)


@dataclass
class Chain:
    """Fitted models in order, the words they know, and the thresholds."""

    words: dict[bytes, int] = field(default_factory=dict)
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, x: Rows) -> np.ndarray:
        out = []
        for model in self.models:
            earlier = np.array(out).reshape(len(out), len(x.begin) - 1).T
            step = Rows(x.index, x.begin, np.hstack([x.dense, earlier]), x.width)
            out.append(model.logits(step).clip(-8, 8))
        return _sigmoid(np.array(out)).reshape(len(self.models), len(x.begin) - 1)

    def features(self, texts: list[str]) -> Rows:
        lists, dense = [], np.zeros((len(texts), _DENSE))
        get = self.words.get
        for i, text in enumerate(texts):
            found = tokens(text)
            lists.append(np.array([k for k in map(get, found) if k is not None], np.int64))
            dense[i] = measures(text, found)
        return Rows.build(lists, dense, len(self.words))


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of 0.2, 0.25, ..., THRESHOLD the one of best F1 that keeps the precision."""
    best, chosen = -1.0, THRESHOLD
    for t in np.arange(0.2, THRESHOLD + 0.01, 0.05):
        hit = p >= t
        right = (y[hit] == 1).sum()
        f1 = 2 * right / max(1, hit.sum() + (y == 1).sum())
        if hit.any() and right >= PRECISION * hit.sum() and f1 > best:
            best, chosen = f1, float(t)
    return chosen


def fit_chain(words: list[bytes], x: Rows, labels: np.ndarray, fold: np.ndarray) -> Chain:
    """One model per label column, in order, later ones on out-of-fold log-odds."""
    chain = Chain({w: i for i, w in enumerate(words)})
    earlier = np.zeros((len(fold), 0))
    for k in range(labels.shape[1]):
        dense = np.hstack([x.dense, earlier])
        out_of_fold = np.zeros(len(fold))
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inside) and len(outside):
                model = fit(x.take(inside, dense), labels[inside, k])
                out_of_fold[outside] = model.logits(x.take(outside, dense)).clip(-8, 8)
        chain.thresholds.append(threshold(_sigmoid(out_of_fold), labels[:, k]))
        everything = Rows(x.index, x.begin, dense, x.width)
        chain.models.append(fit(everything, labels[:, k]))
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return chain


def learn(docs: DataFrame, labels: DataFrame, categories=CHAIN) -> Chain:
    """Fit the chain on the bounded sample of labelled documents."""
    bound_arrow_batches(docs.sparkSession)
    names = [c for c, _ in categories]
    wanted = labels.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(*[F.coalesce(F.expr(sql), F.lit(False)).cast("int").alias(c) for c, sql in categories]).alias("y"),
    )
    wanted = wanted.groupBy("doc_id").agg(F.min("y").alias("y")).select("doc_id", F.xxhash64("doc_id").alias("h"), "y.*")
    # The hash alone leaves few more rows than wanted; then the exact first by hash.
    share = 1.3 * MAX_TRAIN / max(1, wanted.count())
    if share < 1:
        wanted = wanted.where(F.col("h") < int(-(2**63) + share * 2**64))
    sample = wanted.orderBy("h", "doc_id").limit(MAX_TRAIN)
    sample = broadcast_if_small(materialize(sample, "toxicity-sample"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [tokens(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ["doc_id", "h", *names]],
                    pa.array([sorted(f) for f in found], pa.list_(pa.binary())),
                    pa.array([measures(t, f) for t, f in zip(texts, found)], pa.list_(pa.float64())),
                    pa.array([signature(f) for f in found], pa.string()),
                ],
                ["doc_id", "h", *names, "words", "dense", "signature"],
            )

    schema = "doc_id long, h long, " + ", ".join(f"{c} int" for c in names)
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sample, "doc_id")
    # One text of each doc_id, reduced in every task, so that no more than MAX_TRAIN go on however often a doc_id repeats.
    one = F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("one")
    read = read.groupBy("doc_id", "h", *names).agg(one).select("doc_id", "h", *names, "one.text").mapInArrow(
        words, schema + ", words array<binary>, dense array<double>, signature string"
    )
    # Of the bounded sample's near copies the first by hash.
    nth = F.row_number().over(Window.partitionBy("signature", *names).orderBy("h", "doc_id"))
    read = materialize(read.withColumn("nth", nth).where("nth = 1").drop("nth"), "toxicity-words")
    n = read.count()
    if not n:
        return Chain()
    frequency = (
        read.select(F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("df"))
        .where((F.col("df") >= min(MIN_DF, max(2, n // 100))) & (F.col("df") <= MAX_SHARE * n))
        .orderBy(F.desc("df"), "word")
        .limit(VOCABULARY)
    )
    vocabulary = [bytes(r["word"]) for r in frequency.toLocalIterator()]
    ids = {w: i for i, w in enumerate(vocabulary)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[ids[w] for w in row if w in ids] for row in batch.column("words").to_pylist()]
            kept = ["doc_id", "h", *names, "dense", "signature"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(lists, pa.list_(pa.int32()))], [*kept, "ids"]
            )

    # At most MAX_TRAIN rows, one of each doc_id, of at most VOCABULARY numbers.
    rows = read.mapInArrow(indexed, schema + ", dense array<double>, signature string, ids array<int>").toPandas()
    rows = rows.sort_values(["h", "doc_id"])
    dense = np.array([np.asarray(d, float) for d in rows["dense"]]).reshape(len(rows), _DENSE)
    x = Rows.build([np.asarray(i, np.int64) for i in rows["ids"]], dense, len(vocabulary))
    y = rows[names].to_numpy(float)
    fold = ((rows["h"].to_numpy(np.int64) >> 20) % FOLDS).astype(int)
    return fit_chain(vocabulary, x, y, fold)


def predict(docs: DataFrame, chain: Chain, categories=CHAIN) -> DataFrame:
    """doc_id, p_<category> and <category> (at the threshold) of every document."""
    names = [c for c, _ in categories]
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = "doc_id long, " + ", ".join(f"p_{c} double, {c} boolean" for c in names)
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if model.models:
                p = model.probabilities(model.features(texts))
            else:
                p = np.zeros((len(names), len(texts)))
            out = [batch.column("doc_id")]
            for row, least in zip(p, model.thresholds or [THRESHOLD] * len(names), strict=True):
                out += [pa.array(row), pa.array(row >= least)]
            yield pa.RecordBatch.from_arrays(out, columns)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, categories=CHAIN) -> DataFrame:
    return predict(docs, learn(docs, labels, categories), categories)
