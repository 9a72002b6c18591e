"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is lower-cased and cut into words; every run of 2 to 4 bytes inside a
word, with a blank at each end, is hashed to a bucket. The average of the
buckets' embeddings goes through a linear softmax over the languages and one
class more, text of no language, learned from letters of the sample in random
order. Embeddings and weights are trained together by stochastic gradient
descent in numpy. Since everything is linear after the average, a model is one
row of class scores per bucket, and predicting is a look-up and a mean, done for
a batch of texts at once.

The sample is bounded: MAX_ROWS texts, shared out evenly among the languages, at
most PER_LANGUAGE of each: one text (that of the smallest hash) of each of the
doc_ids with the smallest hashes, however many rows a doc_id has. Of a text the
most frequent subwords teach, so many that all texts have MAX_FEATURES. Of each
language's texts one in CALIBRATE, by that order and so at every size, does not
train but calibrates: a temperature of least log loss, and the score under
which a prediction is rejected. That score is set where about REJECT of the
texts predicted right are expected below it: their log-odds fall off below the
TAIL quantile as an exponential whose scale is the mean distance to it, which
also holds for a sample too small to have a text that far down.

Learning sees text and lang of the rows whose crc32(doc_id as text) mod FOLDS is
not 0. Predicting sees the whole text and nothing else.

Defined cases: null text, or one without a letter, is `und` with score 0 and is
rejected; a null doc_id is never learned from and counts as held out; null lang
is not learned; without any labelled text every prediction is `und`; with too
few to calibrate (fewer than 3 of every language) nothing but `und` is
rejected; repeated rows get the same prediction; extra columns are ignored, and
the stage returns them as they are.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.plans.materialize import broadcast_if_small, materialize
from tempora.session import bound_arrow_batches

FOLDS = 5
BUCKETS = 1 << 15
DIM = 16
#: Bounds of the sample: texts of each language, texts of all languages, and different subwords of all texts together.
PER_LANGUAGE = 450
MAX_ROWS = 45_000
MAX_FEATURES = 1 << 24
#: One in so many texts of each language calibrates.
CALIBRATE = 3
#: Letters of a text in random order, at most, that teach what is no language: of every calibrating text and of the next.
NOISE_LETTERS = 1_500
EPOCHS = 6
RATE = 40.0
#: Part of the right predictions that the rejecting score may cost, and of the calibration texts that show how they fall off.
REJECT = 0.001
TAIL = 0.1
UND = "und"
#: Bytes of text that are looked up at once.
GROUP_BYTES = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(
    b if b >= 128 or chr(b) in string.ascii_letters else 32 for b in range(256)
)
_MIX = np.uint32(2654435761)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def pieces(text: str) -> list[bytes]:
    """The words between single blanks; a long text in several pieces, cut at blanks."""
    packed = b" " + b" ".join(text.lower().encode().translate(_BLANK).split()) + b" "
    out, at = [], 0
    while len(packed) - at > GROUP_BYTES:
        cut = packed.rfind(b" ", at + 1, at + GROUP_BYTES)
        if cut < 0:
            cut = packed.find(b" ", at + 1)
        out.append(packed[at : cut + 1])
        at = cut
    return [*out, packed[at:]]


def subwords(packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 2, 3 and 4 bytes: their buckets in all pieces, and where each piece's begin.

    No subword crosses a blank, and every piece begins and ends with one, so none crosses pieces.
    """
    starts = np.cumsum([0] + [len(p) for p in packed])
    b = np.frombuffer(b"".join(packed), np.uint8).astype(np.uint32)
    inner = b != 32
    code = b[:-1] * np.uint32(257) + b[1:]
    whole = inner[:-1] | inner[1:]
    for n in (2, 3, 4):
        if n > 2:
            code = code[:-1] * np.uint32(257) + b[n - 1 :]
            whole = inner[1 : len(b) - n + 2]
            for k in range(2, n - 1):
                whole = whole & inner[k : len(b) - n + 1 + k]
        at = np.flatnonzero(whole)
        mixed = (code[at] + np.uint32(n)) * _MIX
        yield (mixed >> np.uint32(17)) & np.uint32(BUCKETS - 1), np.searchsorted(at, starts)


def buckets(text: str) -> np.ndarray:
    """Bucket of every subword of a text."""
    return np.concatenate([found for p in pieces(text) if len(p) > 2 for found, _ in subwords([p])] or [np.zeros(0, np.uint32)])


def grouped(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of the texts, and whose they are, in groups of about GROUP_BYTES."""
    owners: list[int] = []
    packed: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in pieces(text):
            if len(piece) > 2:
                owners.append(i)
                packed.append(piece)
                size += len(piece)
                if size >= GROUP_BYTES:
                    yield owners, packed
                    owners, packed, size = [], [], 0
    if packed:
        yield owners, packed


@dataclass
class LanguageModel:
    """Class scores per bucket (the last class is no language), bias, temperature and the rejecting score.

    With weights, table holds the embeddings of the buckets, from which the class
    scores follow: narrower than the scores where there are many languages.
    """

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    weights: np.ndarray | None = None

    def softmax(self, mean: np.ndarray) -> np.ndarray:
        """Calibrated class probabilities of averages, a row each."""
        z = ((mean if self.weights is None else mean @ self.weights) + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of every class, a row for each text; a text alone or in a batch gets the same."""
        sums, counts = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for owners, packed in grouped(texts):
            for found, bounds in subwords(packed):
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                at, who = bounds[:-1][some], np.array(owners)[some]
                np.add.at(counts, who, n[some])
                for k, column in enumerate(self.table.T):
                    if len(some):
                        np.add.at(sums[:, k], who, np.add.reduceat(column[found], at, dtype=np.float64))
        return self.softmax(sums / np.maximum(counts, 1)[:, None])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and which are rejected."""
        some = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        langs, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if some:
            p = self.scores([texts[i] for i in some])[:, : len(self.langs)]
            best = p.argmax(axis=1)
            score[some] = p.max(axis=1)
            rejected[some] = score[some] < self.reject_below
            for i, k in zip(some, best, strict=True):
                langs[i] = self.langs[k]
        return langs, score, rejected


def train(
    samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], seed: int = 7
) -> LanguageModel:
    """SGD over (bucket, frequency) samples; one text a step, the rate falling to zero.

    y counts through langs; the number after them is no language.
    """
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w = np.zeros((DIM, len(langs) + 1), np.float32)
    bias = np.zeros(len(langs) + 1, np.float32)
    steps, done = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            bucket, freq = samples[i]
            x = freq @ e[bucket]
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            rate = np.float32(RATE * (1 - done / steps))
            back = w @ p
            w -= np.float32(0.1) * rate * np.outer(x, p)
            bias -= np.float32(0.001) * rate * p
            e[bucket] -= rate * freq[:, None] * back[None, :]
            done += 1
    return LanguageModel(langs, e @ w, bias) if len(bias) <= DIM else LanguageModel(langs, e, bias, weights=w)


def calibrate(model: LanguageModel, samples, y: np.ndarray, reject: float = REJECT) -> LanguageModel:
    """Temperature of least log loss over all samples, then the rejecting score from those of a language."""
    if not len(samples):
        return model
    mean = np.array([freq @ model.table[bucket] for bucket, freq in samples], np.float64)
    # Targets a little below one, after Platt, so that a small sample without an error does not ask for certainty.
    classes, unsure = len(model.bias), 1 / (len(y) + 2)
    rest = unsure / (classes - 1)
    loss = []
    grid = np.geomspace(0.2, 20.0, 60)
    for model.temperature in grid:
        logs = np.log(model.softmax(mean) + 1e-300)
        loss.append(-(rest * logs.sum(axis=1) + (1 - unsure - rest) * logs[np.arange(len(y)), y]).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    p = model.softmax(mean)[:, : len(model.langs)]
    right = p.max(axis=1)[(p.argmax(axis=1) == y) & (y < len(model.langs))]
    model.reject_below = tail_score(right, reject)
    return model


def tail_score(right: np.ndarray, reject: float) -> float:
    """The score that about `reject` of right predictions fall under, by an exponential tail of their log-odds."""
    if not len(right):
        return 0.0
    s = np.sort(np.clip(right, 1e-9, 1 - 1e-9))
    s = np.log(s / (1 - s))
    k = max(1, int(np.ceil(TAIL * len(s))))
    begin = s[min(k, len(s) - 1)]
    scale = (begin - s[:k]).mean()
    z = begin - scale * max(0.0, np.log(k / len(s) / reject))
    return float(1 / (1 + np.exp(-z)))


def _fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def learn(docs: DataFrame) -> LanguageModel:
    """Fit on the bounded sample of labelled rows that may be learned from."""
    bound_arrow_batches(docs.sparkSession)
    labelled = docs.where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold() != 0)
    ).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    # A sketch of each language's doc_ids, for a hash that leaves about twice as many as are wanted.
    known = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids"))
    known = materialize(known.orderBy(F.desc("n"), "lang").limit(MAX_ROWS), "langid-languages")
    per_language = max(1, min(PER_LANGUAGE, MAX_ROWS // max(1, known.count())))
    most_features = max(16, MAX_FEATURES // (2 * per_language * max(1, known.count())))
    share = F.least(F.lit(1.0), 2.0 * (per_language + 20) / F.col("ids"))
    below = broadcast_if_small(known.select("lang", ((share - 0.5) * 2.0**64).alias("below")))
    # One text of each doc_id, reduced in every task, however often the doc_id or its text repeats.
    one = F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("one")
    texts = (
        labelled.where(F.col("text").rlike("\\p{L}"))
        .withColumn("h", F.xxhash64("doc_id"))
        .join(below, "lang")
        .where(F.col("h") <= F.col("below"))
        .groupBy("lang", "h", "doc_id")
        .agg(one)
        .select("lang", "h", "doc_id", "one.text")
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = materialize(texts.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("h"), "langid-sample")

    def features(batches):
        for pdf in batches:
            pairs = [counted(buckets(t), most_features) for t in pdf["text"]]
            noise = [
                counted(buckets(disordered(t, i)), most_features) if n % CALIBRATE < 2 else ([], [])
                for t, i, n in zip(pdf["text"], pdf["doc_id"], pdf["nth"], strict=True)
            ]
            for kind, found in (("", pairs), ("noise_", noise)):
                pdf[kind + "bucket"] = [np.asarray(b, np.int32).tobytes() for b, _ in found]
                pdf[kind + "freq"] = [(np.asarray(c, np.float64) / max(1, np.sum(c))).astype(np.float32).tobytes() for _, c in found]
            yield pdf[["doc_id", "lang", "nth", "bucket", "freq", "noise_bucket", "noise_freq"]]

    # At most MAX_ROWS rows, of at most MAX_FEATURES numbers together.
    rows = (
        chosen.mapInPandas(
            features,
            "doc_id long, lang string, nth int, bucket binary, freq binary, noise_bucket binary, noise_freq binary",
        )
        .toPandas()
        .sort_values(["nth", "lang"])
    )
    langs = sorted(rows["lang"].unique())
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    samples, y, fits = [], [], []
    for row in rows.itertuples():
        for b, f, label in ((row.bucket, row.freq, langs.index(row.lang)), (row.noise_bucket, row.noise_freq, len(langs))):
            if len(b):
                samples.append((np.frombuffer(b, np.int32), np.frombuffer(f, np.float32)))
                y.append(label)
                fits.append(row.nth % CALIBRATE != 0)
    del rows
    y, fits = np.array(y), np.array(fits)
    model = train([s for s, f in zip(samples, fits, strict=True) if f], y[fits], langs)
    return calibrate(model, [s for s, f in zip(samples, fits, strict=True) if not f], y[~fits])


def counted(found: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets and their numbers; of more than so many the most frequent ones."""
    bucket, n = np.unique(found, return_counts=True)
    if len(bucket) > most:
        kept = np.sort(np.argsort(-n, kind="stable")[:most])
        bucket, n = bucket[kept], n[kept]
    return bucket, n


def disordered(text: str, seed: int) -> str:
    """Letters of the text, from all over it, in random order with its share of blanks: no language."""
    rng = np.random.default_rng(abs(int(seed)))
    return "".join(text[i] for i in rng.integers(0, len(text), min(len(text), NOISE_LETTERS)).tolist())


def predictor(spark: SparkSession, model: LanguageModel):
    """A column function: text -> struct(lang_pred, score, rejected)."""
    bound_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        langs, score, rejected = shared.value.predict(text.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": score, "rejected": rejected})

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    predict = predictor(docs.sparkSession, learn(docs))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (_fold() == 0).alias("held_out"),
        predict(F.col("text").cast("string")).alias("p"),
    ).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents with an accepted language, all columns."""
    predict = predictor(docs.sparkSession, learn(docs))
    marked = docs.select(F.struct("*").alias("row"), predict(F.col("text").cast("string")).alias("p"))
    return marked.where(~F.col("p.rejected")).select("row.*")
