"""Phrase collocations: words that stand together far more often than apart.

Texts are cut into pieces at punctuation and line ends, and identical pieces of
a lang become one with a multiplicity. Phrases are counted over these pieces,
weighted by their multiplicity: each task counts what its own pieces hold, the
counts are dealt to hash buckets, and duckdb adds up a bucket, spilling to the
task's scratch folder beyond MEMORY. Words are counted first; then phrases of 2,
3, .. LONGEST words by their 48-bit hashes, which are shorter than the phrases,
and only where both phrases of one word less may occur LEAST times, as a bitmap
of at most 2^28 bits over the frequent hashes tells. Such a bitmap may let rare
phrases through and never holds a frequent one back; what it lets through is
counted by the words themselves in one last pass, which decides.

A candidate's parts are looked up by requests: each of its cuts asks for the
counts of what is before and after it, requests travel to where the part's count
is, salted so that a common word's are many tasks' work, and the answers to the
candidate.

Defined cases: null text is empty and has no pieces; null lang is `und`; repeated
rows count one by one; ties of score go to the smallest cut, of a lang's order to
the higher count, then to the phrase by bytes; a word may be of any length; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.strings import lower_ascii
from tempora.llm.arrow_text import encoded, grouped, split_words, summed
from tempora.plans.bitmap import bits_for
from tempora.plans.materialize import is_small, materialize, release_shuffles
from tempora.session import bound_arrow_batches

LONGEST = 4
LEAST = 30
#: A candidate goes if a longer one that holds it has so many hundredths of its count.
COVERED = 80
SCALE = 2_000_000
TOP = 2_000
UND = "und"
#: What duckdb may hold of a bucket before it spills.
MEMORY = "128MB"
#: Bytes of pieces that are counted at once in a task.
GROUP_BYTES = 6 << 20
#: Bits of a phrase's hash: enough for far more phrases than there can be, and two bytes less to shuffle.
HASH_BITS = 48
#: Rows that leave a task at once.
SLICE = 100_000
#: Parts that the requests for a common part are spread over.
SALTS = 8

#: Fixed value: where a piece ends.
PIECE_END = "[.,;:!?\\x0A-\\x0D]"
COUNTS = "lang string, phrase string, w long"
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("w", pa.int64())])
_HASHES = pa.schema([("h", pa.int64()), ("w", pa.int64())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def distinct_pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by single blanks), n_words, m (multiplicity)."""
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.explode(F.split(text, PIECE_END)).alias("piece")
    )
    odd = F.col("piece").contains("\t") | F.col("piece").contains("  ")
    single = F.when(odd, F.regexp_replace("piece", "[\\x20\\x09]+", " ")).otherwise(F.col("piece"))
    clean = cut.select("lang", F.trim(single).alias("piece")).where("piece <> ''")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1
    return clean.groupBy("lang", "piece").agg(F.count("*").alias("m")).withColumn("n_words", words.cast("long"))


def hashed(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task."""
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False), categorize=False) if len(values) else np.zeros(0, np.uint64)


class Words:
    """The words of many phrases of some langs, as numbers."""

    def __init__(self, rows: dict[str, pa.Array], column: str):
        words, self.owner = split_words(rows[column])
        self.code, self.names = encoded(words)
        self.code, self.owner = self.code.astype(np.int32), self.owner.astype(np.int32)
        self.lang, self.langs = encoded(rows["lang"])

    @functools.cached_property
    def w(self) -> np.ndarray:
        return hashed(self.names)[self.code]

    @functools.cached_property
    def tongue(self) -> np.ndarray:
        return hashed(self.langs)[self.lang]

    def starts(self, k: int) -> np.ndarray:
        """Where k words in a row are of one phrase."""
        n = len(self.owner) - k + 1
        return np.flatnonzero(self.owner[:n] == self.owner[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words, and their lang, that begin at each place."""
        h = self.tongue[self.owner[at]]
        for j in range(k):
            h = (h ^ (h >> np.uint64(29))) * _MIX + self.w[at + j]
        return ((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(64 - HASH_BITS)

    def likely(self, k: int, shorter: Frequent) -> np.ndarray:
        """Starts of k words of which the first and the last k - 1 may both be frequent."""
        at = self.starts(k - 1)
        good = np.zeros(len(self.owner) + 1, bool)
        good[at[shorter.has(self.hashes(at, k - 1))]] = True
        at = self.starts(k)
        return at[good[at] & good[at + 1]]


class Frequent:
    """A bitmap of the hashes of frequent phrases of one length."""

    def __init__(self, bitmap: np.ndarray, bits: int):
        self.bitmap, self.bits = bitmap, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(HASH_BITS - self.bits)).astype(np.int64)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def frequent(hashes: DataFrame) -> Frequent:
    """The bitmap of a materialised table (h): what reaches the driver is bounded by its size, not by the table."""
    bits = bits_for(hashes.count())
    at = F.shiftright("h", HASH_BITS - bits)
    placed = hashes.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(F.lit(32767).cast("long")).alias("bit"))
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for row in placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bitmap[row["bucket"] << 12 : (row["bucket"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return Frequent(bitmap, bits)


def word_hashes(counts: DataFrame) -> DataFrame:
    """h of each word of a table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "phrase"):
            words = Words(rows, "phrase")
            yield pa.RecordBatch.from_arrays([pa.array(words.hashes(words.starts(1), 1).view(np.int64))], ["h"])

    return materialize(counts.select("lang", "phrase").mapInArrow(run, "h long"), "word-hashes")


def phrase_hashes(pieces: DataFrame, k: int, shorter: Frequent, least: int = LEAST) -> DataFrame:
    """h of the phrases of k words that occur least times; of two with one hash both, if they do together."""
    shared = pieces.sparkSession.sparkContext.broadcast(shorter)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "piece", GROUP_BYTES):
            words = Words(rows, "piece")
            at = words.likely(k, shared.value)
            columns = {"h": words.hashes(at, k).view(np.int64), "m": rows["m"].to_numpy()[words.owner[at]]}
            found = summed(columns, ["h"], m="sum")
            for i in range(0, len(found["h"]), SLICE):
                some = slice(i, i + SLICE)
                yield pa.RecordBatch.from_arrays([pa.array(found["h"][some]), pa.array(found["m_sum"][some])], schema=_HASHES)

    counted = pieces.select("lang", "piece", "m").mapInArrow(local, "h long, w long").repartition("h")
    return materialize(counted.mapInArrow(lambda batches: bucket_counts(batches, least, _HASHES), "h long, w long").select("h"), f"phrase-hashes-{k}")


def count_phrases(pieces: DataFrame, levels: dict[int, Frequent | None], least: int = LEAST) -> DataFrame:
    """lang, phrase, f, k of the phrases that occur least times, of each number of words; with a bitmap only what it has."""
    shared = pieces.sparkSession.sparkContext.broadcast(levels)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "piece", GROUP_BYTES):
            words, m = Words(rows, "piece"), rows["m"].to_numpy()
            for k, known in shared.value.items():
                at = words.starts(k)
                if known is not None:
                    at = at[known.has(words.hashes(at, k))]
                mine, by = words.owner[at], ["lang", *[f"w{j}" for j in range(k)]]
                columns = {"lang": words.lang[mine], **{f"w{j}": words.code[at + j] for j in range(k)}, "m": m[mine]}
                found = summed(columns, by, m="sum")
                for i in range(0, len(found["lang"]), SLICE):
                    some = slice(i, i + SLICE)
                    parts = [words.names.take(pa.array(found[f"w{j}"][some])) for j in range(k)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
                    lang = words.langs.take(pa.array(found["lang"][some]))
                    yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(found["m_sum"][some])], schema=_COUNTS)

    counted = pieces.select("lang", "piece", "m").mapInArrow(local, COUNTS).repartition("lang", "phrase")
    counted = counted.mapInArrow(lambda batches: bucket_counts(batches, least, _COUNTS), COUNTS)
    k = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    return materialize(counted.select("lang", "phrase", F.col("w").alias("f"), k.alias("k")), "phrases")


def bucket_counts(batches: Iterator[pa.RecordBatch], least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sums of w over one bucket's rows, by duckdb, which spills beyond MEMORY to a scratch folder that goes with the task."""
    scratch = tempfile.mkdtemp(prefix="phrases-")
    con = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False})
    by = ", ".join(n for n in schema.names if n != "w")
    try:
        con.register("bucket", pa.RecordBatchReader.from_batches(schema, batches))
        found = con.sql(
            f"SELECT {by}, CAST(sum(w) AS BIGINT) AS w FROM bucket GROUP BY {by} HAVING sum(w) >= {int(least)}"
        ).to_arrow_reader(SLICE)
        for batch in found:
            yield batch.cast(schema)
    finally:
        con.close()
        shutil.rmtree(scratch, ignore_errors=True)


def with_parts(candidates: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r, score of each candidate: the counts of the parts of its lowest-scoring cut.

    candidates: lang, phrase, f, k. counts (materialised): lang, phrase, f of every part.
    """
    ws = F.split("phrase", " ")
    cuts = [
        F.struct(F.lit(c).alias("cut"), F.lit(s).alias("side"), F.array_join(part, " ").alias("part"))
        for c in range(1, longest)
        for s, part in (("l", F.slice(ws, 1, c)), ("r", F.slice(ws, F.lit(c + 1), F.lit(longest))))
    ]
    asked = candidates.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.filter(F.array(*cuts), lambda x: x["cut"] < F.col("k"))))
    held = counts.select("lang", F.col("phrase").alias("part"), "f")
    if is_small(counts):
        answered = asked.join(F.broadcast(held), ["lang", "part"])
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        answered = asked.join(held, ["lang", "part", "salt"])
    of = lambda c, s: F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f")))
    each = answered.groupBy("lang", "phrase", "a").agg(*[of(c, s).alias(f"{s}{c}") for c in range(1, longest) for s in "lr"])
    score = lambda c: F.call_function(
        "div", F.lit(SCALE).cast("decimal(38,0)") * F.col("a"), (F.col(f"l{c}") + F.col(f"r{c}")).cast("decimal(38,0)")
    )
    options = F.array(
        *[F.when(F.col(f"l{c}").isNotNull(), F.struct(score(c).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, longest)]
    )
    return each.select("lang", "phrase", "a", F.array_min(options).alias("o")).select("lang", "phrase", "a", "o.l", "o.r", "o.score")


def covered(candidates: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, longer: of each phrase inside a longer candidate the highest count of one; reduced in every task."""
    ws = F.split("phrase", " ")
    inner = [
        F.when(F.col("k") >= max(start + n - 1, n + 1), F.array_join(F.slice(ws, start, n), " "))
        for n in range(2, longest)
        for start in range(1, longest - n + 2)
    ]
    held = candidates.where("k > 2").select("lang", F.explode(F.array(*inner)).alias("phrase"), "f").where("phrase is not null")
    return held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first phrases by score."""
    bound_arrow_batches(docs.sparkSession)
    spark = docs.sparkSession
    pieces = materialize(distinct_pieces(docs), "phrase-pieces", "zstd")
    release_shuffles(spark)
    words = pieces.groupBy("lang").agg(F.sum(F.col("m") * F.col("n_words")).alias("n"))
    single = count_phrases(pieces, {1: None}, least)
    known = {1: frequent(word_hashes(single))}
    for k in range(2, LONGEST + 1):
        release_shuffles(spark)
        known[k] = frequent(phrase_hashes(pieces, k, known[k - 1], least))
    release_shuffles(spark)
    candidates = count_phrases(pieces, {k: known[k] for k in range(2, LONGEST + 1)}, least)
    counts = single.unionByName(candidates)
    scored = with_parts(candidates, counts).join(covered(candidates), ["lang", "phrase"], "left")
    hundredfold = lambda c, by: F.col(c).cast("decimal(38,0)") * by
    kept = scored.where(F.col("longer").isNull() | (hundredfold("longer", 100) < hundredfold("a", COVERED)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
