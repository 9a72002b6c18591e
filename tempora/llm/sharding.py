"""Sharding by jump consistent hashing.

A stable key and the shard count alone decide a row's shard; no ring table is
kept. With one more shard, a key either stays or moves into the new shard, and
only the necessary fraction 1/(n+1) of the keys moves.

Slots are gapless in each shard without gathering a shard in one task: rows are
counted by (shard, bucket, scan task), a running sum over these few counts
gives each cell its first slot, and rows are numbered inside their cell only.

Defined cases: a null doc_id is key 0; a null text has no bytes (size 1,
crc32 0); repeated rows share a shard and get slots of their own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.plans.materialize import broadcast_if_small, materialize
from tempora.plans.ranking import fresh

#: Multiplier of the 64-bit linear congruential generator in the published algorithm.
LCG = np.uint64(2862933555777941757)
BUCKETS = 64


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; vectorised, O(log shards) rounds."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.uint64, copy=True)
    last = np.zeros(len(state), np.int64)
    step = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        last[live] = step[live]
        state[live] = state[live] * LCG + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        step[live] = ((last[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[step[live] < shards]
    return last.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Column form of jump_hash for a long key; null counts as 0."""

    @F.pandas_udf("int")
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64).view(np.uint64), shards))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("task"),
    )
    rows = (
        rows.withColumn("shard", shard_of(F.col("doc_id"), shards))
        .withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int"))
    )
    rows = materialize(rows, "shards")
    cell = ["shard", "bucket", "task"]
    counts = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    # First by bucket over tasks, then over a shard's fixed number of buckets.
    buckets = counts.groupBy("shard", "bucket").agg(F.sum("n").alias("bn"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        "shard",
        "bucket",
        F.coalesce(F.sum("bn").over(before.partitionBy("shard").orderBy("bucket")), F.lit(0)).alias("b0"),
    )
    firsts = counts.join(buckets, ["shard", "bucket"]).select(
        *cell,
        (
            F.col("b0")
            + F.coalesce(F.sum("n").over(before.partitionBy("shard", "bucket").orderBy("task")), F.lit(0))
        ).alias("first"),
    )
    firsts = broadcast_if_small(materialize(firsts, "shard-cells"))
    order = Window.partitionBy(*cell).orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("within", F.row_number().over(order) - 1)
    return numbered.join(firsts, cell).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("within")).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, files_per_shard: int = 16) -> str:
    """Write the documents as one folder per shard, several files each; returns the folders' column.

    That is "shard", with underscores added if the documents have a column of that name.
    """
    folder, salt = fresh(docs, "shard", "salt")
    placed = docs.withColumn(folder, shard_of(F.col("doc_id"), shards)).withColumn(
        salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(files_per_shard))
    )
    spread = placed.repartition(shards * files_per_shard, folder, salt).drop(salt)
    spread.write.partitionBy(folder).parquet(path)
    return folder
