"""A bitmap of keys, of bounded size, that keeps most rows out of a join or a shuffle.

Where the keys to look for are too many to broadcast, a bitmap over a hash of
them is not: 2^BITS bits at most, whatever their number. Rows whose bit is unset
hold none of the keys for certain and stay where they are; only the rest are
joined. Rows are carried as one struct, so their own column names never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.plans.materialize import BROADCAST_ROWS, is_small, materialize

#: 2^28 bits are 32 MB: the proven bound of what is broadcast.
BITS = 28
#: Bits for each key while the bound allows; one row in so many passes by chance.
BITS_PER_KEY = 64
#: Fixed value: bits in one value of Spark's bitmap aggregate.
_PER_VALUE = 15


def bits_for(keys: int) -> int:
    """log2 of the size of a bitmap for so many keys."""
    return min(BITS, max(_PER_VALUE, math.ceil(math.log2(max(1, keys) * BITS_PER_KEY))))


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return F.shiftright(h, _PER_VALUE), h.bitwiseAND(F.lit((1 << _PER_VALUE) - 1))


def key_bitmap(keys: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """bucket, bits over the values of a column."""
    bucket, bit = _place(F.col(column), bits)
    placed = keys.select(bucket.alias("bucket"), bit.alias("bit"))
    return materialize(placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmap")


def possible(df: DataFrame, key: Column, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """row (a struct of df's columns) and maybe: false where key is surely not in the bitmap."""
    bucket, bit = _place(key, bits)
    byte = F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    mask = F.pow(F.lit(2), F.col("bit") % 8).cast("int")
    placed = df.select(F.struct("*").alias("row"), bucket.alias("bucket"), bit.alias("bit"))
    joined = placed.join(F.broadcast(bitmap), "bucket", "left")
    return joined.select("row", F.coalesce(value.bitwiseAND(mask) != 0, F.lit(False)).alias("maybe"))


def split(df: DataFrame, column: str, keys: DataFrame, bound: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows that may hold a key, rows that surely do not).

    keys (materialised) has the column under the same name. With few keys the
    first is all of df and the second is None, since the join will be a broadcast.
    """
    if is_small(keys, bound):
        return df, None
    marked = possible(df, F.col(column), key_bitmap(keys, column))
    return marked.where("maybe").select("row.*"), marked.where(~F.col("maybe")).select("row.*")
