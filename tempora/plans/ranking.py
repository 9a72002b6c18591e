"""Ranks without gathering a group, or all rows, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.plans.materialize import broadcast_if_small, materialize


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _before():
    return Window.rowsBetween(Window.unboundedPreceding, -1)


def rank_by_hash(df: DataFrame, part: list[str], h: str, ties: list[str], bits: int = 48, buckets: int = 4096) -> DataFrame:
    """Add `rank` (1..) and `total` within part, ordered by h (uniform below 2^bits) and ties.

    Rows are ranked inside a bucket of the hash; the buckets' sizes, a few
    thousand rows per part, give what comes before.
    """
    b, n, nth, first = fresh(df, "b", "n", "nth", "first")
    keyed = df.withColumn(b, F.shiftright(F.col(h), bits - buckets.bit_length() + 1))
    sizes = keyed.groupBy(*part, b).agg(F.count("*").alias(n))
    inside = Window.partitionBy(*part)
    firsts = sizes.select(
        *part,
        b,
        F.coalesce(F.sum(n).over(_before().partitionBy(*part).orderBy(b)), F.lit(0)).alias(first),
        F.sum(n).over(inside).alias("total"),
    )
    return (
        keyed.withColumn(nth, F.row_number().over(Window.partitionBy(*part, b).orderBy(h, *ties)))
        .join(firsts, [*part, b])
        .withColumn("rank", F.col(nth) + F.col(first))
        .drop(b, nth, first)
    )


def row_numbers(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """Add 0, 1, 2, .. in the order of a column, by range partitions and their counts."""
    part, n, nth, first = fresh(df, "part", "n", "nth", "first")
    ranged = materialize(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(part).agg(F.count("*").alias(n))
    # One row per partition.
    firsts = counts.select(part, F.coalesce(F.sum(n).over(_before().orderBy(part)), F.lit(0)).alias(first))
    return (
        ranged.withColumn(nth, F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1)
        .join(F.broadcast(firsts), part)
        .withColumn(name, F.col(nth) + F.col(first))
        .drop(part, nth, first)
    )


def first_per_group(df: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each group by an order that decides: pre-aggregated in each task."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    (row,) = fresh(df, "row")
    return df.groupBy(*by).agg(F.min_by(F.struct(*keep), key).alias(row)).select(*by, f"{row}.*")


def quantiles(df: DataFrame, by: list[str], asked: dict[str, tuple[str, float]]) -> DataFrame:
    """by.., and for each name its column's exact quantile, interpolated as by percentile; nulls are left out.

    A mergeable sketch, off by at most one row in 10,000, brackets the quantile by
    ten times that; only the values in the bracket, one in 500, are ranked, after
    they were counted with what lies below. Up to 10,000 values are all ranked, as
    the bracket would be narrower than ten of them. No group's values meet in one buffer.
    """
    k, v, n, lo, hi, pos, upto, x, out = fresh(df, "k", "v", "n", "lo", "hi", "pos", "upto", "x", "out")
    rows = list(enumerate(asked.items()))
    around = lambda p: F.array(F.lit(max(0.0, p - 0.001)), F.lit(min(1.0, p + 0.001)))
    sketch = df.groupBy(*by).agg(
        *[F.percentile_approx(c, around(p), 10_000).alias(f"{x}{i}") for i, (_, (c, p)) in rows],
        *[((F.count(c) - 1) * p).alias(f"{n}{i}") for i, (_, (c, p)) in rows],
        *[(F.count(c) > 10_000).alias(f"{hi}{i}") for i, (_, (c, _)) in rows],
    )
    sketch = materialize(sketch, "sketches")
    edge = lambda i, j, end: F.when(F.col(f"{hi}{i}"), F.col(f"{x}{i}")[j]).otherwise(F.lit(float(end)))
    one = lambda i, c: F.struct(
        F.lit(i).alias(k), F.col(c).cast("double").alias(v), edge(i, 0, "-inf").alias(lo), edge(i, 1, "inf").alias(hi),
        F.col(f"{n}{i}").alias(pos),
    )
    values = df.join(broadcast_if_small(sketch), by).select(*by, F.inline(F.array(*[one(i, c) for i, (_, (c, _)) in rows])))
    low = F.when(F.col(v) < F.col(lo), F.lit(float("-inf"))).otherwise(F.col(v))
    counted = values.where(F.col(v) <= F.col(hi)).groupBy(*by, k, pos, low.alias(v)).agg(F.count("*").alias(n))
    ordered = counted.withColumn(upto, F.sum(n).over(Window.partitionBy(*by, k).orderBy(v)))
    at = lambda r: F.min(F.when(F.col(upto) > r, F.col(v)))
    below, above = F.floor(pos), F.ceil(pos)
    share = F.max(F.col(pos) - below)
    each = ordered.groupBy(*by, k).agg(((1 - share) * at(below) + share * at(above)).alias(out))
    wide = each.groupBy(*by).agg(*[F.max(F.when(F.col(k) == i, F.col(out))).alias(name) for i, (name, _) in rows])
    return sketch.select(*by).join(wide, by, "left")


def medians(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """by.., cols: the exact median of each column."""
    return quantiles(df, by, {c: (c, 0.5) for c in cols})
