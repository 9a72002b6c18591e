"""Connected components of an edge table, by alternating star operations.

Large-star hangs every larger neighbour of a node on the node's smallest
neighbour; small-star does so with the smaller neighbours. Both need only the
minimum of a neighbourhood, which is pre-aggregated in each task, so a hub never
gathers its neighbours in one place. Every round is written to the shared
folder, and removed once the next one is; rounds grow with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.materialize import remove, write_table


def _minimum(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _state(edges: DataFrame):
    """Count and order-free hash of an edge set; equal sets are equal here."""
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of any one orderable type -> node, component (its smallest node).

    Null ends and self-loops are ignored, so nodes without a partner are absent;
    an empty edge table gives an empty result.
    """
    pairs = edges.where("u is not null and v is not null and u != v")
    stars, at = write_table(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    before = _state(stars)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large, large_at = write_table(large.where("u != v").distinct(), "cc-large")
        low = _minimum(large)
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
        )
        stars, next_at = write_table(small.where("u != v").distinct(), "cc")
        remove(edges.sparkSession, at, large_at)
        at = next_at
        after = _state(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    hubs = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
