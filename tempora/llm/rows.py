"""Dropping rows that are named by a key and their doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.plans.bitmap import split
from tempora.plans.materialize import broadcast_if_small


def drop_named(docs: DataFrame, key: Column, marks: DataFrame) -> DataFrame:
    """docs without the rows that marks drops, with all their columns.

    marks (materialised) holds key, doc_id, kept and same (how many rows share
    both), one row for each named pair; doc_id may be null. A row that is not
    named stays. Of several rows with the key and doc_id of a kept pair one stays.

    Rows are carried as one struct, so their column names never clash. Most are
    filtered where they lie: by a broadcast of marks, or beyond its bound by a
    bitmap of the keys that spares all others the shuffle.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))
    some, others = split(rows, "key", marks.select("key"))
    a, b = some.alias("a"), broadcast_if_small(marks).alias("b")
    same_row = (F.col("a.key") == F.col("b.key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    named = a.join(b, same_row, "left").select("a.row", "a.key", "a.doc_id", "b.kept", "b.same")
    stays = named.where("kept is null or (kept and same = 1)").select("row")
    repeated = named.where("kept and same > 1").groupBy("key", "doc_id").agg(
        # Whatever task runs again, the same one of them stays.
        F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")
    )
    out = stays.unionByName(repeated.select("row"))
    if others is not None:
        out = out.unionByName(others.select("row"))
    return out.select("row.*")
