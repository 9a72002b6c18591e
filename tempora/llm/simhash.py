"""Near-duplicates by SimHash and tiled exact comparison.

Each text becomes a 64-bit fingerprint of its 4-word shingles. The distinct
fingerprints are dealt into blocks of bounded size by population count, and each
pair of blocks whose counts differ by no more than the radius becomes one group
of work. A group sorts its fingerprints by the population counts of their four
quarters, cuts them into tiles and compares tiles by exclusive-or and bit count,
skipping tile pairs whose population counts differ, over the quarters together,
by more than the radius: such fingerprints cannot be within it. A group returns the edges of a spanning
forest of its links, not the pairs, so thousands of copies within the radius
cost thousands of rows. Components join the forests.

The comparison is exact and quadratic in the number of distinct fingerprints;
tiles and blocks bound the memory of a task, not the work.

Defined cases: a null or blank text has fingerprint 0 and links like any other;
fewer than four words are one shingle; rows with a null doc_id take part, with
the smallest non-null doc_id of their component (null if there is none);
repeated rows share fingerprint and component; an empty table gives an empty
result; extra columns are ignored, and the stage returns them as they are. The
stage keeps exactly one row of each component: the one with the smallest
doc_id, null last, and of several with that doc_id the one with the smallest
digest of its text; a doc_id on unrelated texts names unrelated rows.

Work: a fingerprint meets the blocks whose population counts are within the
radius, 0.57 of all at radius 4 on random bits. So each of N distinct ones is
copied about max(14, 0.57 N / BLOCK) times: 14 up to 1.6 million of them, 87 at
10 million, 8,700 (a quarter of a megabyte shuffled for each) at a billion,
where a coarser key must come first.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.rows import drop_named
from tempora.operators.components import connected_components
from tempora.plans.materialize import materialize
from tempora.session import bound_arrow_batches

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a block at most, on average; a group holds two blocks.
BLOCK = 65_536
#: Blocks are at most this part of all fingerprints, so that few of them still make many groups.
PARTS = 16
TILE = 256

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; a bit is set if it is in over half the shingle hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces[: len(words) - shingle] + 1).tolist()]
    ends = [*spaces[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    set_bits, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, 65_536):
        h = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65_536], ends[at : at + 65_536])],
            np.dtype("<u8"),
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * set_bits > total, bitorder="little")
    return int(chosen.view("<u8")[0])


def fingerprints(docs: DataFrame, *keys: Column) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document, and key, if one is given."""
    schema = "doc_id long, fp long" + ", key string" * len(keys)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            columns = [batch.column("doc_id"), pa.array(fp.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "key"][: len(columns)])

    bound_arrow_batches(docs.sparkSession)
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[k.alias("key") for k in keys]
    )
    return read.mapInArrow(run, schema)


class Forest:
    """Union of positions, by numpy; pairs already joined cost one look-up."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while (up := self.parent[r]).tobytes() != r.tobytes():
            r = up
        return r

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root(i), self.root(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.root(child)


class Tiles:
    """Fingerprints sorted by the population counts of their quarters, cut into tiles."""

    def __init__(self, fp: np.ndarray, where: np.ndarray):
        quarters = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int8)
        order = np.lexsort(quarters.T)
        self.fp, self.where, quarters = fp[order], where[order], quarters[order]
        cuts = np.arange(0, len(fp), TILE)
        self.spans = [(a, min(a + TILE, len(fp))) for a in cuts.tolist()]
        self.low = np.minimum.reduceat(quarters, cuts) if len(fp) else quarters
        self.high = np.maximum.reduceat(quarters, cuts) if len(fp) else quarters


def link_tiles(a: Tiles, b: Tiles, same: bool, radius: int, forest: Forest) -> None:
    """Merge, in forest, all positions of a and b within the radius."""
    for t, (s, e) in enumerate(a.spans):
        gap = np.maximum(b.low - a.high[t], a.low[t] - b.high).clip(0).sum(axis=1)
        for u in np.flatnonzero(gap <= radius).tolist():
            if same and u < t:
                continue
            f, g = b.spans[u]
            near = np.bitwise_count(a.fp[s:e, None] ^ b.fp[None, f:g]) <= radius
            if same and u == t:
                np.fill_diagonal(near, False)
            if near.any():
                i, j = np.nonzero(near)
                forest.merge(a.where[s + i], b.where[f + j])


def link_group(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Forest edges of one pair of blocks; column side is 0 or 1, one side alone is a block with itself."""
    fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    side = pdf["side"].to_numpy()
    forest = Forest(len(fp))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if pdf["self"].iloc[0]:
        tiles = Tiles(fp[left], left)
        link_tiles(tiles, tiles, True, radius, forest)
    elif len(left) and len(right):
        link_tiles(Tiles(fp[left], left), Tiles(fp[right], right), False, radius, forest)
    u, v = forest.edges()
    signed = fp.view(np.int64)
    return pd.DataFrame({"u": signed[u], "v": signed[v]})


def class_blocks(distinct: DataFrame, block: int) -> list[int]:
    """First block number of each population count 0 to 64, and the number of blocks.

    A class of more than `block` fingerprints, or more than one in PARTS of all,
    has several blocks. 65 counts at most come to the driver.
    """
    counts = {r["p"]: r["n"] for r in distinct.groupBy(F.bit_count("fp").alias("p")).agg(F.count("*").alias("n")).collect()}
    block = min(block, max(1, math.ceil(sum(counts.values()) / PARTS)))
    first = [0]
    for p in range(65):
        first.append(first[-1] + max(1, math.ceil(counts.get(p, 0) / block)))
    return first


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that join all within the radius.

    Blocks are numbered by population count, so a fingerprint goes only to the
    run of blocks whose counts differ from its own by no more than the radius.
    """
    first = class_blocks(distinct, block)
    at = F.array(*[F.lit(v) for v in first])
    own = F.get(at, F.col("p")) + F.pmod(
        F.xxhash64("fp"), F.get(at, F.col("p") + 1) - F.get(at, F.col("p"))
    ).cast("int")
    low, high = F.greatest(F.lit(0), F.col("p") - radius), F.least(F.lit(64), F.col("p") + radius)
    dealt = distinct.select("fp", F.bit_count("fp").alias("p")).select(
        "fp", own.alias("own"), F.explode(F.sequence(F.get(at, low), F.get(at, high + 1) - 1)).alias("other")
    )
    dealt = dealt.select(
        "fp",
        (F.least("own", "other").cast("long") * first[-1] + F.greatest("own", "other")).alias("pair"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        (F.col("own") == F.col("other")).alias("self"),
    )
    return dealt.groupBy("pair").applyInPandas(lambda pdf: link_group(pdf, radius), "u long, v long")


def components(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fp, root (one fp of its component), component_id (its smallest doc_id) of every distinct fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    edges = materialize(links(distinct, radius, block), "simhash-links")
    label = connected_components(edges).select(F.col("node").alias("fp"), "component")
    rooted = distinct.join(label, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"), "simhash-components")


def near_groups(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(fingerprints(docs), "simhash")
    return prints.join(components(prints, radius, block), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Rows are named by the digest of their text and doc_id. Rows that share both
    are counted as one name first, so a text copied a million times is one row
    of the tables that are joined here.
    """
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    prints = materialize(fingerprints(docs, key), "simhash")
    names = prints.groupBy("fp", "key", "doc_id").agg(F.count("*").alias("same"))
    member = names.join(components(prints, radius).select("fp", "root"), "fp")
    member = materialize(member.select("root", "key", "doc_id", "same"), "simhash-members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = member.groupBy("root").agg(F.min(order).alias("best"), F.sum("same").alias("size"))
    marks = member.join(best.where("size > 1"), "root").select(
        "key", "doc_id", (order == F.col("best")).alias("kept"), "same"
    )
    return drop_named(docs, key, materialize(marks, "simhash-marks"))
