"""Exact nearest neighbours of a query set by cosine or by camera, in tiles.

Rows and queries are dealt into blocks of bounded size; each pair of blocks is a
group that compares two small matrices and keeps the k best of each query, and
these are merged. Nothing is collected on the driver and no pair table is built.

Cameras lie in cells between quantiles of each of their six numbers. The k-th
best of a query's own cell bounds its distance, and only cells whose box, of
what they hold, is not farther than the bound are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.geometry import scene_scale
from tempora.plans.materialize import broadcast_if_small, materialize


def _tiles(
    rows: DataFrame, queries: DataFrame, by: tuple[str, ...], best: Callable, kind: str, rows_block: int, queries_block: int
) -> DataFrame:
    """best(key, rows, queries) of every two blocks of rows and queries (by.., id, ..) of the same `by`."""
    up = lambda n, m: F.greatest(F.lit(1), F.ceil(n / m)).cast("int")
    count = lambda df, m, name: df.groupBy(*by).agg(up(F.count("*"), F.lit(m)).alias(name))
    # Blocks of each group on both sides: as many as its own size asks for.
    sizes = count(rows, rows_block, "n_rows").join(count(queries, queries_block, "n_queries"), list(by))
    sizes = broadcast_if_small(materialize(sizes, "knn-blocks"))

    def deal(df, n, own, other, m):
        own_block = F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(own)
        # Columns of its own, should both sides come from one table.
        kept = [F.col(c).alias(c) for c in df.columns]
        return df.join(sizes, list(by)).select(*kept, own_block, F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other))

    left = deal(rows, "n_rows", "rb", "qb", "n_queries")
    right = deal(queries, "n_queries", "qb", "rb", "n_rows")
    return left.groupBy(*by, "rb", "qb").cogroup(right.groupBy(*by, "rb", "qb")).applyInPandas(best, kind)


def knn_cosine(
    rows: DataFrame, queries: DataFrame, k: int, rows_block: int = 20_000, queries_block: int = 2_000, by: tuple[str, ...] = ()
) -> DataFrame:
    """by.., query, id, score, rank of the k most similar other rows (of the same `by`) of each query.

    rows, queries: by.., id long, vec array<float>. Ties go to the smaller id.
    """
    if not by:
        # One group by a key that is no literal: a join on a literal would be a product.
        one = lambda df: df.select(F.pmod(F.xxhash64("id"), F.lit(1)).alias("all"), "id", "vec")
        return knn_cosine(one(rows), one(queries), k, rows_block, queries_block, ("all",)).drop("all")
    def best(key: tuple, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "id", "score"]
        if r.empty or q.empty:
            return pd.DataFrame([], columns=[*by, *columns])
        unit = lambda v: (m := np.array(v.tolist(), float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        ids, asked = r["id"].to_numpy(), q["id"].to_numpy()
        units, wanted, parts = unit(r["vec"]), unit(q["vec"]), []
        for i in range(0, len(q), 256):
            score = np.round(wanted[i : i + 256] @ units.T, 6)
            score[asked[i : i + 256, None] == ids[None]] = -np.inf
            # All that reach the k-th best, ties included, are put in order.
            last = max(0, score.shape[1] - k)
            at, col = np.nonzero(score >= np.partition(score, last, axis=1)[:, last, None])
            found = pd.DataFrame({"query": asked[i : i + 256][at], "id": ids[col], "score": score[at, col]})
            found = found[found["score"] > -np.inf].sort_values(["query", "score", "id"], ascending=[True, False, True])
            parts.append(found.groupby("query").head(k))
        out = pd.concat(parts)
        return out.assign(**dict(zip(by, key, strict=False)))[[*by, *columns]]

    kind = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by) + "query long, id long, score double"
    found = _tiles(rows.select(*by, "id", "vec"), queries.select(*by, "id", "vec"), by, best, kind, rows_block, queries_block)
    order = Window.partitionBy(*by, "query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


CAMERA = ("cx", "cy", "cz", "dx", "dy", "dz")
#: A scene's cells hold at least so many of its views on average.
CELL_ROWS = 1_000
#: Views and queries that meet in a group at most, about.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000
#: Quantiles of each number that cells may lie between.
CUTS = 24
#: Digits of a distance.
DIGITS = 6


def camera_cells(views: DataFrame, by: list[str]) -> DataFrame:
    """views (materialised) with cell: a long, the same for views between the same quantiles of all numbers of CAMERA."""
    at = F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)])
    cuts = views.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile_approx(c, at, 1_000).alias(f"{c}_cuts") for c in CAMERA])
    side = F.greatest(F.lit(1), F.least(F.lit(CUTS + 1), F.floor(F.pow(F.col("n") / CELL_ROWS, F.lit(1 / len(CAMERA))))))
    nth = lambda c: F.floor(F.size(F.filter(f"{c}_cuts", lambda x: x <= F.col(c))) * side / (CUTS + 1))
    cell = reduce(lambda out, c: out * side + nth(c), CAMERA, F.lit(0)).cast("long")
    # A row of cuts is a kilobyte.
    cuts = broadcast_if_small(materialize(cuts, "camera-cuts"), 10_000)
    return views.join(cuts, by).select(*[F.col(c) for c in views.columns], cell.alias("cell"))


def nearest_cameras(rows: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    """by without cell.., query, id, dist, other: the k rows of the same `by` nearest to each query that are not beyond its bound, if not more.

    rows: by.., id, vec (6); queries: by.., id, vec, bound. `other` tells the query from the rest.
    """

    def best(key: tuple, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        columns = [*by[:-1], "query", "id", "dist", "other"]
        if r.empty or q.empty:
            return pd.DataFrame([], columns=columns)
        ids, asked, bound = r["id"].to_numpy(), q["id"].to_numpy(), q["bound"].to_numpy(float)
        x, wanted, parts = np.array(r["vec"].tolist(), float), np.array(q["vec"].tolist(), float), []
        last, step = min(k, len(r)) - 1, max(1, 1_000_000 // len(r))
        for i in range(0, len(q), step):
            far = sum((wanted[i : i + step, j, None] - x[None, :, j]) ** 2 for j in range(x.shape[1]))
            far = np.round(np.sqrt(far), DIGITS)
            # All that reach the k-th best, ties included, are put in order.
            edge = np.minimum(np.partition(far, last, axis=1)[:, last], bound[i : i + step])
            at, col = np.nonzero(far <= edge[:, None])
            found = pd.DataFrame({"query": asked[i : i + step][at], "id": ids[col], "dist": far[at, col]})
            found["other"] = found["query"] != found["id"]
            parts.append(found.sort_values(["query", "dist", "other", "id"]).groupby("query").head(k))
        return pd.concat(parts).assign(**dict(zip(by[:-1], key, strict=False)))[columns]

    kind = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by[:-1])
    own = rows.schema["id"].dataType.simpleString()
    return _tiles(rows, queries, by, best, f"{kind}query {own}, id {own}, dist double, other boolean", BLOCK_ROWS, BLOCK_QUERIES)


def nearest_modern_views(views: DataFrame, queries: DataFrame, k: int = 8, since: float = 2000) -> DataFrame:
    """scene_id, query, row_id, dist, rank: the k modern views nearest to each query, itself the first of equals, then the smaller row_id.

    views: scene_id, row_id, date, cx..cz, dx..dz; queries: scene_id, row_id, some
    modern views. The distance is the norm over position in units of the modern
    views' scale, and direction, rounded to DIGITS. A view without a centre and a
    direction, finite numbers all, finds nothing and is not found.
    """
    modern = views.where(F.col("date") >= since)
    modern = modern.join(scene_scale(modern, ["scene_id"]), "scene_id").select(
        "scene_id", F.col("row_id").alias("id"), *[(F.col(c) / F.col("scale") if c[0] == "c" else F.col(c)).alias(c) for c in CAMERA]
    )
    finite = reduce(lambda a, b: a & b, [F.abs(F.col(c)) < F.lit(float("inf")) for c in CAMERA])
    modern = materialize(modern.where(finite), "modern-views")
    rows = materialize(camera_cells(modern, ["scene_id"]), "modern-cells")
    boxes = rows.groupBy("scene_id", "cell").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{c}_{name}") for c in CAMERA for name, f in (("lo", F.min), ("hi", F.max))]
    )
    boxes = materialize(boxes, "camera-boxes")
    asked = rows.join(queries.select("scene_id", F.col("row_id").alias("id")), ["scene_id", "id"], "left_semi")
    asked = materialize(asked, "nearest-queries")
    by, vec = ("scene_id", "cell"), F.array(*CAMERA).alias("vec")
    rows = rows.select(*by, "id", vec)

    own = nearest_cameras(rows, asked.select(*by, "id", vec, F.lit(float("inf")).alias("bound")), k, by)
    own = own.groupBy("scene_id", F.col("query").alias("id")).agg(F.get(F.array_sort(F.collect_list("dist")), F.lit(k - 1)).alias("bound"))
    bounded = materialize(asked.drop("cell").join(own, ["scene_id", "id"], "left"), "nearest-bounds")
    norm = lambda parts: F.sqrt(sum(p * p for p in parts))
    lo, hi = (lambda c: F.col(f"{c}_lo")), (lambda c: F.col(f"{c}_hi"))
    # Where the own cell holds too few, k are no farther than the far corner of some other.
    corner = norm(F.greatest(F.abs(F.col(c) - lo(c)), F.abs(F.col(c) - hi(c))) for c in CAMERA)
    full = bounded.where("bound is null").join(broadcast_if_small(boxes.where(F.col("n") >= k)), "scene_id")
    full = full.groupBy("scene_id", "id").agg(F.min(corner).alias("corner"))
    slack = 2 * 10.0**-DIGITS
    bound = F.coalesce("bound", F.col("corner") + slack, F.lit(float("inf")))
    bounded = bounded.join(full, ["scene_id", "id"], "left").withColumn("bound", bound).drop("corner")
    near = norm(F.greatest(F.lit(0.0), lo(c) - F.col(c), F.col(c) - hi(c)) for c in CAMERA)
    visits = bounded.join(broadcast_if_small(boxes), "scene_id").where(near <= F.col("bound") + slack)
    visits = materialize(visits.select(*by, "id", vec, "bound"), "nearest-visits")
    order = Window.partitionBy("scene_id", "query").orderBy("dist", "other", "id")
    ranked = nearest_cameras(rows, visits, k, by).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("scene_id", "query", F.col("id").alias("row_id"), "dist", "rank")
