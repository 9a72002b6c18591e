"""Near-duplicate views: band joins, components, and splits that keep groups whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.strings import stable_hash
from tempora.operators.components import connected_components
from tempora.plans.materialize import broadcast_if_small, materialize
from tempora.plans.ranking import rank_by_hash, row_numbers


def band_join(df: DataFrame, key: str, bands: dict[str, float], equal: tuple[str, ...] = (), block: int = 2_000) -> DataFrame:
    """Pairs (a, b), a < b by key, that differ by at most each band's tolerance.

    Equal rows are one value until the end. Each band column falls into cells as
    wide as its tolerance; one side visits the neighbouring cells, so the join is
    an equi-join on all cells (and the equal columns), with the exact difference
    left as a residual. All values of a cell are within tolerance of each other,
    so what is joined is a few times what is found. A cell of more than `block`
    values is dealt into blocks, each of which its visitors meet, so that one full
    cell is many tasks' work. Rows without a value in a band, or in an equal
    column, have no pairs.
    """
    cells = {f"c_{c}": F.floor(F.col(c) / tol).cast("long") for c, tol in bands.items()}
    on = [*equal, *cells]
    full = df.dropna(subset=[*equal, *bands])
    values = full.groupBy(*equal, *bands).agg(F.min(key).alias("v"), F.count("*").alias("n"))
    values = materialize(values.withColumns(cells), "band-values")
    blocks = values.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    left = values.join(blocks, on).withColumn("blk", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).select(*on, "blk", "v", *bands)
    away = values.select(*equal, F.col("v").alias("r_v"), *[F.col(c).alias(f"r_{c}") for c in bands], *cells)
    for c in cells:
        away = away.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    # Visits to cells that are empty end here.
    right = away.join(blocks, on).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    near = F.col("v") < F.col("r_v")
    for c, tol in bands.items():
        near = near & (F.abs(F.col(c) - F.col(f"r_{c}")) <= tol)
    pairs = left.join(right, [*on, "blk"]).where(near).select("v", "r_v")
    if not values.where("n > 1").limit(1).count():
        return pairs.select(F.col("v").alias("a"), F.col("r_v").alias("b"))
    # Every row of the one value with every row of the other, and the rows of one value with each other.
    named = [full[c].eqNullSafe(values[c]) for c in (*equal, *bands)]
    rows = materialize(full.join(values, named).select(full[key].alias("k"), values["v"], values["n"]), "band-rows")
    of = lambda v, k: rows.select(F.col("v").alias(v), F.col("k").alias(k))
    apart = pairs.join(of("v", "x"), "v").join(of("r_v", "y"), "r_v").select("x", "y")
    many = rows.where("n > 1")
    alike = many.select("v", F.col("k").alias("x")).join(many.select("v", F.col("k").alias("y")), "v").where("x < y").select("x", "y")
    return apart.unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def band_groups(df: DataFrame, key: str, bands: dict[str, float], equal: tuple[str, ...] = ()) -> DataFrame:
    """key, group_id: components of band_join's pairs, the smallest key each, without making the pairs.

    Rows of one cell are within every tolerance (up to the rounding of a
    quotient), so a cell is one node, however full it is. Two neighbouring cells
    are linked if any row of one has a partner in the other: a semi-join, which
    stops at the first and leaves at most one row for a row and a cell. Rows
    without a value in a band, or in an equal column, are groups of their own.
    """
    cells = {f"c_{c}": F.floor(F.col(c) / tol).cast("long") for c, tol in bands.items()}
    at = [*equal, *cells]
    rows = df.select(key, *equal, *bands, *[v.alias(c) for c, v in cells.items()])
    nodes = materialize(rows.dropna(subset=at).groupBy(*at).agg(F.min(key).alias("node_key")), "cells")
    # Equal values are one row; each visits the cells that come after its own.
    points = materialize(rows.dropna(subset=at).select(*at, *bands).distinct(), "cell-points")
    away = points.withColumns({f"o_{c}": F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])) for c in cells})
    away = away.where(F.struct(*[f"o_{c}" for c in cells]) > F.struct(*cells))
    other = points.select(*[F.col(c).alias(f"r_{c}") for c in points.columns])
    on = [F.col(c) == F.col(f"r_{c}") for c in equal] + [F.col(f"o_{c}") == F.col(f"r_{c}") for c in cells]
    on += [F.abs(F.col(c) - F.col(f"r_{c}")) <= tol for c, tol in bands.items()]
    met = away.join(other, on, "left_semi").select(*at, *[f"o_{c}" for c in cells]).distinct()
    far = nodes.select(*equal, *[F.col(c).alias(f"o_{c}") for c in cells], F.col("node_key").alias("v"))
    links = met.join(nodes.withColumnRenamed("node_key", "u"), at).join(far, [*equal, *[f"o_{c}" for c in cells]]).select("u", "v")
    label = connected_components(links)
    named = nodes.join(label, F.col("node_key") == F.col("node"), "left").select(
        *at, F.coalesce("component", "node_key").alias("group_id")
    )
    return rows.join(named, at, "left").select(key, F.coalesce("group_id", key).alias("group_id"))


def groups_from_pairs(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """key, group_id: the smallest key of the component; a lone row is its own group."""
    label = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return df.select(key).join(label, F.col(key) == F.col("node"), "left").select(
        key, F.coalesce("component", key).alias("group_id")
    )


def near_duplicate_groups(views: DataFrame, date_tol: float = 0.1, pose_tol: float = 0.05) -> DataFrame:
    """file_key, group_id of views (row_id, file_key, date, cx..cz, dx..dz, scale; scene_id if there are several).

    Both tolerances are inclusive. Undated views are groups of their own, and
    views of different scenes, whose positions have nothing in common, too. Views
    with the same date and camera are one before the join, so that copies are
    linear; the position joins by cells of pose_tol scene widths, since a pose
    distance is never less than the distance of the centres.
    """
    scene = ["scene_id"] if "scene_id" in views.columns else []
    pose = [*scene, "date", "cx", "cy", "cz", "dx", "dy", "dz", "scale"]
    dated = views.where("date is not null and not isnan(date)")
    same = materialize(dated.groupBy(*pose).agg(F.min("row_id").alias("row_id")), "neardup-poses")
    unit = same.select("row_id", *scene, "date", *[(F.col(c) / F.col("scale")).alias(f"u{c}") for c in ("cx", "cy", "cz")],
                       "dx", "dy", "dz")
    pairs = band_join(unit, "row_id", {"date": date_tol, "ucx": pose_tol, "ucy": pose_tol, "ucz": pose_tol}, tuple(scene))
    sides = pairs
    for side in "ab":
        cols = [F.col(c).alias(f"{side}_{c}") for c in ("ucx", "ucy", "ucz", "dx", "dy", "dz")]
        sides = sides.join(unit.select(F.col("row_id").alias(side), *cols), side)
    apart = F.sqrt(sum(F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in ("ucx", "ucy", "ucz")))
    cosine = sum(F.col(f"a_{c}") * F.col(f"b_{c}") for c in ("dx", "dy", "dz"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.pi()
    linked = materialize(sides.where(apart + angle <= pose_tol).select("a", "b"), "neardup-links")
    first = groups_from_pairs(same, "row_id", linked).select(F.col("row_id").alias("first"), "group_id")
    keyed = same.withColumnRenamed("row_id", "first").join(first, "first").select(*pose, "group_id")
    out = views.join(keyed, [views[c] == keyed[c] for c in pose], "left").select(
        views["row_id"], views["file_key"], F.coalesce(keyed["group_id"], views["row_id"]).alias("group_id")
    )
    return out


def number_groups(groups: DataFrame, key: str = "row_id") -> DataFrame:
    """Number groups 0, 1, 2, .. by first appearance."""
    firsts = groups.groupBy("group_id").agg(F.min(key).alias("first"))
    ids = row_numbers(firsts, "first", "n").select("group_id", "n")
    return groups.join(ids, "group_id").drop("group_id").withColumnRenamed("n", "group_id")


def majority(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, value: the most frequent value, the smallest of ties."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(
        F.min_by(value, F.struct((-F.col("n")).alias("n"), value)).alias(value)
    )


def _shrink(n: Column, n_test: Column, n_val: Column) -> tuple[Column, Column]:
    """Take the excess over n - 1 from the larger of the two, val first, in closed form."""
    over = F.greatest(F.lit(0), n_test + n_val - (n - 1))
    # The larger one gives first, until both are even; then they alternate, val first.
    gap = F.abs(n_val - n_test)
    first = F.least(over, gap)
    rest = over - first
    from_val = F.when(n_val >= n_test, first).otherwise(0) + F.ceil(rest / 2)
    from_test = F.when(n_val >= n_test, 0).otherwise(first) + F.floor(rest / 2)
    return n_test - from_test, n_val - from_val


def assign_splits(
    views: DataFrame, test: float = 0.1, val: float = 0.1, seed: int = 0, min_groups: int = 4
) -> DataFrame:
    """file_key, group_id, split: whole groups, stratified by their majority era.

    Groups of an era are ordered by a hash of their smallest file_key, and ranked
    in buckets of that hash, so that a common era stays spread over the cluster.
    """
    named = views.groupBy("group_id").agg(F.min("file_key").alias("name"))
    era = majority(views, "group_id", "era") if "era" in views.columns else named.select(
        "group_id", F.lit("all").alias("era")
    )
    g = named.join(era, "group_id").withColumn("h", stable_hash(F.concat(F.lit(f"{seed}:"), F.col("name"))))
    g = rank_by_hash(g, ["era"], "h", ["name"]).withColumnsRenamed({"rank": "r", "total": "n"})
    want = lambda f: F.when(F.lit(f) > 0, F.greatest(F.lit(1), F.rint(F.col("n") * f).cast("int"))).otherwise(0)
    n_test, n_val = _shrink(F.col("n"), want(test), want(val))
    split = (
        F.when(F.col("n") < min_groups, "train")
        .when(F.col("r") <= n_test, "test")
        .when(F.col("r") <= n_test + n_val, "val")
        .otherwise("train")
    )
    decided = materialize(g.select("group_id", split.alias("split")), "splits")
    return views.join(broadcast_if_small(decided), "group_id").select("file_key", "group_id", "split")


def leaks(splits: DataFrame) -> DataFrame:
    """Groups that are in more than one split; empty for a good table."""
    return splits.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1")


def group_sizes(groups: DataFrame) -> DataFrame:
    """size, n_groups: the histogram of group sizes."""
    return groups.groupBy("group_id").count().groupBy(F.col("count").alias("size")).agg(
        F.count("*").alias("n_groups")
    )
