"""Nearest views by date and by pose, exactly, without a table of all pairs.

By date: candidates have places in the order of their dates, forwards and
backwards, and a target asks for the k places after its date on both sides. The
join is on places, so about k rows for a target and side are all that is made,
and a scene with any number of views is the work of many tasks. Where some
candidates are not allowed, targets that are not certain of k ask again, wider.

By pose: centres lie in a grid whose cells are powers of two, in scene widths.
A few candidates of each cell near a target give an upper bound of its distance;
then the cells that are not farther than it by their centres alone, whose width
follows the bound, are visited, and no other can hold a nearer pose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.geometry import pose_distance
from tempora.plans.materialize import materialize

POSE = ("cx", "cy", "cz", "dx", "dy", "dz")
#: Candidates of a cell that may give a bound, and about how many a first cell holds.
SAMPLED = 8
#: A bound may be off by rounding.
SLACK = 1e-8
#: Cells of a target's own width that are looked at on each side: 2^level <= bound < 2^(level + 1).
REACH = 2


def gap(target: str = "target", cand: str = "cand") -> Column:
    return F.abs(F.col(f"{cand}_date") - F.col(f"{target}_date"))


def pose(digits: int | None = None) -> Column:
    side = lambda role: {c: F.col(f"{role}_{c}") for c in POSE}
    exact = pose_distance(side("target"), side("cand"), F.col("scale"))
    return exact if digits is None else F.round(exact, digits)


def _before(c: str, w) -> Column:
    return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def date_places(dates: DataFrame, by: list[str]) -> DataFrame:
    """by.., date, first, last, total: how many of n are before each date, up to it, and in all.

    Dates (by.., date, n) are summed inside years, and the years, bounded by the calendar, give what is before.
    """
    near = dates.groupBy(*by, "date").agg(F.sum("n").alias("n")).withColumn("year", F.floor("date"))
    years = near.groupBy(*by, "year").agg(F.sum("n").alias("n"))
    starts = years.select(
        *by, "year", _before("n", Window.partitionBy(*by).orderBy("year")).alias("n0"), F.sum("n").over(Window.partitionBy(*by)).alias("total")
    )
    first = F.col("n0") + _before("n", Window.partitionBy(*by, "year").orderBy("date"))
    placed = near.join(starts, [*by, "year"]).select(*by, "date", first.alias("first"), "n", "total")
    return placed.select(*by, "date", "first", (F.col("first") + F.col("n")).alias("last"), "total")


def _asked(targets: DataFrame, cands: DataFrame, width: int, by: list[str]) -> DataFrame:
    """targets x the first `width` cands on both sides of their date, with side, nth place asked for, and more (are there)."""
    # Of one date only the first `width` can be asked for.
    nth = F.row_number().over(Window.partitionBy(*by, "cand_date").orderBy("cand")) - 1
    capped = cands.withColumn("idx", nth).where(F.col("idx") < width)
    at = lambda df, date, n: df.select(*by, F.col(date).alias("date"), F.lit(n).alias("n"))
    dates = date_places(at(capped, "cand_date", 1).unionByName(at(targets, "target_date", 0).distinct()), by)
    dates = materialize(dates, "date-places")
    one = lambda side, place: F.struct(F.lit(side).alias("side"), place.alias("place"))
    placed = capped.join(dates.withColumnRenamed("date", "cand_date"), [*by, "cand_date"]).select(
        *cands.columns, F.inline(F.array(one(0, F.col("first") + F.col("idx")), one(1, F.col("total") - F.col("last") + F.col("idx"))))
    )
    side = lambda s, begin, there: F.struct(F.lit(s).alias("side"), begin.alias("begin"), there.alias("there"))
    last, total = F.col("last"), F.col("total")
    asks = targets.join(dates.withColumnRenamed("date", "target_date"), [*by, "target_date"]).select(
        *targets.columns, F.inline(F.array(side(0, last, total - last), side(1, total - last, last)))
    )
    asks = asks.where("there > 0").select(
        *targets.columns, "side", "begin", "there", F.explode(F.sequence(F.lit(0), F.least("there", F.lit(width)).cast("int") - 1)).alias("asked")
    )
    more = (F.col("asked") == width - 1) & (F.col("there") > width)
    asks = asks.select(*targets.columns, "side", (F.col("begin") + F.col("asked")).alias("place"), more.alias("more"))
    return asks.join(placed, [*by, "side", "place"])


def nearest_by_date(
    targets: DataFrame, cands: DataFrame, k: int, by: list[str], key: list[str], allowed: Column | None = None
) -> DataFrame:
    """targets', cands' columns, gap, nth (1..): the k allowed candidates of each target by (gap, cand).

    targets: by.., key.. (names a row), target_date, ..; cands: by.., cand, cand_date, ...
    allowed: a condition on both sides' columns.
    """
    columns = [*targets.columns, *[c for c in cands.columns if c not in by], "gap"]
    each = Window.partitionBy(*by, *key)
    width, parts = k, []
    while True:
        near = _asked(targets, cands, width, by).withColumn("gap", gap())
        order = F.struct("gap", "cand")
        if allowed is None:
            found = near.withColumn("nth", F.row_number().over(each.orderBy("gap", "cand"))).where(F.col("nth") <= k)
            return found.select(*columns, "nth")
        # What a side has not shown yet comes after the last that it has.
        near = near.withColumn("edge", F.min(F.when(F.col("more"), order)).over(each))
        sure = F.col("edge").isNull() | (order <= F.col("edge"))
        near = near.withColumn("good", sure & F.coalesce(allowed, F.lit(False)))
        near = near.withColumn("done", F.col("edge").isNull() | (F.sum(F.col("good").cast("int")).over(each) >= k))
        near = materialize(near, "date-shortlist")
        ranked = near.where("done and good").withColumn("nth", F.row_number().over(each.orderBy("gap", "cand"))).where(F.col("nth") <= k)
        parts.append(ranked.select(*columns, "nth"))
        targets = materialize(near.where("not done").select(*targets.columns).distinct(), "date-again")
        if not targets.count():
            return reduce(DataFrame.unionByName, parts)
        width *= 4


def _level(width: Column) -> Column:
    """The largest level with 2^level <= width; bounded, so that cell numbers stay longs."""
    return F.greatest(F.lit(-40), F.least(F.lit(40), F.floor(F.log2(F.greatest(width, F.lit(1e-12)))))).cast("int")


def _cell(role: str, c: str, level: Column) -> Column:
    return F.floor(F.col(f"{role}_{c}") / F.col("scale") / F.pow(F.lit(2.0), level)).cast("long")


def _visits(active: DataFrame, reach: int, slack: float) -> DataFrame:
    """A row for each cell of the level that is at most `reach` away on every axis, and not farther than the bound."""
    out = active.withColumn("size", F.pow(F.lit(2.0), F.col("level")))
    away = F.lit(0.0)
    for c in ("cx", "cy", "cz"):
        own = _cell("target", c, F.col("level"))
        out = out.withColumn(f"k{c}", F.explode(F.sequence(own - reach, own + reach)))
        u, low = F.col(f"target_{c}") / F.col("scale"), F.col(f"k{c}") * F.col("size")
        off = F.greatest(F.lit(0.0), low - u, u - low - F.col("size"))
        away = away + off * off
        # As soon as an axis is known, what is too far by it alone goes.
        out = out.where(F.col("bound").isNull() | (F.sqrt(away) <= F.col("bound") + slack))
    return out.drop("size")


def nearest_by_pose(targets: DataFrame, cands: DataFrame, by: list[str], key: list[str], digits: int | None = None) -> DataFrame:
    """by.., key.., cand, gap, pose: the candidate of the same `by` of least (pose, gap, cand); none without candidates.

    targets: by.., key.. (names a row), target_date, target_cx.., scale; cands: by.., cand, cand_date, cand_cx.., scale.
    digits: to which poses are rounded before they are compared. A row without a
    centre and a direction, finite numbers all, finds nothing and is not found.
    """
    slack = SLACK + (0.0 if digits is None else 10.0**-digits)
    whole = lambda df, role: reduce(
        lambda d, c: d.where(F.abs(F.col(c)) < F.lit(float("inf"))), [f"{role}_{c}" for c in POSE] + ["scale"], df
    )
    targets, cands = whole(targets, "target"), whole(cands, "cand")
    own = [f"cand_{c}" for c in ("date", *POSE)]
    # Copies are one candidate.
    cands = materialize(cands.groupBy(*by, "scale", *own).agg(F.min("cand").alias("cand")), "pose-candidates")
    sizes = cands.groupBy(*by).agg(F.count("*").alias("n"))
    # A cell of an even spread over a scene width holds about SAMPLED.
    first = sizes.select(*by, _level(F.pow(F.lit(8.0 * SAMPLED) / F.col("n"), 1 / 3)).alias("level"))
    names = [*by, *key, "target_date", *[f"target_{c}" for c in POSE], "scale"]
    active = targets.select(*names).join(first, by).withColumn("bound", F.lit(None).cast("double"))
    cells = ["kcx", "kcy", "kcz"]
    found_struct = F.struct(pose(digits).alias("pose"), gap().alias("gap"), F.col("cand"))
    sampled = Window.partitionBy(*by, "level", *cells).orderBy(F.xxhash64("cand"), "cand")
    active = materialize(active, "pose-targets")
    bounded = []
    while True:
        # A few of each cell are enough for a bound.
        some = _in_cells(cands, active, by).withColumn("nth", F.row_number().over(sampled)).where(F.col("nth") <= SAMPLED).drop("nth", "scale")
        near = _visits(active, 1, slack).join(some, [*by, "level", *cells], "left").groupBy(*names, "level").agg(F.min(pose(digits)).alias("found"))
        near = materialize(near, "pose-bounds")
        bounded.append(near.where("found is not null").select(*names, F.col("found").alias("bound"), _level(F.col("found")).alias("level")))
        active = near.where("found is null").select(*names, (F.col("level") + 2).alias("level"), F.lit(None).cast("double").alias("bound"))
        active = materialize(active, "pose-targets")
        if not active.count():
            break
    last = materialize(reduce(DataFrame.unionByName, bounded), "pose-balls")
    every = _in_cells(cands, last, by).drop("scale")
    best = _visits(last, REACH, slack).join(every, [*by, "level", *cells]).groupBy(*by, *key).agg(F.min(found_struct).alias("best"))
    return best.select(*by, *key, "best.cand", "best.gap", "best.pose")


def _in_cells(cands: DataFrame, active: DataFrame, by: list[str]) -> DataFrame:
    """cands with their cell on each level that a target of their group looks at; 81 levels exist."""
    at = cands.join(active.select(*by, "level").distinct(), by)
    return at.withColumns({f"k{c}": _cell("cand", c, F.col("level")) for c in ("cx", "cy", "cz")})


def nearest(
    targets: DataFrame, cands: DataFrame, strategy: str, by: list[str], key: list[str], k_date: int = 20,
    allowed: Column | None = None, digits: int | None = None,
) -> DataFrame:
    """by.., key.., cand, gap, pose: the candidate that a strategy chooses for each target.

    date: least (gap, pose, cand); pose: least (pose, gap, cand); date_then_pose: of the k_date least by (gap, cand) the one
    of least pose, the earlier of ties. allowed holds for date_then_pose.
    """
    if allowed is not None and strategy != "date_then_pose":
        raise ValueError(f"no condition on candidates by {strategy}")
    if strategy == "pose":
        return nearest_by_pose(targets, cands, by, key, digits)
    if strategy == "date":
        # The one or two dates of least gap, then the nearest pose among their views.
        dates = cands.select(*by, "cand_date").distinct().withColumn("cand", F.lit(0).cast("long"))
        two = nearest_by_date(targets, dates, 2, by, key).drop("cand", "nth")
        least = two.withColumn("least", F.min("gap").over(Window.partitionBy(*by, *key))).where("gap = least").drop("gap", "least")
        asked = least.withColumnRenamed("cand_date", "on_date")
        best = nearest_by_pose(asked, cands.withColumn("on_date", F.col("cand_date")), [*by, "on_date"], key, digits)
        return best.groupBy(*by, *key).agg(F.min(F.struct("gap", "pose", "cand")).alias("best")).select(*by, *key, "best.cand", "best.gap", "best.pose")
    if strategy != "date_then_pose":
        raise ValueError(f"unknown strategy {strategy}")
    short = nearest_by_date(targets, cands.drop("scale"), k_date, by, key, allowed).withColumn("pose", pose(digits))
    best = short.groupBy(*by, *key).agg(F.min(F.struct("pose", "nth", "cand", "gap")).alias("best"))
    return best.select(*by, *key, "best.cand", "best.gap", "best.pose")
