"""Sampling of dated views, and nearest-photo baselines with their reports."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.geometry import pose_distance
from tempora.functions.strings import stable_hash
from tempora.operators.search import nearest
from tempora.plans.materialize import materialize
from tempora.plans.ranking import first_per_group, fresh, rank_by_hash, row_numbers

# The baselines (strategy, candidates) and the gap buckets.
BASELINES = {
    "input_date": ("date", "inputs"),
    "input_pose": ("pose", "inputs"),
    "pool_date_pose": ("date_then_pose", "pool"),
}
GAPS = ((2.0, "<2y"), (10.0, "2-10y"), (50.0, "10-50y"))
POSE = ("cx", "cy", "cz", "dx", "dy", "dz")


@dataclass(frozen=True)
class Sampling:
    """How many views a sample has, and how far apart their dates may be."""

    n_inputs: int = 3
    n_targets: int = 5
    modern_tolerance: float = 1.0
    old_tolerance: float = 5.0
    boundary: float = 1990.0
    old_before: float = 1970.0
    old_target_fraction: float | None = None


def gap_bucket(years: Column) -> Column:
    out = F.lit(">50y")
    for limit, name in reversed(GAPS):
        out = F.when(years < limit, name).otherwise(out)
    return out


def dated(views: DataFrame) -> DataFrame:
    return views.where("date is not null and not isnan(date)")


def near_dates(dates: DataFrame, cfg: Sampling, by: str) -> DataFrame:
    """by, date, n, same, below of the distinct dates (by, date, n) of each scene.

    same: views within the date's tolerance, its own included; below: those of
    them with an earlier date. Dates meet in cells twice as wide as the tolerance,
    and visit the next cell if they lie near its edge, so that a scene with many
    dates is the work of many tasks.
    """
    cell, own = fresh(dates, "cell", "own")
    out = None
    for tol, mine in (
        (cfg.modern_tolerance, F.col("date") >= cfg.boundary),
        (cfg.old_tolerance, F.col("date") < cfg.boundary),
    ):
        width, reach = 2 * tol or 1.0, 1.001 * tol
        at = lambda d, w=width: F.floor(d / w)
        reached = F.col("date") >= cfg.boundary - reach if out is None else F.col("date") <= cfg.boundary + reach
        halo = dates.where(reached).withColumn(own, at(F.col("date"))).withColumn(
            cell, F.explode(F.sequence(at(F.col("date") - reach), at(F.col("date") + reach)))
        )
        # Frames over doubles are written in SQL.
        total = lambda upto, t=tol: F.expr(
            f"sum(n) over (partition by `{by}`, {cell} order by date range between {float(t)}D preceding and {upto})"
        )
        counted = halo.withColumns(
            {"same": total(f"{float(tol)}D following"), "below": total("current row") - F.col("n")}
        ).where(mine & (F.col(cell) == F.col(own))).select(by, "date", "n", "same", "below")
        out = counted if out is None else out.unionByName(counted)
    return out


def _eligible(views: DataFrame, cfg: Sampling, by: str) -> DataFrame:
    """near_dates of dated views with `total`, the views of the scene, and whether the date gives anchors."""
    dates = views.groupBy(by, "date").agg(F.count("*").alias("n"))
    totals = dates.groupBy(by).agg(F.sum("n").alias("total"))
    return near_dates(dates, cfg, by).join(totals, by).withColumn(
        "eligible", (F.col("same") >= cfg.n_targets) & (F.col("total") - cfg.n_targets >= cfg.n_inputs)
    )


def eligible_anchors(views: DataFrame, cfg: Sampling = Sampling(), by: str = "scene_id") -> DataFrame:
    """Views whose date group can give all targets and leave enough inputs, with `same`, the group's size.

    Undated views are neither anchors nor counted.
    """
    views = dated(views)
    good = _eligible(views, cfg, by).where("eligible").select(by, "date", "same")
    return views.join(good, [by, "date"]).select(*views.columns, "same")


def _places(near: DataFrame, cfg: Sampling) -> tuple[DataFrame, DataFrame]:
    """Where each date's views lie in their scene's order of dates, and each scene's sums.

    first, efirst: views, and possible anchors, of earlier dates. Dates are summed
    inside years, and a scene's years, bounded by the calendar, give what is before.
    """
    anchors = F.when(F.col("eligible"), F.col("n")).otherwise(0)
    near = near.withColumns(
        {"e": anchors, "o": F.when(F.col("date") < cfg.old_before, anchors).otherwise(0), "year": F.floor("date")}
    )
    years = near.groupBy("scene_id", "year").agg(*[F.sum(c).alias(c) for c in "neo"])
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_year = Window.partitionBy("scene_id").orderBy("year")
    by_date = Window.partitionBy("scene_id", "year").orderBy("date")
    starts = years.select("scene_id", "year", before("n", by_year).alias("n0"), before("e", by_year).alias("e0"))
    placed = near.join(starts, ["scene_id", "year"]).select(
        "scene_id", "date", "eligible", "same", "below",
        (F.col("n0") + before("n", by_date)).alias("first"), (F.col("e0") + before("e", by_date)).alias("efirst"),
    )
    sums = years.groupBy("scene_id").agg(*[F.sum(c).alias(k) for c, k in zip("neo", ("total", "anchors", "old"), strict=True)])
    return placed, sums


def _skip(x: Column, taken: Column) -> Column:
    """The x-th place, from 0, that is not among those taken."""
    return F.aggregate(F.array_sort(taken), x, lambda at, p: at + (at >= p).cast("long"))


def draw_samples(
    views: DataFrame, n_samples: int, cfg: Sampling = Sampling(), seed: int = 0, epoch: int = 0, wanted: DataFrame | None = None
) -> DataFrame:
    """scene_id, sample, view, role, row_id: inputs first, then targets, whose first is the anchor.

    Every scene has samples 0 to n_samples - 1, or those that wanted (scene_id, sample) names.

    Every view has a place in its scene's order of date, hash of row_id, row_id.
    A sample draws places, by hashes of (seed, epoch, sample, draw) alone and
    without replacement, and the few places drawn are joined to their views: no
    scene is gathered. The anchor is drawn from all possible anchors (from old
    ones with probability old_target_fraction, if there are any), the other
    targets from its date group, the inputs from the rest of the scene.
    Undated views are left out; a scene without anchors has no samples.
    """
    views = dated(views).select("scene_id", "row_id", "date")
    places, sums = _places(materialize(_eligible(views, cfg, "scene_id"), "sampling-near"), cfg)
    hashed = views.withColumn("h", stable_hash(F.col("row_id").cast("string")))
    nth = F.col("rank") - 1
    ranked = materialize(
        rank_by_hash(hashed, ["scene_id", "date"], "h", ["row_id"]).drop("total").join(places, ["scene_id", "date"]).select(
            "scene_id", "row_id", (F.col("first") + nth).alias("place"), (F.col("first") - F.col("below")).alias("low"),
            "same", F.when(F.col("eligible"), F.col("efirst") + nth).alias("anchor"),
        ),
        "sampling-places",
    )

    def draw(j: int, below: Column) -> Column:
        text = F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col("sample"), F.lit(j))
        return F.pmod(stable_hash(text), below)

    chosen = F.col("anchors")
    if cfg.old_target_fraction is not None:
        wants_old = draw(-1, F.lit(1 << 48)) < F.lit(cfg.old_target_fraction * (1 << 48))
        chosen = F.when(wants_old & (F.col("old") > 0), F.col("old")).otherwise(chosen)
    samples = sums.where("anchors > 0")
    if wanted is None:
        samples = samples.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    else:
        samples = samples.join(wanted.select("scene_id", "sample"), "scene_id")
    got = samples.withColumn("anchor", draw(0, chosen)).join(ranked.where("anchor is not null"), ["scene_id", "anchor"])
    got = got.withColumn("targets", F.array("place")).withColumn("inputs", F.expr("cast(array() as array<bigint>)"))
    for j in range(1, cfg.n_targets):
        place = _skip(F.col("low") + draw(j, F.col("same") - j), F.col("targets"))
        got = got.withColumn("targets", F.array_append("targets", place))
    for j in range(cfg.n_inputs):
        place = _skip(draw(cfg.n_targets + j, F.col("total") - cfg.n_targets - j), F.concat("targets", "inputs"))
        got = got.withColumn("inputs", F.array_append("inputs", place))
    picks = materialize(
        got.select("scene_id", "sample", F.posexplode(F.concat("inputs", "targets")).alias("view", "place")), "sampling-picks"
    )
    role = F.when(F.col("view") < cfg.n_inputs, "input").otherwise("target")
    return picks.join(ranked.select("scene_id", "place", "row_id"), ["scene_id", "place"]).select(
        "scene_id", "sample", "view", role.alias("role"), "row_id"
    )


def affine(n: int, seed: int, epoch: int) -> tuple[int, int]:
    """(a, b) of a permutation i -> (a * i + b) mod n of 0 .. n - 1, keyed by seed and epoch."""
    key = int(hashlib.sha1(f"{seed}:{epoch}".encode()).hexdigest()[:16], 16)
    a = key % n or 1
    while math.gcd(a, n) > 1:
        a += 1
    return a % n or 1, (key >> 20) % n


def epoch_samples(
    views: DataFrame, n_samples: int, cfg: Sampling = Sampling(), seed: int = 0, epoch: int = 0, start: int = 0, shard: int = 0, shards: int = 1
) -> DataFrame:
    """index, scene_id, sample, view, role, row_id: one shard of an epoch of n_samples (below 2^31), from index `start` on.

    What index i of an epoch holds depends on (seed, epoch, i) and the views alone: a keyed permutation sends it to a
    scene that has anchors and a number of sample there, so that scenes take turns, and the sample is drawn by hashes.
    Shards deal the indices out by their remainder; a run that ended at some index goes on from the next.
    """
    if not 0 < n_samples < 1 << 31 or not 0 <= shard < shards:
        raise ValueError(f"no shard {shard} of {shards} of {n_samples} samples")
    scenes = row_numbers(eligible_anchors(views, cfg).select("scene_id").distinct(), "scene_id", "turn")
    n_scenes = max(1, scenes.count())
    a, b = affine(n_samples, seed, epoch)
    at = (F.lit(a) * F.col("index") + b) % n_samples
    wanted = views.sparkSession.range(start, n_samples).withColumnRenamed("id", "index").where(F.col("index") % shards == shard)
    wanted = wanted.select("index", (at % n_scenes).alias("turn"), F.floor(at / n_scenes).cast("int").alias("sample"))
    wanted = materialize(wanted.join(scenes, "turn").select("index", "scene_id", "sample"), "epoch-indices")
    drawn = draw_samples(views, n_samples, cfg, seed, epoch, wanted)
    return wanted.join(drawn, ["scene_id", "sample"]).select("index", "scene_id", "sample", "view", "role", "row_id")


def retrieve(pairs: DataFrame, strategy: str, by: list[str], k_date: int = 20) -> DataFrame:
    """The chosen candidate of each target of a table of few pairs: by.., cand, gap, pose.

    pairs: by columns, cand, gap, pose. Ties go to the other measure, then to the
    smaller candidate.
    """
    gap, pose, cand = F.col("gap"), F.col("pose"), F.col("cand")
    if strategy == "date_then_pose":
        nearest = Window.partitionBy(*by).orderBy("gap", "cand")
        pairs = pairs.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k_date)
        order = [pose, F.col("nth")]
    elif strategy == "date":
        order = [gap, pose, cand]
    elif strategy == "pose":
        order = [pose, gap, cand]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return first_per_group(pairs, by, order, ["cand", "gap", "pose"])


def _named(views: DataFrame, role: str) -> DataFrame:
    return views.select(
        "scene_id", F.col("row_id").alias(role), F.col("date").alias(f"{role}_date"),
        F.col("group_id").alias(f"{role}_group"), *[F.col(c).alias(f"{role}_{c}") for c in POSE],
    )


def baseline_targets(samples: DataFrame, views: DataFrame, scales: DataFrame) -> DataFrame:
    """scene_id, sample, view, target, its date, group and pose, and scale: the drawn targets."""
    drawn = samples.where("role = 'target'").select("scene_id", "sample", "view", F.col("row_id").alias("target"))
    return drawn.join(_named(views, "target"), ["scene_id", "target"]).join(scales, "scene_id")


def input_pairs(targets: DataFrame, samples: DataFrame, views: DataFrame) -> DataFrame:
    """(scene_id, sample, view, target, cand, gap, pose): each target with the few inputs of its sample."""
    cands = samples.where("role = 'input'").select("scene_id", "sample", F.col("row_id").alias("cand"))
    full = targets.join(cands.join(_named(views, "cand"), ["scene_id", "cand"]), ["scene_id", "sample"])
    side = lambda role: {c: F.col(f"{role}_{c}") for c in POSE}
    return full.select(
        "scene_id", "sample", "view", "target", "cand",
        F.abs(F.col("cand_date") - F.col("target_date")).alias("gap"),
        pose_distance(side("target"), side("cand"), F.col("scale")).alias("pose"),
    )


def from_pool(targets: DataFrame, views: DataFrame, strategy: str, k_date: int = 20) -> DataFrame:
    """(scene_id, sample, view, target, cand, gap, pose): the view of the scene that a strategy chooses for each target.

    Targets of the sample are never candidates, nor is any view that shares a group with one.
    """
    key = ["sample", "view", "target"]
    banned = targets.groupBy("scene_id", "sample").agg(F.collect_set("target_group").alias("banned"))
    asked = materialize(targets.join(banned, ["scene_id", "sample"]), "baseline-targets")
    allowed = ~F.coalesce(F.array_contains("banned", F.col("cand_group")), F.lit(False))
    return nearest(asked, _named(dated(views), "cand"), strategy, ["scene_id"], key, k_date, allowed)


def run_baselines(samples: DataFrame, views: DataFrame, scales: DataFrame, k_date: int = 20) -> DataFrame:
    """One row per target and baseline, with the retrieved view."""
    targets = baseline_targets(samples, views, scales)
    columns = ["scene_id", "sample", "view", "target", "cand", "gap", "pose"]
    out = None
    for name, (strategy, source) in BASELINES.items():
        if source == "inputs":
            chosen = retrieve(input_pairs(targets, samples, views), strategy, columns[:4], k_date)
        else:
            chosen = from_pool(targets, views, strategy, k_date)
        chosen = chosen.select(*columns, F.lit(name).alias("baseline"))
        out = chosen if out is None else out.unionByName(chosen)
    return out


def summarize(table: DataFrame) -> DataFrame:
    """Mean PSNR by baseline; by it and the age of the targets; by it and the gap: one pass."""
    keyed = table.withColumn("bucket", gap_bucket(F.col("date_gap")))
    sets = [["baseline"], ["baseline", "old_target_sample"], ["baseline", "bucket"]]
    return keyed.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("baseline"), F.col("old_target_sample"), F.col("bucket")
    ).agg(F.round(F.avg("psnr"), 3).alias("psnr"), F.count("*").alias("n"))


def target_summary(table: DataFrame) -> DataFrame:
    """Targets of each baseline, and the share that has a near copy among the sample's inputs."""
    return table.groupBy("baseline").agg(
        F.count("*").alias("n_targets"),
        F.round(F.avg(F.col("input_has_duplicate").cast("int")), 3).alias("targets_with_duplicate_input"),
    )


def compare(table: DataFrame, other: DataFrame) -> DataFrame:
    """Per baseline against another method's scores of the same targets."""
    matched = table.join(
        other.select("sample", "view", "file_key", F.col("psnr").alias("other_psnr")), ["sample", "view", "file_key"]
    )
    return matched.groupBy("baseline").agg(
        F.count("*").alias("matched_targets"),
        F.round(F.avg("psnr"), 3).alias("retrieval_psnr"),
        F.round(F.avg("other_psnr"), 3).alias("other_psnr"),
        F.round(F.avg((F.col("psnr") > F.col("other_psnr")).cast("int")), 3).alias("retrieval_beats_other"),
    )
