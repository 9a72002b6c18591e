"""Nearest views by date and pose against plain loops over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import search

SIDE = "date double, cx double, cy double, cz double, dx double, dy double, dz double"


def views(n, seed, scenes=3, spread=1.0, dates=12):
    """Scenes of very different sizes, a dense spot, outliers, copies, and ties of date."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        scene = 0 if scenes == 1 or r.random() < 0.7 else r.randrange(1, scenes)
        c = [r.gauss(0, spread) for _ in range(3)]
        if r.random() < 0.3:
            c = [5 + r.gauss(0, 1e-4) for _ in range(3)]
        if r.random() < 0.03:
            c = [x * 1000 for x in c]
        d = [r.gauss(0, 1) for _ in range(3)]
        size = math.sqrt(sum(x * x for x in d))
        row = (scene, i, 1900.0 + r.randrange(dates) * 0.5, *c, *[x / size for x in d], 1.5 + scene, i % 3)
        out.append(row)
        if r.random() < 0.2:
            out.append((scene, i + 100_000, *row[2:]))
    return out


def frames(spark, targets, cands):
    make = lambda rows, role: spark.createDataFrame(
        rows, f"scene_id int, {role} long, {', '.join(f'{role}_{c}' for c in SIDE.split(', '))}, scale double, {role}_group int"
    )
    return make(targets, "target"), make(cands, "cand")


def pairs(targets, cands, digits=None):
    """target -> [(gap, pose, cand, group)] of its scene."""
    out = {}
    for t in targets:
        out[t[1]] = []
        for c in cands:
            if c[0] != t[0]:
                continue
            apart = math.sqrt(sum((a - b) ** 2 for a, b in zip(t[3:6], c[3:6], strict=True))) / t[9]
            cosine = sum(a * b for a, b in zip(t[6:9], c[6:9], strict=True))
            pose = apart + math.acos(max(-1.0, min(1.0, cosine))) / math.pi
            out[t[1]].append((abs(c[2] - t[2]), pose if digits is None else round(pose, digits), c[1], c[10]))
    return {t: p for t, p in out.items() if p}


@pytest.mark.parametrize("seed", [1, 2])
def test_strategies_equal_all_pairs(spark, seed):
    cands = views(400, seed)
    targets = [(r[0], 900_000 + i, *r[2:]) for i, r in enumerate(views(60, seed + 50))] + [(7, 5, *views(1, 3)[0][2:])]
    t, c = frames(spark, targets, cands)
    all_pairs = pairs(targets, cands, 6)

    def shortlist(p):
        return min(enumerate(sorted(p, key=lambda x: (x[0], x[2]))[:5]), key=lambda x: (x[1][1], x[0]))[1]

    want = {
        "date": {k: min(p, key=lambda x: x[:3])[2] for k, p in all_pairs.items()},
        "pose": {k: min(p, key=lambda x: (x[1], x[0], x[2]))[2] for k, p in all_pairs.items()},
        "date_then_pose": {k: shortlist(p)[2] for k, p in all_pairs.items()},
    }
    for strategy, chosen in want.items():
        got = search.nearest(t, c, strategy, ["scene_id"], ["target"], 5, digits=6).collect()
        assert {r.target: r.cand for r in got} == chosen and len(got) == len(chosen), strategy


def test_shortlist_of_allowed_candidates_widens(spark):
    """Most near candidates are not allowed: the shortlist still holds the first k that are."""
    cands = [(0, i, 1900.0 + i // 40, *views(1, i)[0][3:10], i % 20) for i in range(600)] + [(1, 7000, 1950.0, *views(1, 1)[0][3:10], 3)]
    targets = [(0, 10_000 + i, 1900.0 + i, *views(1, i)[0][3:10], i) for i in range(6)] + [(1, 20_000, 1900.0, *views(1, 1)[0][3:10], 1)]
    t, c = frames(spark, targets, cands)
    t = t.withColumn("only", F.col("target_group"))
    got = search.nearest_by_date(t, c.drop("scale"), 4, ["scene_id"], ["target"], F.col("cand_group") == F.col("only")).collect()
    for target in targets:
        near = sorted((abs(x[2] - target[2]), x[1]) for x in cands if x[0] == target[0] and x[10] == target[10])[:4]
        assert sorted((r.nth, r.gap, r.cand) for r in got if r.target == target[1]) == [(i + 1, g, n) for i, (g, n) in enumerate(near)]


def test_rows_made_are_about_k_for_a_target_and_side(spark):
    cands, targets = views(3000, 5, 1), [(0, 10**6 + i, *r[2:]) for i, r in enumerate(views(20, 6, 1))]
    t, c = frames(spark, targets, cands)
    assert search._asked(t, c.drop("scale"), 7, ["scene_id"]).count() <= 2 * 7 * len(targets)


def test_rows_without_a_pose_and_empty_tables(spark):
    cands, targets = views(30, 1, 1), [(0, 10**6 + i, *r[2:]) for i, r in enumerate(views(4, 2, 1))]
    t, c = frames(spark, targets + [(0, 77, 1900.0, None, 0.0, 0.0, 1.0, 0.0, 0.0, 1.5, 0)], cands + [(0, 78, 1900.0, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0, 1.5, 0)])
    got = {r.target for r in search.nearest(t, c, "pose", ["scene_id"], ["target"]).collect()}
    assert got == {x[1] for x in targets}
    assert search.nearest(t, c.limit(0), "pose", ["scene_id"], ["target"]).count() == 0
    assert search.nearest(t.limit(0), c, "date", ["scene_id"], ["target"]).count() == 0
    with pytest.raises(ValueError):
        search.nearest(t, c, "other", ["scene_id"], ["target"])


def test_an_epoch_is_covered_by_its_shards_and_resumed(spark):
    from tempora.operators import retrieval

    r = random.Random(3)
    rows = [(i % 5, i, 1950.0 + r.random() * 3 if i % 5 else 2000.0 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "scene_id long, row_id long, date double")
    whole = set(map(tuple, retrieval.epoch_samples(df, 30, epoch=2).collect()))
    assert {x[0] for x in whole} == set(range(30)) and len(whole) == 30 * 8 and 0 not in {x[1] for x in whole}
    shards = [set(map(tuple, retrieval.epoch_samples(df, 30, epoch=2, shard=s, shards=3).collect())) for s in range(3)]
    assert set.union(*shards) == whole and sum(map(len, shards)) == len(whole)
    later = set(map(tuple, retrieval.epoch_samples(df.repartition(5), 30, epoch=2, start=11).collect()))
    assert later == {x for x in whole if x[0] >= 11}
    assert set(map(tuple, retrieval.epoch_samples(df, 30, epoch=3).collect())) != whole
    for n in (1, 2, 7, 60, 1000):
        a, b = retrieval.affine(n, 4, 9)
        assert {(a * i + b) % n for i in range(n)} == set(range(n))
    with pytest.raises(ValueError):
        retrieval.epoch_samples(df, 30, shard=3, shards=3)


def test_sampled_years_stay_inside_and_do_not_depend_on_partitions(spark):
    from tempora.dating import years

    df = spark.range(2000).select("id", F.struct((1900 + F.col("id") % 5).alias("start"), F.lit(1909).alias("end")).alias("e"))
    drawn = lambda d, k: {r.id: r.y for r in d.select("id", years.sample_year(F.col("e"), F.col("id").cast("string"), k, 7).alias("y")).collect()}
    a, b = drawn(df, 0), drawn(df.repartition(9), 0)
    assert a == b and drawn(df, 1) != a and all(1900 + i % 5 <= y <= 1910 for i, y in a.items())
    share = [(y - 1900 - i % 5) / (10 - i % 5) for i, y in a.items()]
    assert abs(sum(share) / 2000 - 0.5) < 0.03 and min(share) < 0.01 and max(share) > 0.99
    none = df.select(years.sample_year(F.col("e"), F.lit(None).cast("string")).alias("y"))
    assert none.where("y is not null").count() == 0
