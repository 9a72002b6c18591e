"""Census, components, bands, splits, retrieval, ranks and registration."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.functions import geometry as geo
from tempora.functions import images
from tempora.operators import census, neardup, posing, retrieval
from tempora.operators.components import connected_components
from tempora.operators.nearest import knn_cosine
from tempora.plans import ranking
from tempora.plans.ranking import rank_by_hash, row_numbers


def test_eras(spark):
    rows = [(1850.5, 1.0, "pre-1900"), (1922.0, 10.0, "1900-1944"), (1960.0, 22.0, "1945-1969"), (2015.5, 0.01, "2000+"),
            (None, None, "undated"), (1885.0, 119.0, "undated"), (float("nan"), 1.0, "undated"), (1970.0, 30.0, "1970-1999")]
    df = spark.createDataFrame(rows, "m double, w double, want string")
    assert df.where(census.assign_era(F.col("m"), F.col("w")) != F.col("want")).count() == 0


def test_era_counts_are_distinct_and_filled(spark):
    df = spark.createDataFrame([(1, "a", "pre-1900"), (1, "a", "pre-1900"), (1, "b", "2000+"), (None, "c", "2000+")], "scene_id int, file_key string, era string")
    r = census.era_counts(df, ["scene_id"]).collect()
    assert len(r) == 1 and (r[0]["pre-1900"], r[0]["2000+"], r[0]["pre-1970"], r[0]["undated"]) == (1, 1, 1, 0)


def test_gate(spark):
    schema = "best_model int, `best_model_pre-1970` int, `best_model_2000+` int, `photo_pre-1970` int, `photo_2000+` int"
    df = spark.createDataFrame([(0, 12, 40, 30, 100), (None, 0, 0, 15, 50), (None, None, None, 1, 1)], schema)
    got = {(r.gate_posed, r.gate_any) for r in census.passes_gate(df).collect()}
    assert got == {(True, True), (False, True), (False, False)}


def test_scene_table_first_tie_and_missing_model(spark):
    index = spark.createDataFrame([("A", "A", "x"), ("A", "A_old", "x"), ("A", "A", "y"), ("B", "B", "z"), ("C", "C", "w")], "cat string, subcat string, file_key string")
    cats = spark.createDataFrame([("A", 5), ("B", 9), ("C", 11)], "scene string, scene_id int")
    recon = spark.createDataFrame([(5, 0, 4), (5, 1, 30), (5, 2, 30), (9, 0, 12)], "scene_id int, model int, n_images long")
    got = {r.scene: r for r in census.scene_table(index, cats, recon).collect()}
    assert (got["A"].n_paths, got["A"].n_files, got["A"].largest_model, got["A"].largest_model_images) == (3, 2, 1, 30)
    assert got["C"].n_models == 0 and got["C"].largest_model is None
    assert [r.name for r in census.unknown_scenes(census.scene_table(index, cats, recon), ["A", "9", "Z"]).collect()] == ["Z"]


def test_size_compare(spark):
    rows = [(1024, 768, 1024, 768, "match"), (512, 384, 1024, 768, "scaled"), (768, 1024, 1024, 768, "rotated"), (1000, 1000, 1024, 768, "mismatch")]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, want string")
    assert df.where(census.compare_size(*[F.col(x) for x in "abcd"]) != F.col("want")).count() == 0


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["chain", "random", "hub", "none"])
def test_components(spark, shape):
    r = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(60)] + [(100, 99)],
        "random": [(r.randrange(200), r.randrange(200)) for _ in range(150)],
        "hub": [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(50)],
        "none": [],
    }[shape]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "u long, v long")
    got = {x.node: x.component for x in connected_components(df).collect()}
    assert got == {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}


def test_band_join_finds_the_plain_pairs(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(3), r.uniform(-2, 2), r.choice([0.0, 0.5, 1.0, 1.5])) for i in range(250)]
    df = spark.createDataFrame(rows, "id long, g int, x double, y double")
    got = {tuple(p) for p in neardup.band_join(df, "id", {"x": 0.1, "y": 0.5}, ("g",)).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 0.1 and abs(a[3] - b[3]) <= 0.5}
    assert got == want and want


def views(spark, rows):
    """(date, angle on a ring, radius) to camera columns."""
    out = []
    for i, (date, angle, radius) in enumerate(rows):
        c = (radius * math.cos(angle), radius * math.sin(angle), 0.0)
        out.append((i, f"f{i}", date, *c, math.cos(angle), math.sin(angle), 0.0, radius))
    return spark.createDataFrame(out, "row_id long, file_key string, date double, cx double, cy double, cz double, dx double, dy double, dz double, scale double")


def test_near_duplicates_are_transitive_and_inclusive(spark):
    rows = [(2015.0, 0.0, 10.0), (1900.0, 1.0, 10.0), (None, 0.0, 10.0), (2015.05, 0.01, 10.0), (2015.1, 0.02, 10.0), (2015.0, 0.0, 10.0), (None, 0.0, 10.0)]
    got = {r.row_id: r.group_id for r in neardup.near_duplicate_groups(views(spark, rows)).collect()}
    assert got[0] == got[3] == got[4] == got[5] == 0
    assert len({got[1], got[2], got[6], got[0]}) == 4
    numbered = {r.row_id: r.group_id for r in neardup.number_groups(neardup.near_duplicate_groups(views(spark, rows))).collect()}
    assert [numbered[i] for i in range(7)] == [0, 1, 2, 0, 0, 0, 3]


def test_splits(spark):
    rows = [(f"m{i}", i, "2000+") for i in range(300)] + [(f"o{i}", 1000 + i, "pre-1900") for i in range(30)] + [(f"t{i}", 2000 + i, "1970-1999") for i in range(3)]
    df = spark.createDataFrame(rows, "file_key string, group_id long, era string")
    got = df.join(neardup.assign_splits(df).drop("group_id"), "file_key")
    n = {(r.era, r.split): r["count"] for r in got.groupBy("era", "split").count().collect()}
    assert n[("2000+", "test")] == n[("2000+", "val")] == 30 and n[("pre-1900", "test")] == n[("pre-1900", "val")] == 3
    assert n[("1970-1999", "train")] == 3
    assert neardup.leaks(neardup.assign_splits(df)).count() == 0
    again = neardup.assign_splits(df.repartition(7).orderBy(F.rand(1)))
    assert again.exceptAll(neardup.assign_splits(df)).count() == 0
    bare = neardup.assign_splits(df.drop("era")).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in bare} == {"test": 33, "val": 33, "train": 267}


@pytest.mark.parametrize("n, t, v", [(4, 1, 1), (5, 3, 3), (5, 2, 4), (6, 4, 2), (4, 3, 3), (9, 8, 1)])
def test_shrink_closed_form(spark, n, t, v):
    a, b = t, v
    while a + b > n - 1:
        if b >= a and b > 0:
            b -= 1
        else:
            a -= 1
    x = neardup._shrink(F.lit(n), F.lit(t), F.lit(v))
    r = spark.range(1).select(x[0].alias("t"), x[1].alias("v")).first()
    assert (r.t, r.v) == (a, b)


def test_ranks(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("p"), F.xxhash64("id").bitwiseAND(F.lit((1 << 48) - 1)).alias("h"))
    rows = rank_by_hash(df, ["p"], "h", ["id"]).collect()
    for p in range(3):
        mine = sorted((r for r in rows if r.p == p), key=lambda r: (r.h, r.id))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and {r.total for r in mine} == {len(mine)}
    numbered = row_numbers(df, "h").orderBy("h").collect()
    assert [r.row for r in numbered] == list(range(500))


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    vec = rng.normal(size=(120, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<float>")
    got = {(r.query, r["rank"]): r.id for r in knn_cosine(df, df.where("id % 20 = 0"), 4, 30, 2).collect()}
    unit = vec.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    for q in range(0, 120, 20):
        order = [i for i in np.lexsort((np.arange(120), -score[q])) if i != q][:4]
        assert [got[(q, k + 1)] for k in range(4)] == order


def test_retrieve_ties(spark):
    pairs = [(0, 1, 2.0, 0.5), (0, 2, 2.0, 0.1), (0, 3, 5.0, 0.0), (0, 4, 9.0, 0.0)]
    df = spark.createDataFrame(pairs, "target long, cand long, gap double, pose double")
    pick = lambda s, k=20: retrieval.retrieve(df, s, ["target"], k).first().cand
    assert pick("date") == 2 and pick("pose") == 3 and pick("date_then_pose", 2) == 2 and pick("date_then_pose", 3) == 3
    with pytest.raises(ValueError):
        pick("other")


def test_gap_buckets(spark):
    want = {0.0: "<2y", 1.9: "<2y", 2.0: "2-10y", 9.9: "2-10y", 10.0: "10-50y", 49.9: "10-50y", 50.0: ">50y", 400.0: ">50y"}
    df = spark.createDataFrame([(k,) for k in want], "g double")
    assert {r.g: r.b for r in df.select("g", retrieval.gap_bucket(F.col("g")).alias("b")).collect()} == want


def test_samples_and_pool_exclusions(spark):
    rows = [(1, i, f"f{i}", 2000.0 + (i % 10) / 100, float(i), 0.0, 0.0, 1.0, 0.0, 0.0, i // 2) for i in range(20)]
    df = spark.createDataFrame(rows, "scene_id long, row_id long, file_key string, date double, cx double, cy double, cz double, dx double, dy double, dz double, group_id long")
    s = retrieval.draw_samples(df, 3)
    assert s.count() == 24 and s.exceptAll(retrieval.draw_samples(df.orderBy(F.rand(2)), 3)).count() == 0
    targets = {(r["sample"], r.row_id // 2) for r in s.where("role = 'target'").collect()}
    drawn = retrieval.baseline_targets(s, df, geo.scene_scale(df, ["scene_id"]))
    pool = retrieval.from_pool(drawn, df, "date_then_pose", 3).collect()
    assert pool and not any((r["sample"], r.cand // 2) in targets for r in pool)
    out = retrieval.run_baselines(s, df, geo.scene_scale(df, ["scene_id"]))
    assert out.groupBy("baseline").count().where("count <> 15").count() == 0


def test_eligible_anchors_match_the_dense_form(spark):
    r = random.Random(5)
    dates = [r.uniform(1980, 2000) for _ in range(80)]
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate(dates)], "scene_id long, row_id long, date double")
    got = {x.row_id for x in retrieval.eligible_anchors(df).collect()}
    assert got == {i for i, d in enumerate(dates) if sum(abs(d - e) <= (1.0 if d >= 1990 else 5.0) for e in dates) >= 5}


def test_geometry_round_trip(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, rng.normal(size=7))) for _ in range(40)] + [(0.0, 1.0, 0.0, 0.0, 1.0, 2.0, 3.0), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    r = geo.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    df = df.withColumn("r", r).withColumn("q", geo.quaternion(F.col("r")))
    df = df.withColumn("m", geo.camera_to_world(F.col("r"), F.col("tx"), F.col("ty"), F.col("tz")))
    df = df.withColumn("e", geo.rotation_error_deg(F.col("r"), F.col("r")))
    for x in df.collect():
        q = np.array([x.qw, x.qx, x.qy, x.qz])
        q /= np.linalg.norm(q)
        rot = np.array(x.r).reshape(3, 3)
        assert np.allclose(rot @ rot.T, np.eye(3)) and np.isclose(np.linalg.det(rot), 1)
        assert np.allclose(abs(np.dot(q, x.q)), 1) and x.q[0] >= 0
        c2w = np.array(x.m).reshape(4, 4)
        w2c = np.eye(4)
        w2c[:3, :3], w2c[:3, 3] = rot, (x.tx, x.ty, x.tz)
        assert np.allclose(c2w @ w2c, np.eye(4)) and x.e == pytest.approx(0, abs=1e-5)


def test_resize_and_crop_rounds_half_to_even(spark):
    df = spark.createDataFrame([(800, 600), (601, 401), (5, 2)], "w int, h int")
    for r in df.select("w", "h", geo.resize_and_crop(F.col("w"), F.col("h"), 3).alias("p")).collect():
        scale = 3 / min(r.w, r.h)
        assert (r.p.left, r.p.top) == ((round(r.w * scale) - 3) // 2, (round(r.h * scale) - 3) // 2)


def test_image_metrics(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(-0.8, 0.8, (3, 16, 16))
    fade = np.clip(a * 0.5 + 0.2, -1, 1)
    df = spark.createDataFrame([(a.ravel().tolist(), a.ravel().tolist()), (a.ravel().tolist(), (a + 0.2).ravel().tolist()), (a.ravel().tolist(), fade.ravel().tolist())], "p array<double>, t array<double>")
    m = images.metrics(3)
    got = df.select(images.psnr(F.col("p"), F.col("t")).alias("psnr"), m("p", "t").alias("m")).collect()
    assert got[0].psnr == pytest.approx(100) and got[0].m.ssim == pytest.approx(1)
    assert got[1].psnr == pytest.approx(20, abs=1e-6)
    assert got[2].m.cc_psnr > 60
    with pytest.raises(Exception, match="shapes"):
        df.select(images.psnr(F.col("p"), F.array(F.lit(1.0)))).collect()


def cameras(n, rng):
    out = []
    for _ in range(n):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = q * np.sign(np.linalg.det(q)), rng.normal(size=3)
        out.append(m)
    return np.array(out)


def test_alignments_survive_outliers():
    rng = np.random.default_rng(1)
    true = cameras(40, rng)
    turn = cameras(1, rng)[0][:3, :3]
    pred = true.copy()
    pred[:, :3, :3] = turn @ true[:, :3, :3]
    pred[:, :3, 3] = 0.4 * true[:, :3, 3] @ turn.T + 3
    pred[:4, :3, 3] += 50
    for (scale, r, t), inside in (
        posing.rotation_first(pred, true, np.random.default_rng(0)),
        posing.robust_similarity(pred[:, :3, 3], true[:, :3, 3], np.random.default_rng(0)),
    ):
        assert inside.sum() == 36 and scale == pytest.approx(2.5)
        assert np.allclose(scale * pred[4:, :3, 3] @ r.T + t, true[4:, :3, 3])
    with pytest.raises(ValueError):
        posing.robust_similarity(np.zeros((2, 3)), np.zeros((2, 3)), rng)


def test_registered_queries_are_where_they_should_be(spark, small):
    """Cameras of the embeddings, posed from predictions in another frame, come back to their own."""
    from tempora.queries import vision

    rows = vision._posed(spark, small)
    own = lambda name, df=rows: df.select("scene_id", "image", F.col("camera").alias(name))
    scales = geo.scene_scale(rows.where("anchor"), ["scene_id"])
    images = rows.select("scene_id", "image", "anchor", *retrieval.POSE)
    placed, log = posing.register(images, own("known", rows.where("anchor")), vision._shifted, scales, inputs=own("camera"), repeats=2)
    true = {r.image: r.camera for r in rows.where("not anchor").collect()}
    got = placed.collect()
    assert {r.image for r in got} == set(true) and got
    for r in got:
        assert np.allclose(r.c2w, true[r.image], atol=1e-6) and r.n_batches == 2 and r.rot_spread_deg < 1e-3
    assert all(r.used for r in log.collect())
    judged = vision.register_images(spark, small).collect()
    assert len(judged) == len(got) and all(r.placed and r.right_turn and r.right_place for r in judged)


def test_queries_that_no_batch_places_stay(spark):
    """Scene 0 has anchors that agree, scene 1 has scattered ones, scene 2 too few, scene 3 none."""
    rng = np.random.default_rng(5)
    rows, known, seen = [], [], {}
    for scene, n in enumerate((12, 12, 2, 0)):
        scattered = cameras(n + 3, rng)
        for i, m in enumerate(cameras(n + 3, rng)):
            anchor = i >= 3
            seen[100 * scene + i] = (scattered[i] if scene == 1 else m).ravel().tolist()
            rows.append((scene, 100 * scene + i, anchor, *m[:3, 3].tolist(), *m[:3, 2].tolist()))
            if anchor:
                known.append((scene, 100 * scene + i, m.ravel().tolist()))
    images = spark.createDataFrame(rows, "scene_id long, image long, anchor boolean, " + ", ".join(f"{c} double" for c in ("cx", "cy", "cz", "dx", "dy", "dz")))
    predict = lambda pdf: pdf.assign(pred=[seen[k] for k in pdf["image"]], focal=500.0)
    scales = spark.createDataFrame([(s, 1.0) for s in range(3)], "scene_id long, scale double")
    placed, log = posing.register(images, spark.createDataFrame(known, "scene_id long, image long, known array<double>"), predict, scales, queries=2)
    got = {(r.scene_id, r.image): r for r in placed.collect()}
    assert set(got) == {(s, 100 * s + i) for s in range(4) for i in range(3)}
    for (scene, _), r in got.items():
        assert r.n_batches == (3 if scene == 0 else 0)
        assert (r.c2w is None, r.focal is None, r.center_spread is None) == (scene > 0,) * 3
    log = log.collect()
    assert {(r.scene_id, r.n_anchors, r.used) for r in log} == {(0, 12, True), (1, 12, False), (2, 2, False)}
    assert len(log) == 18 and sum(r.n_queries for r in log) == 27
    assert all(r.n_inliers == 12 and r.anchor_rot_err_median < 1e-3 for r in log if r.used)


def test_error_summary(spark):
    df = spark.createDataFrame([(1.0, 0.1), (7.0, 0.2), (None, None)], "rot_err_deg double, center_err double")
    r = posing.summarize_errors(df).first()
    assert (r.n_queries, round(r.placed, 3), r.rot_err_median_deg, round(r.within_5deg, 3), round(r.within_10deg, 3)) == (3, 0.667, 4.0, 0.333, 0.667)


def test_errors_of_registered_queries(spark):
    rng = np.random.default_rng(2)
    true, c, h = cameras(2, rng), np.cos(np.radians(6)), np.sin(np.radians(6))
    turned = true[0].copy()
    turned[:3, :3] = true[0][:3, :3] @ np.array([[c, -h, 0], [h, c, 0], [0, 0, 1]])
    turned[:3, 3] += [0, 3, 4]
    flat = lambda m: m.ravel().tolist()
    placed = spark.createDataFrame([(0, 1, flat(turned)), (0, 2, None)], "scene_id long, image long, c2w array<double>")
    truth = spark.createDataFrame([(0, i + 1, flat(m)) for i, m in enumerate(true)], "scene_id long, image long, true array<double>")
    scales = spark.createDataFrame([(0, 10.0)], "scene_id long, scale double")
    got = posing.evaluate(placed, truth, scales)
    r = {x.image: x for x in got.collect()}
    assert r[1].rot_err_deg == pytest.approx(6, abs=1e-4) and r[1].center_err == pytest.approx(0.5)
    assert (r[2].rot_err_deg, r[2].center_err) == (None, None)
    s = posing.summarize_errors(got).first()
    assert (s.n_queries, s.placed, s.within_5deg, s.within_10deg) == (2, 0.5, 0.0, 0.5)
    log = spark.createDataFrame([(8, True), (6, True), (1, False)], "n_inliers int, used boolean")
    assert posing.summarize_log(log).first() == (3, 2, 6.0)


def _check_similar(rows, vec, is_anchor, queries, anchors, repeats, seed=0):
    """Each query in `repeats` batches, no group larger than a batch, the first turn with the top anchors, others part of the top twice as many."""
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    known, asked = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
    plan = pd.DataFrame(rows, columns=["scene_id", "batch", "image", "anchor"])
    members = plan[~plan["anchor"]]
    assert (members.groupby("image").size() == repeats).all() and set(members["image"]) == set(asked) and not plan.duplicated(["batch", "image"]).any()
    assert (members.assign(turn=members["batch"] % repeats).groupby(["turn", "image"]).size() == 1).all()
    for b, got in plan.groupby("batch"):
        group, drawn = got.loc[~got["anchor"], "image"].to_numpy(), got.loc[got["anchor"], "image"].tolist()
        assert 1 <= len(group) <= queries and b // repeats in group
        score = np.round(unit[group] @ unit[known].T, 6).max(axis=0)
        top = known[np.lexsort((known, -score))].tolist()
        assert set(drawn) == set(top[:anchors]) if b % repeats == 0 else len(set(drawn)) == min(anchors, len(known)) and set(drawn) <= set(top[: 2 * anchors])
    return members


def test_similar_batches(spark):
    rng = np.random.default_rng(7)
    vec = rng.normal(size=(260, 8)).astype(np.float32).astype(float)
    anchor = np.arange(260) >= 140
    images = spark.createDataFrame([(5, i, bool(anchor[i]), vec[i].tolist()) for i in range(260)], "scene_id long, image long, anchor boolean, vec array<float>")
    for small in (2_000, 20):  # in one task, and by rounds
        rows = posing.plan_similar(images, queries=4, anchors=6, repeats=3, small=small).collect()
        members = _check_similar(rows, vec, anchor, 4, 6, 3)
        assert members["batch"].nunique() <= 3 * 140 // 2
    again = posing.plan_similar(images.repartition(7), queries=4, anchors=6, repeats=3, small=20)
    assert set(map(tuple, again.collect())) == set(map(tuple, rows))
    assert posing.plan_similar(images.where("not anchor")).count() == 0
    few = posing.plan_similar(images.where("image < 3 or image > 255"), queries=4, anchors=6, repeats=2).collect()
    assert len({r.batch for r in few}) == 2 and len(few) == 2 * (3 + 4)


def test_similar_batches_query(spark, small):
    """The registered query, scene by scene, against its invariants."""
    from tempora.catalog import QUERIES

    rows = [tuple(r) for r in QUERIES["similar_batches"](spark, small).select("scene_id", "batch", "image", "anchor").collect()]
    vec = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, v = vec["vec_id"].to_numpy(), np.array(vec["embedding"].tolist(), float)
    assert len({r[:3] for r in rows}) == len(rows) and {r[0] for r in rows} == {0, 2}  # every tenth view is in these
    for scene in (0, 2):
        own = np.flatnonzero(ids % 4 == scene)
        place = {int(ids[i]): n for n, i in enumerate(own)}
        mine = [(s, 3 * place[b // 3] + b % 3, place[i], a) for s, b, i, a in rows if s == scene]
        _check_similar(mine, v[own], ids[own] % 10 != 0, 8, 24, 3)


def test_similar_batches_do_not_mix_clusters(spark):
    rng = np.random.default_rng(3)
    side = np.arange(120) % 2
    vec = np.eye(4)[side] * 10 + rng.normal(size=(120, 4))
    images = spark.createDataFrame([(1, i, i >= 60, vec[i].tolist()) for i in range(120)], "scene_id long, image long, anchor boolean, vec array<float>")
    for small in (2_000, 8):
        plan = pd.DataFrame(posing.plan_similar(images, queries=6, anchors=5, repeats=2, small=small).collect(), columns=["scene_id", "batch", "image", "anchor"])
        assert (plan.assign(side=plan["image"] % 2).groupby("batch")["side"].nunique() == 1).mean() > 0.9


def test_nearest_modern_views(spark):
    from tempora.operators.nearest import nearest_modern_views

    rng = np.random.default_rng(3)
    rows = [(s, 100 * s + i, 1990.0 + i, *rng.normal(size=6).tolist()) for s in (1, 2) for i in range(40)]
    names = ("cx", "cy", "cz", "dx", "dy", "dz")
    views = spark.createDataFrame(rows, "scene_id long, row_id long, date double, " + ", ".join(f"{c} double" for c in names))
    asked = spark.createDataFrame([(1, 115), (2, 239)], "scene_id long, row_id long")
    got = nearest_modern_views(views, asked, 5).orderBy("query", "rank").collect()
    for scene, query in ((1, 115), (2, 239)):
        ids = np.array([r[1] for r in rows if r[0] == scene and r[2] >= 2000])
        f = np.array([r[3:] for r in rows if r[0] == scene and r[2] >= 2000])
        f[:, :3] /= np.median(np.linalg.norm(f[:, :3] - np.median(f[:, :3], axis=0), axis=1))
        order = np.argsort(np.linalg.norm(f - f[ids == query], axis=1))[:5]
        assert [r.row_id for r in got if r.query == query] == ids[order].tolist()


@pytest.mark.parametrize("k", [3, 12])
def test_nearest_modern_views_by_cells(spark, monkeypatch, k):
    """Clusters, lone views, copies and ties of rounded distances, with cells of a few views, against all pairs."""
    from tempora.operators import nearest

    monkeypatch.setattr(nearest, "CELL_ROWS", 2)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 50)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(5)
    f = rng.normal(size=(400, 6)) * np.repeat([0.02, 1.0, 30.0, 0.0], 100)[:, None] + np.repeat(rng.normal(size=(4, 6)), 100, axis=0)
    f[150:200] = f[100:150] + rng.normal(size=(50, 6)) * 1e-8
    rows = [(1, i, 2001.0, *v) for i, v in enumerate(f.tolist())] + [(1, 1000, 2001.0, None, *f[0, 1:].tolist()), (2, 2000, 2001.0, *f[0].tolist())]
    views = spark.createDataFrame(rows, "scene_id long, row_id long, date double, " + ", ".join(f"{c} double" for c in ("cx", "cy", "cz", "dx", "dy", "dz")))
    asked = [*range(0, 400, 7), 1000, 2000]
    got = nearest.nearest_modern_views(views, views.where(F.col("row_id").isin(asked)).select("scene_id", "row_id"), k)
    got = {(r.query, r["rank"]): (r.row_id, r.dist) for r in got.collect()}
    x = f.copy()
    with_null = np.concatenate([f[:, 0]]), np.concatenate([f[:, 1], f[:1, 1]]), np.concatenate([f[:, 2], f[:1, 2]])
    mid = np.array([np.median(c) for c in with_null])
    x[:, :3] /= np.median(np.linalg.norm(f[:, :3] - mid, axis=1))
    want = {(2000, 1): (2000, 0.0)}
    for q in asked[:-2]:
        d = np.round(np.linalg.norm(x - x[q], axis=1), 6)
        for n, i in enumerate(sorted(range(400), key=lambda i: (d[i], i != q, i))[:k]):
            want[q, n + 1] = (i, d[i])
    assert set(got) == set(want) and all(got[w][0] == want[w][0] and abs(got[w][1] - want[w][1]) < 2e-6 for w in want)


def test_small_summaries(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "cat string")
    assert [tuple(r) for r in census.largest_groups(rows, ["cat"], 2).collect()] == [("b", 2), ("a", 1)]
    cams = spark.createDataFrame([(1, "PINHOLE", 800), (1, "PINHOLE", 640), (1, "RADIAL", 900), (2, "RADIAL", 5)], "scene_id int, model_name string, width int")
    pics = spark.createDataFrame([(1,)] * 4 + [(2,)], "scene_id int")
    got = {r.scene_id: r for r in census.camera_summary(cams, pics, ["scene_id"]).collect()}
    assert got[1].models == {"PINHOLE": 2, "RADIAL": 1} and (got[1].min_width, got[1].max_width, got[1].shared) == (640, 900, True)
    assert not got[2].shared
    views = spark.createDataFrame([(200, 100, 150, 100), (100, 100, 100, 100)], "image_width int, image_height int, camera_width int, camera_height int")
    assert census.aspect_mismatch(views).first()[0] == 0.5
    t = spark.createDataFrame([("x", True), ("x", False), ("x", False), ("x", None)], "baseline string, input_has_duplicate boolean")
    assert tuple(retrieval.target_summary(t).first()) == ("x", 4, 0.333)


@pytest.mark.parametrize("fraction", [None, 0.7])
def test_samples_equal_the_draws_from_a_sorted_list(spark, fraction):
    """Two scenes with repeated dates, one without anchors, undated views: against plain Python."""
    r = random.Random(8)
    cfg = retrieval.Sampling(old_target_fraction=fraction)
    rows = [(s, 1000 * s + i, r.choice([1950.0, 1952.5, 1968.25, 1989.9, 1990.0, 1990.9, r.uniform(1940, 2020)])) for s in (1, 2) for i in range(90)]
    rows += [(3, 3000 + i, 1900.0 + 20 * i) for i in range(9)] + [(1, 1999, None), (2, 2999, float("nan"))]
    df = spark.createDataFrame(rows, "scene_id long, row_id long, date double")
    number = lambda text: int(hashlib.sha1(text.encode()).hexdigest()[:12], 16)
    want = set()
    for scene in (1, 2):
        order = sorted((d, number(str(i)), i) for s, i, d in rows if s == scene and d is not None and d == d)
        dates = [d for d, _, _ in order]
        tol = lambda d: 1.0 if d >= 1990 else 5.0
        near = [[j for j, e in enumerate(dates) if abs(e - d) <= tol(d)] for d in dates]
        anchors = [p for p in range(len(order)) if len(near[p]) >= 5]
        for i in range(6):
            draw = lambda j, n, i=i: number(f"4:2:{i}:{j}") % n
            pool = anchors
            if fraction is not None and draw(-1, 1 << 48) < fraction * (1 << 48):
                pool = [p for p in anchors if dates[p] < 1970] or anchors
            targets = [pool[draw(0, len(pool))]]
            anchor = targets[0]
            for j in range(1, 5):
                left = [p for p in near[anchor] if p not in targets]
                targets.append(left[draw(j, len(left))])
            inputs = []
            for j in range(3):
                left = [p for p in range(len(order)) if p not in targets + inputs]
                inputs.append(left[draw(5 + j, len(left))])
            want |= {(scene, i, v, "input" if v < 3 else "target", order[p][2]) for v, p in enumerate(inputs + targets)}
    got = [tuple(x) for x in retrieval.draw_samples(df, 6, cfg, seed=4, epoch=2).collect()]
    assert len(got) == len(want) == 96 and set(got) == want
    assert retrieval.draw_samples(df.where("scene_id = 3"), 2).count() == 0 and retrieval.draw_samples(df.limit(0), 2).count() == 0


def test_quantiles_are_exact(spark):
    """Skewed, tied, missing and single values; one group holds most rows; against numpy."""
    rng = np.random.default_rng(11)
    values = {0: rng.lognormal(0, 4, 40_000), 1: np.repeat([1.0, 2.0, 5.0], [9, 1, 10]), 2: np.array([7.5]), 3: np.arange(4.0), 4: np.array([])}
    pdf = pd.DataFrame([(g, float(v), -float(v)) for g, vs in values.items() for v in vs] + [(4, None, None), (1, None, None)], columns=["g", "a", "b"])
    df = spark.createDataFrame(pdf.astype({"a": object, "b": object}).where(pdf.notna(), None), "g long, a double, b double").repartition(7)
    asked = {"low": ("a", 0.05), "mid": ("a", 0.5), "high": ("b", 0.95), "all": ("b", 1.0)}
    got = {r.g: r for r in ranking.quantiles(df, ["g"], asked).collect()}
    assert set(got) == set(values) and got[4].low is None and got[4].high is None
    for g, vs in values.items():
        for name, (c, p) in asked.items():
            if len(vs):
                assert got[g][name] == pytest.approx(np.quantile(vs if c == "a" else -vs, p), rel=1e-12)
    assert ranking.medians(df.limit(0), ["g"], ["a", "b"]).count() == 0


def test_band_groups_equal_the_components_of_the_pairs(spark):
    """A full cell, a chain over cells, equal rows, other groups and missing values."""
    r = random.Random(3)
    rows = [(i, "x", r.uniform(0, 0.1), r.uniform(0, 0.5)) for i in range(300)]
    rows += [(300 + i, "x", 5 + 0.09 * i, 3.0) for i in range(40)] + [(400 + i, "y", 0.05, 0.25) for i in range(50)]
    rows += [(500 + i, r.choice("xyz"), r.uniform(-3, 3), r.uniform(-9, 9)) for i in range(400)]
    rows += [(900, "x", None, 0.1), (901, None, 0.05, 0.1), (902, "x", 0.05, None)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    bands = {"x": 0.1, "y": 0.5}
    want = neardup.groups_from_pairs(df, "id", neardup.band_join(df, "id", bands, ("g",)))
    got = {r.id: r.group_id for r in neardup.band_groups(df, "id", bands, ("g",)).collect()}
    assert got == {r.id: r.group_id for r in want.collect()} and len(got) == len(rows)
    assert got[299] == 0 and got[339] == 300 and got[449] == 400 and got[900] == 900 and got[901] == 901


def test_near_duplicates_stay_within_their_scene(spark):
    rows = [(2015.0, 0.0, 10.0), (2015.0, 0.0, 10.0), (2015.05, 0.01, 10.0), (2015.0, 0.0, 10.0)]
    df = views(spark, rows).drop("scene_id").withColumn("scene_id", F.col("row_id") % 2)
    got = {r.row_id: r.group_id for r in neardup.near_duplicate_groups(df).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1}


def test_nearest_keeps_the_smaller_ids_of_ties(spark):
    vec = lambda i: [1.0, float(i % 3)]
    df = spark.createDataFrame([(i, vec(i)) for i in range(60)], "id long, vec array<double>")
    got = {(r.query, r["rank"]): r.id for r in knn_cosine(df, df.where("id % 20 = 0"), 5, 1000, 1000).collect()}
    for q in (0, 20, 40):
        same = [i for i in range(60) if i % 3 == q % 3 and i != q]
        assert [got[q, k] for k in range(1, 6)] == same[:5]
    assert knn_cosine(df.limit(3), df.limit(1), 5).count() == 2


def test_scenes_are_planned_in_parts_of_bounded_size(spark):
    """Many anchors, many queries for few anchors, no anchors, no queries."""
    sizes = {1: (90, 20), 2: (3, 130), 3: (0, 7), 4: (6, 0)}
    rows = [(s, 1000 * s + i, i < a, *([float(i % 7), float(i % 5), float(i), 0.0, 0.0, 1.0])) for s, (a, q) in sizes.items() for i in range(a + q)]
    df = spark.createDataFrame(rows, "scene_id long, image long, anchor boolean, " + ", ".join(f"{c} double" for c in ("cx", "cy", "cz", "dx", "dy", "dz")))
    dealt = posing.deal_scenes(df, 20)
    assert dealt.groupBy("scene_id", "part", "anchor").count().agg(F.max("count")).first()[0] < 45
    assert dealt.where("scene_id in (1, 2)").select("scene_id", "part").distinct().count() == 5 + 7
    assert dealt.where("not anchor").count() == 157 and dealt.where("anchor and scene_id = 2").count() == 21
    plan = dealt.groupBy("scene_id", "part").applyInPandas(
        lambda pdf: posing.plan_part(pdf, queries=4, anchors=3, repeats=2), "scene_id long, batch int, image long, anchor boolean"
    ).toPandas()
    asked = plan[~plan["anchor"]]
    assert (asked.groupby("image")["batch"].nunique() == 2).all() and asked["image"].nunique() == 150 and set(asked["scene_id"]) == {1, 2}
    known = plan[plan["anchor"]].groupby(["scene_id", "batch"])["image"]
    assert (known.nunique() == known.size()).all() and (known.size() <= 3).all()
    assert (asked.groupby(["scene_id", "batch"]).size() <= 4).all()


def test_band_join_of_a_full_cell_spreads(spark):
    """Distinct values in one cell, and many copies of one value: the right pairs, and many tasks' work."""
    r = random.Random(2)
    values = [(i, 10 + r.random() * 0.9, r.choice((1, 2, None))) for i in range(700)] + [(1000 + i, 50.0, 1) for i in range(40)] + [(2000, None, 1), (2001, float("nan"), 1), (2002, 50.5, 1)]
    df = spark.createDataFrame(values, "k long, x double, e int")
    for equal, same in (((), lambda a, b: True), (("e",), lambda a, b: a is not None and a == b)):
        want = {(a[0], b[0]) for a in values for b in values if a[0] < b[0] and same(a[2], b[2]) and a[1] is not None and b[1] is not None and abs(a[1] - b[1]) <= 0.5}
        got = [tuple(p) for p in neardup.band_join(df, "k", {"x": 0.5}, equal, block=50).collect()]
        assert set(got) == want and len(got) == len(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        hot = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") / 4000.0).alias("x"))
        parts = neardup.band_join(hot, "k", {"x": 1.0}, block=50).groupBy(F.spark_partition_id()).count().collect()
        assert sum(p["count"] for p in parts) == 2000 * 1999 // 2 and max(p["count"] for p in parts) < 500_000
    finally:
        for k in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{k}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
