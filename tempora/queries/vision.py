"""Cameras, embeddings, retrieval, sampling, registration and image metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import geometry as geo
from tempora.functions import images
from tempora.operators import neardup, posing, retrieval, search
from tempora.operators.nearest import knn_cosine
from tempora.plans.materialize import new_path
from tempora.queries.registry import query
from tempora.session import table
from tempora.sources.ply import PlySource

E = "embedding[{}]"
QN = "sqrt(pow(embedding[1], 2) + pow(embedding[2], 2) + pow(embedding[3], 2) + pow(embedding[4], 2))"
QUAT = "(SELECT vec_id, " + ", ".join(
    f"CAST(embedding[{i}] AS DOUBLE) AS {n}" for i, n in ((1, "rw"), (2, "rx"), (3, "ry"), (4, "rz"), (5, "tx"), (6, "ty"), (7, "tz"))
) + " FROM embeddings)"
UNIT = f"(SELECT vec_id, tx, ty, tz, rw / n AS w, rx / n AS x, ry / n AS y, rz / n AS z FROM (SELECT *, sqrt(rw * rw + rx * rx + ry * ry + rz * rz) AS n FROM {QUAT}))"
ROT = f"""(SELECT vec_id, tx, ty, tz, w, x, y, z, 1 - 2 * (y * y + z * z) AS r00, 2 * (x * y - w * z) AS r01, 2 * (x * z + w * y) AS r02,
  2 * (x * y + w * z) AS r10, 1 - 2 * (x * x + z * z) AS r11, 2 * (y * z - w * x) AS r12,
  2 * (x * z - w * y) AS r20, 2 * (y * z + w * x) AS r21, 1 - 2 * (x * x + y * y) AS r22 FROM {UNIT})"""
CAMS = f"""cams AS (SELECT vec_id, vec_id % 4 AS scene_id, -(r00 * tx + r10 * ty + r20 * tz) AS cx, -(r01 * tx + r11 * ty + r21 * tz) AS cy,
  -(r02 * tx + r12 * ty + r22 * tz) AS cz, r20 AS dx, r21 AS dy, r22 AS dz, 1900 + vec_id % 97 + 0.25 AS date FROM {ROT})"""
SCALE = """mid AS (SELECT scene_id, median(cx) AS mx, median(cy) AS my, median(cz) AS mz FROM cams GROUP BY 1),
sc AS (SELECT scene_id, median(sqrt(pow(cx - mx, 2) + pow(cy - my, 2) + pow(cz - mz, 2))) AS scale FROM cams JOIN mid USING (scene_id) GROUP BY 1)"""


def cameras(spark, d) -> DataFrame:
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    e = table(spark, d, "embeddings").select(
        "vec_id", "label", "embedding", (F.col("vec_id") % 4).alias("scene_id"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
        (1900 + F.col("vec_id") % 97 + 0.25).alias("date"),
    )
    return geo.camera_features(e)


@query(
    "quat_geometry",
    f"""
SELECT vec_id, list_transform([r00, r01, r02, r10, r11, r12, r20, r21, r22], lambda v: round(v, 6) + 0.0) AS r,
  round(-(r00 * tx + r10 * ty + r20 * tz), 6) + 0.0 AS cx, round(-(r01 * tx + r11 * ty + r21 * tz), 6) + 0.0 AS cy,
  round(-(r02 * tx + r12 * ty + r22 * tz), 6) + 0.0 AS cz, round(abs(w), 6) AS qw
FROM {ROT}
""",
)
def quat_geometry(spark, d):
    cams = cameras(spark, d)
    r = geo.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    six = lambda c: F.round(c, 6) + 0.0
    return cams.withColumn("r", r).select(
        "vec_id", F.transform("r", six).alias("r"), *[six(F.col(c)).alias(c) for c in ("cx", "cy", "cz")],
        F.round(geo.quaternion(F.col("r"))[0], 6).alias("qw"),
    )


@query("scene_scale", f"WITH {CAMS}, {SCALE} SELECT scene_id, round(scale, 6) AS scale FROM sc")
def scene_scale(spark, d):
    return geo.scene_scale(cameras(spark, d), ["scene_id"]).withColumn("scale", F.round("scale", 6))


@query(
    "pose_distance",
    f"""
WITH {CAMS}, {SCALE}
SELECT a.vec_id, round(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2)) / scale
  + acos(greatest(-1, least(1, a.dx * b.dx + a.dy * b.dy + a.dz * b.dz))) / pi(), 6) AS dist
FROM cams a JOIN cams b ON b.vec_id = a.vec_id + 4 JOIN sc ON sc.scene_id = a.scene_id
""",
)
def pose_distance(spark, d):
    cams = cameras(spark, d)
    other = cams.select((F.col("vec_id") - 4).alias("vec_id"), *[F.col(c).alias(f"o_{c}") for c in retrieval.POSE])
    both = cams.join(other, "vec_id").join(geo.scene_scale(cams, ["scene_id"]), "scene_id")
    a, b = ({c: F.col(p + c) for c in retrieval.POSE} for p in ("", "o_"))
    return both.select("vec_id", F.round(geo.pose_distance(a, b, F.col("scale")), 6).alias("dist"))


@query(
    "rotation_error",
    f"""
WITH r AS {ROT}
SELECT a.vec_id, round(degrees(acos(greatest(-1, least(1, (a.r00 * b.r00 + a.r01 * b.r01 + a.r02 * b.r02 + a.r10 * b.r10 + a.r11 * b.r11
  + a.r12 * b.r12 + a.r20 * b.r20 + a.r21 * b.r21 + a.r22 * b.r22 - 1) / 2)))), 4) AS deg
FROM r a JOIN r b ON b.vec_id = a.vec_id + 1
""",
)
def rotation_error(spark, d):
    r = geo.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    rows = cameras(spark, d).select("vec_id", r.alias("r"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("r").alias("o"))
    return rows.join(other, "vec_id").select("vec_id", F.round(geo.rotation_error_deg(F.col("r"), F.col("o")), 4).alias("deg"))


PAIRS = f"""
WITH {CAMS}, {SCALE},
p AS (SELECT t.vec_id AS target, c.vec_id AS cand, abs(c.date - t.date) AS gap,
  round(sqrt(pow(t.cx - c.cx, 2) + pow(t.cy - c.cy, 2) + pow(t.cz - c.cz, 2)) / scale
  + acos(greatest(-1, least(1, t.dx * c.dx + t.dy * c.dy + t.dz * c.dz))) / pi(), 9) AS pose
  FROM cams t JOIN cams c ON t.scene_id = c.scene_id AND c.vec_id % 20 <> 0 JOIN sc ON sc.scene_id = t.scene_id WHERE t.vec_id % 20 = 0)
"""


def _retrieved(spark, d, strategy):
    """For every twentieth view the one that is chosen of the other views of its scene."""
    cams = cameras(spark, d)
    cams = cams.join(geo.scene_scale(cams, ["scene_id"]), "scene_id")
    side = lambda df, role: df.select("scene_id", "scale", F.col("vec_id").alias(role), F.col("date").alias(f"{role}_date"), *[F.col(c).alias(f"{role}_{c}") for c in retrieval.POSE])
    t, c = side(cams.where("vec_id % 20 = 0"), "target"), side(cams.where("vec_id % 20 <> 0"), "cand")
    return search.nearest(t, c, strategy, ["scene_id"], ["target"], 5, digits=9).select("target", "cand")


@query("retrieval_date", PAIRS + "SELECT target, cand FROM p QUALIFY row_number() OVER (PARTITION BY target ORDER BY gap, pose, cand) = 1")
def retrieval_date(spark, d):
    return _retrieved(spark, d, "date")


@query("retrieval_pose", PAIRS + "SELECT target, cand FROM p QUALIFY row_number() OVER (PARTITION BY target ORDER BY pose, gap, cand) = 1")
def retrieval_pose(spark, d):
    return _retrieved(spark, d, "pose")


@query(
    "retrieval_date_then_pose",
    PAIRS + """, s AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY gap, cand) AS nth FROM p QUALIFY nth <= 5)
SELECT target, cand FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY pose, nth) = 1""",
)
def retrieval_date_then_pose(spark, d):
    return _retrieved(spark, d, "date_then_pose")


@query(
    "embedding_topk",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)
SELECT q.vec_id AS query, r.vec_id AS id, round(list_dot_product(q.e, r.e), 6) AS score,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, r.e), 6) DESC, r.vec_id) AS INTEGER) AS rank
FROM n q JOIN n r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
QUALIFY rank <= 10
""",
)
def embedding_topk(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return knn_cosine(rows, rows.where("id % 20 = 0"), 10)


@query(
    "psnr",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT a.vec_id, round(10 * log10(1 / greatest(list_sum(list_transform(list_zip(a.e, b.e), lambda p: pow((p[1] - p[2]) / 2, 2))) / len(a.e), 1e-10)), 4) AS psnr
FROM v a JOIN v b ON b.vec_id = a.vec_id + a.vec_id % 3
""",
)
def psnr(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = e.withColumn("k", F.col("vec_id") + F.col("vec_id") % 3).join(
        e.select(F.col("vec_id").alias("k"), F.col("a").alias("b")), "k"
    )
    return pairs.select("vec_id", F.round(images.psnr(F.col("a"), F.col("b")), 4).alias("psnr"))


@query(
    "image_metrics",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
px AS (SELECT a.vec_id, i // 8 AS y, i % 8 AS x, a.e[i + 1] AS p, b.e[i + 1] AS t FROM v a JOIN v b ON b.vec_id = a.vec_id + 1, range(64) r(i)),
line AS (SELECT vec_id, covar_pop(p, t) / var_pop(p) AS slope, avg(t) - covar_pop(p, t) / var_pop(p) * avg(p) AS level FROM px GROUP BY 1),
fit AS (SELECT px.*, greatest(-1, least(1, slope * p + level)) AS f FROM px JOIN line USING (vec_id)),
two AS (SELECT vec_id, 'p' AS kind, y, x, (p + 1) / 2 AS a, (t + 1) / 2 AS b FROM fit UNION ALL SELECT vec_id, 'f', y, x, (f + 1) / 2, (t + 1) / 2 FROM fit),
g AS (SELECT d, exp(-0.5 * pow(d / 1.5, 2)) AS g FROM range(-6, 7) r(d)),
w AS (SELECT i, CASE WHEN i + d < 0 THEN -1 - i - d WHEN i + d > 7 THEN 15 - i - d ELSE i + d END AS j, sum(g) / (SELECT sum(g) FROM g) AS w FROM range(8) r(i), g GROUP BY 1, 2),
h AS (SELECT vec_id, kind, y, i AS x, sum(w * a) AS a, sum(w * b) AS b, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM two JOIN w ON j = x GROUP BY 1, 2, 3, 4),
s AS (SELECT vec_id, kind, i AS y, x, sum(w * a) AS a, sum(w * b) AS b, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab FROM h JOIN w ON j = y GROUP BY 1, 2, 3, 4),
m AS (SELECT vec_id, kind, avg((2 * a * b + 1e-4) * (2 * (ab - a * b) + 9e-4) / ((a * a + b * b + 1e-4) * (aa - a * a + bb - b * b + 9e-4))) AS ssim FROM s GROUP BY 1, 2),
n AS (SELECT vec_id, 10 * log10(1 / greatest(avg(pow((f - t) / 2, 2)), 1e-10)) AS cc_psnr FROM fit GROUP BY 1)
SELECT vec_id, round(max(ssim) FILTER (kind = 'p'), 5) AS ssim, round(max(cc_psnr), 4) AS cc_psnr, round(max(ssim) FILTER (kind = 'f'), 5) AS cc_ssim
FROM m JOIN n USING (vec_id) GROUP BY vec_id
""",
)
def image_metrics(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    run = images.metrics(channels=1)
    m = pairs.select("vec_id", run(F.col("embedding"), F.col("b")).alias("m"))
    return m.select("vec_id", *[F.round(f"m.{c}", digits).alias(c) for c, digits in (("ssim", 5), ("cc_psnr", 4), ("cc_ssim", 5))])


def _views(spark, d) -> DataFrame:
    cams = cameras(spark, d)
    return cams.withColumn("row_id", F.col("vec_id")).withColumn("file_key", F.col("vec_id").cast("string"))


def samples_sql(n: int) -> str:
    """SQL of the draws: `drawn` (scene_id, sample, view, role, row_id) from `cams`."""
    draw = lambda j: f"CAST('0x' || substr(sha1('0:0:' || sample || ':{j}'), 1, 12) AS BIGINT)"
    skip = lambda x, got: f"list_reduce(list_prepend(CAST({x} AS BIGINT), list_sort({got})), lambda x, p: x + CAST(x >= p AS BIGINT))"
    steps, last = [], "t0"
    for j in range(1, 5):
        steps.append(f"t{j} AS (SELECT * REPLACE (list_append(t, {skip(f'low + {draw(j)} % (same - {j})', 't')}) AS t) FROM {last})")
        last = f"t{j}"
    for j in range(3):
        steps.append(f"i{j} AS (SELECT * REPLACE (list_append(i, {skip(f'{draw(5 + j)} % (total - {5 + j})', 'list_concat(t, i)')}) AS i) FROM {last})")
        last = f"i{j}"
    span = lambda t: f"(PARTITION BY scene_id ORDER BY date RANGE BETWEEN {t} PRECEDING AND {t} FOLLOWING)"
    by_era = lambda f: f"CASE WHEN date >= 1990 THEN {f} OVER {span(1)} ELSE {f} OVER {span(5)} END"
    return f"""
o AS (SELECT scene_id, vec_id AS row_id, date, row_number() OVER (PARTITION BY scene_id ORDER BY date,
  CAST('0x' || substr(sha1(CAST(vec_id AS VARCHAR)), 1, 12) AS BIGINT), vec_id) - 1 AS place FROM cams),
s AS (SELECT *, {by_era('count(*)')} AS same, {by_era('min(place)')} AS low, count(*) OVER (PARTITION BY scene_id) AS total FROM o),
e AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY place) - 1 AS anchor, count(*) OVER (PARTITION BY scene_id) AS anchors
  FROM s WHERE same >= 5 AND total - 5 >= 3),
t0 AS (SELECT scene_id, sample, low, same, total, [place] AS t, CAST([] AS BIGINT[]) AS i FROM e, range({n}) r(sample) WHERE anchor = {draw(0)} % anchors),
{", ".join(steps)},
picks AS (SELECT scene_id, CAST(sample AS INTEGER) AS sample, unnest(list_concat(i, t)) AS place, unnest(range(8)) AS view FROM {last}),
drawn AS (SELECT p.scene_id, sample, CAST(view AS INTEGER) AS view, CASE WHEN view < 3 THEN 'input' ELSE 'target' END AS role, row_id
  FROM picks p JOIN o ON o.scene_id = p.scene_id AND o.place = p.place)"""


EPOCH = retrieval.affine(60, 0, 0)
APART = """sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2)) / scale
  + acos(greatest(-1, least(1, a.dx * b.dx + a.dy * b.dy + a.dz * b.dz))) / pi()"""


@query(
    "near_duplicate_views",
    f"""
WITH RECURSIVE {CAMS}, {SCALE},
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM cams a JOIN cams b USING (scene_id) JOIN sc USING (scene_id)
  WHERE a.vec_id <> b.vec_id AND abs(a.date - b.date) <= 0.1 AND {APART} <= 0.5),
reach AS (SELECT vec_id AS u, vec_id AS v FROM cams UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u)
SELECT u AS row_id, CAST(u AS VARCHAR) AS file_key, min(v) AS group_id FROM reach GROUP BY u
""",
)
def near_duplicate_views(spark, d):
    views = _views(spark, d)
    return neardup.near_duplicate_groups(views.join(geo.scene_scale(views, ["scene_id"]), "scene_id"), 0.1, 0.5)


@query("sampled_views", f"WITH {CAMS}, {samples_sql(8)} SELECT * FROM drawn")
def sampled_views(spark, d):
    return retrieval.draw_samples(_views(spark, d), 8)


@query(
    "epoch_views",
    f"""
WITH {CAMS}, {samples_sql(15)},
i AS (SELECT index, ({EPOCH[0]} * index + {EPOCH[1]}) % 60 AS p FROM range(7, 60) r(index) WHERE index % 3 = 1)
SELECT index, scene_id, sample, view, role, row_id FROM i JOIN drawn ON scene_id = p % 4 AND sample = p // 4
""",
)
def epoch_views(spark, d):
    """Shard 1 of 3 of an epoch of 60 samples, resumed at its seventh index."""
    return retrieval.epoch_samples(_views(spark, d), 60, start=7, shard=1, shards=3)


@query(
    "retrieval_baselines",
    f"""
WITH {CAMS}, {SCALE}, {samples_sql(8)},
c AS (SELECT t.scene_id, t.sample, t.view, t.row_id AS target, 'inputs' AS pool, i.row_id AS cand FROM drawn t JOIN drawn i
    ON t.scene_id = i.scene_id AND t.sample = i.sample AND t.role = 'target' AND i.role = 'input'
  UNION ALL SELECT t.scene_id, t.sample, t.view, t.row_id, 'all', v.vec_id FROM drawn t JOIN cams v ON t.scene_id = v.scene_id AND t.role = 'target'
    WHERE NOT EXISTS (SELECT 1 FROM drawn x WHERE x.scene_id = t.scene_id AND x.sample = t.sample AND x.role = 'target' AND x.row_id = v.vec_id)),
p AS (SELECT c.*, abs(a.date - b.date) AS gap, {APART} AS pose FROM c JOIN cams a ON a.vec_id = target JOIN cams b ON b.vec_id = cand
  JOIN sc ON sc.scene_id = c.scene_id),
k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, sample, view ORDER BY gap, cand) AS nth FROM p WHERE pool = 'all' QUALIFY nth <= 20),
w AS (
  SELECT 'input_date' AS baseline, * EXCLUDE (pool) FROM p WHERE pool = 'inputs' QUALIFY row_number() OVER (PARTITION BY scene_id, sample, view ORDER BY gap, pose, cand) = 1
  UNION ALL SELECT 'input_pose', * EXCLUDE (pool) FROM p WHERE pool = 'inputs' QUALIFY row_number() OVER (PARTITION BY scene_id, sample, view ORDER BY pose, gap, cand) = 1
  UNION ALL SELECT 'pool_date_pose', * EXCLUDE (pool, nth) FROM k QUALIFY row_number() OVER (PARTITION BY scene_id, sample, view ORDER BY pose, nth) = 1)
SELECT scene_id, sample, view, target, cand, gap, round(pose, 6) AS pose, baseline FROM w
""",
)
def retrieval_baselines(spark, d):
    views = _views(spark, d).withColumn("group_id", F.col("row_id"))
    scales = geo.scene_scale(views, ["scene_id"])
    return retrieval.run_baselines(retrieval.draw_samples(views, 8), views, scales).withColumn("pose", F.round("pose", 6))


TURN, STRETCH = np.array([[0.0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]), 0.5


def _shifted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stand-in predictor: the cameras it is given, turned and scaled into another frame."""
    m = np.array(pdf["camera"].tolist(), float).reshape(-1, 4, 4)
    moved = TURN @ m
    moved[:, :3, 3] = STRETCH * m[:, :3, 3] @ TURN[:3, :3].T + TURN[:3, 3]
    kept = pdf[["scene_id", "batch", "image", "anchor"]]
    return kept.assign(pred=list(moved.reshape(-1, 16)), focal=500.0)


def _posed(spark, d) -> DataFrame:
    """Cameras of the embeddings, nine in ten of them anchors, with their poses and descriptors."""
    cams = cameras(spark, d)
    r = geo.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    pose = geo.camera_to_world(r, F.col("tx"), F.col("ty"), F.col("tz"))
    return cams.select(
        "scene_id", F.col("vec_id").alias("image"), (F.col("vec_id") % 10 != 0).alias("anchor"), pose.alias("camera"),
        *retrieval.POSE, F.col("embedding").alias("vec"),
    )


@query(
    "register_images",
    """
SELECT vec_id % 4 AS scene_id, vec_id AS image, CAST(2 AS INTEGER) AS n_batches, true AS placed, true AS right_turn, true AS right_place, 500.0::DOUBLE AS focal
FROM embeddings WHERE vec_id % 10 = 0
""",
)
def register_images(spark, d):
    """Every tenth view posed against the others, from predictions in another frame, and held against where it is."""
    rows = _posed(spark, d)
    scales = geo.scene_scale(rows.where("anchor"), ["scene_id"])
    own = lambda name, df=rows: df.select("scene_id", "image", F.col("camera").alias(name))
    images = rows.select("scene_id", "image", "anchor", *retrieval.POSE)
    placed = posing.register(images, own("known", rows.where("anchor")), _shifted, scales, inputs=own("camera"), repeats=2)[0]
    judged = posing.evaluate(placed, own("true"), scales)
    return judged.select(
        "scene_id", "image", F.col("n_batches").cast("int").alias("n_batches"), F.col("c2w").isNotNull().alias("placed"),
        (F.col("rot_err_deg") < 0.01).alias("right_turn"), (F.col("center_err") < 0.001).alias("right_place"), "focal",
    )


@query("similar_batches")
def similar_batches(spark, d):
    """Batches of similar views and the anchors most like them, over whole scenes; SQL cannot follow the rounds."""
    return posing.plan_similar(_posed(spark, d).select("scene_id", "image", "anchor", "vec"))


@query(
    "cloud_points",
    """
SELECT CAST(vec_id AS INTEGER) AS id, embedding[1] AS x, embedding[2] AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS SMALLINT) AS label FROM embeddings
""",
)
def cloud_points(spark, d):
    """Points of the embeddings, written as PLY files into the shared folder and read again in ranges of 200."""
    spark.dataSource.register(PlySource)
    e, at = F.col("embedding"), new_path(spark, "cloud")
    points = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"), e[0].alias("x"), e[1].alias("y"), e[2].cast("double").alias("z"), F.col("label").cast("short").alias("label")
    )
    points.write.format("ply").mode("append").save(at)
    return spark.read.format("ply").option("rows", 200).load(at).drop("path", "row")
