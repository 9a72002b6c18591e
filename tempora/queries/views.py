"""View tables, name matching, chunks, capped subsets, frames and per-sample kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions import geometry as geo
from tempora.operators import retrieval, views
from tempora.queries.registry import query
from tempora.queries.vision import CAMS, ROT, cameras, samples_sql, _views
from tempora.session import table


@query(
    "pose_rows",
    """
SELECT l_suppkey % 7 AS scene_id, 0 AS model, l_orderkey AS image_id, 'commons/S' || l_linenumber || '/f ' || l_orderkey || '.jpg' AS path,
  'S' || l_linenumber AS subcat, 'f_' || l_orderkey || '.jpg' AS file_key,
  CASE WHEN s_nationkey % 2 = 0 THEN 'SIMPLE_RADIAL' ELSE 'PINHOLE' END AS camera_model,
  round(s_acctbal, 3) AS fx, round(CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal ELSE s_acctbal + 1 END, 3) AS fy,
  round(CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal + 2 END, 3) AS cx
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
""",
)
def pose_rows(spark, d):
    scene = F.col("l_suppkey") % 7
    images = table(spark, d, "lineitem").select(
        scene.alias("scene_id"), F.lit(0).alias("model"), F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("camera_id"),
        F.concat(F.lit("commons/S"), F.col("l_linenumber"), F.lit("/f "), F.col("l_orderkey"), F.lit(".jpg")).alias("name"),
        *[F.lit(0.0).alias(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")],
    )
    cameras = table(spark, d, "supplier").select(
        (F.col("s_suppkey") % 7).alias("scene_id"), F.lit(0).alias("model"), F.col("s_suppkey").alias("camera_id"),
        F.when(F.col("s_nationkey") % 2 == 0, "SIMPLE_RADIAL").otherwise("PINHOLE").alias("model_name"),
        F.lit(8).alias("width"), F.lit(6).alias("height"),
        F.array(*[F.col("s_acctbal") + i for i in range(4)]).alias("params"),
    )
    return views.pose_rows(images, cameras).select(
        "scene_id", "model", "image_id", "path", "subcat", "file_key", "camera_model",
        *[F.round(c, 3).alias(c) for c in ("fx", "fy", "cx")],
    )


@query(
    "missing_models",
    "SELECT o_custkey AS scene_id, o_orderkey AS model FROM orders WHERE o_totalprice >= 200000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
)
def missing_models(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("scene_id"), F.col("o_orderkey").alias("model"), F.col("o_totalprice").alias("n_images"))
    have = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("model")).distinct()
    return views.missing_models(o, o.join(have, "model"), 200000)


@query(
    "registered_views",
    "SELECT p_partkey AS file_key, p_size / 2 AS cx, p_retailprice AS fx, CASE WHEN p_size > 30 THEN '2000+' ELSE '1945-1969' END AS era FROM part WHERE p_partkey % 3 = 0",
)
def registered_views(spark, d):
    p = table(spark, d, "part")
    q = p.select(
        F.col("p_partkey").alias("file_key"), F.col("p_size").alias("image_width"), F.lit(6).alias("image_height"),
        F.when(F.col("p_size") > 30, 2005.0).otherwise(1950.0).alias("date_mid"), F.lit(1.0).alias("date_width"),
    )
    poses = p.where("p_partkey % 3 = 0").select(
        F.col("p_partkey").alias("file_key"), *[F.lit(0.0).alias(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz", "rot_spread_deg", "center_spread")],
        F.lit(2).alias("n_batches"), F.col("p_retailprice").alias("focal"),
    )
    return views.registered_to_views(q, poses, 0).select("file_key", "cx", "fx", "era")


@query(
    "cap_modern",
    """
WITH v AS (SELECT event_id, user_id, 1990 + event_id % 20 AS date_mid FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST('0x' || substr(sha1('0:' || event_id), 1, 12) AS BIGINT), event_id) AS r
      FROM v WHERE date_mid >= 2000)
SELECT event_id AS file_key FROM v WHERE date_mid < 2000 UNION ALL SELECT event_id FROM m WHERE r <= 10
""",
)
def cap_modern(spark, d):
    v = table(spark, d, "events").select(
        F.col("event_id").alias("file_key"), F.col("user_id").alias("scene_id"), (1990 + F.col("event_id") % 20).alias("date_mid")
    )
    return views.cap_modern(v, 10).select("file_key")


@query(
    "old_target_samples",
    """
SELECT o_orderkey, max(CASE WHEN o_orderkey % 2 = 1 THEN 1960 + o_orderkey % 13 END) OVER (PARTITION BY o_custkey) < 1970 AS old_target_sample FROM orders
""",
)
def old_target_samples(spark, d):
    s = table(spark, d, "orders").select(
        "o_orderkey", F.lit(0).alias("scene_id"), F.col("o_custkey").alias("sample"),
        F.when(F.col("o_orderkey") % 2 == 1, "target").otherwise("input").alias("role"), (1960 + F.col("o_orderkey") % 13).alias("date"),
    )
    return views.old_target_samples(s).select("o_orderkey", "old_target_sample")


@query(
    "name_matches",
    "SELECT count(*) AS n_names, count(*) FILTER (p_partkey % 2 = 0) AS on_path, count(*) FILTER (p_partkey % 3 <> 0) AS on_name FROM part",
)
def name_matches(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    names = p.select(F.concat(F.lit("a_b/"), key, F.lit("_x.jpg")).alias("name"))
    index = p.select(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a b/"), key, F.lit(" x.jpg"))).otherwise("none").alias("image"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(key, F.lit(" x.jpg"))).otherwise("none").alias("image_name"),
    )
    return views.name_matches(names, index)


@query(
    "request_chunks",
    "WITH r AS (SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1) // 50 AS chunk FROM customer) SELECT chunk, list_sort(list(c_name)) AS items FROM r GROUP BY chunk",
)
def request_chunks(spark, d):
    return views.chunks(table(spark, d, "customer"), "c_name", 50)


@query(
    "load_years",
    "SELECT 'n' || p_partkey AS colmap_name, (1800 + p_size * 5 + 1800 + p_size * 5 + 2) / 2 + 0.5 AS year FROM part WHERE p_partkey % 10 >= 5 AND (3600 + p_size * 10 + 3) / 2 >= 1826",
)
def load_years(spark, d):
    start = 1800 + F.col("p_size") * 5
    rows = table(spark, d, "part").select(
        F.concat(F.lit("n"), F.col("p_partkey")).alias("colmap_name"), start.alias("date_start"), (start + 2).alias("date_end"),
        ((F.col("p_partkey") % 10) / 10).alias("date_conf"),
    )
    return views.load_years(rows)


@query(
    "splat_attributes",
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 5) AS e FROM embeddings)
SELECT vec_id, list_transform(e[1:3], lambda x: round(exp(x) * 2, 6)) AS sizes,
  list_transform([e[5], e[6], e[7], e[4]], lambda x: round(x / sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6] + e[7] * e[7]), 6) + 0.0) AS rotation,
  list_transform(e[8:10], lambda x: CAST(floor(greatest(0, least(1, 0.5 + 0.28209479177387814 * x)) * 255) AS INTEGER)) AS rgb,
  CAST(floor(greatest(0, least(1, 1.5 / (1 + exp(-e[11])))) * 255) AS INTEGER) AS alpha
FROM e
""",
)
def splat_attributes(spark, d):
    names = ["scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2", "opacity"]
    pts = table(spark, d, "embeddings").select("vec_id", *[(F.col("embedding")[i].cast("double") * 5).alias(n) for i, n in enumerate(names)])
    out = views.splat_attributes(pts, 2.0, 1.5)
    return out.select(
        "vec_id", F.transform("sizes", lambda x: F.round(x, 6)).alias("sizes"),
        F.transform("rotation", lambda x: F.round(x, 6) + 0.0).alias("rotation"), "rgb", "alpha",
    )


@query(
    "unit_vectors",
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e FROM embeddings)
SELECT vec_id, list_transform(e, lambda x: round(x / sqrt(list_dot_product(e, e)), 6) + 0.0) AS vec FROM e
""",
)
def unit_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    return e.select("vec_id", F.transform(views.unit_vectors(F.col("e")), lambda x: F.round(x, 6) + 0.0).alias("vec"))


def _posed_samples(spark, d):
    cams = _views(spark, d)
    r = geo.rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    posed = cams.select("scene_id", "row_id", geo.camera_to_world(r, F.col("tx"), F.col("ty"), F.col("tz")).alias("c2w"))
    drawn = retrieval.draw_samples(cams, 4)
    k = F.array(*[F.lit(v) for v in (1.2, 0.0, 0.5, 0.0, 1.2, 0.5, 0.0, 0.0, 1.0)])
    return drawn.join(posed, ["scene_id", "row_id"]).select("scene_id", "sample", "view", "c2w", k.alias("k"))


POSED = f"""WITH {CAMS}, {samples_sql(4)},
posed AS (SELECT d.scene_id, sample, view, r.r00, r.r01, r.r02, r.r10, r.r11, r.r12, r.r20, r.r21, r.r22, cx, cy, cz
  FROM drawn d JOIN cams c ON c.vec_id = d.row_id JOIN {ROT} r ON r.vec_id = d.row_id)"""


def _six(c):
    return F.transform(c, lambda x: F.round(x, 6) + 0.0)


@query(
    "normalised_cameras",
    POSED + """,
m AS (SELECT *, median(cx) OVER w AS mx, median(cy) OVER w AS my, median(cz) OVER w AS mz FROM posed WINDOW w AS (PARTITION BY scene_id, sample)),
f AS (SELECT *, sqrt(pow(cx - mx, 2) + pow(cy - my, 2) + pow(cz - mz, 2)) AS far FROM m),
q AS (SELECT *, far <= least(10 * quantile_cont(far, 0.97) OVER (PARTITION BY scene_id, sample), 1e6) AS inside FROM f),
z AS (SELECT * REPLACE (cx - avg(CASE WHEN inside THEN cx END) OVER w AS cx, cy - avg(CASE WHEN inside THEN cy END) OVER w AS cy,
  cz - avg(CASE WHEN inside THEN cz END) OVER w AS cz) FROM q WINDOW w AS (PARTITION BY scene_id, sample)),
n AS (SELECT *, max(CASE WHEN view = 0 THEN sqrt(cx * cx + cy * cy + cz * cz) END) OVER (PARTITION BY scene_id, sample) AS near FROM z),
g AS (SELECT *, CASE WHEN near > 1e-5 THEN 2.0 / near ELSE 2.0 END AS g FROM n)
SELECT scene_id, sample, view, list_transform([r00, r10, r20, cx * g, r01, r11, r21, cy * g, r02, r12, r22, cz * g, 0, 0, 0, 1], lambda x: round(x, 6) + 0.0) AS c2w,
  CAST([1.2, 0, 0.5, 0, 1.2, 0.5, 0, 0, 1] AS DOUBLE[]) AS k FROM g
""",
)
def normalised_cameras(spark, d):
    s = _posed_samples(spark, d)
    return views.per_sample(s, views.normalise_cameras, s.schema).withColumn("c2w", _six("c2w"))


@query(
    "plucker_rays",
    POSED + """,
rel AS (SELECT v.*, list_transform([[o.r00, o.r01, o.r02], [o.r10, o.r11, o.r12], [o.r20, o.r21, o.r22]], lambda a: [
    a[1] * v.r00 + a[2] * v.r01 + a[3] * v.r02, a[1] * v.r10 + a[2] * v.r11 + a[3] * v.r12, a[1] * v.r20 + a[2] * v.r21 + a[3] * v.r22,
    a[1] * (v.cx - o.cx) + a[2] * (v.cy - o.cy) + a[3] * (v.cz - o.cz)]) AS a
  FROM posed v JOIN posed o ON v.scene_id = o.scene_id AND v.sample = o.sample AND o.view = 0),
px AS (SELECT *, ((n % 6 + 0.5) / 6 - 0.5) / 1.2 AS x, ((n // 6 + 0.5) / 4 - 0.5) / 1.2 AS y FROM rel, range(24) p(n)),
raw AS (SELECT *, list_transform(a, lambda q: q[1] * x + q[2] * y + q[3]) AS d, list_transform(a, lambda q: q[4]) AS t FROM px),
u AS (SELECT *, list_transform(d, lambda q: q / sqrt(list_dot_product(d, d))) AS e FROM raw),
six AS (SELECT *, [e[1], e[2], e[3], t[2] * e[3] - t[3] * e[2], t[3] * e[1] - t[1] * e[3], t[1] * e[2] - t[2] * e[1]] AS r FROM u),
flat AS (SELECT scene_id, sample, view, n, unnest(r) AS x, unnest(range(6)) AS part FROM six)
SELECT scene_id, sample, view, list(round(x, 6) + 0.0 ORDER BY part, n) AS rays FROM flat GROUP BY scene_id, sample, view
""",
)
def plucker_rays(spark, d):
    s = _posed_samples(spark, d)
    rays = views.per_sample(s, lambda p: views.plucker_rays(p, 4, 6), "scene_id long, sample int, view int, rays array<double>")
    return rays.withColumn("rays", _six("rays"))


@query(
    "camera_plane",
    f"""
WITH {CAMS},
mid AS (SELECT scene_id, median(cx) AS mx, median(cy) AS my, median(cz) AS mz FROM cams GROUP BY 1),
c AS (SELECT vec_id, scene_id, cx - mx AS x, cy - my AS y, cz - mz AS z FROM cams JOIN mid USING (scene_id)),
s AS (SELECT scene_id, sum(x * x) AS xx, sum(y * y) AS yy, sum(z * z) AS zz, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * z) AS yz, (sum(x * x) + sum(y * y) + sum(z * z)) / 3 AS q
  FROM c GROUP BY 1),
p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM s),
r AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 AS a FROM p),
l AS (SELECT *, unnest([q + 2 * p * cos(a), 3 * q - (q + 2 * p * cos(a)) - (q + 2 * p * cos(a + 2 * pi() / 3))]) AS l, unnest([1, 2]) AS axis FROM r),
x AS (SELECT scene_id, axis, unnest([
    [xy * yz - xz * (yy - l), xz * xy - (xx - l) * yz, (xx - l) * (yy - l) - xy * xy],
    [xy * (zz - l) - xz * yz, xz * xz - (xx - l) * (zz - l), (xx - l) * yz - xy * xz],
    [(yy - l) * (zz - l) - yz * yz, yz * xz - xy * (zz - l), xy * yz - (yy - l) * xz]]) AS w FROM l),
best AS (SELECT scene_id, axis, arg_max(w, list_dot_product(w, w)) AS w FROM x GROUP BY 1, 2),
unit AS (SELECT scene_id, axis, list_transform(w, lambda k: k / sqrt(list_dot_product(w, w)) * sign(CASE WHEN abs(w[1]) >= abs(w[2]) AND abs(w[1]) >= abs(w[3]) THEN w[1]
  WHEN abs(w[2]) >= abs(w[3]) THEN w[2] ELSE w[3] END)) AS w FROM best)
SELECT vec_id, round(u.w[1] * x + u.w[2] * y + u.w[3] * z, 5) + 0.0 AS u, round(v.w[1] * x + v.w[2] * y + v.w[3] * z, 5) + 0.0 AS v
FROM c JOIN unit u ON u.scene_id = c.scene_id AND u.axis = 1 JOIN unit v ON v.scene_id = c.scene_id AND v.axis = 2
""",
)
def camera_plane(spark, d):
    at = views.plane(cameras(spark, d).select("vec_id", "scene_id", "cx", "cy", "cz"))
    return at.select("vec_id", *[(F.round(c, 5) + 0.0).alias(c) for c in "uv"])


FRAME = "file_path string, fl_x double, fl_y double, cx double, cy double, w int, h int, transform_matrix array<array<double>>"


@query(
    "transform_frames",
    POSED + """
SELECT scene_id || '/' || view AS file_path, 1.0::DOUBLE AS fl_x, 1.0::DOUBLE AS fl_y, 1.0::DOUBLE AS cx, 1.0::DOUBLE AS cy, CAST(8 AS INTEGER) AS w, CAST(6 AS INTEGER) AS h,
  list_transform([r00, r10, r20, posed.cx, r01, r11, r21, posed.cy, r02, r12, r22, posed.cz, 0, 0, 0, 1], lambda x: round(x, 6) + 0.0) AS transform_matrix
FROM posed
""",
)
def transform_frames(spark, d):
    """The frames as they are written, read again from their JSON."""
    value = F.from_json("value", FRAME)
    return _frames(spark, d).select(value.alias("f")).select("f.*").withColumn("transform_matrix", _six(F.flatten("transform_matrix")))


def _frames(spark, d):
    s = _posed_samples(spark, d)
    return views.frames_json(s.select(F.concat(F.col("scene_id"), F.lit("/"), F.col("view")).alias("path"), "c2w", *[F.lit(1.0).alias(c) for c in ("fx", "fy", "cx", "cy")], F.lit(8).alias("width"), F.lit(6).alias("height")))


@query(
    "color_stats",
    """
WITH e AS (SELECT vec_id, list_transform(embedding[1:63], lambda x: CAST(floor((x + 1) * 127) AS INTEGER) / 255) AS p FROM embeddings),
x AS (SELECT vec_id, p[3 * i + 1] AS r, p[3 * i + 2] AS g, p[3 * i + 3] AS b FROM e, range(21) t(i)),
l AS (SELECT vec_id, greatest(r, g, b) AS hi, least(r, g, b) AS lo,
  list_transform([r, g, b], lambda c: CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END) AS v FROM x),
xyz AS (SELECT *, [(0.4124564 * v[1] + 0.3575761 * v[2] + 0.1804375 * v[3]) / 0.95047, 0.2126729 * v[1] + 0.7151522 * v[2] + 0.0721750 * v[3],
  (0.0193339 * v[1] + 0.1191920 * v[2] + 0.9503041 * v[3]) / 1.08883] AS t FROM l),
f AS (SELECT *, list_transform(t, lambda c: CASE WHEN c > pow(6 / 29, 3) THEN cbrt(c) ELSE c / (3 * pow(6 / 29, 2)) + 4 / 29 END) AS f FROM xyz),
s AS (SELECT vec_id, avg(CASE WHEN hi > 0 THEN (hi - lo) / hi ELSE 0 END) AS saturation, var_samp(500 * (f[1] - f[2])) AS aa,
  var_samp(200 * (f[2] - f[3])) AS bb, covar_samp(500 * (f[1] - f[2]), 200 * (f[2] - f[3])) AS ab FROM f GROUP BY 1),
m AS (SELECT vec_id, saturation, sqrt(greatest((aa + bb) / 2 - sqrt(pow((aa - bb) / 2, 2) + ab * ab), 0)) AS chroma_minor FROM s)
SELECT vec_id, round(saturation, 6) AS saturation, round(chroma_minor, 4) AS chroma_minor, chroma_minor < 1.0 AS is_monochrome FROM m
""",
)
def color_stats(spark, d):
    # Single precision throughout, as in the SQL: float and int are double in Spark's ANSI mode.
    one, most = F.lit(1).cast("float"), F.lit(127).cast("float")
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x + one) * most).cast("int")).alias("p"))
    s = e.select("vec_id", views.color_stats(F.slice("p", 1, 63)).alias("s"))
    return s.select("vec_id", F.round("s.saturation", 6).alias("saturation"), F.round("s.chroma_minor", 4).alias("chroma_minor"), "s.is_monochrome")
