"""Summaries of cameras, batches, registrations and date audits, and nearest views, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.dating import years
from tempora.operators import census, posing
from tempora.operators.nearest import nearest_modern_views
from tempora.queries.dates import LEGACY, legacy_rows
from tempora.queries.registry import query
from tempora.queries.vision import CAMS, cameras
from tempora.session import table


@query(
    "camera_summary",
    """
WITH c AS (SELECT l_suppkey % 40 AS scene_id, 'M' || l_returnflag AS model_name, CAST(l_quantity AS INTEGER) * 16 AS width FROM lineitem),
n AS (SELECT scene_id, model_name, count(*) AS n FROM c GROUP BY 1, 2),
i AS (SELECT c_custkey % 47 AS scene_id, count(*) * 30 AS n_images FROM customer GROUP BY 1)
SELECT scene_id, string_agg(model_name || ':' || n, ',' ORDER BY model_name) AS models, CAST(sum(n) AS BIGINT) AS n_cameras,
  (SELECT min(width) FROM c WHERE c.scene_id = n.scene_id) AS min_width, (SELECT max(width) FROM c WHERE c.scene_id = n.scene_id) AS max_width,
  CAST(coalesce(any_value(n_images), 0) AS BIGINT) AS n_images, coalesce(any_value(n_images), 0) > sum(n) AS shared
FROM n LEFT JOIN i USING (scene_id) GROUP BY scene_id
""",
)
def camera_summary(spark, d):
    cams = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 40).alias("scene_id"), F.concat(F.lit("M"), "l_returnflag").alias("model_name"),
        (F.col("l_quantity").cast("int") * 16).alias("width"),
    )
    thirty = F.explode(F.sequence(F.lit(1), F.lit(30)))
    images = table(spark, d, "customer").select((F.col("c_custkey") % 47).alias("scene_id"), thirty.alias("pic"))
    out = census.camera_summary(cams, images, ["scene_id"])
    said = F.transform(F.map_entries("models"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.withColumn("models", F.array_join(said, ","))


@query(
    "aspect_mismatch",
    "SELECT max(abs((p_size + 10.0) / (p_partkey % 7 + 5) - (p_size + 11.0) / (p_partkey % 5 + 5))) AS max_aspect_mismatch FROM part",
)
def aspect_mismatch(spark, d):
    size, key = F.col("p_size").cast("double"), F.col("p_partkey")
    views = table(spark, d, "part").select(
        (size + 10).alias("image_width"), (key % 7 + 5).alias("image_height"),
        (size + 11).alias("camera_width"), (key % 5 + 5).alias("camera_height"),
    )
    return census.aspect_mismatch(views)


@query(
    "largest_groups",
    "SELECT l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
)
def largest_groups(spark, d):
    return census.largest_groups(table(spark, d, "lineitem"), ["l_partkey"])


@query(
    "batch_log_summary",
    "SELECT count(*) AS n_batches, count(*) FILTER (l_quantity > 25) AS n_used, median(l_linenumber * 3) AS n_inliers_median FROM lineitem",
)
def batch_log_summary(spark, d):
    log = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).alias("used"), (F.col("l_linenumber") * 3).alias("n_inliers"))
    return posing.summarize_log(log)


# Poses turned about one axis, a quarter of which no batch placed; the true ones lag by up to 90 degrees.
TURNED = """
WITH q AS (SELECT o_orderkey AS image, o_custkey % 50 AS scene_id, o_orderkey % 4 <> 0 AS placed, o_orderkey % 89 + 1 AS off,
  (o_orderkey % 11) / 4.0 AS x, 1.0 + (o_custkey % 50) / 10 AS scale FROM orders),
e AS (SELECT scene_id, image, CASE WHEN placed THEN CAST(off AS DOUBLE) END AS rot, CASE WHEN placed THEN abs(x - 1) / scale END AS err FROM q)
"""


def _evaluated(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image"), (F.col("o_custkey") % 50).alias("scene_id"),
        F.radians(F.col("o_orderkey") % 300).alias("a"), F.radians(F.col("o_orderkey") % 89 + 1).alias("off"),
        (F.col("o_orderkey") % 11 / 4).alias("x"),
    )

    def turned(angle, x):
        zero, one = F.lit(0.0), F.lit(1.0)
        return F.array(F.cos(angle), -F.sin(angle), zero, x, F.sin(angle), F.cos(angle), zero, zero, zero, zero, one, zero, zero, zero, zero, one)

    placed = F.when(F.col("image") % 4 != 0, turned(F.col("a"), F.col("x").cast("double")))
    truth = o.select("scene_id", "image", turned(F.col("a") - F.col("off"), F.lit(1.0)).alias("true"))
    scales = o.select("scene_id").distinct().withColumn("scale", 1 + F.floor(F.col("scene_id")) / 10)
    return posing.evaluate(o.select("scene_id", "image", placed.alias("c2w")), truth, scales)


@query("registration_errors", TURNED + "SELECT scene_id, image, rot AS rot_err_deg, round(err, 9) AS center_err FROM e")
def registration_errors(spark, d):
    return _evaluated(spark, d).select(
        "scene_id", "image", F.round("rot_err_deg", 6).alias("rot_err_deg"), F.round("center_err", 9).alias("center_err")
    )


@query(
    "registration_summary",
    TURNED + """
SELECT count(*) AS n_queries, count(rot) / count(*) AS placed, round(median(rot), 6) AS rot_err_median_deg,
  count(*) FILTER (rot < 4.5) / count(*) AS within_5deg, count(*) FILTER (rot < 9.5) / count(*) AS within_10deg,
  count(*) FILTER (rot < 19.5) / count(*) AS within_20deg, round(median(err), 9) AS center_err_median FROM e
""",
)
def registration_summary(spark, d):
    # Errors are whole degrees; half a degree less keeps them off the limits.
    out = posing.summarize_errors(_evaluated(spark, d).withColumn("rot_err_deg", F.col("rot_err_deg") + 0.5))
    return out.withColumn("rot_err_median_deg", F.round(F.col("rot_err_median_deg") - 0.5, 6)).withColumn(
        "center_err_median", F.round("center_err_median", 9)
    )


@query(
    "nearest_modern_views",
    f"""
WITH {CAMS}, m AS (SELECT * FROM cams WHERE date >= 1950),
mid AS (SELECT scene_id, median(cx) AS mx, median(cy) AS my, median(cz) AS mz FROM m GROUP BY 1),
sc AS (SELECT scene_id, median(sqrt(pow(cx - mx, 2) + pow(cy - my, 2) + pow(cz - mz, 2))) AS scale FROM m JOIN mid USING (scene_id) GROUP BY 1),
p AS (SELECT q.scene_id, q.vec_id AS query, r.vec_id AS row_id, round(sqrt(pow((q.cx - r.cx) / scale, 2) + pow((q.cy - r.cy) / scale, 2) + pow((q.cz - r.cz) / scale, 2)
    + pow(q.dx - r.dx, 2) + pow(q.dy - r.dy, 2) + pow(q.dz - r.dz, 2)), 6) AS dist
  FROM m q JOIN m r ON q.scene_id = r.scene_id AND q.vec_id % 20 = 0 JOIN sc ON sc.scene_id = q.scene_id)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY dist, row_id <> query, row_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 8
""",
)
def nearest_views(spark, d):
    """Queries are the views whose id is divisible by 20, against all modern views of their scene."""
    views = cameras(spark, d).withColumnRenamed("vec_id", "row_id")
    asked = views.where("row_id % 20 = 0").select("scene_id", "row_id")
    return nearest_modern_views(views, asked, 8, since=1950).withColumn("dist", F.round("dist", 6))


@query(
    "audit_drops",
    LEGACY + """, m AS (SELECT *, (s + t + 1) / 2 AS mid FROM e)
SELECT count(*) FILTER (mid IS NULL) AS undated, count(*) FILTER (c < 0.5) AS low_conf_dropped,
  count(*) FILTER (c >= 0.5 AND mid < 1826) AS pre_photo_dropped, count(*) - count(DISTINCT o_custkey) AS duplicate_rows FROM m
""",
)
def audit_drops(spark, d):
    return years.audit_drops(legacy_rows(spark, d))


@query(
    "audit_sources",
    LEGACY + """SELECT 'date_field' AS date_source, count(*) AS n, count(*) FILTER (c >= 0.5 AND (s + t + 1) / 2 >= 1826) AS usable
FROM e WHERE s IS NOT NULL""",
)
def audit_sources(spark, d):
    return years.audit_sources(legacy_rows(spark, d))
