"""Census, joins, aggregates, windows, splits and retrieval on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.interval import decimal_year
from tempora.functions.strings import stable_hash
from tempora.operators import census, neardup, retrieval
from tempora.queries.registry import query
from tempora.session import TABLES, table

#: SQL for the decimal year of a date expression.
DY = "(year({0}) + (dayofyear({0}) - 1) / dayofyear(make_date(year({0}), 12, 31)))"
O_DAY = "CAST(o_orderdate AS DATE)"
#: Eras cut anew for order dates.
STARTS = (1996, 1998, 2000, 2001)
E_NAMES = ("e0", "e1", "e2", "e3", "e4")
ERA_SQL = (
    "CASE WHEN m IS NULL THEN 'undated' WHEN m < 1996 THEN 'e0' WHEN m < 1998 THEN 'e1' "
    "WHEN m < 2000 THEN 'e2' WHEN m < 2001 THEN 'e3' ELSE 'e4' END"
)


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").withColumn("mid", decimal_year(F.to_date("o_orderdate")))


@query(
    "era_census",
    f"""
WITH f AS (SELECT c_nationkey AS scene_id, o_orderkey AS k, {DY.format(O_DAY)} AS m
           FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT scene_id,
  count(DISTINCT k) FILTER (m < 1996) AS e0, count(DISTINCT k) FILTER (m >= 1996 AND m < 1998) AS e1,
  count(DISTINCT k) FILTER (m >= 1998 AND m < 2000) AS e2, count(DISTINCT k) FILTER (m >= 2000 AND m < 2001) AS e3,
  count(DISTINCT k) FILTER (m >= 2001) AS e4, CAST(0 AS BIGINT) AS undated FROM f GROUP BY scene_id)
SELECT *, e0 + e1 + e2 AS early, e0 + e1 + e2 >= 10 AND e4 >= 10 AS gate FROM c
""",
)
def era_census(spark: SparkSession, d: str) -> DataFrame:
    files = _orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("scene_id"),
        F.col("o_orderkey").alias("file_key"),
        census.assign_era(F.col("mid"), F.lit(0.1), STARTS, E_NAMES).alias("era"),
    )
    out = census.era_counts(files, ["scene_id"], (*E_NAMES, "undated")).withColumnRenamed("pre-1970", "early")
    return out.withColumn("gate", (F.col("early") >= 10) & (F.col("e4") >= 10))


def _scene_inputs(spark, d):
    index = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cat"),
        F.col("l_returnflag").alias("subcat"),
        F.col("l_partkey").cast("string").alias("file_key"),
    )
    cats = table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("scene"), F.col("c_custkey").alias("scene_id")
    )
    recon = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(
        F.col("o_custkey").alias("scene_id"),
        F.col("o_orderkey").alias("model"),
        F.floor(F.col("o_totalprice") / 20000).alias("n_images"),
    )
    return index, cats, recon


SCENES_SQL = """
WITH s AS (SELECT 'c' || o_custkey AS scene, count(*) AS n_paths, count(DISTINCT l_partkey) AS n_files,
             count(DISTINCT l_returnflag) AS n_subcats
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT o_custkey AS scene_id, o_orderkey AS model, CAST(floor(o_totalprice / 20000) AS BIGINT) AS n
      FROM orders WHERE o_orderkey % 3 = 0),
m AS (SELECT scene_id, count(*) AS n_models, max(n) AS largest_model_images, CAST(sum(n) AS BIGINT) AS registered_paths
      FROM r GROUP BY 1),
b AS (SELECT scene_id, model AS largest_model FROM r
      QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, model) = 1),
t AS (SELECT s.scene, c_custkey AS scene_id, n_paths, n_files, n_subcats, coalesce(n_models, 0) AS n_models, largest_model,
  coalesce(largest_model_images, 0) AS largest_model_images, coalesce(registered_paths, 0) AS registered_paths
FROM s LEFT JOIN customer ON s.scene = 'c' || c_custkey LEFT JOIN m ON m.scene_id = c_custkey
LEFT JOIN b ON b.scene_id = c_custkey)
"""


@query("scene_table", SCENES_SQL + "SELECT * FROM t")
def scene_table(spark, d):
    return census.scene_table(*_scene_inputs(spark, d))


@query("select_scenes_top", SCENES_SQL + "SELECT * FROM t WHERE largest_model_images >= 5 ORDER BY n_files DESC, scene LIMIT 25")
def select_scenes_top(spark, d):
    return census.select_scenes(scene_table(spark, d), top=25, min_model_images=5)


@query("select_scenes_names", SCENES_SQL + "SELECT * FROM t WHERE scene IN ('c1', 'c10', '22') OR scene_id IN (22)")
def select_scenes_names(spark, d):
    return census.select_scenes(scene_table(spark, d), names=["c1", "c10", "22"])


@query(
    "scan_pushdown",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity > 45",
)
def scan_pushdown(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A") & (F.col("l_quantity") > 45)).select(
        "l_orderkey", "l_linenumber"
    )


@query("scan_substring", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name")
def scan_substring(spark, d):
    return table(spark, d, "part").where(F.lower("p_name").contains("ring")).select("p_partkey", "p_name").orderBy("p_name")


@query("footer_stats", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES))
def footer_stats(spark, d):
    counts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n_rows")) for t in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _files(spark, d) -> DataFrame:
    customers = table(spark, d, "customer")
    meta = customers.select(
        F.col("c_nationkey").alias("scene_id"), F.col("c_custkey").alias("file_key"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "photo")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "painting").otherwise("unknown").alias("medium"),
    )
    orders = _orders(spark, d).join(
        customers.select(F.col("c_custkey").alias("file_key"), F.col("c_nationkey").alias("scene_id")),
        F.col("o_custkey") == F.col("file_key"),
    )
    dates = orders.groupBy("scene_id", "file_key").agg(
        F.min("mid").alias("date_mid"), F.lit(0.5).alias("date_width")
    )
    # Years 1995 to 2001 stretched over the eras.
    dates = dates.withColumn("date_mid", 1880 + (F.col("date_mid") - 1995) * 60)
    poses = orders.where("o_orderstatus = 'F'").select(
        "scene_id", "file_key", F.pmod("o_orderkey", F.lit(7)).cast("int").alias("model")
    )
    return census.load_files(meta, dates, poses)


FILES_SQL = f"""
WITH o AS (SELECT c_nationkey AS scene_id, c_custkey AS file_key, o_orderkey, o_orderstatus, {DY.format(O_DAY)} AS m
           FROM orders JOIN customer ON o_custkey = c_custkey),
dt AS (SELECT file_key, 1880 + (min(m) - 1995) * 60 AS date_mid FROM o GROUP BY 1),
ps AS (SELECT file_key, list_sort(list(DISTINCT CAST(o_orderkey % 7 AS INTEGER))) AS models FROM o
       WHERE o_orderstatus = 'F' GROUP BY 1),
f AS (SELECT c_nationkey AS scene_id, c.c_custkey AS file_key,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'photo' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'painting'
         ELSE 'unknown' END AS medium,
    date_mid, coalesce(models, []) AS models,
    CASE WHEN date_mid IS NULL THEN 'undated' WHEN date_mid < 1900 THEN 'pre-1900' WHEN date_mid < 1945 THEN '1900-1944'
      WHEN date_mid < 1970 THEN '1945-1969' WHEN date_mid < 2000 THEN '1970-1999' ELSE '2000+' END AS era
  FROM customer c LEFT JOIN dt ON dt.file_key = c.c_custkey LEFT JOIN ps ON ps.file_key = c.c_custkey),
g AS (SELECT *, len(models) > 0 AS registered, medium IN ('photo', 'unknown') AS photographic FROM f)
"""


@query(
    "load_files",
    FILES_SQL + "SELECT scene_id, file_key, medium, round(date_mid, 6) AS date_mid, models, era, registered, photographic FROM g",
)
def load_files(spark, d):
    return _files(spark, d).withColumn("date_mid", F.round("date_mid", 6)).drop("date_width")


_ERA = {"n_pre1900": "pre-1900", "n_1900": "1900-1944", "n_1945": "1945-1969", "n_1970": "1970-1999", "n_2000": "2000+", "n_undated": "undated"}
MODELS_SQL = (
    "ex AS (SELECT scene_id, file_key, era, photographic, unnest(models) AS model FROM g), mc AS (SELECT scene_id, model, "
    + ", ".join(f"count(DISTINCT file_key) FILTER (photographic AND era = '{e}') AS {n}" for n, e in _ERA.items())
    + ", count(DISTINCT file_key) AS model_files, bool_or(photographic) AS any_photo FROM ex GROUP BY 1, 2)"
)


def _models(spark, d):
    return census.model_census(_files(spark, d), min_files=3)


@query(
    "model_census",
    FILES_SQL + ", " + MODELS_SQL + " SELECT scene_id, model, " + ", ".join(_ERA)
    + ", n_pre1900 + n_1900 + n_1945 AS n_early, model_files FROM mc WHERE model_files >= 3 AND any_photo",
)
def model_census(spark, d):
    return _models(spark, d).withColumnsRenamed({v: k for k, v in _ERA.items()} | {"pre-1970": "n_early"})


@query(
    "scene_summary",
    FILES_SQL + ", " + MODELS_SQL + """
, best AS (SELECT scene_id, model AS best_model, n_pre1900 + n_1900 + n_1945 AS b_old, n_2000 AS b_new FROM mc
  WHERE model_files >= 3 AND any_photo
  QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY n_pre1900 + n_1900 + n_1945 DESC, n_2000 DESC, model) = 1)
, s AS (SELECT scene_id, count(*) AS files, count(*) FILTER (photographic) AS n_photo, count(date_mid) AS n_dated,
   count(*) FILTER (registered) AS n_registered,
   count(*) FILTER (photographic AND era IN ('pre-1900', '1900-1944', '1945-1969')) AS photo_old,
   count(*) FILTER (photographic AND era = '2000+') AS photo_new,
   count(*) FILTER (photographic AND registered AND era IN ('pre-1900', '1900-1944', '1945-1969')) AS posed_old
  FROM g GROUP BY 1)
SELECT s.*, best_model, b_old, b_new, coalesce(b_old >= 10 AND b_new >= 10, false) AS gate_posed,
  coalesce(photo_old >= 10 AND photo_new >= 10, false) AS gate_any
FROM s LEFT JOIN best USING (scene_id)
""",
)
def scene_summary(spark, d):
    files = _files(spark, d)
    best = census.best_models(census.model_census(files, min_files=3))
    out = census.passes_gate(census.scene_summary(files).join(best, "scene_id", "left"))
    return out.select(
        "scene_id", "files", F.col("photographic").alias("n_photo"), F.col("dated").alias("n_dated"),
        F.col("registered").alias("n_registered"), F.col("`photo_pre-1970`").alias("photo_old"),
        F.col("`photo_2000+`").alias("photo_new"), F.col("`posed_pre-1970`").alias("posed_old"), "best_model",
        F.col("`best_model_pre-1970`").alias("b_old"), F.col("`best_model_2000+`").alias("b_new"), "gate_posed", "gate_any",
    )


@query(
    "global_era_census",
    FILES_SQL + "SELECT era, count(*) AS n_all, count(*) FILTER (photographic) AS n_photo, "
    "count(*) FILTER (photographic AND registered) AS n_posed, "
    "round(avg(CAST(registered AS INTEGER)), 6) AS share_posed FROM g GROUP BY era",
)
def global_era_census(spark, d):
    files = census.first_occurrence(_files(spark, d))
    return files.groupBy("era").agg(
        F.count("*").alias("n_all"),
        F.count_if("photographic").alias("n_photo"),
        F.count_if(F.col("photographic") & F.col("registered")).alias("n_posed"),
        F.round(F.avg(F.col("registered").cast("int")), 6).alias("share_posed"),
    )


@query(
    "unposed_candidates",
    FILES_SQL + "SELECT file_key, min(o_orderkey) AS path FROM g JOIN orders ON o_custkey = file_key "
    "WHERE date_mid < 1950 AND photographic AND NOT list_contains(models, 3) GROUP BY 1",
)
def unposed_candidates(spark, d):
    paths = table(spark, d, "orders").select(F.col("o_custkey").alias("file_key"), F.col("o_orderkey").alias("path"))
    return census.unposed_candidates(_files(spark, d), paths, 3, 1950).select("file_key", "path")


@query(
    "view_table",
    f"""
WITH first AS (SELECT o_custkey, o_orderkey, o_totalprice, {DY.format(O_DAY)} AS m FROM orders WHERE o_orderkey % 2 = 1
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT c_nationkey AS scene_id, c_custkey AS file_key, o_orderkey AS path, c_name AS title, round(m, 6) AS date_mid
FROM first JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 AND c_mktsegment <> 'AUTOMOBILE'
""",
)
def view_table(spark, d):
    customers = table(spark, d, "customer")
    orders = _orders(spark, d).where("o_orderkey % 2 = 1").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key = [F.col("c_nationkey").alias("scene_id"), F.col("c_custkey").alias("file_key")]
    poses = orders.select(*key, F.col("o_orderkey").alias("path"), F.lit(0).alias("model"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    dates = customers.select(
        *key, F.when(F.col("c_mktsegment") == "AUTOMOBILE", "painting").otherwise("photo").alias("medium"),
        F.when(F.col("c_acctbal") >= 0, 0.8).otherwise(0.1).alias("date_confidence"), F.lit(1.0).alias("date_width"),
    )
    first = orders.groupBy("c_custkey").agg(F.min_by("mid", "o_orderkey").alias("date_mid"))
    dates = dates.join(first, F.col("file_key") == F.col("c_custkey")).drop("c_custkey").withColumn("date_lo", F.col("date_mid"))
    meta = customers.select(*key, F.col("c_name").alias("title"))
    return census.views_table(poses, dates, meta, 0).select(
        "scene_id", "file_key", "path", "title", F.round("date_mid", 6).alias("date_mid")
    )


@query(
    "confident_registrations",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10 AND l_discount <= 0.1 AND l_linenumber >= 2",
)
def confident_registrations(spark, d):
    views = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(1.0).alias("qw"), F.col("l_quantity").alias("rot_spread_deg"),
        F.col("l_discount").alias("center_spread"), F.col("l_linenumber").alias("n_batches"),
    )
    return census.confident_registrations(views).select("l_orderkey", "l_linenumber")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query(
    "summarize_grouping_sets",
    """
WITH t AS (SELECT l_returnflag AS baseline, l_linestatus = 'O' AS old_target_sample, l_extendedprice / 1000 AS psnr,
  CASE WHEN l_quantity < 2 THEN '<2y' WHEN l_quantity < 10 THEN '2-10y' WHEN l_quantity < 50 THEN '10-50y' ELSE '>50y' END AS bucket
  FROM lineitem)
SELECT baseline, old_target_sample, bucket, round(avg(psnr), 3) AS psnr, count(*) AS n FROM t
GROUP BY GROUPING SETS ((baseline), (baseline, old_target_sample), (baseline, bucket))
""",
)
def summarize_grouping_sets(spark, d):
    t = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("baseline"), (F.col("l_linestatus") == "O").alias("old_target_sample"),
        (F.col("l_extendedprice") / 1000).alias("psnr"), F.col("l_quantity").alias("date_gap"),
    )
    return retrieval.summarize(t)


@query(
    "compare_three_key_join",
    """
WITH a AS (SELECT l_orderkey AS sample, l_linenumber AS view, CAST(l_partkey AS VARCHAR) AS file_key, l_returnflag AS baseline,
  l_extendedprice AS psnr, l_tax FROM lineitem)
SELECT baseline, count(*) AS matched_targets, round(avg(psnr), 3) AS retrieval_psnr, round(avg(30000 * (1 + t)), 3) AS other_psnr,
  round(avg(CASE WHEN psnr > 30000 * (1 + t) THEN 1 ELSE 0 END), 3) AS retrieval_beats_other
FROM a JOIN (SELECT sample, view, file_key, l_tax AS t FROM a WHERE sample % 3 <> 0) b USING (sample, view, file_key)
GROUP BY baseline
""",
)
def compare_three_key_join(spark, d):
    t = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("view"),
        F.col("l_partkey").cast("string").alias("file_key"), F.col("l_returnflag").alias("baseline"),
        F.col("l_extendedprice").alias("psnr"), "l_tax",
    )
    other = t.where("sample % 3 <> 0").select("sample", "view", "file_key", (30000 * (1 + F.col("l_tax"))).alias("psnr"))
    return retrieval.compare(t.drop("l_tax"), other)


DATE_TOL, VALUE_TOL = 0.05, 4.0
BAND_SQL = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 86400000000.0 AS day, value FROM events),
p AS (SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id
      AND abs(a.day - b.day) <= {DATE_TOL} AND abs(a.value - b.value) <= {VALUE_TOL})
"""


def _events(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", "user_id", (micros / 86400000000.0).alias("day"), "value")


@query("band_join_pairs", BAND_SQL + "SELECT a, b FROM p")
def band_join_pairs(spark, d):
    return neardup.band_join(_events(spark, d), "event_id", {"day": DATE_TOL, "value": VALUE_TOL}, ("user_id",))


@query(
    "band_join_components",
    BAND_SQL + """
, s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT event_id AS k, event_id AS g FROM e UNION SELECT s.b, r.g FROM r JOIN s ON r.k = s.a)
SELECT k AS event_id, min(g) AS group_id FROM r GROUP BY k
""",
)
def band_join_components(spark, d):
    return neardup.band_groups(_events(spark, d), "event_id", {"day": DATE_TOL, "value": VALUE_TOL}, ("user_id",))


SPLIT_SQL = """
WITH v AS (SELECT CAST(event_id AS VARCHAR) AS file_key, user_id * 10 + event_id % 10 AS group_id, event_type AS era FROM events),
n AS (SELECT group_id, min(file_key) AS name FROM v GROUP BY 1),
e AS (SELECT group_id, era FROM v GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, era) = 1),
h AS (SELECT group_id, era, name, CAST('0x' || substr(sha1('0:' || name), 1, 12) AS BIGINT) AS h FROM n JOIN e USING (group_id)),
r AS (SELECT *, count(*) OVER (PARTITION BY era) AS n, row_number() OVER (PARTITION BY era ORDER BY h, name) AS r FROM h),
q AS (SELECT *, greatest(1, round_even(n * 0.1, 0)) AS t FROM r),
s AS (SELECT group_id, CASE WHEN n < 4 THEN 'train' WHEN r <= t THEN 'test' WHEN r <= 2 * t THEN 'val' ELSE 'train' END AS split FROM q)
"""


def _split(spark, d):
    views = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("file_key"),
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("group_id"),
        F.col("event_type").alias("era"),
    )
    return views, neardup.assign_splits(views)


@query("stratified_splits", SPLIT_SQL + "SELECT file_key, group_id, split FROM v JOIN s USING (group_id)")
def stratified_splits(spark, d):
    return _split(spark, d)[1]


@query("split_leaks", SPLIT_SQL + "SELECT group_id, count(DISTINCT split) AS n FROM v JOIN s USING (group_id) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leaks(spark, d):
    return neardup.leaks(_split(spark, d)[1])


@query(
    "split_summary",
    SPLIT_SQL + "SELECT era, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, "
    "count(*) FILTER (split = 'test') AS test FROM v JOIN s USING (group_id) GROUP BY era",
)
def split_summary(spark, d):
    views, splits = _split(spark, d)
    return census.split_summary(views.join(splits.select("file_key", "split"), "file_key"))


@query(
    "group_sizes",
    "SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM events GROUP BY user_id, event_id % 10) GROUP BY size",
)
def group_sizes(spark, d):
    views = table(spark, d, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("group_id"))
    return neardup.group_sizes(views)


@query("stable_hash", "SELECT c_custkey, CAST('0x' || substr(sha1(c_name), 1, 12) AS BIGINT) AS h FROM customer")
def stable_hash_query(spark, d):
    return table(spark, d, "customer").select("c_custkey", stable_hash(F.col("c_name")).alias("h"))


@query(
    "number_groups",
    """
WITH g AS (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1)
SELECT o_orderkey, dense_rank() OVER (ORDER BY f) - 1 AS group_id FROM orders JOIN g USING (o_custkey)
""",
)
def number_groups(spark, d):
    groups = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("group_id"))
    return neardup.number_groups(groups, "o_orderkey")


@query(
    "eligible_anchors",
    """
WITH v AS (SELECT event_id, user_id, 1985 + epoch_us(ts) / 86400000000.0 - 19723 AS date FROM events),
c AS (SELECT a.event_id, a.date, count(*) AS same FROM v a JOIN v b ON a.user_id = b.user_id
      AND abs(a.date - b.date) <= CASE WHEN a.date >= 1990 THEN 1.0 ELSE 5.0 END GROUP BY 1, 2),
t AS (SELECT user_id, count(*) AS total FROM v GROUP BY 1)
SELECT event_id, same FROM c JOIN v USING (event_id) JOIN t USING (user_id) WHERE same >= 5 AND total - 5 >= 3
""",
)
def eligible_anchors(spark, d):
    # Days since the first of 2024 stand for years since 1985.
    views = _events(spark, d).select("event_id", F.col("user_id").alias("scene_id"), (1985 + F.col("day") - 19723).alias("date"))
    return retrieval.eligible_anchors(views).select("event_id", "same")


@query(
    "gap_buckets",
    "SELECT CASE WHEN p_size < 2 THEN '<2y' WHEN p_size < 10 THEN '2-10y' WHEN p_size < 50 THEN '10-50y' ELSE '>50y' END AS bucket, count(*) AS n FROM part GROUP BY 1",
)
def gap_buckets(spark, d):
    return table(spark, d, "part").groupBy(retrieval.gap_bucket(F.col("p_size")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "size_compare",
    """
WITH s AS (SELECT p_partkey, 600 + p_size AS iw, 400 AS ih,
  CASE p_partkey % 4 WHEN 0 THEN 600 + p_size WHEN 1 THEN 300 WHEN 2 THEN 400 ELSE 1000 END AS cw,
  CASE p_partkey % 4 WHEN 0 THEN 400 WHEN 1 THEN 200 WHEN 2 THEN 600 ELSE 1000 END AS ch FROM part)
SELECT p_partkey, CASE WHEN iw = cw AND ih = ch THEN 'match'
  WHEN abs(iw / ih - cw / ch) <= 0.01 * (cw / ch) THEN 'scaled'
  WHEN abs(iw / ih - ch / cw) <= 0.01 * (ch / cw) THEN 'rotated' ELSE 'mismatch' END AS kind FROM s
""",
)
def size_compare(spark, d):
    k = F.col("p_partkey") % 4
    iw, ih = 600 + F.col("p_size"), F.lit(400)
    cw = F.when(k == 0, iw).when(k == 1, 300).when(k == 2, 400).otherwise(1000)
    ch = F.when(k == 0, 400).when(k == 1, 200).when(k == 2, 600).otherwise(1000)
    return table(spark, d, "part").select("p_partkey", census.compare_size(iw, ih, cw, ch).alias("kind"))


@query(
    "old_vs_modern",
    """
WITH c AS (SELECT vec_id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z,
   CASE WHEN vec_id % 5 = 0 THEN 1900 ELSE 2010 END AS year FROM embeddings),
m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM c WHERE year >= 2000),
r AS (SELECT year, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS r FROM c, m),
q AS (SELECT quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM r WHERE year >= 2000)
SELECT count(*) AS n_old, count(*) FILTER (r BETWEEN lo AND hi) AS inside, count(*) FILTER (r > hi) AS too_far,
  count(*) FILTER (r < lo) AS too_close FROM r, q WHERE year < 1950
""",
)
def old_vs_modern(spark, d):
    cams = table(spark, d, "embeddings").select(
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")],
        F.when(F.col("vec_id") % 5 == 0, 1900).otherwise(2010).alias("year"),
    )
    return census.old_vs_modern(cams)


@query(
    "majority_label",
    """
SELECT o_custkey AS g, o_orderpriority AS v FROM orders GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) = 1
""",
)
def majority_label(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("v"))
    return neardup.majority(rows, "g", "v")
