"""Date evidence on generated strings.

Each string is written from an order's date, or its key, in a known form, and
parsed; the SQL works out the expected interval from the date itself, so it
shares nothing with the parsers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.dating import evidence, years
from tempora.dating.qs import parse_qs
from tempora.dating.resolve import date_images
from tempora.dating.text import parse_date_text
from tempora.functions import interval as iv
from tempora.functions.geometry import date_features
from tempora.queries.registry import query
from tempora.session import table

LAST = 2025
DAY = "CAST(o_orderdate AS DATE)"
DY = "(year({0}) + (dayofyear({0}) - 1) / dayofyear(make_date(year({0}), 12, 31)))"
Y = f"year({DAY})"
MONTH_LO = DY.format(f"CAST(date_trunc('month', {DAY}) AS DATE)")
MONTH_HI = DY.format(f"CAST(date_trunc('month', {DAY}) + INTERVAL 1 MONTH AS DATE)")
DAY_LO, DAY_HI = DY.format(DAY), DY.format(f"CAST({DAY} + INTERVAL 1 DAY AS DATE)")


def _orders(spark, d) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", day.alias("day"), F.year(day).alias("y")
    )


def _form(n: int, *forms: Column) -> Column:
    k = F.pmod("o_orderkey", F.lit(n))
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        out = F.when(k == i, f).otherwise(out)
    return out


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _year(shift: int = 0) -> Column:
    return (F.col("y") + shift).cast("string")


def _shown(df: DataFrame, c: Column, *keep: str) -> DataFrame:
    return df.withColumn("c", c).select(
        *keep, F.round("c.lo", 6).alias("lo"), F.round("c.hi", 6).alias("hi"),
        F.col("c.precision").alias("precision"), F.col("c.confidence").alias("confidence"),
        F.array_join("c.flags", ",").alias("flags"),
    )


def _cases(n: int, *cases: tuple) -> str:
    """SQL of expected (lo, hi, precision, confidence, flags) by o_orderkey % n; None for no candidate."""
    pick = lambda i: " ".join(
        f"WHEN {k} THEN {'NULL' if c is None else c[i]}" for k, c in enumerate(cases)
    )
    cols = ("lo", "hi", "precision", "confidence", "flags")
    return ", ".join(
        (
            f"round(CAST(CASE o_orderkey % {n} {pick(i)} END AS DOUBLE), 6)"
            if i in (0, 1, 3)
            else f"CASE o_orderkey % {n} {pick(i)} END"
        )
        + f" AS {c}"
        for i, c in enumerate(cols)
    )


@query(
    "text_date_parse",
    "SELECT o_orderkey, " + _cases(
        12,
        (f"{Y} - 5", f"{Y} + 6", "'year'", "0.85", "'circa'"),
        (Y, f"{Y} + 4", "'range'", "0.85", "''"),
        ("1000", f"{Y} + 1", "'bound'", "0.35", "'open_start'"),
        (Y, str(LAST + 1), "'bound'", "0.35", "'open_end'"),
        (DAY_LO, DAY_HI, "'day'", "0.85", "''"),
        (DAY_LO, DAY_HI, "'day'", "0.85", "''"),
        (MONTH_LO, MONTH_HI, "'month'", "0.85", "''"),
        (f"{Y} // 10 * 10", f"{Y} // 10 * 10 + 10", "'decade'", "0.85", "''"),
        ("1801", "1901", "'century'", "0.85", "''"),
        (Y, f"{Y} + 1", "'year'", "0.85", "'upload_date'"),
        (f"{Y} - 50", f"{Y} + 1", "'range'", "0.35", "'multiple_years'"),
        None,
    ) + " FROM orders",
)
def text_date_parse(spark, d):
    o = _orders(spark, d)
    text = _form(
        12,
        _text("circa ", _year()),
        _text("between ", _year(), " and ", _year(3)),
        _text("before ", _year()),
        _text("after the ", _year()),
        F.date_format("day", "d MMMM yyyy"),
        F.date_format("day", "yyyy-MM-dd"),
        F.date_format("day", "MMMM yyyy"),
        _text((F.floor(F.col("y") / 10) * 10).cast("string"), "s"),
        F.lit("19th century"),
        _text("upload in ", _year()),
        _text(_year(-50), "; ", _year()),
        F.lit("unknown date"),
    )
    return _shown(o, parse_date_text(text, max_year=LAST), "o_orderkey")


@query(
    "qs_parse",
    "SELECT o_orderkey, " + _cases(
        6,
        (f"{Y} - 5", f"{Y} + 6", "'year'", "0.85", "'circa'"),
        (Y, f"{Y} + 4", "'range'", "0.85", "''"),
        (f"{Y} // 10 * 10", f"{Y} // 10 * 10 + 10", "'decade'", "0.85", "''"),
        (DAY_LO, DAY_HI, "'day'", "0.6", "'uncertain'"),
        ("1000", f"{Y} + 1", "'bound'", "0.35", "'open_start'"),
        None,
    ) + " FROM orders",
)
def qs_parse(spark, d):
    o = _orders(spark, d)
    at = lambda code, shift=0: _text("+", _year(shift), f"-00-00T00:00:00Z/{code}")
    text = _form(
        6,
        _text("P571,", at(9), ",P1480,Q5727902"),
        _text("P,", at(7), ",P1319,", at(9), ",P1326,", at(9, 3)),
        _text("P,", at(8)),
        _text("P571,+", F.date_format("day", "yyyy-MM-dd"), "T00:00:00Z/11,P1480,Q56644435"),
        _text("P,", at(7), ",P1326,", at(9)),
        _text("P,-", _year(), "-00-00T00:00:00Z/9"),
    )
    return _shown(o, parse_qs(text, LAST), "o_orderkey")


@query(
    "category_parse",
    "SELECT o_orderkey, " + _cases(
        10,
        (Y, f"{Y} + 1", "'year'", "0.75", "''"),
        (MONTH_LO, MONTH_HI, "'month'", "0.65", "''"),
        (Y, f"{Y} + 1", "'year'", "0.6", "''"),
        (DAY_LO, DAY_HI, "'day'", "0.8", "''"),
        ("1000", Y, "'bound'", "0.35", "'open_start'"),
        (f"{Y} // 10 * 10", f"{Y} // 10 * 10 + 10", "'decade'", "0.45", "'depicted_era'"),
        (Y, f"{Y} + 1", "'year'", "0.55", "'publication'"),
        None,
        (Y, f"{Y} + 1", "'year'", "0.6", "''"),
        (Y, f"{Y} + 3", "'range'", "0.35", "'span'"),
    ) + " FROM orders",
)
def category_parse(spark, d):
    o = _orders(spark, d)
    text = _form(
        10,
        _text(_year(), " photographs of Dresden"),
        _text("Gate in ", F.date_format("day", "MMMM yyyy")),
        _text("Dresden_in_", _year()),
        _text("Photographs taken on ", F.date_format("day", "yyyy-MM-dd")),
        _text("Church (before ", _year(), ")"),
        _text("Paris in the ", (F.floor(F.col("y") / 10) * 10).cast("string"), "s"),
        _text(_year(), " postcards of Dresden"),
        _text("Buildings completed in ", _year()),
        _text("House (1732 building) in ", _year()),
        _text("Siege ", _year(), "-", _year(2)),
    )
    return _shown(o, evidence.parse_category(text, max_year=LAST), "o_orderkey")


@query(
    "title_parse",
    "SELECT o_orderkey, " + _cases(
        5,
        (DAY_LO, DAY_HI, "'day'", "0.35", "''"),
        (f"{Y} - 5", f"{Y} + 6", "'year'", "0.35", "'circa'"),
        (Y, f"{Y} + 1", "'year'", "0.2", "''"),
        None,
        None,
    ) + " FROM orders",
)
def title_parse(spark, d):
    o = _orders(spark, d)
    text = _form(
        5,
        _text("View_", F.date_format("day", "yyyyMMdd"), ".jpg"),
        _text("Church um ", _year(), ".jpg"),
        _text("Tower ", _year(), " east.png"),
        _text("IMG_", _year(), ".jpg"),
        _text("From ", _year(-40), " to ", _year(), ".jpg"),
    )
    return _shown(o, evidence.parse_title(text, LAST), "o_orderkey")


@query(
    "exif_parse",
    "SELECT o_orderkey, " + _cases(
        5,
        (DAY_LO, DAY_HI, "'day'", f"CASE WHEN month({DAY}) = 1 AND day({DAY}) = 1 THEN 0.35 ELSE 0.95 END",
         f"CASE WHEN month({DAY}) = 1 AND day({DAY}) = 1 THEN 'placeholder' ELSE '' END"),
        (DAY_LO, DAY_HI, "'day'", f"CASE WHEN month({DAY}) = 1 AND day({DAY}) = 1 THEN 0.35 ELSE 0.6 END",
         f"CASE WHEN month({DAY}) = 1 AND day({DAY}) = 1 THEN 'scanner,placeholder' ELSE 'scanner' END"),
        (DAY_LO, DAY_HI, "'day'", "0.35",
         f"CASE WHEN month({DAY}) = 1 AND day({DAY}) = 1 THEN 'digitized,placeholder' ELSE 'digitized' END"),
        (DY.format(f"make_date({Y} - 20, 6, 15)"), DY.format(f"make_date({Y} - 20, 6, 16)"), "'day'", "0.35", "'pre_digital'"),
        None,
    ) + " FROM orders",
)
def exif_parse(spark, d):
    o = _orders(spark, d)
    taken = F.date_format("day", "yyyy:MM:dd")
    one = lambda key, value, *more: F.map_from_arrays(
        F.array(F.lit(key), *[F.lit(k) for k, _ in more]), F.array(value, *[F.lit(v) for _, v in more])
    )
    k = F.pmod("o_orderkey", F.lit(5))
    exif = (
        F.when(k == 0, one("DateTimeOriginal", _text(taken, " 10:00:00"), ("Make", "Canon")))
        .when(k == 1, one("DateTimeOriginal", _text(taken, " 10:00:00"), ("Make", "Epson"), ("Model", "Perfection V700")))
        .when(k == 2, one("DateTimeDigitized", taken, ("Make", "Canon")))
        .when(k == 3, one("DateTimeOriginal", _text(_year(-20), ":06:15 10:00:00"), ("Make", "Canon")))
        .otherwise(one("DateTimeOriginal", F.lit("0000:00:00 00:00:00")))
    )
    return _shown(o, evidence.parse_exif(exif), "o_orderkey")


def _meta(spark, d) -> DataFrame:
    """Metadata rows with a known winner, by o_orderkey % 5."""
    o = _orders(spark, d).withColumn("k", F.pmod("o_orderkey", F.lit(5)))
    none = F.lit(None)
    exif_day = _text(F.date_format("day", "yyyy:MM:dd"), " 10:00:00")
    camera = F.map_from_arrays(F.array(F.lit("DateTimeOriginal"), F.lit("Make")), F.array(exif_day, F.lit("Canon")))
    empty = F.create_map().cast("map<string,string>")
    return o.select(
        F.col("o_custkey").alias("scene_id"),
        F.col("o_orderkey").alias("file_key"),
        F.lit("View").alias("title"),
        F.when(F.col("k") == 1, _text("circa ", _year(-60))).when(F.col("k") == 3, F.date_format("day", "yyyy-MM-dd"))
        .otherwise("").alias("date_text"),
        F.when(F.col("k") == 0, _text("P571,+", _year(-80), "-00-00T00:00:00Z/9")).otherwise(none.cast("string")).alias("date_qs"),
        F.lit("commons-desc-page").alias("date_source"),
        F.when(F.col("k").isin(2, 3), camera).otherwise(empty).alias("exif"),
        F.when(F.col("k") == 2, F.array(_text(_year(-70), " photographs of Dresden")))
        .when(F.col("k") == 1, F.array(_text("Dresden in ", _year(-61))))
        .otherwise(F.array().cast("array<string>")).alias("categories"),
        F.array().cast("array<string>").alias("subcats"),
        F.lit("").alias("object_name"), F.lit("").alias("license"), F.lit("").alias("credit"),
        F.lit("2020-05-05T00:00:00Z").alias("upload_time"),
        none.cast("int").alias("artist_born"), none.cast("int").alias("artist_died"),
    )


@query(
    "resolve_dates",
    f"""
SELECT o_orderkey AS file_key,
  round(CASE o_orderkey % 5 WHEN 0 THEN {Y} - 80 WHEN 1 THEN {Y} - 61 WHEN 2 THEN {Y} - 70 WHEN 3 THEN {DAY_LO} END, 6) AS lo,
  round(CASE o_orderkey % 5 WHEN 0 THEN {Y} - 79 WHEN 1 THEN {Y} - 60 WHEN 2 THEN {Y} - 69 WHEN 3 THEN {DAY_HI} END, 6) AS hi,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 0.825 WHEN 2 THEN 0.75
    WHEN 3 THEN CASE WHEN month({DAY}) = 1 AND day({DAY}) = 1 THEN 0.85 ELSE 0.95 END ELSE 0.0 END AS DOUBLE) AS confidence,
  CASE o_orderkey % 5 WHEN 0 THEN 'qs' WHEN 1 THEN 'date_text' WHEN 2 THEN 'category'
    WHEN 3 THEN CASE WHEN month({DAY}) = 1 AND day({DAY}) = 1 THEN 'date_text' ELSE 'exif' END END AS source,
  CASE o_orderkey % 5 WHEN 1 THEN 'narrowed_by:category'
    WHEN 2 THEN CASE WHEN month({DAY}) = 1 AND day({DAY}) = 1 THEN 'exif_placeholder' ELSE 'exif_is_digitization' END
    WHEN 3 THEN CASE WHEN month({DAY}) = 1 AND day({DAY}) = 1 THEN 'exif_placeholder' ELSE 'exif_agrees' END ELSE '' END AS flags,
  CASE o_orderkey % 5 WHEN 2 THEN 'photo' WHEN 3 THEN 'photo' ELSE 'unknown' END AS medium
FROM orders
""",
)
def resolve_dates(spark, d):
    out = date_images(_meta(spark, d), LAST)
    return out.select(
        "file_key", F.round("date_lo", 6).alias("lo"), F.round("date_hi", 6).alias("hi"),
        F.col("date_confidence").alias("confidence"), F.col("date_source").alias("source"),
        F.array_join("date_flags", ",").alias("flags"), "medium",
    )


@query(
    "medium_classify",
    """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'plan' WHEN 1 THEN 'painting' WHEN 2 THEN 'print' WHEN 3 THEN 'drawing'
    WHEN 4 THEN 'postcard' WHEN 5 THEN 'photo' WHEN 6 THEN 'artwork' ELSE 'unknown' END AS medium,
  CASE WHEN p_partkey % 3 = 0 THEN 'bw' ELSE 'unknown' END AS color, p_partkey % 5 = 0 AS historical
FROM part
""",
)
def medium_classify(spark, d):
    kinds = ["Maps of X", "Oil on canvas", "Engravings of X", "Sketches of X", "Postcards of X", "Photographs of X", "X in art", "Views of X"]
    k = F.pmod("p_partkey", F.lit(8)).cast("int")
    parts = table(spark, d, "part").select(
        "p_partkey",
        F.array_compact(F.array(
            F.get(F.array(*[F.lit(x) for x in kinds]), k),
            F.lit("Files with wikidata drawings"),
            F.when(F.col("p_partkey") % 3 == 0, "Black and white views"),
            F.when(F.col("p_partkey") % 5 == 0, "PD-old"),
        )).alias("categories"),
    )
    empty = F.create_map().cast("map<string,string>")
    m = evidence.classify_medium(F.col("categories"), F.lit("View"), F.lit(""), empty, F.lit(""), F.lit(""))
    return parts.withColumn("m", m).select(
        "p_partkey", F.col("m.medium").alias("medium"), F.col("m.color").alias("color"),
        F.col("m.historical_hint").alias("historical"),
    )


LEGACY = """
WITH t AS (SELECT o_orderkey, o_custkey, year(CAST(o_orderdate AS DATE)) AS y, o_orderkey % 9 AS k FROM orders),
e AS (SELECT o_orderkey, o_custkey,
  CASE k WHEN 0 THEN y WHEN 1 THEN y WHEN 2 THEN y - 5 WHEN 3 THEN y // 10 * 10 + 3 WHEN 4 THEN 1866 WHEN 5 THEN y WHEN 6 THEN y - 30 WHEN 7 THEN y END AS s,
  CASE k WHEN 0 THEN y WHEN 1 THEN y + 7 WHEN 2 THEN y + 5 WHEN 3 THEN y // 10 * 10 + 6 WHEN 4 THEN 1899 WHEN 5 THEN y WHEN 6 THEN y - 30 WHEN 7 THEN y END AS t,
  CASE k WHEN 0 THEN 0.95 WHEN 1 THEN 0.7 WHEN 2 THEN 0.6 WHEN 3 THEN 0.6 WHEN 4 THEN 0.4 WHEN 5 THEN 0.9 WHEN 6 THEN 0.19 WHEN 7 THEN 0.38 END AS c
  FROM t)
"""


def legacy_rows(spark, d) -> DataFrame:
    o = _orders(spark, d)
    decade = (F.floor(F.col("y") / 10) * 10).cast("string")
    text = _form(
        9,
        F.date_format("day", "d MMMM yyyy"),
        _text("between ", _year(), " and ", _year(7)),
        _text("c. ", _year()),
        _text("mid ", decade, "s"),
        F.lit("late 19th century"),
        _year(),
        _text(_year(-30), "-01-03 17:00:23"),
        _text(F.date_format("day", "d MMMM yyyy"), " (original upload date)"),
        F.lit("no date here"),
    )
    e = years.parse_field(text)
    return o.withColumn("e", e).select(
        "o_orderkey", F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("title"),
        F.col("e.start").alias("date_start"), F.col("e.end").alias("date_end"), F.col("e.confidence").alias("date_conf"),
        F.col("e.source").alias("date_source"),
    )


@query(
    "sampled_years",
    LEGACY + """
SELECT o_orderkey, CAST(draw AS INTEGER) AS draw, round(s + CAST('0x' || substr(sha1('3:' || o_orderkey || ':' || draw), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * (t + 1 - s), 6) AS year
FROM e, range(3) d(draw)
""",
)
def sampled_years(spark, d):
    """Three decimal years drawn from each estimate."""
    rows = legacy_rows(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(2))))
    e = F.struct(F.col("date_start").alias("start"), F.col("date_end").alias("end"))
    year = years.sample_year(e, F.col("o_orderkey").cast("string"), F.col("draw").cast("string"), 3)
    return rows.select("o_orderkey", "draw", F.round(year, 6).alias("year"))


@query("legacy_year_parse", LEGACY + "SELECT o_orderkey, s AS date_start, t AS date_end, CAST(c AS DOUBLE) AS date_conf FROM e")
def legacy_year_parse(spark, d):
    return legacy_rows(spark, d).drop("title", "date_source")


@query(
    "legacy_audit",
    LEGACY + """, m AS (SELECT *, (s + t + 1) / 2 AS mid FROM e), u AS (SELECT * FROM m WHERE c >= 0.5 AND mid >= 1826)
SELECT count(*) AS total, count(DISTINCT o_custkey) AS titles, count(mid) AS dated, count(*) FILTER (c >= 0.5) AS confident,
  (SELECT count(*) FROM u) AS usable, (SELECT count(*) FROM u WHERE mid < 1900) AS pre_1900,
  (SELECT count(*) FROM u WHERE mid < 1950) AS pre_1950, (SELECT count(*) FROM u WHERE mid < 1970) AS pre_1970,
  (SELECT count(*) FROM u WHERE mid >= 2000) AS post_2000 FROM m""",
)
def legacy_audit(spark, d):
    return years.audit(legacy_rows(spark, d))


@query("decade_histogram", LEGACY + "SELECT CAST(floor((s + t + 1) / 2 / 10) * 10 AS BIGINT) AS decade, count(*) AS n FROM e WHERE c >= 0.5 AND (s + t + 1) / 2 >= 1826 GROUP BY 1")
def decade_histogram(spark, d):
    return years.decade_histogram(legacy_rows(spark, d))


@query(
    "oldest_n",
    LEGACY + "SELECT (s + t + 1) / 2 AS mid, 't' || o_custkey AS title FROM e WHERE c >= 0.5 AND (s + t + 1) / 2 >= 1826 ORDER BY 1, 2 LIMIT 15",
)
def oldest_n(spark, d):
    return years.oldest(legacy_rows(spark, d)).select("mid", "title")


@query(
    "legacy_best_estimate",
    f"""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN {Y} WHEN 1 THEN {Y} - 20 ELSE {Y} - 40 END AS s,
  CASE o_orderkey % 3 WHEN 0 THEN 'date_field' WHEN 1 THEN 'category' ELSE 'exif' END AS source FROM orders
""",
)
def legacy_best_estimate(spark, d):
    o = _orders(spark, d)
    k = F.pmod("o_orderkey", F.lit(3))
    e = years.estimate_image_year(
        F.when(k == 1, _text("Tower ", _year(-30), ".jpg")).otherwise("Tower.jpg"),
        F.when(k == 1, F.array(F.lit("Tower"), _text("Photographed in ", _year(-20)))).otherwise(F.array(F.lit("Tower"))),
        F.lit(""),
        _text(_year(-40), ":06:15 10:00:00"),
        F.when(k == 0, _year()).otherwise(""),
    )
    return o.withColumn("e", e).select("o_orderkey", F.col("e.start").alias("s"), F.col("e.source").alias("source"))


@query(
    "interval_algebra",
    f"""
WITH t AS (SELECT o_orderkey, CAST({Y} AS DOUBLE) AS a_lo, CAST({Y} + 3 AS DOUBLE) AS a_hi, CAST(1990.5 + o_orderkey % 11 AS DOUBLE) AS b_lo, CAST(1992 + o_orderkey % 11 AS DOUBLE) AS b_hi FROM orders)
SELECT o_orderkey, a_lo < b_hi AND b_lo < a_hi AS overlaps,
  CASE WHEN greatest(a_lo, b_lo) < least(a_hi, b_hi) THEN greatest(a_lo, b_lo) END AS lo,
  CASE WHEN greatest(a_lo, b_lo) < least(a_hi, b_hi) THEN least(a_hi, b_hi) END AS hi,
  a_lo - 0.1 < b_hi + 0.1 AND b_lo - 0.1 < a_hi + 0.1 AS agree, (a_lo + a_hi) / 2 AS mid, a_hi - a_lo AS width,
  CASE WHEN a_lo < 1999 THEN CAST(CAST(a_lo AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(least(a_hi, 1999) AS INTEGER) - 1 AS VARCHAR) END AS raw_label
FROM t
""",
)
def interval_algebra(spark, d):
    o = _orders(spark, d)
    k = F.pmod("o_orderkey", F.lit(11))
    a = iv.from_years(F.col("y"), F.col("y") + 2)
    b = iv.interval(1990 + k + 0.5, 1992 + k)
    o = o.withColumn("a", a).withColumn("b", b)
    a, b = F.col("a"), F.col("b")
    both, cut = iv.intersect(a, b), iv.clip(a, F.lit(None).cast("double"), F.lit(1999.0))
    text = iv.label(cut)
    return o.select(
        "o_orderkey", iv.overlaps(a, b).alias("overlaps"), both["lo"].alias("lo"), both["hi"].alias("hi"),
        iv.agree(a, b).alias("agree"), iv.mid(a).alias("mid"), iv.width(a).alias("width"),
        F.when(text.contains("-"), text).otherwise(_text(text, "-", text)).alias("raw_label"),
    )


@query(
    "decimal_year",
    f"SELECT o_orderkey, round({DAY_LO}, 6) AS lo, round({DAY_HI}, 6) AS hi, round({MONTH_LO}, 6) AS m_lo, round({MONTH_HI}, 6) AS m_hi FROM orders",
)
def decimal_year(spark, d):
    o = _orders(spark, d)
    day = iv.from_day(F.year("day"), F.month("day"), F.dayofmonth("day"))
    month = iv.from_month(F.year("day"), F.month("day"))
    return o.select(
        "o_orderkey", F.round(day["lo"], 6).alias("lo"), F.round(day["hi"], 6).alias("hi"),
        F.round(month["lo"], 6).alias("m_lo"), F.round(month["hi"], 6).alias("m_hi"),
    )


@query(
    "date_embedding_features",
    f"""
SELECT o_orderkey, list_transform(list_concat([t], list_transform(range(0, 8), lambda k: sin(t * pow(2, k) * pi())),
   list_transform(range(0, 8), lambda k: cos(t * pow(2, k) * pi()))), lambda v: round(v, 6) + 0.0) AS features
FROM (SELECT o_orderkey, ({Y} - 1900) / 100 AS t FROM orders)
""",
)
def date_embedding_features(spark, d):
    f = F.transform(date_features(F.col("y").cast("double")), lambda v: F.round(v, 6) + 0.0)
    return _orders(spark, d).select("o_orderkey", f.alias("features"))
