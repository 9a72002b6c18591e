"""The year engine: inclusive integer years, confidence by wording and place.

Kept apart from the interval engine: types, bounds and rules differ on purpose.
An estimate is struct(start, end, confidence, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.dating.candidate import group, number
from tempora.functions.strings import let, stable_hash

MIN_YEAR, MAX_YEAR = 1500, 2100
# Confidence by wording, weight by place.
WORDING = {
    "full_date": 0.95, "month_year": 0.9, "year_labeled": 0.8, "range": 0.7,
    "circa": 0.6, "decade": 0.6, "century": 0.4, "bare_year": 0.5,
}
PLACE = {
    "date_field": 1.0, "structured_data": 1.0, "category": 0.95,
    "filename": 0.85, "description": 0.8, "exif": 0.7,
}
OTHER_PLACE = 0.8
NOT_CAPTURE, BROKEN_CLOCK = 0.4, 0.2
EARLIEST_DIGITAL = 1995

# Patterns over lower-cased text.
Y = "(?<!\\d)(1[5-9]\\d{2}|20\\d{2})(?!\\d)"
MONTHS = (
    "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|"
    "january|february|march|april|june|july|august|september|october|november|december"
)
ISO = Y + "[-:/](0?[1-9]|1[0-2])[-:/](0?[1-9]|[12]\\d|3[01])(?!\\d)"
DAY_FIRST = f"(?U)\\b\\d{{1,2}}\\s+(?:{MONTHS})\\.?,?\\s+{Y}"
MONTH_FIRST = f"(?U)\\b(?:{MONTHS})\\.?\\s+\\d{{1,2}},?\\s+{Y}"
MONTH_YEAR = f"(?U)\\b(?:{MONTHS})\\.?\\s+{Y}"
BETWEEN = f"(?U)between\\s+{Y}\\s+and\\s+{Y}"
DASH = f"(?U){Y}\\s*(?:-|–|—|to)\\s*{Y}"
CIRCA = f"(?U)\\b(?:circa|ca|c)\\.?\\s*{Y}"
DECADE = "(?U)\\b(early|mid|late)?[\\s-]*(1[5-9]\\d0|20[0-2]0)'?s\\b"
CENTURY = "(?U)\\b(early|mid|late)?[\\s-]*(1[6-9]|20|21)(?:st|nd|rd|th)[\\s-]+century"
LABELED = f"(?U)\\b(?:taken|photographed|photo|negative|built|in|dated|from)\\s+(?:in\\s+)?{Y}"
NOT_CAPTURE_CUE = "(?iU)\\b(upload\\w*|scan\\w*|digiti[sz]ed)\\b"
CLOCK = "\\d{1,2}:\\d{2}"

ESTIMATE = "struct<start:int,end:int,confidence:double,source:string>"


def make(start: Column, end: Column, wording: str, source: str) -> Column:
    """The estimate; null if out of range or reversed. The product is rounded in Python."""
    sure = round(WORDING[wording] * PLACE.get(source, OTHER_PLACE), 3)
    return F.when(
        (start >= MIN_YEAR) & (end <= MAX_YEAR) & (start <= end),
        F.struct(
            start.cast("int").alias("start"), end.cast("int").alias("end"),
            F.lit(sure).alias("confidence"), F.lit(source).alias("source"),
        ),
    ).cast(ESTIMATE)


def midpoint(e: Column) -> Column:
    return (e["start"] + e["end"] + 1) / 2


def sample_year(e: Column, row: Column, draw: Column | int = 0, seed: int = 0) -> Column:
    """A decimal year inside the estimate, evenly drawn: from its first day to the end of its last year.

    The draw is a hash of (seed, row, draw) alone, so it is the same on any partitioning and can be had again; null
    without an estimate or a row.
    """
    draw = draw if isinstance(draw, Column) else F.lit(draw)
    share = stable_hash(F.concat_ws(":", F.lit(seed), row, draw)) / F.lit(float(1 << 48))
    return F.when(row.isNotNull(), e["start"] + share * (e["end"] + 1 - e["start"]))


def parse_text(text: Column, source: str) -> Column:
    """The first pattern found decides, even if its years are out of range."""

    def rules(t: Column) -> Column:
        year = lambda p, n=1: number(t, p, n)
        one = lambda p, wording: let(year(p), lambda y: make(y, y, wording, source))
        span = lambda p: let(
            F.struct(year(p, 1).alias("a"), year(p, 2).alias("b")),
            lambda s: F.when(s["a"] <= s["b"], F.struct(make(s["a"], s["b"], "range", source).alias("e"))),
        )
        part = lambda p, parts, wording: let(  # noqa: E731  a decade or century, or a named part of it
            F.struct(F.regexp_extract(t, p, 1).alias("q"), year(p, 2).alias("y")),
            lambda s: make(*parts(s["q"], s["y"]), wording, source),
        )
        pick = lambda q, early, mid, late, whole: (
            F.when(q == "early", early).when(q == "mid", mid).when(q == "late", late).otherwise(whole)
        )
        decade = lambda q, d: (d + pick(q, 0, 3, 6, 0), d + pick(q, 3, 6, 9, 9))
        century = lambda q, c: (
            (c - 1) * 100 + pick(q, 0, 33, 66, 0), (c - 1) * 100 + pick(q, 33, 66, 99, 99)
        )

        def later(ranges: Column) -> Column:
            """A range in order decides; a reversed one is passed over."""
            return (
                F.when(ranges.isNotNull(), ranges["e"])
                .when(t.rlike(CIRCA), let(year(CIRCA), lambda y: make(y - 5, y + 5, "circa", source)))
                .when(t.rlike(DECADE), part(DECADE, decade, "decade"))
                .when(t.rlike(CENTURY), part(CENTURY, century, "century"))
                .when(t.rlike(LABELED), one(LABELED, "year_labeled"))
                .when(t.rlike(Y), one(Y, "bare_year"))
            )

        return (
            F.when(t.rlike(ISO), one(ISO, "full_date"))
            .when(t.rlike(DAY_FIRST), one(DAY_FIRST, "full_date"))
            .when(t.rlike(MONTH_FIRST), one(MONTH_FIRST, "full_date"))
            .when(t.rlike(MONTH_YEAR), one(MONTH_YEAR, "month_year"))
            .otherwise(let(F.coalesce(span(BETWEEN), span(DASH)), later))
        )

    visible = F.get(F.split(text, "(?i)\\s*date\\s+QS:", 2), F.lit(0))
    return F.when(text != "", let(F.replace(F.lower(visible), F.lit("_"), F.lit(" ")), rules))


def parse_field(text: Column) -> Column:
    """The date field: a lone year is explicit; upload cues and broken clocks cost confidence."""

    def rules(t: Column) -> Column:
        alone = t.rlike(f"^(?:{Y})$")
        year = F.when(alone, t.try_cast("int"))

        def adjusted(e: Column) -> Column:
            cue = F.when(t.rlike(NOT_CAPTURE_CUE), NOT_CAPTURE).otherwise(1.0)
            clock = F.when(t.rlike(CLOCK) & (e["start"] < EARLIEST_DIGITAL), BROKEN_CLOCK).otherwise(1.0)
            return F.when(
                e.isNotNull(),
                e.withField("confidence", F.round(F.round(e["confidence"] * cue, 3) * clock, 3)),
            )

        return F.when(alone, make(year, year, "month_year", "date_field")).otherwise(
            let(parse_text(t, "date_field"), adjusted)
        )

    bare = F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", "")
    return F.when(text != "", let(bare, rules))


def parse_exif_time(value: Column) -> Column:
    p = "(?U)^\\s*" + Y + "[:\\-/](\\d{1,2})"
    y = group(value, p).cast("int")
    return make(y, y, "full_date", "exif")


def best(estimates: Column) -> Column:
    """Most confident, then narrowest, then first of an array of estimates."""
    ordered = F.array_sort(
        F.transform(
            F.array_compact(estimates),
            lambda e, i: F.struct(
                (-e["confidence"]).alias("a"), (e["end"] - e["start"]).alias("b"), i.alias("i"), e.alias("e")
            ),
        )
    )
    return F.get(ordered, F.lit(0))["e"]


def estimate_image_year(filename: Column, categories: Column, description: Column, exif: Column, field: Column) -> Column:
    """Field first, then the best of file name, description and categories, then EXIF."""
    said = F.concat(
        F.array(parse_text(filename, "filename"), parse_text(description, "description")),
        F.transform(categories, lambda c: parse_text(c, "category")),
    )
    return F.coalesce(parse_field(field), best(said), parse_exif_time(exif))


def _judged(rows: DataFrame, min_conf: float, min_year: int) -> DataFrame:
    """Add mid, sure (dated, and confident enough) and usable (and photographs existed)."""
    middle = F.when(F.col("date_start").isNotNull(), (F.col("date_start") + F.col("date_end") + 1) / 2)
    r = rows.withColumn("mid", middle)
    sure = F.col("mid").isNotNull() & F.coalesce(F.col("date_conf") >= min_conf, F.lit(False))
    return r.withColumn("sure", sure).withColumn("usable", sure & (F.col("mid") >= min_year))


def usable(rows: DataFrame, min_conf: float = 0.5, min_year: int = 1826) -> DataFrame:
    """The rows that the audit finds usable, with their mid year."""
    return _judged(rows, min_conf, min_year).where("usable").select(*rows.columns, "mid")


def _count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def audit(rows: DataFrame, min_conf: float = 0.5, min_year: int = 1826) -> DataFrame:
    """One row of counts over (title, date_start, date_end, date_conf, date_source)."""
    kept, mid = F.col("usable"), F.col("mid")
    return _judged(rows, min_conf, min_year).agg(
        F.count("*").alias("total"),
        F.count_distinct("title").alias("titles"),
        _count(mid.isNotNull(), "dated"),
        _count(F.col("sure"), "confident"),
        _count(kept, "usable"),
        _count(kept & (mid < 1900), "pre_1900"),
        _count(kept & (mid < 1950), "pre_1950"),
        _count(kept & (mid < 1970), "pre_1970"),
        _count(kept & (mid >= 2000), "post_2000"),
    )


def audit_drops(rows: DataFrame, min_conf: float = 0.5, min_year: int = 1826) -> DataFrame:
    """One row: what each stage of the audit drops, and rows that repeat a title."""
    dated, sure = F.col("mid").isNotNull(), F.col("sure")
    return _judged(rows, min_conf, min_year).agg(
        _count(~dated, "undated"),
        _count(dated & ~sure, "low_conf_dropped"),
        _count(sure & ~F.col("usable"), "pre_photo_dropped"),
        (F.count("*") - F.count_distinct("title")).alias("duplicate_rows"),
    )


def audit_sources(rows: DataFrame, min_conf: float = 0.5, min_year: int = 1826) -> DataFrame:
    """date_source, n, usable: the dated rows of each source."""
    judged = _judged(rows, min_conf, min_year).where("mid is not null")
    return judged.groupBy("date_source").agg(F.count("*").alias("n"), _count(F.col("usable"), "usable"))


def decade_histogram(rows: DataFrame, min_conf: float = 0.5, min_year: int = 1826) -> DataFrame:
    """decade, n of the usable rows."""
    decade = (F.floor(F.col("mid") / 10) * 10).cast("long").alias("decade")
    return usable(rows, min_conf, min_year).groupBy(decade).agg(F.count("*").alias("n"))


def oldest(rows: DataFrame, n: int = 15, min_conf: float = 0.5, min_year: int = 1826) -> DataFrame:
    """The n oldest usable rows by mid year: a top-k report."""
    return usable(rows, min_conf, min_year).orderBy("mid", "title").limit(n)
