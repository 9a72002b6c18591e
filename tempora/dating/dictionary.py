"""A dictionary of date evidence: every distinct string is parsed once.

Images repeat their evidence: categories, date templates and visible dates name
the same days again and again. Their distinct strings are kept with what they
say, keyed by kind and a hash of the string; a later batch adds only the strings
that an anti-join does not find, and rows get their readings back by a join, on
the hash and the string itself. What travels are row numbers and strings, not
rows; a dictionary of few strings is broadcast, and a common string of a large
one is split by adaptive execution.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.dating.candidate import CANDIDATE, strings
from tempora.dating.evidence import parse_category, parse_title
from tempora.dating.qs import parse_qs
from tempora.dating.text import parse_date_text
from tempora.functions.interval import THIS_YEAR
from tempora.plans.materialize import broadcast_if_small, materialize

ENTRY = f"kind string, h long, value string, found {CANDIDATE}"
PARSERS = {
    "qs": parse_qs,
    "text": lambda c, max_year: parse_date_text(c, max_year=max_year),
    "category": lambda c, max_year: parse_category(c, max_year=max_year),
    "title": parse_title,
}


@functools.lru_cache(maxsize=8)
def _reading(gateway: int, max_year: int) -> Column:
    """What `value` says as evidence of its `kind`: a large expression, built once for a JVM and year."""
    out = F.lit(None)
    for kind, parse in PARSERS.items():
        out = F.when(F.col("kind") == kind, parse(F.col("value"), max_year)).otherwise(out)
    return out.cast(CANDIDATE).alias("found")


def parsed(values: DataFrame, max_year: int = THIS_YEAR) -> DataFrame:
    """ENTRY for rows (kind, value)."""
    reading = _reading(id(values.sparkSession.sparkContext._gateway), max_year)
    return values.select("kind", F.xxhash64("value").alias("h"), "value", reading)


class Dictionary:
    """Entries in one folder of files, for one last year; it has one writer at a time.

    Without a path the entries of a batch lie in the shared folder, as long as its intermediates do.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, max_year: int = THIS_YEAR):
        self.spark, self.max_year = spark, max_year
        self.path = f"{path.rstrip('/')}/max_year={max_year}" if path else None

    def entries(self) -> DataFrame:
        """All entries of the folder; none before the first batch."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(ENTRY).parquet(self.path) if there else self.spark.createDataFrame([], ENTRY)

    def extended(self, values: DataFrame) -> DataFrame:
        """The entries of all values (kind, value; repeated ones), after those that are new were parsed and added."""
        distinct = values.where("value is not null").distinct()
        if self.path is None:
            return materialize(parsed(distinct, self.max_year), "evidence")
        known = self.entries().select("kind", "value", "h")
        new = distinct.withColumn("h", F.xxhash64("value")).join(known, ["kind", "value", "h"], "left_anti")
        # Written aside first: a folder cannot be read and added to in one job.
        new = materialize(parsed(new.select("kind", "value"), self.max_year), "evidence-new")
        new.write.mode("append").parquet(self.path)
        return self.entries()


def evidence() -> Column:
    """The strings of an image_metadata row: array of struct(kind, source, scale, value), in the order of weight."""
    c = F.col
    spaced = lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    one = lambda kind, value, source=None, scale=1.0: F.struct(
        F.lit(kind).alias("kind"), F.lit(source or kind).alias("source"), F.lit(scale).alias("scale"), value.alias("value")
    )
    direct = F.transform(c("categories"), spaced)
    extra = F.filter(F.coalesce(c("subcats"), strings()), lambda s: ~F.array_contains(direct, spaced(s)))
    visible = F.when(c("date_source") == "commons-desc-page", c("date_text"))
    return F.filter(
        F.concat(
            F.array(one("qs", c("date_qs")), one("text", visible)),
            F.transform(F.coalesce(c("categories"), strings()), lambda x: one("category", x)),
            F.transform(extra, lambda x: one("category", x, "subcategory", SUBCATEGORY_SCALE)),
            F.array(one("title", c("title"))),
        ),
        lambda e: e["value"] != "",
    )


# Fixed value: what a subcategory's evidence is worth, of a category's.
SUBCATEGORY_SCALE = 0.8


def with_candidates(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (row, evidence, exif candidate, ..), materialised, with `candidates`: what their evidence says, in its order.

    The page's own date is that of its template, or else the visible one.
    """
    asked = rows.select("row", F.posexplode("evidence").alias("pos", "e")).select("row", "pos", "e.*", F.xxhash64("e.value").alias("h"))
    said = entries.where("found is not null")
    # What a string of a category says is worth less where it is a subcategory's.
    scaled = F.when(
        F.col("kind") == "category",
        F.col("found").withField("source", F.col("source")).withField("confidence", F.round(F.col("found.confidence") * F.col("scale"), 3)),
    ).otherwise(F.col("found"))
    answered = asked.join(broadcast_if_small(said), ["kind", "h", "value"]).select("row", F.struct("pos", "kind", scaled.alias("c")).alias("a"))
    each = answered.groupBy("row").agg(F.array_sort(F.collect_list("a")).alias("said"))
    of = lambda *kinds: F.transform(F.filter("said", lambda a: a["kind"].isin(*kinds)), lambda a: a["c"])
    page = F.get(of("qs", "text"), F.lit(0))
    listed = F.array_compact(F.concat(F.array(page, F.col("exif")), of("category"), of("title")))
    none = F.array_compact(F.array("exif"))
    full = rows.drop("evidence").join(each, "row", "left")
    return full.withColumn("candidates", F.when(F.col("said").isNotNull(), listed).otherwise(none)).drop("said", "exif", "row")
