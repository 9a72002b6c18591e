"""Raw page metadata: nested JSON to one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.dating.candidate import group
from tempora.functions.strings import file_key, strip_html, unescape
from tempora.plans.materialize import materialize

PAGE = (
    "struct<pageid:bigint,title:string,imageinfo:array<struct<timestamp:string,width:int,height:int,url:string,"
    "extmetadata:map<string,struct<value:string,source:string>>,"
    "commonmetadata:array<struct<name:string,value:string>>>>>"
)
RAW = f"elements array<map<string,{PAGE}>>"

# EXIF fields kept, the hidden date, the lifespan of a creator.
EXIF_FIELDS = ("DateTimeOriginal", "DateTimeDigitized", "DateTime", "Make", "Model", "Software")
HIDDEN_DATE = "date QS:([^<]*)"
LIFESPAN = 'title="[^"]*\\((?:c\\.\\s*)?(\\d{4})\\s*[-–]\\s*(?:c\\.\\s*)?(\\d{4})\\)"'


def read_raw_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, page: the pages of raw_metadata.json files, gzipped or not.

    Control characters are let through; a file that is no JSON has no pages and
    shows in audit().
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return pages(text)


def pages(text: DataFrame) -> DataFrame:
    parsed = F.from_json("value", RAW, {"allowUnquotedControlChars": "true"})
    every = F.flatten(F.transform(parsed["elements"], F.map_values))
    keep = [c for c in text.columns if c != "value"]
    return text.select(*keep, F.explode(every).alias("page")).where(F.size("page.imageinfo") > 0)


def audit(text: DataFrame) -> DataFrame:
    """Files that are no JSON of the expected shape."""
    parsed = F.from_json("value", RAW, {"allowUnquotedControlChars": "true"})
    return text.where(parsed["elements"].isNull()).drop("value")


def english(value: Column) -> Column:
    """A value that may be a map by language: English, else the first."""
    langs = F.from_json(value, "map<string,string>")
    named = F.map_filter(langs, lambda k, _: ~k.startswith("_"))
    best = F.coalesce(F.element_at(named, "en"), F.get(F.map_values(named), F.lit(0)), F.lit(""))
    return F.when(value.startswith("{") & langs.isNotNull(), best).otherwise(value)


def parse_pages(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The image_metadata columns of `page` rows."""
    info = F.col("page.imageinfo")[0]
    ext = lambda key: F.element_at(info["extmetadata"], key)
    raw = lambda key: F.coalesce(ext(key)["value"], F.lit(""))
    text = lambda key: strip_html(english(raw(key)))
    title = F.regexp_replace("page.title", "^File:", "")
    kept = F.filter(
        F.coalesce(info["commonmetadata"], F.array().cast("array<struct<name:string,value:string>>")),
        lambda x: x["name"].isin(*EXIF_FIELDS) & x["value"].isNotNull(),
    )
    # Of a repeated field the last counts.
    exif = F.map_from_entries(
        F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, i + 2, 10_000), lambda y: y["name"] == x["name"]))
    )
    hidden = raw("DateTimeOriginal")
    return df.select(
        *[F.col(c) for c in (keep or [])],
        F.col("page.pageid").alias("pageid"),
        title.alias("title"),
        file_key(title).alias("file_key"),
        F.coalesce(info["timestamp"], F.lit("")).alias("upload_time"),
        F.coalesce(info["width"], F.lit(0)).alias("width"),
        F.coalesce(info["height"], F.lit(0)).alias("height"),
        text("DateTimeOriginal").alias("date_text"),
        F.trim(group(F.when(hidden.contains("&"), unescape(hidden)).otherwise(hidden), HIDDEN_DATE)).alias("date_qs"),
        F.coalesce(ext("DateTimeOriginal")["source"], F.lit("")).alias("date_source"),
        F.filter(F.split(raw("Categories"), "\\|"), lambda c: c != "").alias("categories"),
        text("ObjectName").alias("object_name"),
        F.substring(text("ImageDescription"), 1, 2000).alias("description"),
        text("Artist").alias("artist"),
        group(raw("Artist"), LIFESPAN, 1).cast("int").alias("artist_born"),
        group(raw("Artist"), LIFESPAN, 2).cast("int").alias("artist_died"),
        F.substring(text("Credit"), 1, 500).alias("credit"),
        text("LicenseShortName").alias("license"),
        exif.alias("exif"),
        F.coalesce(info["url"], F.lit("")).alias("url"),
    )


def harvest(records: DataFrame) -> DataFrame:
    """One row per (scene_id, file_key): the first by subcat and place, and all its subcats.

    records: scene_id, subcat, pos and the metadata columns. The minimum is
    pre-aggregated, so a file under many paths costs one row a task.
    """
    rest = [c for c in records.columns if c not in ("scene_id", "file_key", "subcat", "pos")]
    return (
        records.groupBy("scene_id", "file_key")
        .agg(
            F.min_by(F.struct(*rest), F.struct("subcat", "pos")).alias("r"),
            F.array_sort(F.collect_set("subcat")).alias("subcats"),
        )
        .select("scene_id", "file_key", *[f"r.{c}" for c in rest], "subcats")
    )


def flatten_exif(df: DataFrame) -> DataFrame:
    """Flat exif_* columns in place of the map."""
    return df.select(
        *[c for c in df.columns if c != "exif"],
        *[F.element_at("exif", f).alias(f"exif_{f}") for f in EXIF_FIELDS],
    )


def gather_exif(df: DataFrame) -> DataFrame:
    """The inverse of flatten_exif; absent fields stay absent."""
    entries = F.array(*[F.struct(F.lit(f).alias("k"), F.col(f"exif_{f}").alias("v")) for f in EXIF_FIELDS])
    exif = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return df.withColumn("exif", exif).drop(*[f"exif_{f}" for f in EXIF_FIELDS])


def _doubled(rows: DataFrame, name: str) -> DataFrame:
    """node, at, more: every pointer moved as far again; more is false where it had reached an end."""
    ahead = rows.select(F.col("node").alias("at"), F.col("at").alias("ahead"))
    moved = rows.select("node", "at").join(ahead, "at", "left")
    return materialize(
        moved.select("node", F.coalesce("ahead", "at").alias("at"), F.col("ahead").isNotNull().alias("more")), name
    )


def _ends(step: DataFrame) -> tuple[DataFrame, int]:
    """(node, at, more; number of rows with more): where the steps from each node end.

    Rounds grow with the logarithm of the longest chain. While a chain is
    unfinished each round finishes some node of it; once a round finishes none,
    the rows left with `more` lead into cycles.
    """
    rows, before = step, None
    while True:
        rows = _doubled(rows, "aliases")
        left = rows.where("more").count()
        if left in (0, before):
            return rows, left
        before = left


def _cycle_ends(step: DataFrame, rows: DataFrame, ends: str) -> DataFrame:
    """node, at for the nodes that lead into cycles (rows)."""
    # What 2^k steps reach shrinks to the nodes on cycles and then no more.
    n, before = rows.select("at").distinct().count(), None
    while n != before:
        rows, before = _doubled(rows, "alias-cycles"), n
        n = rows.select("at").distinct().count()
    ring = materialize(rows.select(F.col("at").alias("node")).distinct(), "alias-ring")
    steps = step.join(rows.select("node"), "node", "left_semi")
    tails, _ = _ends(steps.join(ring, "node", "left_anti"))
    entry = tails.select("node", "at").unionByName(ring.select("node", F.col("node").alias("at")))
    if ends == "first":
        return entry
    last = steps.join(ring, "node", "left_semi").select(F.col("node").alias("last"), "at")
    return entry.join(last, "at").select("node", F.col("last").alias("at"))


def resolve_aliases(requested: DataFrame, edges: DataFrame, pages: DataFrame, ends: str = "first") -> DataFrame:
    """title, final, found: follow renamings (src -> dst), however many, to a page.

    A cycle ends at the title that is repeated first, or, with ends="last", at the
    one before it. Each round is an equi-join written to the shared folder.
    """
    if ends not in ("last", "first"):
        raise ValueError(f"ends must be last or first, not {ends}")
    step = edges.where("src is not null and dst is not null").groupBy("src").agg(F.max("dst").alias("at"))
    step = materialize(step.withColumnRenamed("src", "node"), "alias-steps")
    rows, left = _ends(step)
    out = rows.select("node", "at")
    if left:
        out = rows.where("not more").select("node", "at").unionByName(_cycle_ends(step, rows.where("more"), ends))
    out = requested.select("title").join(out.withColumnRenamed("node", "title"), "title", "left")
    out = out.select("title", F.coalesce("at", "title").alias("final"))
    have = pages.select(F.col("title").alias("final")).distinct().withColumn("found", F.lit(True))
    return out.join(have, "final", "left").select("title", "final", F.coalesce("found", F.lit(False)).alias("found"))
