"""Weigh the date evidence of an image, and date whole metadata tables.

The candidates of a row are one array of structs; each step is an expression
over that array, kept in a column of its own so that it is computed once. In a
batch the distinct strings of all rows are parsed, once each, and read back from
a dictionary; in a stream a row's are parsed where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.dating.candidate import CANDIDATE, LOW, MEDIUM, VERY_HIGH, strings
from tempora.dating.evidence import (
    FIRST_PHOTO_YEAR,
    PHOTOGRAPHIC,
    classify_medium,
    named_categories,
    parse_categories,
    parse_exif,
    parse_title,
)
from tempora.dating.dictionary import SUBCATEGORY_SCALE, Dictionary, evidence, with_candidates
from tempora.dating.qs import parse_qs
from tempora.dating.text import parse_date_text
from tempora.functions.strings import let
from tempora.functions.interval import INTERVAL, THIS_YEAR, agree, decimal_year, interval, label, mid, overlaps, width
from tempora.plans.materialize import materialize

# Fixed values.
UPLOAD_SLACK = 2 / 365
SCAN_GAP = 5
NARROW_MIN, CONFLICT_MIN = 0.45, 0.5
MODERN_YEAR = 1990
MIN_CREATOR_AGE = 10
PHOTOGRAPHY_INVENTED = 1839.0
PAGE = ("qs", "date_text")


def upload_year(iso: Column) -> Column:
    """Decimal year of the calendar date that an ISO time string names."""
    return decimal_year(F.try_to_date(F.substring(iso, 1, 10), "yyyy-MM-dd"))


def _with_flags(c: Column, *names: str) -> Column:
    return c.withField("flags", F.array_union(c["flags"], strings(*names)))


def resolve(
    df: DataFrame,
    candidates: str = "candidates",
    upload: str = "upload_time",
    hint: str = "historical_hint",
    floor: str = "floor_year",
    ceiling: str = "ceiling_year",
    artwork: str = "artwork",
) -> DataFrame:
    """Add column `result`: struct(interval, confidence, source, precision, flags, kept, digitized)."""
    c = F.col
    is_exif = lambda x: x["source"] == "exif"
    is_page = lambda x: x["source"].isin(*PAGE)
    bound = lambda x: x["precision"] == "bound"
    has = lambda x, f: F.array_contains(x["flags"], f)
    empty = strings()

    # What lies after the upload, or outside the bounds known for the work, is cut off.
    out = df.withColumn("_up", upload_year(c(upload)))
    cap = F.least(c(ceiling).cast("double"), c("_up") + 1 / 365)
    cut = lambda x: F.struct(
        F.greatest(x["lo"], c(floor).cast("double")).alias("lo"), F.least(x["hi"], c("_cap")).alias("hi")
    )
    out = out.withColumn("_cap", cap).withColumn(
        "_cut", F.transform(c(candidates), lambda x: F.struct(x.alias("c"), cut(x).alias("i")))
    )
    possible = lambda p: p["i"]["lo"] < p["i"]["hi"]
    same = lambda p: (p["i"]["lo"] == p["c"]["lo"]) & (p["i"]["hi"] == p["c"]["hi"])
    clipped = lambda p: p["c"].withField("lo", p["i"]["lo"]).withField("hi", p["i"]["hi"]).withField(
        "flags", F.concat(p["c"]["flags"], strings("clipped"))
    )
    out = out.withColumn(
        "_f1",
        F.transform(
            F.filter(c("_cut"), lambda p: ~possible(p)), lambda p: F.concat(F.lit("impossible:"), p["c"]["source"])
        ),
    ).withColumn(
        "_k1",
        F.transform(F.filter(c("_cut"), possible), lambda p: F.when(same(p), p["c"]).otherwise(clipped(p))).cast(
            f"array<{CANDIDATE}>"
        ),
    )

    # The upload day given as the date of an old image, and explicit upload dates.
    old = c(hint) | F.exists(
        c("_k1"),
        lambda x: (x["hi"] <= MODERN_YEAR) & (x["confidence"] >= NARROW_MIN) & ~bound(x) & ~is_exif(x) & ~is_page(x),
    )
    near = lambda x: (x["precision"] == "day") & (F.abs(x["lo"] - c("_up")) <= UPLOAD_SLACK)
    typed = lambda x: is_page(x) & near(x) & ~F.exists(c("_cam"), lambda e: agree(e, x))
    out = (
        out.withColumn("_cam", F.filter(c("_k1"), lambda x: is_exif(x) & (F.size(x["flags"]) == 0)))
        .withColumn("_typed", F.coalesce(c("_up").isNotNull() & old & F.exists(c("_k1"), typed), F.lit(False)))
        .withColumn(
            "_k2",
            F.when(
                c("_typed"),
                F.filter(c("_k1"), lambda x: ~(typed(x) | ((x["source"] == "category") & near(x)))),
            ).otherwise(c("_k1")),
        )
        .withColumn("_plain", F.filter(c("_k2"), lambda x: ~has(x, "upload_date")))
        .withColumn("_drop", (F.size("_plain") > 0) & (F.size("_plain") < F.size("_k2")))
        .withColumn("_k3", F.when(c("_drop"), c("_plain")).otherwise(c("_k2")))
    )

    # EXIF dates that are those of a scan or a reproduction, or of an unset clock.
    aged = F.transform(
        F.filter(
            c("_k3"),
            lambda x: ~is_exif(x)
            & (((x["confidence"] >= MEDIUM) & ~bound(x)) | (is_page(x) & has(x, "open_start"))),
        ),
        lambda x: x["hi"],
    )
    unset = lambda x: is_exif(x) & has(x, "placeholder")
    scan = lambda x: (
        is_exif(x)
        & ~has(x, "placeholder")
        & (c(artwork) | has(x, "scanner") | F.coalesce(c("_aged") + SCAN_GAP <= x["lo"], F.lit(False)))
    )
    out = (
        out.withColumn("_aged", F.array_min(aged))
        .withColumn("_scan", F.filter(c("_k3"), scan))
        .withColumn("_f3", F.transform(
            F.filter(c("_k3"), lambda x: unset(x) | scan(x)),
            lambda x: F.when(unset(x), "exif_placeholder").otherwise("exif_is_digitization"),
        ))
        .withColumn("kept", F.filter(c("_k3"), lambda x: ~(unset(x) | scan(x))))
        .withColumn("_f", F.concat(
            c("_f1"),
            F.when(c("_typed"), strings("date_is_upload_date")).otherwise(empty),
            F.when(c("_drop"), strings("dropped_upload_date_text")).otherwise(empty),
            c("_f3"),
        ))
    )

    # The best candidate, narrowed by what is consistent with it, in rank order.
    ranked = F.transform(
        F.array_sort(F.transform(c("kept"), lambda x, i: F.struct(
            (-x["confidence"]).alias("a"), (x["hi"] - x["lo"]).alias("b"), i.alias("i")
        ))),
        lambda k: F.get(c("kept"), k["i"]),
    )
    out = out.withColumn("_r", ranked).withColumn("_best", F.get("_r", F.lit(0)))
    start = F.struct(
        c("_best.lo").alias("lo"), c("_best.hi").alias("hi"), c("_best.confidence").alias("s"), empty.alias("f")
    )

    def narrow(acc: Column, x: Column) -> Column:
        lo, hi = F.greatest(acc["lo"], x["lo"]), F.least(acc["hi"], x["hi"])
        fit = ((x["confidence"] >= NARROW_MIN) | bound(x)) & overlaps(acc, x) & (hi - lo < acc["hi"] - acc["lo"])
        sure = F.when(bound(x), acc["s"]).otherwise(F.least(acc["s"], (acc["s"] + x["confidence"]) / 2 + 0.1))
        return F.when(
            fit,
            F.struct(
                lo.alias("lo"), hi.alias("hi"), sure.alias("s"),
                F.concat(acc["f"], F.array(F.concat(F.lit("narrowed_by:"), x["source"]))).alias("f"),
            ),
        ).otherwise(acc)

    others = F.slice("_r", 2, 100_000)
    clean = F.filter(c("kept"), lambda x: is_exif(x) & (F.size(x["flags"]) == 0))
    pages = F.filter(c("kept"), is_page)
    out = (
        out.withColumn("_others", others)
        .withColumn("_n", F.aggregate("_others", start, narrow))
        .withColumn("_clean", clean)
        .withColumn("_confirmed", F.exists(pages, lambda p: F.exists(c("_clean"), lambda e: agree(e, p))))
    )

    # What disagrees with the result.
    begin = F.struct(
        F.when(c("_confirmed"), F.greatest(c("_n.s"), F.lit(VERY_HIGH))).otherwise(c("_n.s")).alias("s"),
        F.concat(c("_n.f"), F.when(c("_confirmed"), strings("exif_agrees")).otherwise(empty)).alias("f"),
    )

    def doubt(acc: Column, x: Column) -> Column:
        named = lambda kind: F.concat(F.lit(kind), x["source"])
        serious = x["confidence"] >= c("_best.confidence") - 0.15
        return (
            F.when(agree(x, c("_n")), acc)
            .when(
                x["confidence"] >= CONFLICT_MIN,
                F.struct(
                    F.when(serious, acc["s"] * 0.6).otherwise(acc["s"]).alias("s"),
                    F.concat(
                        acc["f"], F.array(named("conflict:")), F.when(serious, strings("needs_review")).otherwise(empty)
                    ).alias("f"),
                ),
            )
            .when(
                x["confidence"] >= LOW,
                F.struct(acc["s"].alias("s"), F.concat(acc["f"], F.array(named("weak_conflict:"))).alias("f")),
            )
            .otherwise(acc)
        )

    out = out.withColumn("_d", F.aggregate("_others", begin, doubt))
    some = F.size("kept") > 0
    last_scan = F.element_at("_scan", -1)
    result = F.struct(
        F.when(some, interval(c("_n.lo"), c("_n.hi"))).cast(INTERVAL).alias("interval"),
        F.when(some, F.round(c("_d.s"), 3)).otherwise(0.0).alias("confidence"),
        c("_best.source").alias("source"),
        c("_best.precision").alias("precision"),
        F.when(some, F.array_sort(F.array_distinct(F.concat("_f", "_d.f")))).otherwise(c("_f")).alias("flags"),
        c("kept").alias("kept"),
        F.when(F.size("_scan") > 0, interval(last_scan["lo"], last_scan["hi"])).cast(INTERVAL).alias("digitized"),
    )
    return out.select(*df.columns, result.alias("result"))


def gather_candidates(max_year: int = THIS_YEAR) -> Column:
    """The evidence of an image_metadata row, in source order."""
    c = F.col
    spaced = lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    direct = F.transform(c("categories"), spaced)
    extra = let(
        direct,
        lambda have: F.filter(F.coalesce(c("subcats"), strings()), lambda s: ~F.array_contains(have, spaced(s))),
    )
    named = F.concat(
        named_categories(c("categories")), named_categories(extra, "subcategory", SUBCATEGORY_SCALE)
    )
    visible = F.when(c("date_source") == "commons-desc-page", parse_date_text(c("date_text"), max_year=max_year))
    page = let(parse_qs(c("date_qs"), max_year), lambda q: F.coalesce(q, visible))
    return F.array_compact(
        F.concat(
            F.array(page, parse_exif(c("exif"))),
            parse_categories(named, max_year),
            F.array(parse_title(c("title"), max_year)),
        )
    )


def date_images(meta: DataFrame, max_year: int = THIS_YEAR, dictionary: str | None = None) -> DataFrame:
    """The dates table of a metadata table: one row per file.

    meta: scene_id, file_key, title, date_text, date_qs, date_source, exif map,
    categories, subcats, object_name, license, credit, upload_time, artist_born,
    artist_died. dictionary: a folder that keeps what strings of earlier batches
    say; without it a batch has its own.
    """
    c = F.col
    medium = classify_medium(c("categories"), c("title"), c("object_name"), c("exif"), c("license"), c("credit")).alias("m")
    own = ("scene_id", "file_key", "upload_time", "artist_born", "artist_died")
    if meta.isStreaming:
        rows = meta.select(*own, medium, gather_candidates(max_year).alias("candidates"))
    else:
        # The few columns that dating needs, written once, so that a row keeps its number when a task runs again.
        narrow = meta.select(
            *own, medium, parse_exif(c("exif")).alias("exif"), evidence().alias("evidence"), F.monotonically_increasing_id().alias("row")
        )
        narrow = materialize(narrow, "dating-rows")
        values = narrow.select(F.explode("evidence").alias("e")).select("e.kind", "e.value")
        rows = with_candidates(narrow, Dictionary(meta.sparkSession, dictionary, max_year).extended(values))
    photo = c("m.medium").isin(*PHOTOGRAPHIC)
    alive = c("artist_born") + MIN_CREATOR_AGE
    rows = (
        rows.withColumn("artwork", ~photo & (c("m.medium") != "unknown"))
        .withColumn(
            "floor_year",
            F.when(c("artist_died").isNotNull(), F.greatest(F.when(photo, FIRST_PHOTO_YEAR), alive)).otherwise(
                F.when(photo, FIRST_PHOTO_YEAR)
            ).cast("double"),
        )
        .withColumn("ceiling_year", F.when(c("artist_born").isNotNull(), c("artist_died") + 1).cast("double"))
        .withColumn("historical_hint", c("m.historical_hint") | c("artwork"))
    )
    r = resolve(rows)
    i = c("result.interval")
    ancient = (c("m.medium") == "unknown") & F.coalesce(i["hi"] <= PHOTOGRAPHY_INVENTED, F.lit(False))
    said = F.transform(
        c("result.kept"),
        lambda x: F.concat(x["source"], F.lit(":"), label(x), F.lit("@"), x["confidence"].cast("string")),
    )
    return r.select(
        "scene_id",
        "file_key",
        i["lo"].alias("date_lo"),
        i["hi"].alias("date_hi"),
        mid(i).alias("date_mid"),
        width(i).alias("date_width"),
        c("result.confidence").alias("date_confidence"),
        c("result.source").alias("date_source"),
        c("result.precision").alias("date_precision"),
        c("result.flags").alias("date_flags"),
        c("result.digitized.lo").alias("digitized_year"),
        F.size("result.kept").alias("n_candidates"),
        F.array_join(said, "; ").alias("candidates"),
        F.when(ancient, "artwork").otherwise(c("m.medium")).alias("medium"),
        F.when(ancient, "predates photography").otherwise(c("m.evidence")).alias("medium_evidence"),
        c("m.color").alias("color_hint"),
        c("m.historical_hint").alias("historical_hint"),
    )
