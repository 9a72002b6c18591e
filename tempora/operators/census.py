"""Counts over scenes, files, models and eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.plans.materialize import deal_by, materialize
from tempora.plans.ranking import medians, quantiles

# Era names, their first years, and the limits.
ERAS = ("pre-1900", "1900-1944", "1945-1969", "1970-1999", "2000+")
ERA_STARTS = (1900, 1945, 1970, 2000)
UNDATED = "undated"
LABELS = (*ERAS, UNDATED)
MAX_ERA_WIDTH = 30
MIN_MODEL_FILES = 50


def assign_era(mid: Column, width: Column, starts: tuple[int, ...] = ERA_STARTS, names=ERAS) -> Column:
    """Half-open eras; undated where the date is missing or too wide."""
    known = mid.isNotNull() & ~F.isnan(mid) & (width <= MAX_ERA_WIDTH)
    out = F.lit(names[-1])
    for start, name in reversed(list(zip(starts, names, strict=False))):
        out = F.when(mid < start, name).otherwise(out)
    return F.when(known, out).otherwise(UNDATED)


def photographic(medium: Column) -> Column:
    return medium.isin("photo", "postcard", "unknown")


def scene_table(index: DataFrame, categories: DataFrame, recon: DataFrame) -> DataFrame:
    """Per scene: paths, files, subcategories, models and the largest one (the first of ties)."""
    files = materialize(index.select(F.col("cat").alias("scene"), "file_key", "subcat"), "scene-files")
    # Distinct values of either kind are counted where their scene's rows are, in tasks of bounded numbers of rows.
    kind = F.col("kind")
    each = deal_by(files, "scene").withColumn("kind", F.explode(F.array(F.lit("file"), F.lit("subcat"))))
    each = each.groupBy(
        "scene", "kind", F.when(kind == "file", F.col("file_key")).alias("file_key"), F.when(kind == "subcat", F.col("subcat")).alias("subcat")
    ).agg(F.count("*").alias("n"))
    per_scene = each.groupBy("scene").agg(
        F.sum(F.when(kind == "file", F.col("n"))).alias("n_paths"),
        F.count("file_key").alias("n_files"),
        F.count("subcat").alias("n_subcats"),
    )
    per_model = recon.groupBy("scene_id").agg(
        F.count("*").alias("n_models"),
        F.min_by("model", F.struct((-F.col("n_images")).alias("n"), "model")).alias("largest_model"),
        F.max("n_images").alias("largest_model_images"),
        F.sum("n_images").alias("registered_paths"),
    )
    return (
        per_scene.join(categories, "scene", "left")
        .join(per_model, "scene_id", "left")
        .fillna(0, ["n_models", "largest_model_images", "registered_paths"])
    )


def select_scenes(scenes: DataFrame, names: list[str] | None = None, top: int = 0, min_model_images: int = 0) -> DataFrame:
    """By name or number, else the largest with a large enough model (all for top=0)."""
    if names:
        return scenes.where(F.col("scene").isin(names) | F.col("scene_id").cast("string").isin(names))
    big = scenes.where(F.col("largest_model_images") >= min_model_images).orderBy(F.desc("n_files"), "scene")
    return big.limit(top) if top else big


def unknown_scenes(scenes: DataFrame, names: list[str]) -> DataFrame:
    """The asked names that are neither a scene nor a number of one."""
    asked = scenes.sparkSession.createDataFrame([(n,) for n in names], "name string")
    known = scenes.select(F.explode(F.array("scene", F.col("scene_id").cast("string"))).alias("name"))
    return asked.join(known, "name", "left_anti")


def load_files(meta: DataFrame, dates: DataFrame, poses: DataFrame) -> DataFrame:
    """meta with dates, the models that hold the file, era and flags."""
    models = poses.groupBy("scene_id", "file_key").agg(F.array_sort(F.collect_set("model")).alias("models"))
    return (
        meta.join(dates, ["scene_id", "file_key"], "left")
        .join(models, ["scene_id", "file_key"], "left")
        .withColumn("models", F.coalesce("models", F.array().cast("array<int>")))
        .withColumn("registered", F.size("models") > 0)
        .withColumn("era", assign_era(F.col("date_mid"), F.col("date_width")))
        .withColumn("photographic", photographic(F.col("medium")))
    )


def era_counts(files: DataFrame, by: list[str], labels=LABELS) -> DataFrame:
    """Distinct files per era in fixed column order, and those before 1970."""
    keyed = files
    for c in by:
        keyed = keyed.where(F.col(c).isNotNull())
    wide = keyed.groupBy(*by).pivot("era", list(labels)).agg(F.count_distinct("file_key")).fillna(0, list(labels))
    return wide.withColumn("pre-1970", sum((F.col(f"`{e}`") for e in labels[1:3]), F.col(f"`{labels[0]}`")))


def model_census(files: DataFrame, min_files: int = MIN_MODEL_FILES) -> DataFrame:
    """Era counts of photographic files per model, of models with enough files."""
    each = files.withColumn("model", F.explode("models"))
    size = each.groupBy("scene_id", "model").agg(F.count_distinct("file_key").alias("model_files"))
    return (
        era_counts(each.where("photographic"), ["scene_id", "model"])
        .join(size, ["scene_id", "model"])
        .where(F.col("model_files") >= min_files)
    )


def scene_summary(files: DataFrame) -> DataFrame:
    """Per scene: totals and era histograms of all, photographic and posed files, in one pass."""
    posed = F.col("photographic") & F.col("registered")
    kinds = {"all": F.lit(True), "photo": F.col("photographic"), "posed": posed}
    counts = [
        F.count_if(cond & (F.col("era") == era)).alias(f"{kind}_{era}")
        for kind, cond in kinds.items()
        for era in LABELS
    ]
    dated = F.col("date_mid").isNotNull()
    out = files.groupBy("scene_id").agg(
        F.count("*").alias("files"),
        F.count_if("photographic").alias("photographic"),
        F.count_if(dated).alias("dated"),
        F.count_if("registered").alias("registered"),
        *counts,
    )
    early = lambda kind: sum((F.col(f"`{kind}_{e}`") for e in ERAS[1:3]), F.col(f"`{kind}_{ERAS[0]}`"))
    return out.withColumn("photo_pre-1970", early("photo")).withColumn("posed_pre-1970", early("posed"))


def best_models(models: DataFrame) -> DataFrame:
    """Per scene the model with most files before 1970, then since 2000."""
    best = models.groupBy("scene_id").agg(
        F.min_by(
            F.struct("model", "`pre-1970`", "`2000+`"),
            F.struct((-F.col("`pre-1970`")).alias("a"), (-F.col("`2000+`")).alias("b"), "model"),
        ).alias("m")
    )
    return best.select(
        "scene_id",
        F.col("m.model").alias("best_model"),
        F.col("m.`pre-1970`").alias("best_model_pre-1970"),
        F.col("m.`2000+`").alias("best_model_2000+"),
    )


def passes_gate(summary: DataFrame, n_old: int = 10, n_modern: int = 10) -> DataFrame:
    """Add gate_posed and gate_any."""
    enough = lambda old, new: F.coalesce(
        (F.col(f"`{old}`") >= n_old) & (F.col(f"`{new}`") >= n_modern), F.lit(False)
    )
    return summary.withColumn("gate_posed", enough("best_model_pre-1970", "best_model_2000+")).withColumn(
        "gate_any", enough("photo_pre-1970", "photo_2000+")
    )


def first_occurrence(files: DataFrame, key: str = "file_key", order: str = "scene_id") -> DataFrame:
    """One row per key, the first by order; pre-aggregated, so that a hot key costs a row a task."""
    rest = [c for c in files.columns if c != key]
    return files.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order and _orderable(files, c)])).alias("r")
    ).select(
        
        key, *[F.col("r")[c].alias(c) for c in rest]
    )


def _orderable(df: DataFrame, name: str) -> bool:
    return not df.schema[name].dataType.typeName().startswith("map")


def split_summary(views: DataFrame, splits=("train", "val", "test")) -> DataFrame:
    return views.groupBy("era").pivot("split", list(splits)).count().fillna(0)


def views_table(poses: DataFrame, dates: DataFrame, meta: DataFrame, model: int, max_width=30, min_confidence=0.3) -> DataFrame:
    """Posed, dated, photographic views of one model, first pose of each file."""
    order = Window.partitionBy("scene_id", "file_key").orderBy("path")
    one = poses.where(F.col("model") == model).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return (
        one.join(dates, ["scene_id", "file_key"])
        .join(meta.select("scene_id", "file_key", "title"), ["scene_id", "file_key"], "left")
        .where(
            F.col("date_lo").isNotNull()
            & (F.col("date_width") <= max_width)
            & (F.col("date_confidence") >= min_confidence)
            & photographic(F.col("medium"))
        )
        .withColumn("era", assign_era(F.col("date_mid"), F.col("date_width")))
        .withColumnsRenamed({"width": "camera_width", "height": "camera_height"})
        .withColumn("pose_source", F.lit("colmap"))
    )


def unposed_candidates(files: DataFrame, paths: DataFrame, model: int, before: float) -> DataFrame:
    """Old photographic files that the model lacks, with the first path of each."""
    first = paths.groupBy("file_key").agg(F.min("path").alias("path"))
    return files.where(
        (F.col("date_mid") < before)
        & (F.col("date_width") <= MAX_ERA_WIDTH)
        & photographic(F.col("medium"))
        & ~F.array_contains("models", model)
    ).join(first, "file_key")


def confident_registrations(views: DataFrame, max_rot_spread=10.0, max_center_spread=0.1, min_batches=2) -> DataFrame:
    return views.where(
        F.col("qw").isNotNull()
        & (F.col("rot_spread_deg") <= max_rot_spread)
        & (F.col("center_spread") <= max_center_spread)
        & (F.col("n_batches") >= min_batches)
    )


def compare_size(iw: Column, ih: Column, cw: Column, ch: Column, tol: float = 0.01) -> Column:
    """match, scaled, rotated or mismatch of an image against its camera."""
    close = lambda a, b: F.abs(a - b) <= tol * b
    ratio = iw / ih
    return (
        F.when((iw == cw) & (ih == ch), "match")
        .when(close(ratio, cw / ch), "scaled")
        .when(close(ratio, ch / cw), "rotated")
        .otherwise("mismatch")
    )


def old_vs_modern(cameras: DataFrame, old_before=1950, modern_from=2000) -> DataFrame:
    """Where old cameras stand against the 5th to 95th percentile shell of the modern ones."""
    modern, old = cameras.where(F.col("year") >= modern_from), cameras.where(F.col("year") < old_before)
    # Five numbers come back: the median centre of the modern cameras and their shell.
    whole = lambda df: df.withColumn("whole", F.lit(1))
    middle = medians(whole(modern.select(*"xyz")), ["whole"], list("xyz")).first() or dict.fromkeys("xyz")
    apart = lambda c: F.col(c) - F.lit(middle[c]).cast("double")
    radius = F.sqrt(sum(apart(c) * apart(c) for c in "xyz"))
    shell = quantiles(whole(modern.select(radius.alias("r"))), ["whole"], {"low": ("r", 0.05), "high": ("r", 0.95)}).first()
    low, high = (F.lit(shell[k] if shell else None).cast("double") for k in ("low", "high"))
    placed = old.withColumn("r", radius)
    return placed.agg(
        F.count("*").alias("n_old"),
        F.count_if(F.col("r").between(low, high)).alias("inside"),
        F.count_if(F.col("r") > high).alias("too_far"),
        F.count_if(F.col("r") < low).alias("too_close"),
    )


def largest_groups(rows: DataFrame, by: list[str], n: int = 15) -> DataFrame:
    """by.., n_rows of the n largest groups; ties go by the key."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), *by).limit(n)


def camera_summary(cameras: DataFrame, images: DataFrame, by: list[str]) -> DataFrame:
    """by.., cameras by model, their widths, and whether images share one.

    cameras: by.., model_name, width; images: by...
    """
    counts = cameras.groupBy(*by, "model_name").agg(
        F.count("*").alias("n"), F.min("width").alias("low"), F.max("width").alias("high")
    )
    models = counts.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", "n")))).alias("models"),
        F.sum("n").alias("n_cameras"), F.min("low").alias("min_width"), F.max("high").alias("max_width"),
    )
    out = models.join(images.groupBy(*by).agg(F.count("*").alias("n_images")), by, "left").fillna(0, ["n_images"])
    return out.withColumn("shared", F.col("n_images") > F.col("n_cameras"))


def aspect_mismatch(views: DataFrame) -> DataFrame:
    """The largest difference in aspect between an image and its camera."""
    ratio = lambda side: F.col(f"{side}_width") / F.col(f"{side}_height")
    return views.agg(F.max(F.abs(ratio("image") - ratio("camera"))).alias("max_aspect_mismatch"))
