"""The image index, the scene dictionary and reconstruction sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.strings import file_key


def load_image_index(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Column-pruned index with a derived file_key."""
    df = spark.read.parquet(path)
    wanted = [c for c in df.columns if columns is None or c in columns or c == "image_name"]
    return df.select(*wanted, file_key(F.col("image_name")).alias("file_key"))


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, value) rows of a JSON file that is one object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", schema)).alias("key", "value"))


def load_categories(spark: SparkSession, path: str) -> DataFrame:
    """scene, scene_id."""
    return json_object(spark, path, "map<string,int>").toDF("scene", "scene_id")


def recon_rows(raw: DataFrame) -> DataFrame:
    """(key, value array<string>) with [name, n_models, images, points, ...] -> one row per model."""
    n = F.col("value")[1].cast("int")
    checked = raw.withColumn(
        "n",
        F.when(F.size("value") != 2 + 2 * n, F.raise_error(F.lit("sizes do not match the number of models")).cast("int"))
        .otherwise(n),
    ).where("n > 0")
    return checked.withColumn("model", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        F.col("key").cast("int").alias("scene_id"),
        F.col("value")[0].alias("scene"),
        "model",
        F.get("value", 2 + 2 * F.col("model")).cast("long").alias("n_images"),
        F.get("value", 3 + 2 * F.col("model")).cast("long").alias("n_points"),
    )


def load_recon_metadata(spark: SparkSession, path: str) -> DataFrame:
    """scene_id, scene, model, n_images, n_points; an error where a list has the wrong length."""
    return recon_rows(json_object(spark, path, "map<string,array<string>>"))


def read_scene_file(spark: SparkSession, path: str) -> DataFrame:
    """One scene a line; comments and blank lines go."""
    line = F.trim(F.split("value", "#")[0])
    return spark.read.text(path).select(line.alias("scene")).where("scene != ''")


def raw_metadata_key(scene_prefix, subcat):
    return F.concat(F.lit("images/"), scene_prefix, F.lit("/commons/"), subcat, F.lit("/raw_metadata.json"))


def image_key(scene_prefix, path):
    return F.concat(F.lit("images/"), scene_prefix, F.lit("/"), F.replace(path, F.lit(" "), F.lit("_")))


def reconstruction_key(scene_prefix, model, filename):
    root = F.when(filename.endswith(".minibin"), "reconstruct_aux").otherwise("reconstruct")
    return F.concat(root, F.lit("/"), scene_prefix, F.lit("/colmap/"), model.cast("string"), F.lit("/"), filename)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only cache."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[f"r.{c}" for c in rest])


def missing(wanted: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """What is still to do: wanted keys that have does not hold."""
    return wanted.join(have, on, "left_anti")


def write_partitions(df: DataFrame, path: str, by: str = "scene_id") -> None:
    """Write one folder per scene; only the folders that df touches are replaced."""
    df.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
