"""Incremental runs: new metadata files are dated once and land in their scene's folder.

The batch jobs skip what exists. As a stream, the file source remembers what it
has read, each micro-batch is dated by the same expressions, and the writer adds
files under scene_id, so a restart after a failure repeats at most one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tempora.dating.resolve import date_images
from tempora.functions.interval import THIS_YEAR


def incremental(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
    job: Callable[[DataFrame], DataFrame], by: str = "scene_id",
) -> StreamingQuery:
    """Run a narrow job over all files that are new since the last run, then stop."""
    new = spark.readStream.schema(schema).parquet(source)
    return (
        job(new)
        .writeStream.format("parquet")
        .partitionBy(by)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def date_new_files(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, max_year: int = THIS_YEAR
) -> StreamingQuery:
    return incremental(spark, source, schema, target, checkpoint, lambda df: date_images(df, max_year))
