"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC timestamps, ANSI SQL and adaptive execution."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tempora")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Without the call site of every column, large expressions are built in about half the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to Python at once, on top of the limit on their number.
BATCH_BYTES = 8 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_arrow_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by size, so that long texts do not add up to large ones.

    A limit that the session's owner has set is left as it is.
    """
    if _BYTES_SETTING not in spark.conf.getAll:
        spark.conf.set(_BYTES_SETTING, str(BATCH_BYTES))
