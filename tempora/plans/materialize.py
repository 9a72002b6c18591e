"""Cut lineage through the folder that every executor shares.

A table written here survives lost executors, is split again by size when it
is reread, and brings file statistics, so Catalyst's size-checked broadcast
decides later joins on it. Tables written inside `intermediates` are removed
when it is left.
"""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths written in each open `intermediates` of this thread, innermost last.
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and all runs on this machine.

    On a cluster a folder of this machine would split a table over the executors'
    disks, so an unset spark.checkpoint.dir is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = f"file://{tempfile.gettempdir()}/tempora-checkpoints"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open.get():
        _open.get()[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more; absent ones are ignored."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


def write_table(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """Write df once as Parquet in the shared folder; (the table read back, its path)."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back; large texts may ask for zstd."""
    return write_table(df, name, codec)[0]


def release_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of tables that are written go before the next ones come.

    Spark removes a shuffle's files when the driver's JVM has collected its plan,
    which a driver with room to spare puts off; disks of executors fill meanwhile.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scope:
    """What is open inside `intermediates`."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, paths
        #: Where the last table kept lies.
        self.kept: str | None = None

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Materialise df, and leave it to whatever encloses this scope."""
        table, path = write_table(df, name)
        self.paths.remove(path)
        self.kept = path
        if len(_open.get()) > 1:
            _open.get()[-2].append(path)
        return table


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[Scope]:
    """Remove on leaving all tables that were written inside, but those kept.

    A DataFrame built inside reads them, so write its result before leaving.
    """
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield Scope(spark, paths)
    finally:
        _open.reset(token)
        remove(spark, *paths)


#: Rows up to which a checked table is broadcast; at about 100 bytes a row 20 MB.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a materialised table has few rows; each task counts its own from the footers."""
    return df.count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if df (materialised, of narrow rows) has few rows; beyond, the join shuffles."""
    return F.broadcast(df) if is_small(df, rows) else df


#: Rows of a task that keeps what is distinct of them in memory.
TASK_ROWS = 500_000


def deal_by(df: DataFrame, *by: str, rows: int = TASK_ROWS) -> DataFrame:
    """A materialised table dealt by its keys into as many tasks as its rows ask for, whatever their size on disk.

    Adaptive execution fills tasks by compressed bytes, of which rows that repeat much take few.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *by)
