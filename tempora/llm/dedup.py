"""Exact duplicates by a log-structured merge index of text digests.

A flush turns a batch of documents into level-0 runs: sorted digest files of at
most MEMTABLE rows each (a task's memtable). Once FANOUT runs have gathered on a
level, compaction merges them by digest into one run of the next level, keeps
one identifier for each digest, and removes what it merged. A run has a
manifest of its files (least and greatest digest, rows) and a filter, a bitmap
of its digests of bounded size. A probe tests the filters first: a row that no
filter lets pass is new and is never joined, and a run is opened only for rows
that its filter lets pass, of these only the files whose range holds one.

exact_groups flushes the table into RUNS level-0 runs in one pass, compacts
them, and probes the repeated digests, themselves a run, with every row. Digest
hits are then compared byte by byte: a class whose smallest and largest
normalised text are the same string holds equal texts only; any other class is
split by the text itself, so that equal digests of different texts never merge
them.

Everything on the path is a DataFrame operation. Texts never enter a shuffle
unless the filter of repeated digests lets them pass, and those are reduced to
two a digest in each task first, so one group of copies may hold any share of
the rows.

Defined cases: a null text equals an empty one; a null doc_id loses against any
other; of repeated rows with the same doc_id and text exactly one stays; an
empty table gives an empty result; other columns are ignored, and the stage
returns them as they are.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.strings import lower_ascii
from tempora.llm.rows import drop_named
from tempora.plans.bitmap import bits_for, key_bitmap, possible
from tempora.plans.materialize import broadcast_if_small, is_small, materialize, new_path, remove

#: Runs of a level that a compaction waits for.
FANOUT = 4
#: Level-0 runs that a whole table is flushed into.
RUNS = 4
#: Rows of a memtable, and so of a level-0 file, at most.
MEMTABLE = 1_000_000
#: Keys up to which a probe looks for the files that can hold one.
FEW_KEYS = 10_000


def normalized(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def text_digest(text: Column) -> Column:
    return F.sha2(normalized(text).cast("binary"), 256)


def _key(digest: Column, key_chars: int) -> Column:
    return digest if key_chars >= 64 else F.substring(digest, 1, key_chars)


def _winner(keep: str, who: Column) -> Column:
    """The identifier that stays, of structs (doc_id, row_id); null ids lose."""
    if keep == "largest":
        return F.max(who)
    found = F.min(F.struct(who["doc_id"].isNull().alias("none"), who.alias("who")))
    return found["who"]


class Run:
    """Sorted digest files, with a manifest of what each spans and a filter over all, built when first asked for."""

    def __init__(self, table: DataFrame, path: str):
        self.table, self.path = table, path

    @functools.cached_property
    def files(self) -> DataFrame:
        """file, low, high, rows."""
        spans = self.table.groupBy(F.input_file_name().alias("file")).agg(
            F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("rows")
        )
        return materialize(spans, "lsm-files")

    @functools.cached_property
    def bits(self) -> int:
        return bits_for(self.table.count())

    @functools.cached_property
    def bitmap(self) -> DataFrame:
        return key_bitmap(self.table, "digest", self.bits)

    def maybe(self, df: DataFrame, key: Column) -> DataFrame:
        """row, maybe: false where the filter shows that no file holds the key."""
        return possible(df, key, self.bitmap, self.bits)

    def files_for(self, keys: DataFrame) -> list[str]:
        """Files whose range holds one of a few keys (column key), by way of the keys' first two digits."""
        first = lambda c, pad: F.conv(F.rpad(F.substring(c, 1, 2), 2, pad), 16, 10).cast("int")
        spans = self.files.withColumn("two", F.explode(F.sequence(first("low", "0"), first("high", "f"))))
        keys = F.broadcast(keys.select("key", first("key", "0").alias("two")).distinct())
        held = spans.join(keys, "two").where("key >= low and key <= high").select("file").distinct()
        return [r["file"] for r in held.collect()]


@dataclass
class Hits:
    """What a probe found, and what it had to open for it."""

    rows: DataFrame
    new: DataFrame
    opened: int = 0
    skipped: int = 0
    runs_skipped: int = 0


@dataclass
class MergeIndex:
    """Digest runs in the shared folder: flush batches, compact, probe.

    keep is "smallest" or "largest": which identifier a compaction keeps.
    key_chars shortens the digest used as key (for tests of verification).
    """

    spark: SparkSession
    keep: str = "smallest"
    key_chars: int = 64
    levels: list[list[Run]] = field(default_factory=lambda: [[]])

    def __post_init__(self):
        if self.keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be smallest or largest, not {self.keep}")

    def write_run(self, entries: DataFrame, name: str) -> Run:
        """A run of entries (digest, who, n), in files of disjoint digest ranges."""
        path = new_path(self.spark, name)
        entries.repartitionByRange("digest").sortWithinPartitions("digest").write.parquet(path)
        return Run(self.spark.read.schema(entries.schema).parquet(path), path)

    def flush(self, docs: DataFrame, runs: int = 1) -> DataFrame:
        """Write a batch as level-0 runs; returns its rows (doc_id, row_id, sha256, digest)."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("sha256"))
        rows = rows.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row_id"),
            "sha256",
            _key(F.col("sha256"), self.key_chars).alias("digest"),
            F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        )
        path = new_path(self.spark, f"lsm-l0-{len(self.levels[0])}")
        (
            rows.sortWithinPartitions("run", "digest")
            .write.option("maxRecordsPerFile", MEMTABLE)
            .partitionBy("run")
            .parquet(path)
        )
        table = self.spark.read.schema(rows.schema).parquet(path)
        one = F.struct("doc_id", "row_id").alias("who")
        for r in range(runs):
            part = table.where(F.col("run") == r).select("digest", one, F.lit(1).cast("long").alias("n"))
            self.levels[0].append(Run(part, f"{path}/run={r}"))
        return table.drop("run")

    def merged(self, runs: list[Run]) -> DataFrame:
        """digest, who stays, how many: pre-aggregated in each task."""
        rows = runs[0].table
        for run in runs[1:]:
            rows = rows.unionByName(run.table)
        return rows.groupBy("digest").agg(_winner(self.keep, F.col("who")).alias("who"), F.sum("n").alias("n"))

    def compact(self, remove_merged: bool = True) -> None:
        """From level 0 upwards: FANOUT runs of a level become one of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= FANOUT:
                old = self.levels[level]
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self.write_run(self.merged(old), f"lsm-l{level + 1}"))
                self.levels[level] = []
                if remove_merged:
                    remove(self.spark, *[run.path for run in old])
            level += 1

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def lookup(self) -> DataFrame:
        """digest, who, n over all runs; a single compacted run is that already."""
        runs = self.runs()
        return runs[0].table if len(runs) == 1 and not self.levels[0] else self.merged(runs)

    def probe(self, docs: DataFrame) -> Hits:
        """Rows of docs whose digest some run holds (before verification), and the others.

        Run by run: the filter is tested first, and what it lets pass is looked
        for in the files whose range can hold it. Few keys name their files; many
        would name them all.
        """
        key = _key(text_digest(F.col("text")), self.key_chars)
        left = docs.select(F.struct("*").alias("row"), key.alias("key"))
        found, hits = None, Hits(docs, docs)
        for run in self.runs():
            marked = materialize(run.maybe(left, F.col("key")), "lsm-probe")
            maybe = marked.where("maybe").select("row.*")
            total = run.files.count()
            files = None
            if is_small(maybe, FEW_KEYS):
                files = run.files_for(maybe)
            hits.opened += total if files is None else len(files)
            hits.skipped += 0 if files is None else total - len(files)
            if files == []:
                hits.runs_skipped += 1
                continue
            table = run.table if files is None else self.spark.read.schema(run.table.schema).parquet(*files)
            held = table.select(F.col("digest").alias("key"))
            hit = maybe.join(held, "key", "left_semi").select("row", "key")
            missed = maybe.join(held, "key", "left_anti").select("row", "key")
            found = hit if found is None else found.unionByName(hit)
            left = marked.where(~F.col("maybe")).select("row.*").unionByName(missed)
        hits.rows = docs.limit(0) if found is None else found.select("row.*")
        hits.new = left.select("row.*")
        return hits


def exact_groups(docs: DataFrame, keep: str = "largest", key_chars: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = MergeIndex(docs.sparkSession, keep, key_chars)
    rows = index.flush(docs, RUNS)
    index.compact(remove_merged=False)  # the rows themselves are read again below
    repeats = index.write_run(index.lookup().where("n > 1"), "lsm-repeats")
    bad = _unequal(docs, repeats, key_chars)
    good = repeats.table if bad is None else repeats.table.join(bad, "digest", "left_anti")

    marked = repeats.maybe(rows, F.col("digest"))
    maybe = marked.where("maybe").select("row.*")
    if bad is not None:
        maybe = maybe.join(broadcast_if_small(bad), "digest", "left_anti")
    if is_small(repeats.table):
        good = F.broadcast(good)
    found = maybe.join(good, "digest", "left").select("doc_id", "row_id", "sha256", "who", "n")
    single = marked.where(~F.col("maybe")).select("row.doc_id", "row.row_id", "row.sha256")
    out = found.unionByName(single, allowMissingColumns=True).select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("who.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("who.row_id") == F.col("row_id"), F.lit(True)).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
    if bad is None:
        return out
    return out.unionByName(_split_by_text(docs, bad, keep, key_chars))


def _unequal(docs: DataFrame, repeats: Run, key_chars: int) -> DataFrame | None:
    """Byte verification: digests whose rows are not all the same text, or None.

    What the filter lets pass is reduced to two texts a digest in each task; a
    digest that is not repeated after all has one text only and drops out.
    """
    norm = normalized(F.col("text")).alias("norm")
    digest = _key(text_digest(F.col("text")), key_chars)
    maybe = repeats.maybe(docs.select(norm, digest.alias("digest")), F.col("digest"))
    spread = (
        maybe.where("maybe")
        .groupBy(F.col("row.digest").alias("digest"))
        .agg(F.min("row.norm").alias("low"), F.max("row.norm").alias("high"))
        .where("low != high")
        .select("digest")
    )
    spread = materialize(spread, "lsm-unequal")
    return None if spread.isEmpty() else spread


def _split_by_text(docs: DataFrame, bad: DataFrame, keep: str, key_chars: int) -> DataFrame:
    """Classes by the text itself, for digests shared by different texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("norm"))
    rows = rows.withColumn("sha256", F.sha2(F.col("norm").cast("binary"), 256))
    rows = rows.withColumn("digest", _key(F.col("sha256"), key_chars)).join(bad, "digest", "left_semi")
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "lsm-split")
    who = _winner(keep, F.struct("doc_id", "row_id")).alias("who")
    groups = rows.groupBy("digest", "norm").agg(who, F.count("*").alias("n"))
    return rows.join(groups, ["digest", "norm"]).select(
        "doc_id",
        F.col("who.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("who.row_id") == F.col("row_id")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns; dropped ones are named by digest and doc_id."""
    groups = materialize(exact_groups(docs, keep), "exact-groups")
    named = groups.where("group_size > 1").groupBy(F.col("text_sha256").alias("key"), "doc_id")
    marks = materialize(named.agg(F.max("kept").alias("kept"), F.count("*").alias("same")), "exact-copies")
    return drop_named(docs, text_digest(F.col("text")), marks)
