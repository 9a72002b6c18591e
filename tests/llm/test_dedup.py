import hashlib
import string

from tempora.llm import dedup
from tempora.session import table

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, keep):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    pick = max if keep == "largest" else min
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, best, len(ids), sha) for i in ids]
    return sorted(out, key=repr)


def check(docs, keep, **args):
    rows = dedup.exact_groups(docs, keep, **args).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], keep)
    stays = {}
    for r in rows:
        stays[r.text_sha256] = stays.get(r.text_sha256, 0) + r.kept
    assert set(stays.values()) <= {1}


def test_awkward_rows(odd):
    check(odd, "largest")
    check(odd, "smallest")


def test_colliding_digests_are_split_by_bytes(odd):
    check(odd, "largest", key_chars=1)
    check(odd, "smallest", key_chars=1)


def test_documents(spark, small):
    check(table(spark, small, "documents"), "largest")


def test_empty(none):
    assert dedup.exact_groups(none).count() == 0
    assert dedup.drop_exact(none).count() == 0


def test_stage_keeps_one_of_each_text_and_all_columns(odd):
    out = dedup.drop_exact(odd)
    assert out.columns == odd.columns
    texts = [(r.text or "").translate(LOWER) for r in out.collect()]
    assert len(texts) == len(set(texts)) == 6
    assert 2 in [r.doc_id for r in out.collect()] and 1 not in [r.doc_id for r in out.collect()]


def test_index_over_batches(spark, odd):
    """Levels fill, compaction replaces what it merged, and probes see all of it."""
    import os

    index = dedup.MergeIndex(spark, "smallest")
    one, two = odd.where("doc_id <= 2"), odd.where("doc_id > 2 or doc_id is null")
    index.flush(one)
    hits = index.probe(two)
    assert [r.text for r in hits.rows.collect()] == ["The same text here, twice over."]
    assert hits.rows.columns == odd.columns and hits.new.count() == two.count() - 1
    index.flush(two)
    index.flush(two.limit(0))
    index.compact()
    assert [len(x) for x in index.levels] == [3]
    index.flush(two.limit(0))
    merged = [run.path for run in index.levels[0]]
    index.compact()
    assert [len(x) for x in index.levels] == [0, 1]
    assert not any(os.path.exists(p.removeprefix("file:")) for p in merged)
    level = {r.n: r.who.doc_id for r in index.lookup().collect()}
    assert level[4] == 1
    assert index.probe(odd).new.count() == 0


def test_levels_cascade(spark, monkeypatch):
    """Four batches, two runs a compaction: one run of level 2 that keeps the smallest number of each text."""
    monkeypatch.setattr(dedup, "FANOUT", 2)
    index = dedup.MergeIndex(spark, "smallest")
    for batch in range(4):
        rows = [(batch * 10 + 3, "text common to all"), (batch * 10 + 5, f"text of batch {batch}")]
        index.flush(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
        index.compact()
    assert [len(x) for x in index.levels] == [0, 0, 1]
    got = {(r.who.doc_id, r.n) for r in index.lookup().collect()}
    assert got == {(3, 4)} | {(b * 10 + 5, 1) for b in range(4)}


def test_probe_skips_files_and_runs(spark):
    """Files whose range cannot hold a key are not opened, nor runs whose filter lets nothing pass."""
    from pyspark.sql import functions as F

    old = spark.range(4000).select("id", F.format_string("text number %d", "id").alias("text")).withColumnRenamed("id", "doc_id")
    index = dedup.MergeIndex(spark, "smallest")
    index.flush(old.where("doc_id < 3000"))
    index.flush(old.where("doc_id >= 3000"))
    entries = index.merged(index.levels[0][:1])
    parts = entries.repartitionByRange(6, "digest").sortWithinPartitions("digest")
    path = dedup.new_path(spark, "six")
    parts.write.parquet(path)
    index.levels[0][0] = dedup.Run(spark.read.schema(parts.schema).parquet(path), path)
    assert index.levels[0][0].files.count() == 6
    batch = spark.createDataFrame([(9000, "TEXT number 17"), (9001, "never seen")], "doc_id long, text string")
    hits = index.probe(batch)
    assert [r.doc_id for r in hits.rows.collect()] == [9000] and [r.doc_id for r in hits.new.collect()] == [9001]
    assert hits.opened == 1 and hits.skipped >= 6 and hits.runs_skipped == 1
    # Many keys are joined with all files; the answer is the same.
    every = index.probe(old.unionByName(batch))
    assert every.rows.count() == 4001 and [r.doc_id for r in every.new.collect()] == [9001]


def test_memtable_bounds_files(spark, monkeypatch):
    monkeypatch.setattr(dedup, "MEMTABLE", 100)
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('t', id) AS text").coalesce(2)
    index = dedup.MergeIndex(spark)
    index.flush(docs, 2)
    assert len(index.levels[0]) == 2
    rows = [r["rows"] for run in index.levels[0] for r in run.files.collect()]
    assert sum(rows) == 1000 and max(rows) <= 100


def test_shuffled_joins_give_the_same(odd, monkeypatch):
    """Beyond the broadcast bounds: the same result, with a text that most rows hold."""
    import functools

    from pyspark.sql import functions as F

    from tempora.llm import rows

    hot = odd.unionByName(odd.where("doc_id = 1").withColumn("doc_id", F.explode(F.sequence(F.lit(100), F.lit(400)))))
    want = sorted(map(repr, dedup.drop_exact(hot).collect()))
    monkeypatch.setattr(rows, "split", functools.partial(rows.split, bound=0))
    for module in (rows, dedup):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(dedup, "is_small", lambda *a: False)
    assert sorted(map(repr, dedup.drop_exact(hot).collect())) == want
    check(hot, "largest")
    check(odd, "largest", key_chars=1)


def test_stage_keeps_columns_of_any_name(clashing, unchanged):
    unchanged(dedup.drop_exact(clashing), clashing)
