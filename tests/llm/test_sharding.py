import zlib

import numpy as np

from tempora.llm import sharding
from tempora.session import table


def jump(key, n):
    """The published algorithm, one key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_scalar_form():
    keys = np.concatenate([np.arange(500, dtype=np.uint64), np.array([2**63 - 1, 2**63, 2**64 - 1, 2**64 - 2, 12345678901234], np.uint64)])
    assert keys.dtype == np.uint64 and int(keys[-3]) == 2**64 - 1
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def check(docs, n=8):
    rows = sharding.assign_shards(docs, n).collect()
    want = sorted(
        (r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
        for r in docs.select("doc_id", "text").collect()
    )
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        key = (r.doc_id or 0) % 2**64
        assert r.shard == jump(key, n) and r.grown_shard in (r.shard, n) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(odd):
    check(odd)


def test_documents(spark, small):
    check(table(spark, small, "documents"))


def test_one_hot_key(spark):
    check(spark.createDataFrame([(7, "same")] * 300 + [(i, "x") for i in range(50)], "doc_id long, text string"))


def test_empty(none):
    assert sharding.assign_shards(none).count() == 0


def test_written_shards(spark, odd, tmp_path):
    docs = odd.drop("shard")
    sharding.write_shards(docs, str(tmp_path / "out"), 4, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert all(r.shard == jump(r.doc_id or 0, 4) for r in back.collect())


def test_written_shards_keep_columns_of_any_name(spark, clashing, unchanged, tmp_path):
    folder = sharding.write_shards(clashing, str(tmp_path / "out"), 4, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert folder == "shard_" and set(back.columns) == {*clashing.columns, folder}
    assert all(r[folder] == jump(r.doc_id or 0, 4) for r in back.collect())
    unchanged(back.select(*clashing.columns), clashing)
