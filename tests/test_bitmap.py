"""The key bitmap: no key is ever missed, and most others are kept out."""

from pyspark.sql import functions as F

from tempora.plans import bitmap


def test_split_loses_no_key(spark):
    keys = spark.range(0, 3000, 7).select(F.format_string("k%d", "id").alias("k"))
    rows = spark.range(0, 3000).select(F.format_string("k%d", "id").alias("k"), "id").unionByName(
        spark.createDataFrame([(None, None)], "k string, id long")
    )
    maybe, no = bitmap.split(rows, "k", keys, bound=10)
    assert maybe.columns == no.columns == ["k", "id"]
    assert maybe.count() + no.count() == 3001
    assert no.join(keys, "k", "left_semi").count() == 0
    assert keys.count() <= maybe.count() <= keys.count() + 5


def test_few_keys_need_no_bitmap(spark):
    rows, no = bitmap.split(spark.range(5), "id", spark.range(2))
    assert no is None and rows.count() == 5
