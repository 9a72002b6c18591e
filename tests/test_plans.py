"""What the physical plans must and must not hold."""

import pytest

from tempora.catalog import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_of_tables(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(QUERIES["scan_pushdown"](spark, small))
    assert "PushedFilters: [" in text and "GreaterThan(l_quantity,45.0)" in text
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"}


@pytest.mark.parametrize("name", ["text_date_parse", "qs_parse", "category_parse", "title_parse", "exif_parse", "medium_classify", "legacy_year_parse"])
def test_dating_needs_no_python_and_no_shuffle(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def test_a_row_dated_where_it_is_needs_no_python_and_no_shuffle(spark, small):
    """Streams date a row in place; a batch reads a dictionary of the distinct strings, which costs a shuffle."""
    from tempora.dating.resolve import gather_candidates
    from tempora.queries.dates import _meta

    text = plan(_meta(spark, small).select("file_key", gather_candidates()))
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def test_size_check_needs_no_single_task(spark):
    """A limit would bring rows of every partition into one task; a count adds up numbers."""
    from tempora.plans.materialize import broadcast_if_small, is_small, materialize

    df = materialize(spark.range(0, 1000, 1, 7), "size-check")
    assert is_small(df, 1000) and not is_small(df, 999)
    assert "Limit" not in plan(broadcast_if_small(df, 999))


def test_intermediates_are_removed_and_kept_ones_stay(spark, monkeypatch, tmp_path):
    import os

    from pyspark.sql import functions as F

    from tempora.operators.components import connected_components
    from tempora.plans import materialize

    monkeypatch.setattr(materialize, "shared_dir", lambda spark: f"file://{tmp_path}")
    edges = spark.range(1, 50).select((F.col("id") - 1).alias("u"), F.col("id").alias("v"))
    with materialize.intermediates(spark) as outer:
        with materialize.intermediates(spark) as scope:
            kept = scope.keep(connected_components(edges), "kept")
        assert len(os.listdir(tmp_path)) == 1 and kept.select("component").distinct().count() == 1
        last = outer.keep(kept, "last")
    assert [n.split("-")[0] for n in os.listdir(tmp_path)] == ["last"] and last.count() == 50


def test_no_folder_of_this_machine_on_a_cluster():
    from tempora.plans.materialize import shared_dir

    class Session:
        class conf:
            settings = {"spark.master": "spark://host:7077"}

            @classmethod
            def get(cls, key, default=None):
                return cls.settings.get(key, default)

    with pytest.raises(ValueError, match="share"):
        shared_dir(Session)
    Session.conf.settings["spark.checkpoint.dir"] = "hdfs://host/shared/"
    assert shared_dir(Session) == "hdfs://host/shared"


def test_ranks_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    from tempora.plans.ranking import rank_by_hash, row_numbers

    df = spark.range(20).select("id", *[F.lit(n).alias(n) for n in ("b", "n", "nth", "FIRST", "part")])
    ranked = rank_by_hash(df.withColumn("h", F.shiftright(F.xxhash64("id"), 16).bitwiseAND(F.lit((1 << 48) - 1))), ["n"], "h", ["id"])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 21)) and ranked.first()["FIRST"] == "FIRST"
    assert [r.row for r in row_numbers(df, "id").orderBy("id").collect()] == list(range(20))


def test_quantiles_keep_rows_of_a_large_group_where_they_are(spark):
    """A join with the sketches by key would bring the group's rows into one task, whatever sizes Catalyst expects."""
    from tempora.plans.ranking import quantiles

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        df = spark.range(20_001).selectExpr("id % 2 AS g", "double(id) AS v")
        out = quantiles(df, ["g"], {"mid": ("v", 0.5)})
        assert "BroadcastHashJoin" in plan(out)
        assert {r.g: r.mid for r in out.collect()} == {0: 10_000.0, 1: 10_000.0}
    finally:
        spark.conf.set(threshold, before)


def test_tasks_of_bounded_rows(spark):
    from tempora.plans.materialize import deal_by, materialize

    df = materialize(spark.range(0, 1000, 1, 2), "dealt")
    assert deal_by(df, "id", rows=100).rdd.getNumPartitions() == 10 and deal_by(df.limit(0), "id").rdd.getNumPartitions() == 1


def test_scene_table_doubles_no_row_before_a_shuffle(spark, small):
    """Spark's own count of two distinct columns does, and keeps both in one task's memory."""
    assert "Expand" not in plan(QUERIES["scene_table"](spark, small))
