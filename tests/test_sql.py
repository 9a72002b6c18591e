"""Queries against their SQL on awkward rows."""

import duckdb
import numpy as np

import __spark_entry__ as entry


def check(spark, folder, name, **tables):
    """The query's rows are those of its SQL, on tables written to folder."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    cols = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"SELECT {cols} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    return len(want)


EMBEDDINGS = "vec_id long, label int, embedding array<float>"


def test_color_stats_on_the_steps_of_single_precision(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = (rng.integers(0, 255, (200, 64)) / 127 - 1).astype("f4")
    check(spark, tmp_path, "color_stats", embeddings=(EMBEDDINGS, [(i, 0, v.tolist()) for i, v in enumerate(x)]))


HTML = [
    "a &amp b &amp; c &ampd", "&copy x &copy; y", "\xa0 a \xa0b　", None, "", "&#xA0;x&#65;&#x41;", "<p>a</p>&a&copy;mp;b&co&lt;py;",
    "a\x0bb\x85\t\nc", "&amp;lt;b&amp;gt;", "<a <b>> x < y", "&notit; &lt &AMP; &", "&amp;amp; &amp;#65;", "&am<b>p;",
]


def test_strip_html_on_cut_entities_and_blanks(spark, tmp_path):
    check(spark, tmp_path, "strip_html", pages=("page_id long, url string, html string", [(i, "", h) for i, h in enumerate(HTML)]))
