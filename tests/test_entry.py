"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tempora.session import TABLES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    assert entry.entry(spark).count() == 25


def test_every_query_has_sql_or_runs(spark, small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name, text in sql.items():
        assert sorted(con.sql(text).columns) == sorted(queries[name](spark, small).columns), name


@pytest.mark.parametrize("name", ["scene_table", "band_join_components", "stratified_splits", "summarize_grouping_sets", "resolve_dates"])
def test_counts_match_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert entry.queries()[name](spark, small).count() == con.sql(f"SELECT count(*) FROM ({entry.oracle_sql()[name]})").fetchall()[0][0]


def test_library_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr


def test_nothing_outside_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "tempora")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "tempora.llm" not in source.read(), f
