"""Registered queries and their SQL: all texts parse, and a cross-section gives equal rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows

SAMPLE = ["agg4_com_speed_summary", "agg5_com_shift_summary", "agg10_xfactor_summary", "win8_one_euro_raw", "win9_suppress_jumps",
          "win25_static_trim", "win27_majority_clusters", "jn7_match_depth_frames", "smp10_balanced_sequences", "agg25_auc_scores",
          "plan_training_set", "str1_latest_status_stream"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_sql_texts_parse(con):
    names = entry.queries()
    for name, sql in entry.oracle_sql().items():
        assert name in names
        con.sql("EXPLAIN " + sql)


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_rows(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
