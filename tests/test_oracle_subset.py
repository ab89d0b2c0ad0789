"""A fast slice of the Spark-vs-DuckDB contract on sf0.001 (the full run is tools/check_oracle.py)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
SUBSET = ["dedupe_rows", "iqr_clip", "clean_sessions", "composite_label", "build_lookup", "lookup_join",
          "stratified_split", "class_report", "top3_classes", "recommendation_clauses", "history_seq",
          "time_features", "smote_balance", "metric_correlation"]


@pytest.fixture(scope="module")
def duck():
    from athlos.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_duckdb(spark, duck, name):
    import __spark_entry__ as ent
    from check_oracle import rows_of
    sp = ent.queries()[name](spark, SF).toPandas()
    dp = duck.execute(ent.oracle_sql()[name]).df()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dp)
    assert sc == dc
    assert sr == dr
