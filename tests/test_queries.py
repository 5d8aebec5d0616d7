"""Every registered query against its SQL equivalent at the smallest scale."""

import importlib
import math
from collections import Counter

import duckdb
import pytest

from trustlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

entry = importlib.import_module("__spark_entry__")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(SQL[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())


LOOKUPS = [
    "met_all", "met_code_quality", "e2e_update", "e2e_search", "join_readme_name", "join_pr_files",
    "join_keys_lookup", "flt_artifact_by_key", "flt_update_valid", "join_update_exists",
    "snk_prune_index", "src_landed_readme",
]


@pytest.mark.parametrize("key", LOOKUPS)
def test_query_without_broadcasts(spark, duck, key):
    """The same results when no table is small enough to be broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        test_query(spark, duck, key)
    finally:
        spark.conf.set(name, before)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
