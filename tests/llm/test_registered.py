"""Corpus queries against their SQL, and what every query promises."""

import importlib
from collections import Counter

import duckdb
import pytest

from trustlake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "pages", "events"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    df = QUERIES[key](spark, SF)
    result = con.execute(SQL[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(result.fetchall())
