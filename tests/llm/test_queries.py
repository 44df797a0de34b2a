"""Registered queries against their SQL on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical
from volarium.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine, theirs = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and canonical(mine) == canonical(theirs) and len(mine) > 0


def test_one_query_per_operator():
    numbers = sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
