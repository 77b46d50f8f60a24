"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

from pagewright.plans.oracle import SQL
from pagewright.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def value(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, float):
        return "0" if x == 0 else f"{x:.9g}" if not math.isinf(x) else str(x)
    return str(x)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    mine = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    theirs = sorted(tuple(value(r[i]) for i in order) for r in cursor.fetchall())
    assert mine == theirs


def test_fixture_counts(spark):
    assert QUERIES["caption_candidates"](spark, SMALL).count() == 124
    assert QUERIES["caption_match_greedy"](spark, SMALL).count() == 104


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 104
