"""Every query with SQL gives its rows on the smallest of the test tables, and those without give some."""

import math
import os

import duckdb
import pytest

from vellum.plans import catalogue, queries, sources, streams, texts  # noqa: F401  (each adds its queries)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rounded(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(map(rounded, r)) for r in con.sql(f"SELECT {names} FROM ({queries.SQL[name]})").fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_items_move_their_texts_once(spark):
    """Texts are shuffled, not their items; windows by document need no further shuffle."""
    from vellum.operators import items as ops
    from vellum.plans import streams

    rows = streams.items(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    runs = ops.words(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in runs and runs.count("Exchange hashpartitioning") == 1
