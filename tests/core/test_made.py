"""Queries over made rows against their SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from wardline.plans import made, registry, texts

SF = "/root/testdata/sf0.001"
NAMES = [n for n in registry.ORACLE if registry.QUERIES[n].__module__ in (made.__name__, texts.__name__) and n not in ("calm_messages", "screenshots_and_trust", "entities")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[: -len('.parquet')]} AS SELECT * FROM '{f}'")
    return con


def sheet(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [*NAMES, "edit_distance", "lookalike_hosts"])
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE[name])
    assert sheet(got.columns, got.collect()) == sheet([c[0] for c in want.description], want.fetchall())
