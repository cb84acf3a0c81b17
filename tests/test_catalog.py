"""Every catalogued query against its SQL, or for a schema and rows where it has none."""

import os

import duckdb
import pytest

from galeframe.plans import catalog


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for name in os.listdir(tables):
        con.sql(f"create view {name.removesuffix('.parquet')} as from '{tables}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, tables, duck):
    got = catalog.QUERIES[name](spark, tables).toPandas()
    if name not in catalog.ORACLES:
        assert len(got.columns) and len(got) >= 0
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = ({c: d[c].astype(object).where(d[c].notna(), None) for c in cols} for d in (got, want))
    key = lambda row: tuple((x is None, str(x) if not isinstance(x, (int, float, bool)) else "", x if isinstance(x, (int, float)) else 0) for x in row)
    a, b = (sorted(zip(*(d[c] for c in cols)), key=key) for d in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert (p is None) == (q is None), (x, y)
            assert p == q or abs(float(p) - float(q)) < 2e-6 * max(1, abs(float(q))), (x, y)


def test_entry_works_without_the_training_data_operators(spark):
    import __spark_entry__ as e

    assert "weighted_bias_by_season" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["year", "time_slice", "cluster", "obs", "sim", "scalar"]


def test_model_assignment_against_all_parts(spark, tmp_path):
    import math

    makers, sizes = ["aaaa", "zzzz", "qqqq"], [1, 8, 15, 22, 36, 50, 41, 9]
    parts = [(k, makers[k % 3], sizes[k - 1]) for k in range(1, 9)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {int(r["ID"]): r["model"] for r in catalog.QUERIES["model_assignment"](spark, str(tmp_path)).collect()}
    want = {}
    for k, maker, size in parts:
        density = (500 + size * 60) * 1000 / (math.pi * 40**2)
        near = lambda rows: min((abs(200 + 6 * z - density), 200 + 6 * z, f"M{i}") for i, _, z in rows)
        own, best = near([p for p in parts if p[1] == maker]), near(parts)
        if own[0] < 1 or best[0] <= 100:
            want[k] = own[2] if own[0] < 1 else best[2]
    assert got == want and len(want) > 4


def test_load_germany_of_many_parts(spark, tmp_path):
    """IDs of all first digits and postcodes under 11111, as in tables of more than 10,000 parts."""
    keys = [7, 150, 10100, 10101, 10300, 11000, 20000, 110100, 999900, 2100300, 9999800, 10100]
    spark.createDataFrame([(k, "Vestas wind", 10 + k % 5) for k in keys], "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as from '{tmp_path}/part.parquet/*.parquet'")
    got = catalog.QUERIES["load_germany"](spark, str(tmp_path)).toPandas()
    want = con.sql(catalog.ORACLES["load_germany"]).df()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want[list(got.columns)].itertuples(index=False, name=None)) and len(got) > 5
