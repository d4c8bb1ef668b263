"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.8g}"  # other orders of summation, and ties of rounding
    return str(v)[:10] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    rel = oracle.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_inception_of_half_days_is_that_of_the_sql(spark, tmp_path):
    """A quarter of an even balance may end in a half, which the SQL's cast rounds to the even day: by itself that shifts an age."""
    from tidemark.plans import screen_plans

    con = duckdb.connect()
    con.sql(f"COPY (SELECT range AS s_suppkey, 'x' AS s_name, (range % 25)::INTEGER AS s_nationkey, (range * 2 - 900)::DOUBLE AS s_acctbal FROM range(5000)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    ours = {(r["ticker"], str(r["inception"])) for r in screen_plans._fund_facts(spark, str(tmp_path)).collect()}
    assert ours == {(t, str(d)) for t, d in con.sql(f"WITH {screen_plans.FUND_SQL} SELECT ticker, inception FROM fund").fetchall()}
