"""Queries against their SQL on the smallest tables."""

import functools

import duckdb
import pytest

from wardline.plans import queries as links

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def one_scan():
    """The queries that start with the scan share one in this module."""
    whole = links.scan
    links.scan = functools.cache(whole)
    yield
    links.scan = whole


@pytest.mark.parametrize("name", sorted(links.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("events", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = links.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({links.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want))
