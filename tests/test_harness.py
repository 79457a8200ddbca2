"""Every harness query against its SQL on the smallest tables."""

import os

import pytest

from ledgerloom import catalog

SF = os.environ.get("HARNESS_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    want = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert plain(df.select(*[f"`{c}`" for c in cols]).collect()) == plain(want.fetchall())


def test_entry(spark):
    assert catalog.entry(spark, SF).count() > 0
