"""Every engine query with an oracle equals DuckDB on the smallest tables."""

import duckdb
import pytest

from rulelake import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    cell = lambda v: "~" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return cols, sorted(tuple(map(cell, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLES:
        assert plain(got) == plain(con.sql(catalog.ORACLES[name]).df())


def test_entry_without_the_training_operators(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and "scan_rules" in __spark_entry__.oracle_sql()
    assert __spark_entry__.entry(spark).columns
