"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from inkfold.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(frame, columns):
    def show(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(show(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert canonical(got, columns) == canonical(want, columns)


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)):
        assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_is_stable(spark):
    assert entry.entry(spark).columns == ["conv_id", "fluency", "persistence", "creativity"]
