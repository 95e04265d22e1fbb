"""Every report query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from inkwell.plans import report_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row):
    return tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(report_queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = report_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(report_queries.ORACLE_SQL[name])
    assert columns == sorted(relation.columns)
    got = sorted(plain(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(map(plain, relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_registries_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(report_queries.QUERIES) - set(report_queries.ORACLE_SQL) == {"pca_fit"}
