"""Every query that has SQL gives what DuckDB gives, row by row."""

import math
import os

import pytest

from tessella.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL | registry.CASE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = (registry.QUERIES | registry.CASES)[name](spark, DIR)
    sql = (registry.ORACLE_SQL | registry.CASE_SQL)[name]
    want = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(tuple(map(plain, r)) for r in duck.sql(f"select {quoted} from ({sql})").fetchall())


@pytest.mark.parametrize("name", sorted((set(registry.QUERIES) | set(registry.CASES)) - set(registry.ORACLE_SQL) - set(registry.CASE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert (registry.QUERIES | registry.CASES)[name](spark, DIR).count() > 0
