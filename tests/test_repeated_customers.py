"""Customers with several rows, without a key, or with keys below 0: the query still gives what its SQL gives."""

from collections import Counter

from tessella.plans import registry
from tests.test_oracles import plain


def test_competitors_of_odd_customers(spark, tmp_path):
    import duckdb

    keys = [*range(-400, 1500), *range(0, 900, 3), *range(0, 900, 3), 7, None, None]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    df = registry.QUERIES["competitors_nearby"](spark, str(tmp_path))
    columns = ", ".join(df.columns)
    want = con.sql(f"select {columns} from ({registry.ORACLE_SQL['competitors_nearby']})").fetchall()
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in want)
