"""Work is dealt out by rows, not by the files they are read from."""

from pyspark.sql import functions as F

from tessella.operators import recommend
from tessella.sources import staging


def test_rows_are_spread_over_tasks(spark, monkeypatch):
    one = spark.range(1_000).coalesce(1)
    assert staging.spread(one, 300).rdd.getNumPartitions() == 4
    by = staging.spread(one.withColumn("k", F.col("id") % 9), 100, "k").withColumn("at", F.spark_partition_id())
    assert by.select("k", "at").distinct().count() == 9 and by.count() == 1_000
    monkeypatch.setattr(recommend, "REQUESTS", 100)
    asked = spark.range(1_000).coalesce(1).selectExpr("id", "'shop' as product_type", "'' as industry", "'' as keywords")
    made = recommend.compose(asked)
    assert made.rdd.getNumPartitions() == 11 and made.count() == 1_000
