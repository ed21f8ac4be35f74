"""Exact positions in the order of a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.staging import checkpointed


def positions(rows: DataFrame, order: str) -> DataFrame:
    """rows with position, from 0 in the order of a column (nulls first); every row once.

    The rows are range-partitioned and stored with the number of their range, so the
    sizes of the ranges and the rows themselves come from one partitioning. Ranks are
    counted per range and offset by the ranges before. Ties take positions in either order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(F.struct(*rows.columns).alias("row"), F.col(order).alias("at")).repartitionByRange(n, "at")
    ranged = checkpointed(ranged.withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    sums = ranged.groupBy("slice").agg(F.count("*").alias("n"))
    offsets = sums.select(F.col("slice").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("slice").orderBy("at")) - 1
    placed = ranged.withColumn("within", within).join(offsets, F.col("slice") == F.col("of"))
    return placed.select("row", (F.col("offset") + F.col("within")).alias("position")).select("row.*", "position")
