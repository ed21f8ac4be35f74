"""Samples of exact size: the rows of least priority in each stratum, by a seeded hash.

Priorities follow from the seed and a row's key, so a sample is the same however the table is
partitioned, and grows from the same order when more rows are asked for. Spark prunes each
task to the rows that can still be drawn before it shuffles them, so nothing is sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that a priority is made of: as many bits as a double holds.
DIGITS = 13
#: Up to so many rows for a stratum Spark prunes by itself; beyond, strata are first drawn from in parts.
PRUNED, PARTS = 1_000, 64


def uniform(seed: int, by: Sequence[str]) -> Column:
    """A number within (0, 1) that follows from the seed and the columns (null: empty)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in by])
    number = F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, DIGITS), 16, 10).cast("double")
    return (number + 0.5) / float(16**DIGITS)


def _least(rows: DataFrame, strata: Sequence[str], k: int, by: Sequence[str], priority: Column) -> DataFrame:
    if k < 0:
        raise ValueError("a sample has no fewer than 0 rows")
    kept = rows.columns
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *[F.col(f"`{c}`").alias(f"_s{i}") for i, c in enumerate(strata)], *[F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(by)], priority.alias("_priority")).where("_priority is not null")
    groups, order = [f"_s{i}" for i in range(len(strata))], ["_priority", *[f"_b{i}" for i in range(len(by))]]
    rank = lambda *more: F.row_number().over(Window.partitionBy(*groups, *more).orderBy(*order))
    if k > PRUNED or not groups:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
        rows = rows.withColumn("_rank", rank("_part")).where(F.col("_rank") <= k)
    return rows.withColumn("_rank", rank()).where(F.col("_rank") <= k).select("_row.*")


def stratified(rows: DataFrame, strata: Sequence[str], k: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """k rows of each stratum (all, where it has fewer), every set of k equally likely over seeds.

    by: the columns that tell rows apart; rows alike in them are drawn in either order, and of
    repeated rows each counts. A null stratum is one. strata may be empty: k rows of all. Every
    stratum is ranked in one task, over at most k rows from each task that read it.
    """
    return _least(rows, strata, k, by, uniform(seed, by))


def weighted(rows: DataFrame, weight: str, k: int, by: Sequence[str], strata: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """k rows without replacement, each next one drawn in proportion to its weight among those left: the
    least of exponential times -ln(u) / weight. Rows whose weight is null, NaN or not above 0
    are never drawn; an infinite weight comes first."""
    w = F.col(f"`{weight}`").cast("double")
    return _least(rows, strata, k, by, F.when((w > 0) & ~F.isnan(w), -F.log(uniform(seed, by)) / w))
