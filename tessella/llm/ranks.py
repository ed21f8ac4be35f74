"""Exact ranks and running sums over groups of any size, without one task per group.

A window over a whole group puts the group into one task. Here each group is cut
into slices by a hash of its order key; slices are summed (a small table, combined
map-side), slice offsets come from a running sum over that small table, and only
single slices are windowed over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a slice, about: few, so that a large group fills many slices, until the table of slices would grow long.
SLICE_ROWS, MANY_SLICES, LARGE_SLICE_ROWS = 500, 4096, 50_000


#: Bits of a seeded hash, the first ones of an MD5 digest, which other engines have as well.
HASH_BITS = 60


def seeded_hash(seed: int, *cols: str) -> Column:
    """A number from 0 to 2^HASH_BITS - 1 that follows from the seed and the columns (null: empty)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("long")


def slice_of(h: str, n_slices: int) -> Column:
    """Which of n equal ranges of the hashes h falls in; ordered as h is."""
    return F.floor(F.col(h).cast("double") / F.lit(2.0**HASH_BITS / n_slices)).cast("long")


def slices_for(n_rows: int) -> int:
    return max(1, min(n_rows // SLICE_ROWS, MANY_SLICES), n_rows // LARGE_SLICE_ROWS)


def running(rows: DataFrame, group: list[str], slice_col: str, order: list[str], amount: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `amount` over rows of the group before this one, in the order
    (slice_col, *order); slice_col must not decrease along `order`.

    With amount = 1 it is a rank from 0. Ties beyond `order` fall in either order.
    """
    keys = [*group, slice_col]
    sums = rows.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_here", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(offsets, same, "left")
    return joined.withColumn(out, F.col("_before") + F.col("_here")).drop("_here", "_before", *[f"_k{i}" for i in range(len(keys))])
