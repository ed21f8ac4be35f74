"""Long tables of (row, feature, value) as sparse vectors, whatever features there are.

Unlike a pivot it needs no list of columns: features get their rank among all features as
number, found without any task or the driver seeing them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.ranks import positions

#: Feature numbers that one block of a row covers; it bounds a vector.
WIDTH = 65_536


def feature_ids(cells: DataFrame, feature: str = "feature") -> DataFrame:
    """(feature, id): distinct features, numbered from 0 in code-point order; null is none."""
    return positions(cells.select(F.col(feature).cast("string").alias("feature")).where("feature is not null").distinct(), "feature").withColumnRenamed("position", "id")


def vectors(cells: DataFrame, ids: DataFrame, row: str = "row", feature: str = "feature", value: str = "value", width: int = WIDTH) -> DataFrame:
    """(row, block, indices, values): the cells of each row by ascending feature number, block holding
    numbers from block * width on; blocks without cells are not there.

    Values of one row and feature are added up; null features and values count for nothing, a
    null row is a row. Cells are added up before they are shuffled; a vector holds at most
    `width` cells, so that a row of very many features is several.
    """
    known = cells.select(F.col(row).alias("row"), F.col(feature).cast("string").alias("_feature"), F.col(value).cast("double").alias("_value")).dropna(subset=["_feature", "_value"])
    sums = known.groupBy("row", "_feature").agg(F.sum("_value").alias("_value"))
    numbered = sums.join(ids, F.col("_feature") == F.col("feature")).select("row", F.floor(F.col("id") / width).alias("block"), F.struct("id", "_value").alias("cell"))
    made = numbered.groupBy("row", "block").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    return made.select("row", "block", F.col("cells.id").alias("indices"), F.col("cells._value").alias("values"))


def unpivoted(table: DataFrame, row: str) -> DataFrame:
    """(row, feature, value): the numeric columns of a wide table as cells."""
    names = [c for c in table.columns if c != row]
    return table.select(row, *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot([row], names, "feature", "value").withColumnRenamed(row, "row")
