"""Column profiles from mergeable sketches, kept by file, so that a grown set reads only its new files.

A sketch of distinct values (HLL) and one of quantiles (KLL) take a bounded number of bytes
for a column however many rows it has, and two of them merge into that of both row sets.
Counts, extremes and sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import to_number
from tessella.operators.profile import NUMERIC_SHARE

#: Logarithm of the registers of a sketch of distinct values: about 1.6 % standard error.
LG_REGISTERS = 12
#: Size of a sketch of quantiles: ranks are right within about 0.7 %.
QUANTILE_SIZE = 400
FILE = ("file", "modified", "bytes")


def sketched(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, filled, parsed, lo, hi, total, values, quantiles): a row for each column of rows, and group.

    Null and '' are empty; numbers are what parses as one, NaN left out. Every cell is read once;
    sketches are built before the shuffle, so a hot group is a row for each task.
    """
    names = [c for c in rows.columns if c not in by]
    cells = rows.select(*by, *[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot([F.col(f"`{c}`") for c in by], [F.col(f"`{c}`") for c in names], "column", "value")
    number = to_number("value")
    cells = cells.withColumn("text", F.nullif("value", F.lit(""))).withColumn("number", F.when(~F.isnan(number), number))
    return cells.groupBy(*by, "column").agg(
        F.count("*").alias("n"),
        F.count("text").alias("filled"),
        F.count("number").alias("parsed"),
        F.min("number").alias("lo"),
        F.max("number").alias("hi"),
        F.sum("number").alias("total"),
        F.hll_sketch_agg("text", LG_REGISTERS).alias("values"),
        F.kll_sketch_agg_double("number", QUANTILE_SIZE).alias("quantiles"),
    )


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of all groups as those of fewer: `by` and column stay."""
    add = lambda c: F.sum(c).alias(c)
    return sketches.groupBy(*by, "column").agg(
        add("n"), add("filled"), add("parsed"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), add("total"),
        F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def quantiles(*shares: float) -> Column:
    """Quantiles of the numbers of a sketch, as an array; null without any number."""
    # Within a higher-order function, as Spark 4.1 doesn't always generate valid code for it on its own.
    got = F.transform(F.array("quantiles"), lambda q: F.array(*[F.kll_sketch_get_quantile_double(q, F.lit(s)) for s in shares]))
    return F.when(F.col("parsed") > 0, F.get(got, 0))


def profiled(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, count, non_empty, empty, distinct, type, min, max, mean, q1, median, q3) from sketches.

    distinct and the quartiles are estimates, all else is exact. type as in profile: numeric if
    80 % of the non-empty cells parse; then the numbers' columns are filled.
    """
    numeric = (F.col("filled") > 0) & (F.col("parsed") >= F.ceil(F.lit(NUMERIC_SHARE) * F.col("filled")))
    shown = lambda c: F.when(numeric, c)
    return merged(sketches, by).withColumn("cuts", quantiles(0.25, 0.5, 0.75)).select(
        *by,
        "column",
        F.col("n").alias("count"),
        F.col("filled").alias("non_empty"),
        (F.col("n") - F.col("filled")).alias("empty"),
        F.hll_sketch_estimate("values").alias("distinct"),
        F.when(numeric, "numeric").otherwise("categorical").alias("type"),
        shown(F.round("lo", 4)).alias("min"),
        shown(F.round("hi", 4)).alias("max"),
        shown(F.round(F.try_divide("total", "parsed"), 4)).alias("mean"),
        *[shown(F.get("cuts", i)).alias(name) for i, name in enumerate(("q1", "median", "q3"))],
    )


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, bytes) of the files at a path; nothing of them is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def _empty(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def refreshed(spark: SparkSession, path: str, table: str, read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """The sketches of all files at path, by file; only files that the table at `table` lacks are read, and
    what they give is added to it.

    A file that changed (time or size) is read again, one that went no longer counts; their
    old rows stay in the table unused. read makes a DataFrame of file names, which the driver
    lists as Spark's own scans do. No files give no rows; a file without rows gives none and
    is looked at each time.
    """
    now = _listed(spark, path)
    same = [F.col(c) == F.col(f"_{c}") for c in FILE]
    new = now
    if not _empty(spark, table):
        known = spark.read.parquet(table).select(*[F.col(c).alias(f"_{c}") for c in FILE]).distinct()
        new = now.join(known, same, "left_anti")
    names = [r["file"] for r in new.select("file").collect()]
    if names:
        rows = read(names)
        found = sketched(rows.withColumn("_from", F.col("_metadata.file_path")), ["_from"])
        marked = found.join(new, F.col("_from") == F.col("file")).drop("_from")
        marked.write.mode("append").parquet(table)
    if _empty(spark, table):
        return sketched(now.limit(0), FILE)
    kept = now.select(*[F.col(c).alias(f"_{c}") for c in FILE])
    return spark.read.parquet(table).join(kept, same, "left_semi")
