"""Writers: JSON reports, CSV, single texts, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """(json) a report line for each row, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def as_lines(df: DataFrame) -> DataFrame:
    """(line) `name: value` pairs for people to read; null and '' show as (blank)."""
    shown = lambda c: F.coalesce(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("(blank)"))
    return df.select(F.concat_ws("  ", *[F.concat(F.lit(f"{c}: "), shown(c)) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_texts(df: DataFrame, path: str, text: str, name: str) -> None:
    """A folder for each name with its text as one file, ended by a newline: pages, sheets, bundles, sitemaps."""
    value = F.regexp_replace(F.col(text), "\n$", "")
    df.select(F.col(name).cast("string").alias("name"), value.alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_packed(df: DataFrame, path: str, text: str, name: str) -> str:
    """Texts as they are, many to a file, each after a line of JSON with its name; for more texts than a file each is
    good for. Returns what stands between them, which read_packed asks for: drawn anew, so that no text holds it."""
    between = "\x1e" + uuid.uuid4().hex
    head = F.to_json(F.struct(F.col(name).cast("string").alias("name"), F.col(text).isNull().alias("missing")))
    df.select(F.concat(head, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).alias("value")).write.mode("overwrite").option("lineSep", between).text(path)
    return between


def write_snapshot(df: DataFrame, path: str) -> None:
    """A baseline for later comparison, as Parquet."""
    df.write.mode("overwrite").parquet(path)
