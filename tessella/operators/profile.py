"""Profiling of all-string tables: filter, project, group and profile, in that order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import to_number

# Fixed value: column names that are taken to hold secrets.
SENSITIVE = (
    r"(?i)(password|passwd|secret|token|api[_-]?key|ssn|social.?security|"
    r"credit.?card|card.?number|cvv|auth|private[_-]?key|access[_-]?key)"
)
REDACTED = "[redacted]"
NUMERIC_SHARE, TOP = 0.8, 5
ROW = "_row_idx"


@dataclass
class Report:
    """What a profiling run asks for, and what it warns of."""

    filters: list[str] = field(default_factory=list)
    select: str | None = None
    group_by: str | None = None
    show_sensitive: bool = False
    warnings: list[str] = field(default_factory=list)


def with_row_idx(df: DataFrame) -> DataFrame:
    """First-seen order, set before any shuffle."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def duplicate_headers(header: list[str]) -> list[str]:
    return sorted({h for h in header if header.count(h) > 1})


def apply_filters(df: DataFrame, report: Report) -> DataFrame:
    """Keeps rows where each COL=VALUE holds exactly; null never equals; a malformed or unknown
    condition is skipped with a warning."""
    for condition in report.filters:
        name, sign, value = condition.partition("=")
        if not sign or name.strip() not in df.columns:
            report.warnings.append(f"filter skipped: {condition}")
        else:
            df = df.where(F.col(f"`{name.strip()}`") == value.strip())
    return df


def apply_select(df: DataFrame, report: Report) -> DataFrame:
    """Columns in the order asked for; unknown ones warn, and if none is left all stay."""
    if report.select is None:
        return df
    asked = [c.strip() for c in report.select.split(",") if c.strip()]
    known = [c for c in asked if c in df.columns and c != ROW]
    report.warnings += [f"unknown column: {c}" for c in asked if c not in df.columns]
    return df.select(*dict.fromkeys([*known, *([ROW] if ROW in df.columns else [])])) if known else df


def is_sensitive(name: Column) -> Column:
    return F.regexp_like(name, F.lit(SENSITIVE))


def group_count(df: DataFrame, column: str, show_sensitive: bool = False) -> DataFrame:
    """(value, n), most frequent first, ties in first-seen order; null and blank stay apart.
    Values of a sensitive column are redacted here too."""
    df = with_row_idx(df)
    value = F.col(f"`{column}`").cast("string")
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(ROW).alias("first_idx"))
    if not show_sensitive:
        counts = counts.withColumn("value", F.when(is_sensitive(F.lit(column)), F.lit(REDACTED)).otherwise(F.col("value")))
    return counts.orderBy(F.desc("n"), "first_idx").select("value", "n")


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n, first_idx): one unpivot and one partially combined aggregate."""
    df = with_row_idx(df)
    names = [c for c in df.columns if c != ROW]
    cells = df.select(ROW, *[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot([ROW], names, "column", "value")
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"), F.min(ROW).alias("first_idx"))


def profile(df: DataFrame, show_sensitive: bool = False) -> DataFrame:
    """A row per column: count, non_empty, empty, distinct, type, min, max, mean.

    Null and '' are empty. A column is numeric if at least 80 % of its non-empty cells
    parse; then min, max and mean run over those that do (NaN left out), rounded to 4
    places. Sensitive columns count as categorical. Statistics come from the counts of
    distinct values, so no row is shuffled as such.
    """
    counts = value_counts(df).withColumn("filled", F.nullif(F.col("value"), F.lit(""))).withColumn("number", to_number("value"))
    number = F.when(~F.isnan("number"), F.col("number"))
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.coalesce(F.sum(F.when(F.col("filled").isNotNull(), F.col("n"))), F.lit(0)).alias("non_empty"),
        F.count("filled").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("number").isNotNull(), F.col("n"))), F.lit(0)).alias("parsed"),
        F.min(number).alias("lo"),
        F.max(number).alias("hi"),
        (F.sum(number * F.col("n")) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("avg"),
    )
    numeric = (F.col("non_empty") > 0) & (F.col("parsed") >= F.ceil(F.lit(NUMERIC_SHARE) * F.col("non_empty")))
    numeric = numeric if show_sensitive else numeric & ~is_sensitive(F.col("column"))
    shown = lambda c: F.when(numeric, F.round(c, 4))
    kind = F.when(numeric, "numeric").otherwise("categorical")
    return stats.select("column", "count", "non_empty", (F.col("count") - F.col("non_empty")).alias("empty"), "distinct", kind.alias("type"), shown("lo").alias("min"), shown("hi").alias("max"), shown("avg").alias("mean"))


def top_values(df: DataFrame, show_sensitive: bool = False, k: int = TOP) -> DataFrame:
    """(column, rank, value, n): the k most frequent non-empty values, ties first-seen.

    Candidates are cut to k per column within each partition of values first, so a
    column of very many values is not ranked by one task.
    """
    counts = value_counts(df).where("value is not null and value <> ''")
    order = [F.desc("n"), "first_idx"]
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    near = salted.withColumn("r", F.row_number().over(Window.partitionBy("column", "salt").orderBy(*order))).where(f"r <= {k}")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(f"rank <= {k}")
    value = F.col("value") if show_sensitive else F.when(is_sensitive(F.col("column")), F.lit(REDACTED)).otherwise(F.col("value"))
    return ranked.select("column", "rank", value.alias("value"), "n")


def run(df: DataFrame, report: Report) -> dict[str, DataFrame]:
    """All parts of a report as lazy tables: rows, profile, top_values and, if asked for, groups."""
    df = apply_select(apply_filters(with_row_idx(df), report), report)
    parts = {"rows": df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns) - 1)), "profile": profile(df, report.show_sensitive), "top_values": top_values(df, report.show_sensitive)}
    if report.group_by is not None:
        if report.group_by in df.columns:
            parts["groups"] = group_count(df, report.group_by, report.show_sensitive)
        else:
            report.warnings.append(f"unknown group column: {report.group_by}")
    return parts
