"""Windows of event time over a stream, closed by a watermark, and what came too late for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.temporal import overlapping
from tessella.sources.staging import folder


def drained(stream: DataFrame, name: str) -> tuple[DataFrame, str | None]:
    """(what a stream gives for all that is there now, as a written table; its last watermark).

    Append mode: only what is final is written. Table and checkpoint lie in the shared folder.
    """
    spark, out = stream.sparkSession, folder(stream.sparkSession, name)
    run = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress
    mark = (last["eventTime"] or {}).get("watermark") if last else None
    return spark.read.schema(stream.schema).parquet(out), mark


def files_stream(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the rows of Parquet files (a folder, or a file), with the schema they have now; times
    without a zone are taken in the session's, as watermarks need them."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    path = path.rstrip("/")  # as a pattern that only this path fits: streams take single files so, and folders too
    rows = (reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumns({f.name: F.col(f"`{f.name}`").cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def counted(rows: DataFrame, time: str, late: str, keys: Sequence[str], totals: Sequence[Column], size: str | None = None, slide: str | None = None, gap: str | None = None) -> DataFrame:
    """(keys, start, end, n, totals): rows by windows of event time, for a stream or a table.

    size alone: windows side by side; with slide: windows that begin every slide, so a row is in
    several; gap: sessions, which a pause of that length ends. A stream closes a window once its
    end is not after the watermark, the latest time seen less `late`; rows for closed windows
    are dropped then (late_counts finds them). A null time is in no window, null keys are a
    key. Counts are added up before the shuffle; of a hot key a row for each task and window
    is shuffled, only sessions need a key's rows together, window by window.
    """
    if (size is None) == (gap is None):
        raise ValueError("give either a size or a gap")
    window = F.session_window(time, gap) if gap is not None else F.window(time, size, slide or size)
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    found = rows.groupBy(*keys, window.alias("window")).agg(F.count("*").alias("n"), *totals)
    return found.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in found.columns if c not in (*keys, "window")])


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    same = F.lit(True)
    for x, y in zip(a, b, strict=True):
        same &= F.col(x).eqNullSafe(F.col(y))
    return same


def late_counts(rows: DataFrame, written: DataFrame, watermark: str, time: str, keys: Sequence[str], size: str, slide: str | None = None) -> DataFrame:
    """(keys, start, end, n_late): how many rows each closed window misses, of the table `rows` that the
    stream has read by now and the windows it has written. Every row of a closed window is either
    counted there or here; windows that miss none are not listed."""
    whole = counted(rows, time, "0 seconds", keys, [], size, slide).where(F.col("end") <= F.to_timestamp(F.lit(watermark)))
    seen = written.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_start"), F.col("n").alias("_n"))
    both = whole.join(seen, _same([*keys, "start"], [*[f"_{k}" for k in keys], "_start"]), "left")
    return both.select(*keys, "start", "end", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n_late")).where("n_late > 0")


def late_rows(rows: DataFrame, sessions: DataFrame, watermark: str, time: str, keys: Sequence[str], gap: str) -> DataFrame:
    """Rows that came too late for sessions: those whose time and gap are not after the watermark and
    that lie in no session written for their key (keys must not be null)."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    due = numbered.where(F.col(time) + F.expr(f"interval {gap}") <= F.to_timestamp(F.lit(watermark)))
    inside = overlapping(due, sessions.select(*keys, "start", "end"), keys, (time, None), ("start", "end"), "_session_").select("_row")
    return due.join(inside, "_row", "left_anti").drop("_row")


def answered(asked: DataFrame, answers: DataFrame, on: Sequence[str], asked_at: str, answered_at: str, within: str, late: str, prefix: str = "answer_", how: str = "inner") -> DataFrame:
    """Two streams (or tables) joined: each row of asked with the rows of answers with equal keys that
    come at or after it, at most `within` later; their columns get the prefix.

    Streams keep a row only until the watermark says that no partner can come any more. With
    how="left", rows that stay without an answer are given then, with nulls. Null keys and
    times match nothing. Shuffled by key.
    """
    if asked.isStreaming:
        asked, answers = asked.withWatermark(asked_at, late), answers.withWatermark(answered_at, late)
    other = answers.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in answers.columns])
    at = F.col(f"{prefix}{answered_at}")
    near = (at >= F.col(asked_at)) & (at <= F.col(asked_at) + F.expr(f"interval {within}"))
    for k in on:
        near &= F.col(k) == F.col(f"{prefix}{k}")
    return asked.join(other, near, how)


def first_seen(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The stream without rows whose keys came before, as far back as the watermark keeps them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
