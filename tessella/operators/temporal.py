"""Joins along time: the last row before each row (as-of), and rows whose spans overlap.

Neither is an equality join, so left to itself Spark would compare every row of a key with
every other. Both are brought down to equality here: the as-of join by running a last
value along the union of both sides, in slices of time where a key is long; the overlap
join by bins about as wide as the spans themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.staging import SMALL_ROWS

#: Moments of one key in a slice, about. A key with more is cut.
SLICE_ROWS = 50_000
#: A long key is cut at so many quantiles, and evenly between two of them.
QUANTILES, ACCURACY = 64, 10_000
#: Spans whose lengths lie within a factor of 2 ** STEP share a width of bins.
STEP = 2
#: The end of an open span.
OPEN = 1 << 61


def place(df: DataFrame, name: str) -> Column:
    """A column's place in time as a long: microseconds of times and dates, else the number itself."""
    if df.schema[name].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(f"`{name}`").cast("timestamp"))
    return F.col(f"`{name}`").cast("long")


def _whole(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def _equal(left: Sequence[str], right: Sequence[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same &= F.col(a) == F.col(b)
    return same


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], prefix: str = "last_", tie: Sequence[str] = (), forward: bool = False, strict: bool = False, within: int | None = None) -> DataFrame:
    """left with `columns` of right (named with prefix): of right's rows with equal keys, the last
    one at or before left_time (forward: the first at or after it; strict: not at the same moment).

    * Of several rows of right at that moment the one with the largest `tie`, then the largest `columns`.
    * within: at most so far away, in microseconds for times, else in the column's own unit.
    * A row of left without a match, or with a null key or time, stays, with nulls; null keys
      and times of right match nothing. Repeated rows of left are each answered. An empty left
      gives no rows, an empty right no matches. No column of left may be called like a new one.

    Shuffled: left once, to meet its answers by key and moment, and beside it only distinct
    moments with their keys. A key with most of the rows is cut into slices of time; what a
    slice ends with is carried over, a row for each slice.
    """
    sign = -1 if forward else 1
    keys, asked_keys = [f"_k{i}" for i in range(len(on))], [f"_a{i}" for i in range(len(on))]
    spot = lambda df, time: [*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], (sign * place(df, time)).alias("_t")]
    known = [*keys, "_t"]
    best = F.max(F.struct(*[F.col(f"_right.`{c}`").alias(f"t{i}") for i, c in enumerate(tie)], *[F.col(f"_right.`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]))
    given = right.select(*spot(right, right_time), F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*tie, *columns])]).alias("_right")).dropna(subset=known)
    given = given.groupBy(*known).agg(best.alias("_row")).withColumn("_side", F.lit(int(strict)))
    asked = left.select(*spot(left, left_time)).dropna().distinct()
    # At one moment side 0 comes first: what is given there counts for what is asked there, unless strict.
    both = given.unionByName(asked.withColumn("_side", F.lit(int(not strict))), allowMissingColumns=True)
    sliced, many = _sliced(both, keys)
    found = F.when(F.col("_row").isNotNull(), F.struct("_t", "_row"))
    here = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = sliced.withColumn("_found", F.last(found, ignorenulls=True).over(here)).where(F.col("_row").isNull())
    if many:
        ends = sliced.groupBy(*keys, "_slice").agg(F.max(found).alias("_end"))  # the latest, as moments are distinct
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        answers = answers.join(carried, [*keys, "_slice"]).withColumn("_found", F.coalesce("_found", "_carried"))
    if within is not None:
        answers = answers.withColumn("_found", F.when(F.col("_t") - F.col("_found._t") <= within, F.col("_found")))
    answers = answers.select(*[F.col(k).alias(a) for k, a in zip(keys, asked_keys, strict=True)], F.col("_t").alias("_at"), "_found")
    rows = left.select(_whole(left, "_left"), *spot(left, left_time))
    new = [F.col(f"_found._row.c{i}").alias(f"{prefix}{c}") for i, c in enumerate(columns)]
    return rows.join(answers, _equal([*keys, "_t"], [*asked_keys, "_at"]), "left").select("_left.*", *new)


def _sliced(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """(rows with _slice, which never falls along _t; whether any key has several).

    A long key is cut at quantiles of its moments, and between two quantiles evenly, so that
    a slice holds some SLICE_ROWS of them also where they crowd.
    """
    long = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > SLICE_ROWS)
    n_long, most = long.agg(F.count("*"), F.max("_n")).first()
    if not n_long:
        return rows.withColumn("_slice", F.lit(0).cast("long")), False
    step = [i / QUANTILES for i in range(QUANTILES + 1)]
    cuts = rows.join(long, keys, "left_semi") if keys else rows
    cuts = cuts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_t", step, ACCURACY)).alias("_cuts"))
    of = [f"_c{i}" for i in range(len(keys))]
    cuts = cuts.select(*[F.col(k).alias(c) for k, c in zip(keys, of, strict=True)], "_cuts")
    cuts = F.broadcast(cuts) if n_long <= SMALL_ROWS else cuts
    pieces = max(1, most // SLICE_ROWS // QUANTILES + 1)
    rows = rows.join(cuts, _equal(keys, of), "left").withColumn("_q", F.size(F.filter("_cuts", lambda c: c <= F.col("_t"))).cast("long"))
    low, high = F.get("_cuts", F.col("_q").cast("int") - 1), F.get("_cuts", F.col("_q").cast("int"))
    share = F.coalesce(F.try_divide((F.col("_t") - low).cast("double"), (high - low).cast("double")), F.lit(0.0))
    slice_ = F.col("_q") * pieces + F.least(F.floor(share * pieces), F.lit(pieces - 1))
    return rows.withColumn("_slice", F.coalesce(F.when(F.col("_cuts").isNotNull(), slice_), F.lit(0)).cast("long")).drop("_q", "_cuts", *of), True


def _spans(df: DataFrame, on: Sequence[str], span: tuple[str, str | None], side: str) -> DataFrame:
    """The rows of df that can overlap anything: key columns, the row, its span [lo, hi), and
    the level of its length, the least multiple of STEP with 2 ** level at or above it."""
    start, end = span
    low = place(df, start)
    high = low + 1 if end is None else F.coalesce(place(df, end), F.lit(OPEN))
    rows = df.select(*[F.col(f"`{c}`").alias(f"_{side}k{i}") for i, c in enumerate(on)], _whole(df, f"_{side}"), low.alias(f"_{side}lo"), high.alias(f"_{side}hi"))
    rows = rows.dropna(subset=[c for c in rows.columns if c != f"_{side}"]).where(F.col(f"_{side}lo") < F.col(f"_{side}hi"))
    length = F.col(f"_{side}hi") - F.col(f"_{side}lo")
    bits = F.when(length > 1, F.length(F.bin(length - 1))).otherwise(0)
    return rows.withColumn(f"_{side}l", (F.ceil(bits / STEP) * STEP).cast("int"))


def _binned(rows: DataFrame, side: str, others: list[int]) -> DataFrame:
    """A row for each bin that a span touches, at its own level and at the higher ones of the other
    side; at most two for a level, as no bin is shorter than the span."""
    own = F.col(f"_{side}l")
    levels = F.array_distinct(F.concat(F.array(own), F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > own)))
    rows = rows.withColumn("_level", F.explode(levels))
    return rows.withColumn("_bin", F.explode(F.expr(f"sequence(shiftright(_{side}lo, _level), shiftright(_{side}hi - 1, _level))")))


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str | None], right_span: tuple[str, str | None], prefix: str = "other_") -> DataFrame:
    """Pairs of rows with equal keys whose spans [start, end) share a moment: left's columns, and
    right's named with prefix.

    * A span without an end column is one moment (a microsecond for times, else one unit).
    * A null end is open; a null start or key, or an end not after the start, overlaps nothing.
    * Repeated rows pair each; no rows on one side give none. With no keys, all rows may pair.

    Bins are as wide as spans are long, a width for each power of 4 that occurs, so a span
    lies in two bins at most however long it is, and only rows that are near meet. A pair is
    given at its first common bin only. Shuffled: each row twice at most for its own width
    and each larger one on the other side. A key with most of the rows is spread over bins.
    """
    a, b = _spans(left, on, left_span, "a"), _spans(right, on, right_span, "b")
    levels = {side: sorted(r[0] for r in df.select(f"_{side}l").distinct().collect()) for side, df in (("a", a), ("b", b))}  # at most 32 each
    a, b = _binned(a, "a", levels["b"]), _binned(b, "b", levels["a"]).withColumnsRenamed({"_level": "_blevel", "_bin": "_bbin"})
    near = _equal([*[f"_ak{i}" for i in range(len(on))], "_level", "_bin"], [*[f"_bk{i}" for i in range(len(on))], "_blevel", "_bbin"])
    meet = (F.greatest("_al", "_bl") == F.col("_level")) & (F.col("_alo") < F.col("_bhi")) & (F.col("_blo") < F.col("_ahi"))
    first = F.expr("shiftright(greatest(_alo, _blo), _level)") == F.col("_bin")
    pairs = a.join(b, near & meet & first)
    return pairs.select("_a.*", *[F.col(f"_b.`{c}`").alias(f"{prefix}{c}") for c in right.columns])
