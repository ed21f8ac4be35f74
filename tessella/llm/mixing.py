"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

A source's weight is piecewise linear in training progress t, from 0 to 1. Its
integral is the source's share of the token budget; a source repeats at most
`max_epochs` times, and what it can't supply is dealt again by weight. Documents lie
behind one another, pass after pass, on the source's token axis. The cumulative
demand D(t) says how far training has come on that axis by t, so a document that
starts at token c is read at t = D^-1(c): within a linear piece D is quadratic, and
its inverse is a closed form. Sorting by t gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, Workspace, n_words
from tessella.llm.ranks import running, seeded_hash, slice_of, slices_for

SEED = 20_011
#: How often a source may be read, at most.
MAX_EPOCHS = 3.0


def ramp_schedule(sources: DataFrame, n_weights: int = 3) -> DataFrame:
    """(source, w0, w1): sources in code-point order, null last, weigh 1..n in turn.

    The integral of the line from w0 (t = 0) to w1 (t = 1) is that weight. Weights
    fall, stay and rise in turn, by half at each end, so early training leans to the
    first kind and late training to the last. The window runs over distinct sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = (F.row_number().over(order) - 1) % n_weights + 1.0
    tilt = (F.row_number().over(order) - 1) % 3 - 1
    return sources.select("source").distinct().select("source", (weight * (1 - 0.5 * tilt)).alias("w0"), (weight * (1 + 0.5 * tilt)).alias("w1"))


def targets(sizes: DataFrame, schedule: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, w0, w1, target): shares of the whole size by integrated weight,
    each at most max_epochs * source_size, the excess dealt again by weight. A source without
    words, or whose weight stays 0, has the target 0.

    Sources are taken by cap per weight; as long as the next cap is below what the
    weight would fetch among those still open, the source is closed at its cap. The
    window runs over sources, a table that holds no documents.
    """
    joined = sizes.join(schedule.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    weight, cap = (F.col("w0") + F.col("w1")) / 2, max_epochs * F.col("source_size")
    joined = joined.withColumn("_w", weight).withColumn("_cap", cap.cast("double"))
    joined = joined.withColumn("_ratio", F.when(F.col("_w") > 0, F.try_divide("_cap", "_w")))
    order = [F.col("_ratio").asc_nulls_last(), F.col("source").isNull(), F.encode("source", "UTF-8")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    joined = joined.withColumn("_rate", F.when(F.col("_w") > 0, F.try_divide(left, open_w))).withColumn("_open", F.col("_rate") < F.col("_ratio"))
    # Once a source stays open, all later ones do, at the rate of the first of them.
    rate = F.first(F.when(F.col("_open"), F.col("_rate")), ignorenulls=True).over(everything)
    target = F.when(F.col("_w") <= 0, 0.0).otherwise(F.least(F.col("_cap"), F.coalesce(rate * F.col("_w"), F.col("_cap"))))
    return joined.withColumn("target", target).select("source", "source_size", "w0", "w1", "target")


def progress_at(share: Column, w0: Column, w1: Column) -> Column:
    """t with (integral of the weight from 0 to t) = share * (its integral from 0 to 1).

    A share of 0 is reached at 0, also where the weight starts from 0; a null share is
    reached never, nor is any share of a weight that stays 0.
    """
    area = share * (w0 + w1) / 2
    t = F.try_divide(2 * area, w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * (w1 - w0) * area)))
    return F.when((w0 + w1 > 0) & share.isNotNull(), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def curriculum(docs: DataFrame, schedule: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per input row, in training order: doc_id, source, size, source_size, target,
    taken, position and passes, an array of (epoch, taken, position).

    * size: words of the text; a null text has none. A null source is a source.
    * taken: the words read from the row over all passes; a source's rows add up to
      its target, rounded. The pass that reaches the target is cut within one row.
    * position: of the first pass, null if the row is not read (such rows come last).
    * Order within a source: a seeded hash of id and size, so reruns agree. Repeated
      rows are each read; alike ones may change places. No rows, no output.

    Only ids, sources and sizes are shuffled. Running sums use hash slices, so a
    source with a third of all rows is spread over tasks as others are.
    """
    return _curriculum(docs, schedule, max_epochs, seed, id_col, text_col, source_col).drop("key")


def _curriculum(docs: DataFrame, schedule: DataFrame | None, max_epochs: float, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What `curriculum` returns, and key, a hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("key"))
    rows = Workspace(docs.sparkSession, "mix").write(rows.withColumn("_h", seeded_hash(seed, "doc_id", "size")), "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, ramp_schedule(sizes) if schedule is None else schedule, max_epochs)
    n_rows = rows.count()
    placed = running(rows.withColumn("_slice", slice_of("_h", slices_for(n_rows))), ["source"], "_slice", ["_h", "doc_id", "key"], F.col("size"), "_start")
    placed = placed.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goal = F.round("target").cast("long")

    def one_pass(epoch: int) -> Column:
        at = F.col("_start") + epoch * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - at)).cast("long")
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("taken"), progress_at(F.try_divide(at, F.col("target")), F.col("w0"), F.col("w1")).alias("position"))

    passes = F.filter(F.array(*[one_pass(e) for e in range(max(1, int(-(-max_epochs // 1))))]), lambda p: p["taken"] > 0)
    placed = placed.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(F.filter(passes, lambda p: F.lit(False))))
    placed = placed.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["taken"]))
    placed = placed.withColumn("position", F.try_element_at("passes", F.lit(1))["position"])
    out = placed.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "passes", "key")
    n_ranges = max(1, n_rows // 200_000 + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return out.repartitionByRange(n_ranges, F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def training_stream(docs: DataFrame, schedule: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs as training reads them: a row per pass over a document, in training order, with
    docs' own columns, whatever their names. The pass that a target ends within holds its
    first words only (one a source); documents beyond the target don't occur, nor do null
    and empty texts, which have no words to read.

    Rows are matched by id, size and a hash of the text. Rows alike in all three are each
    read as the least read of them is, so reruns agree. No rows give none.
    """
    same = ["doc_id", "size", "key"]
    mix = _curriculum(docs, schedule, max_epochs, seed).where("taken > 0").groupBy(*same).agg(F.min("passes").alias("passes"))
    mix = mix.select(*[F.col(c).alias(f"mix_{c}") for c in same], "passes")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), n_words("text").alias("size"), F.xxhash64("text").alias("key"))
    read = rows.join(mix, F.col("doc_id").eqNullSafe(F.col("mix_doc_id")) & (F.col("size") == F.col("mix_size")) & (F.col("key") == F.col("mix_key")))
    read = read.select("row", "doc_id", "size", F.explode("passes").alias("once"))
    text = F.col("row.text")
    begun = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("once.taken").cast("int")), "")
    text = F.when(F.col("once.taken") < F.col("size"), begun).otherwise(text)
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    ordered = read.repartitionByRange(F.col("once.position"), "doc_id").sortWithinPartitions("once.position", "doc_id")
    return ordered.select(row.alias("row")).select("row.*")
