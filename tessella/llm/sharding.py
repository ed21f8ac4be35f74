"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within their source by a seeded hash and ranked; rank r of a
source of n rows stands at (r + 1/2) / n. Sorted by that fraction, every stretch of
the corpus holds each source in its proportion, so cutting the order into equal
pieces gives shards that all match the mixture, their row counts at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Workspace, utf8_crc32
from tessella.llm.ranks import running, seeded_hash, slice_of, slices_for

SEED = 20_011


def interleave(docs: DataFrame, n_shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per input row: doc_id, source, size, text_crc32, position, shard, slot.

    * position: the row's place in the interleaved order, from 0, without gaps.
    * shard: floor(position * n_shards / rows); slot: place within it, from 0.
    * size: the text's UTF-8 bytes and 1; a null text counts as empty.
    * A null source is a source of its own. Repeated rows each get a slot; rows
      alike in id, size and text share neither, and either may come first.
    * A shard holds of each source its share, its rows / n_shards, to within 1 + rows * sources / all rows:
      a piece of the order may begin and end just before or after a row of each source.
    * An empty table gives no row. Further columns are ignored.

    Only ids, sizes and checksums are shuffled, never texts. No source is windowed
    as a whole (see ranks); every slice of the merged order holds about as many rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        utf8_crc32(F.col(text_col)).alias("text_crc32"),
    )
    space = Workspace(docs.sparkSession, "shards")
    rows = space.write(rows.withColumn("_h", seeded_hash(seed, "doc_id", "text_crc32")), "rows")
    n_rows = rows.count()
    n_slices = slices_for(n_rows)
    ranked = running(rows.withColumn("_slice", slice_of("_h", n_slices)), ["source"], "_slice", ["_h", "doc_id", "size", "text_crc32"], F.lit(1), "_rank")
    totals = rows.groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_source")
    placed = ranked.join(totals, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_at", (F.col("_rank") + 0.5) / F.col("_n"))
    placed = space.write(placed.select("doc_id", "source", "size", "text_crc32", "_h", "_at", F.floor(F.col("_at") * n_slices).cast("long").alias("_slice")), "ranks")
    space.drop(rows)
    order = running(placed, [], "_slice", ["_at", "_h", "source", "doc_id", "size", "text_crc32"], F.lit(1), "position")
    n = max(n_rows, 1)
    shard = F.expr(f"position * {n_shards}L div {n}L")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    return order.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", "position", F.col("shard").cast("int").alias("shard"), (F.col("position") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, seed: int = SEED) -> None:
    """Writes docs as n_shards folders shard=K of Parquet, rows in slot order, columns whatever
    their names but shard.

    Rows are matched to their slots by id and checksum; rows alike in both are
    numbered on each side, so each takes one of the slots.
    """
    same = ["doc_id", "text_crc32"]
    number = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))).alias("copy")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8_crc32(F.col("text")).alias("text_crc32")).select("*", number)
    slots = interleave(docs, n_shards, seed).select(*same, number, "shard", "slot")
    slots = slots.select(*[F.col(c).alias(f"at_{c}") for c in slots.columns])
    match = F.col("doc_id").eqNullSafe(F.col("at_doc_id")) & (F.col("text_crc32") == F.col("at_text_crc32")) & (F.col("copy") == F.col("at_copy"))
    out = rows.join(slots, match).repartition(n_shards, "at_shard").sortWithinPartitions("at_shard", "at_slot")
    out.select("row.*", F.col("at_shard").alias("shard")).write.partitionBy("shard").parquet(path)
