"""How much of each text occurs nowhere else, without a shuffled row for each shingle.

Batches of texts are blocks. A block sends its distinct shingles, as packed hashes, to buckets
by hash; a bucket answers which of them other blocks have as well. What occurs twice within a
block is known there, so a shingle that all texts share is one entry for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.blobs import BLOB, OWN, blob_row, blob_table, narrow, packed, unpacked
from tessella.functions.text import words
from tessella.sources.staging import folder

#: Texts in a block, and input bytes for each bucket.
BLOCK_ROWS, BUCKET_BYTES = 2_000, 8_000_000


def shingled(rows: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, grams): 64-bit hashes of each text's distinct runs of k lower-cased words; null counts as empty."""
    held = rows.select(F.col(key).cast("string").alias("key"), words(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    starts = F.slice("w", F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(0)))
    return held.select("key", F.array_distinct(F.transform(starts, lambda _, i: F.xxhash64(F.array_join(F.slice("w", i + 1, k), " ")))).alias("grams"))


def unique_counts(rows: DataFrame, n_buckets: int) -> DataFrame:
    """(key, shingles, unique) of rows (key, grams): a row for each row, whatever its key; unique are the
    grams that no other row has. key: string, null or not; grams: array of distinct longs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, grams = batch.column(0).cast(pa.large_string()), batch.column(1).cast(pa.large_list(pa.int64()))
            n = np.diff(grams.offsets.to_numpy())
            flat = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            names, first, counts = np.unique(flat, return_index=True, return_counts=True)
            owner = np.repeat(np.arange(len(n)), n)[first]
            bucket = (names >> np.uint64(32)).astype(np.int64) % n_buckets
            order = np.lexsort((names, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            asked = np.flatnonzero(np.diff(cuts)).tolist()
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            texts = [(x or "").encode() for x in keys.to_pylist()]
            ends = np.cumsum([0, *map(len, texts)])
            yield blob_row(block, OWN, np.frombuffer(b"".join(texts), np.uint8), ends, known.view(np.uint8), narrow(n), narrow(owner[order]), (counts[order] == 1).view(np.uint8), np.array([len(asked)]))
            for b in asked:
                yield blob_row(block, b, names[order[cuts[b] : cuts[b + 1]]])
            block += 1

    def shared(blobs: pa.Table) -> pa.Table:
        opened = [unpacked(p)[0] for p in blobs["payload"].to_pylist()]
        names, back, counts = np.unique(np.concatenate(opened), return_inverse=True, return_counts=True)
        flags, at, replies = (counts > 1)[back], 0, []
        for x in opened:
            replies.append(packed(np.packbits(flags[at : at + len(x)]), np.array([len(x)])))
            at += len(x)
        return blob_table(blobs["block"], blobs["bucket"], replies)

    def gather(own: pa.Table, replies: pa.Table) -> pa.Table:
        raw, ends, known, n, owner, single, n_blobs = unpacked(own["payload"][0].as_py())
        if len(replies) != n_blobs[0]:
            raise RuntimeError(f"{len(replies)} of {n_blobs[0]} replies came back to a block")
        replies = replies.sort_by("bucket")
        elsewhere = [np.unpackbits(bits, count=int(size[0])) for bits, size in map(unpacked, replies["payload"].to_pylist())]
        alone = single.astype(bool)
        alone &= ~np.concatenate([np.zeros(0, np.uint8), *elsewhere]).astype(bool)
        unique = np.bincount(owner[alone].astype(np.int64), minlength=len(n))
        text = raw.tobytes()
        keys = [text[a:b].decode() if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), known.tolist(), strict=True)]
        return pa.table({"key": pa.array(keys, pa.string()), "shingles": pa.array(n.astype(np.int64)), "unique": pa.array(unique.astype(np.int64))})

    spark = rows.sparkSession
    path, setting = folder(spark, "uniqueness"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BLOCK_ROWS))
    try:
        rows.mapInArrow(cut, BLOB).write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    blobs = spark.read.schema(BLOB).parquet(path)
    replies = blobs.where(F.col("bucket") != OWN).groupBy("bucket").applyInArrow(shared, BLOB)
    own = blobs.where(F.col("bucket") == OWN)
    return own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(gather, "key string, shingles long, unique long")
