"""Removal of repeated byte strings through blockwise difference-cover suffix sorting.

Sorting every suffix of a corpus would shuffle many times the corpus. So windows
(strings of `length` bytes) are first assigned to anchors: the GRAM-byte string of
least hash within the window. Equal windows have equal anchors, at equal places; an
anchor that occurs once rules out all its windows. For anchors that recur, the
stretch of text that its windows span is dealt out by anchor, and the suffixes that
start windows there are sorted (suffix_array). Neighbours that share `length` bytes
are copies; all but the first in document order are marked, and the bytes under the
marks go. Anchors leave no window out, so the result is that of the whole corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.blobs import BLOB, OWN, blob_row, blob_table, fingerprints, packed, unpacked
from tessella.llm.common import Workspace, parts
from tessella.llm.ngram_join import BATCH_ROWS, block_numbers, checked, deal_entries, shared_entries
from tessella.llm.suffix_array import CoverSorter
from tessella.llm.words import SLICE_BYTES, bytes_of, gather_ranges, give_back, mix64, slice_hashes, slices

LENGTH, GRAM = 100, 32
NO_ID = -(1 << 63)
#: Bytes hashed at once.
CHUNK = 1 << 17
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD6E8FEB86659FD93


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each place on (GRAM is a power of 2)."""
    h, size, base = _BYTE[text], 1, _BASE
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base & 0xFFFFFFFFFFFFFFFF, 2 * size
    return mix64(h)


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first window start, number of windows) of a text's runs of windows with one anchor.

    Of equal hashes in a window the leftmost is the anchor, which the window's bytes decide.
    """
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = length - GRAM + 1
    found, ahead = [], CHUNK - length
    bits = np.uint64(CHUNK - 1)
    for at in range(0, len(text) - length + 1, ahead):
        h = gram_hashes(text[at : at + ahead + length - 1])
        low = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        place = (low & bits).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0]))
        found.append((h[place[starts]], starts + at, np.diff(np.append(starts, len(place)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _table(names: list[str], kinds: list, columns: list) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def recurring(docs: DataFrame, length: int, n_buckets: int, space: Workspace) -> DataFrame:
    """(doc_id, key, runs) of the documents with recurring anchors, each once; runs packs their
    anchors' names, first window starts and numbers of windows. docs: doc_id, key, text.

    The blocks are written once, with what stays behind for each, so replies meet their
    block however docs was partitioned or ordered. An anchor that recurs within a block is
    one entry for the block, whatever the number of its documents.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_numbers()
        for batch in slices(batches):
            block = next(numbers)
            raw, offsets = bytes_of(batch.column(2))
            runs = [anchors(raw[a:b], length) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            name, start, windows = (np.concatenate(x) for x in zip(*runs, strict=True))
            owner = np.repeat(np.arange(len(runs)), [len(r[0]) for r in runs])
            again, blobs = deal_entries(block, name, n_buckets, owner, start, windows)
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            yield blob_row(block, OWN, ids, keys, fingerprints(name[again]), owner[again].astype(np.uint32), start[again].astype(np.uint32), windows[again].astype(np.uint32), np.array([len(blobs)]))
            yield from blobs

    def count(blobs: pa.Table) -> pa.Table:
        replies = [packed(prints[shared], *(v[shared] for v in values)) for prints, values, shared in shared_entries(blobs)]
        return blob_table(blobs["block"], blobs["bucket"], replies)

    def gather(own: pa.Table, replies: pa.Table) -> pa.Table:
        columns: tuple[list, ...] = ([], [], [])
        ids, keys, *local, n_blobs = unpacked(own["payload"][0].as_py())
        answers = [local, *checked(int(n_blobs[0]), replies)]
        name, owner, start, windows = (np.concatenate([a[k] for a in answers]) for k in range(4))
        order = np.lexsort((start, owner))
        name, owner, start, windows = name[order], owner[order], start[order], windows[order]
        cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[i], cuts[i + 1]
            for column, value in zip(columns, (int(ids[i]), int(keys[i]), packed(name[a:b], start[a:b].astype(np.int64), windows[a:b].astype(np.int64))), strict=True):
                column.append(value)
        return _table(["doc_id", "key", "runs"], [pa.int64(), pa.int64(), pa.binary()], list(columns))

    blobs = space.write(docs.mapInArrow(deal, BLOB), "anchors", BATCH_ROWS)
    replies = blobs.where(f"bucket <> {OWN}").groupBy("bucket").applyInArrow(count, BLOB)
    own = blobs.where(f"bucket = {OWN}")
    found = own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(gather, "doc_id long, key long, runs binary")
    found = space.write(found.groupBy("doc_id", "key").agg(F.first("runs").alias("runs")), "recurring-anchors")
    space.drop(blobs)
    return found


def first_of_equal(raw: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the stretches, position in it of the first with the same bytes).

    Equal ones stand together, by keys. Hashes bring them there; bytes decide.
    """
    end = begin + windows + length - 1
    hashes = slice_hashes(raw, begin, end)
    order = np.lexsort((*reversed(keys), hashes))
    at = np.arange(len(order))
    new = np.concatenate([[True], np.diff(hashes[order]) != 0]) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, at, 0))
    later, whole = np.flatnonzero(first != at), raw.tobytes()
    own, head = order[later], order[first[later]]
    ends = zip(begin[own].tolist(), end[own].tolist(), begin[head].tolist(), end[head].tolist(), strict=True)
    same = np.fromiter((whole[a:b] == whole[c:d] for a, b, c, d in ends), bool, len(later))
    first[later[~same]] = later[~same]  # equal hashes by chance: it stands for itself
    return order, first


def marked(texts: DataFrame, length: int, n_buckets: int, n_groups: int) -> DataFrame:
    """(group, payload) blobs of marked windows: keys of documents, starts and numbers of windows.

    texts: doc_id, key, text, runs. Stretches equal to an earlier one in the same batch
    are marked at once and not sent, so a passage that many documents share is sent
    once by each batch, not by each document.
    """

    def emit(doc: np.ndarray, key: np.ndarray, start: np.ndarray, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = key % n_groups  # as Spark's pmod
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(n_groups + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[g] : cuts[g + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([int(g)], pa.int32()), pa.array([packed(doc[mine], key[mine], start[mine], windows[mine])], pa.binary())], ["bucket", "group", "payload"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 * SLICE_BYTES):
            raw, offsets = bytes_of(batch.column(2))
            runs = [unpacked(b) for b in batch.column(3).to_pylist()]
            if not runs:
                continue
            name, start, windows = (np.concatenate([r[k] for r in runs]) for k in range(3))
            n = [len(r[0]) for r in runs]
            doc, key = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in (0, 1))
            begin = np.repeat(offsets[:-1], n) + start
            # Places of equal anchors in equal stretches agree, so equal bytes mean equal windows.
            order, first = first_of_equal(raw, begin, windows, length, [doc, start])
            head = order[first]
            later = (doc[order] != doc[head]) | (start[order] != start[head])
            yield from emit(doc[order[later]], key[order[later]], start[order[later]], windows[order[later]])
            sent = order[first == np.arange(len(first))]
            bucket = (mix64(name[sent].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                mine = sent[by[cuts[b] : cuts[b + 1]]]
                blob = packed(doc[mine], key[mine], start[mine], windows[mine], raw[gather_ranges(begin[mine], windows[mine] + length - 1)])
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([-1], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "group", "payload"])

    def sort(bucket: tuple, blobs: pa.Table) -> pa.Table:
        if bucket[0].as_py() < 0:  # marked already
            return blobs.select(["bucket", "group", "payload"])
        give_back()
        opened = [unpacked(p) for p in blobs["payload"].to_pylist()]
        doc, key, start, windows, raw = (np.concatenate([u[k] for u in opened]) for k in range(5))
        ends = np.cumsum(windows + length - 1)
        begin = ends - (windows + length - 1)
        order, first = first_of_equal(raw, begin, windows, length, [doc, start])
        head = order[first]
        later = order[(doc[order] != doc[head]) | (start[order] != start[head])]
        kept = order[first == np.arange(len(first))]
        kept = kept[np.lexsort((start[kept], doc[kept]))]  # so that places in the text follow document order
        text = raw[gather_ranges(begin[kept], windows[kept] + length - 1)]
        at = np.cumsum(windows[kept] + length - 1) - (windows[kept] + length - 1)
        suffixes = gather_ranges(at, windows[kept])
        owner = np.repeat(np.arange(len(kept)), windows[kept])
        whole = start[kept][owner] + suffixes - at[owner]
        copy_of = CoverSorter(text).repeats(suffixes, length)
        origin = np.searchsorted(suffixes, copy_of)
        hit = (doc[kept][owner[origin]] != doc[kept][owner]) | (whole[origin] != whole)
        # Runs of marked windows of one stretch.
        mark = np.flatnonzero(hit)
        new = np.concatenate([[True], (np.diff(mark) != 1) | (np.diff(owner[mark]) != 0)]) if len(mark) else np.zeros(0, bool)
        heads_ = mark[new]
        counts = np.diff(np.append(np.flatnonzero(new), len(mark)))
        o = kept[owner[heads_]]
        rows = list(emit(np.concatenate([doc[later], doc[o]]), np.concatenate([key[later], key[o]]), np.concatenate([start[later], whole[heads_]]), np.concatenate([windows[later], counts])))
        return pa.Table.from_batches(rows) if rows else _table(["bucket", "group", "payload"], [pa.int32(), pa.int32(), pa.binary()], [[], [], []])

    sent = texts.mapInArrow(stretches, "bucket int, group int, payload binary")
    # Marked ones pass by, spread over all tasks.
    early = sent.where("bucket < 0").select("group", "payload")
    late = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(sort, "bucket int, group int, payload binary").select("group", "payload")
    return early.union(late)


def changes(docs: DataFrame, length: int, space: Workspace, with_text: bool = False) -> DataFrame:
    """A row per document that loses bytes: id, key, removed, n_spans, sha256, and with_text spans
    and kept. docs: doc_id, key, text. All other tables of the workspace are dropped."""
    docs = docs.select("doc_id", "key", "text")
    runs = recurring(docs, length, parts(docs, 6.0), space)
    found = runs.select(F.col("doc_id").alias("id"), F.col("key").alias("id_key"), "runs").hint("shuffle_hash")
    texts = docs.join(found, (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("id_key"))).select("doc_id", "key", "text", "runs")
    texts = space.write(texts, "recurring-texts")
    space.drop(runs)
    n_groups = parts(texts, 2.0)
    marks = space.write(marked(texts, length, parts(texts, 0.5, 32), n_groups), "marked-windows", BATCH_ROWS)

    def cut(rows: pa.Table, marks_: pa.Table) -> pa.Table:
        give_back()
        columns: tuple[list, ...] = ([], [], [], [], [], [], [])
        if len(marks_):
            blobs = [unpacked(p) for p in marks_["payload"].to_pylist()]
            doc, key, start, windows = (np.concatenate([b[k] for b in blobs]) for k in range(4))
            order = np.lexsort((start, key, doc))
            doc, key, start, windows = doc[order], key[order], start[order], windows[order]
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(key) != 0)]))
            of = {(int(doc[a]), int(key[a])): (a, b) for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True)}
            seen = set()
            for i, k, text in zip(rows["doc_id"].to_pylist(), rows["key"].to_pylist(), rows["text"], strict=True):
                if (i, k) not in of or (i, k) in seen:
                    continue
                seen.add((i, k))
                a, b = of[i, k]
                raw = text.as_py().encode()
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, start[a:b], 1)
                np.add.at(edge, start[a:b] + windows[a:b] - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                values = (i, k, int(gone.sum()), len(flips) // 2, hashlib.sha256(kept).hexdigest(), [{"start": int(s), "end": int(e)} for s, e in flips.reshape(-1, 2)] if with_text else None, kept if with_text else None)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return _table(["id", "id_key", "removed", "n_spans", "sha256", "spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()], list(columns))

    grouped = texts.select("doc_id", "key", "text", F.pmod("key", F.lit(n_groups)).cast("int").alias("group"))
    done = grouped.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(cut, "id long, id_key long, removed long, n_spans long, sha256 string, spans array<struct<start:long,end:long>>, kept binary")
    done = space.write(done, "changed")
    space.drop(texts, marks)
    return done


def repeated_strings(docs: DataFrame, length: int = LENGTH, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds spans
    (array of removed (start, end) byte ranges) and kept (the remaining bytes).

    A byte goes if it lies in a string of `length` bytes that also starts earlier: in a
    document of smaller doc_id, or in the same one further left. Strings are judged on
    the input; matches don't cross documents. A null text counts as empty. Rows with
    equal doc_id count as one document: of equal strings at equal places in them,
    neither is earlier. A null doc_id counts as smallest. No rows give none.
    length is from GRAM + 1 to 128. Further columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    done = changes(rows, length, Workspace(docs.sparkSession, "suffixes"), with_text)
    summary = rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"), *(["text"] if with_text else []))
    out = summary.join(done, (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("id_key")), "left")
    columns = [F.when(F.col("doc_id") > NO_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha256", "whole_sha256").alias("kept_sha256")]
    if with_text:
        columns += [F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("kept", F.encode("text", "UTF-8")).alias("kept")]
    return out.select(*columns)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id (null: NO_ID), key (a hash of the text), text (null: empty), and more."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    return rows.withColumn("key", F.xxhash64("text"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated strings cut from their texts, in docs' own columns, whatever their names.

    Bytes of a character that a cut splits go as well. Documents of which nothing but
    white space is left are dropped; those that lost nothing stay as they are, empty ones
    too. n_chars, where there is one, is counted again. Only texts that change are joined
    back to their rows, by id and a hash of the text.
    """
    rows = keyed(docs, "doc_id", "text", F.struct(*docs.columns).alias("row"))
    done = changes(rows, length, Workspace(docs.sparkSession, "suffixes"), with_text=True).select("id", "id_key", "kept")

    @F.arrow_udf("string")
    def whole_characters(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for kept in batches:
            yield pa.array([None if b is None else b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())

    done = done.select("id", "id_key", whole_characters("kept").alias("rest"))
    out = rows.drop("text").join(done.hint("shuffle_hash"), (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("id_key")), "left")
    out = out.where(F.col("id").isNull() | (F.trim(F.translate("rest", "\t\n\x0b\x0c\r", "     ")) != ""))
    text = F.when(F.col("id").isNull(), F.col("row.text")).otherwise(F.col("rest"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("id").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
        row = row.withField("n_chars", n_chars)
    return out.select(row.alias("row")).select("row.*")
