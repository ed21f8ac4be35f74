"""Many names searched for in many texts at once, and tasks routed by the triggers in them.

A list of names travels as hashes, by length. Each text is read once however many names there
are: what has the hash of a name is cut out, and a join with the names says whether it is one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a list of names may take, in characters.
MOST_CHARS = 1_000_000_000
#: Names whose hashes a task holds at once, 8 bytes each; of longer lists one part after another is searched for.
PART = 8_000_000
#: Bytes of texts that are tried at once.
STEP = 500_000
#: Hits in an output batch, about.
HITS = 50_000
#: First bytes of a name that are tried before its hash.
HEAD = 4
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the base and of its inverse, modulo 2^64."""
    return tuple(np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From which each stretch has its hash: (sums[end] - sums[start]) * back[start]."""
    power, back = _powers(1 << max(16, len(data).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[: len(data)], dtype=np.uint64)]), back


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where its rows begin and the last ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data and data.size else np.empty(0, np.uint8), at


def _heads(data: np.ndarray, at: np.ndarray | slice, width: int) -> np.ndarray:
    """Slots of the first bytes from each position on, among 2^22."""
    code = np.zeros(1, np.uint32)
    for k in range(width):
        code = code * np.uint32(256) + data[k:][at]
    return (code * np.uint32(2654435761)) >> np.uint32(10)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, hash, head) of names."""
    for batch in batches:
        data, at = _bytes(batch.column(0))
        start, n = at[:-1], np.diff(at)
        if not len(n):
            continue
        data, start = data[at[0] : at[-1]], start - at[0]
        sums, back = _sums(data)
        head = np.zeros(len(n), np.uint32)
        for width in range(1, HEAD + 1):
            of = np.minimum(n, HEAD) == width
            head[of] = _heads(data, start[of], width)
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(((sums[start + n] - sums[start]) * back[start]).view(np.int64)), pa.array(head.astype(np.int32))], ["length", "hash", "head"])


def _by_length(names: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Which slots of first bytes occur, by their number, and the hashes in order, by length."""
    table = names.select(F.col("name").cast("binary")).mapInArrow(_hashed, "length int, hash long, head int").toArrow()
    length, hash_, head = (table.column(i).to_numpy() for i in range(3))
    heads = {}
    for width in np.unique(np.minimum(length, HEAD)).tolist():
        heads[width] = np.zeros(1 << 22, bool)
        heads[width][head[np.minimum(length, HEAD) == width]] = True
    return heads, {n: np.sort(hash_[length == n].view(np.uint64)) for n in np.unique(length).tolist()}


def _windows(data: np.ndarray, first: int, heads: dict[int, np.ndarray], hashes: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    """(positions, length) of stretches with the hash of a name that begin in the first bytes."""
    sums, back = _sums(data)
    for width, slots in heads.items():
        n = min(first, len(data) - width + 1)
        near = np.flatnonzero(slots[_heads(data, slice(0, n), width)]) if n > 0 else np.empty(0, np.int64)
        for length in hashes if len(near) else ():
            if min(length, HEAD) == width:
                at = near[: np.searchsorted(near, len(data) - length, "right")]
                own = (sums[at + length] - sums[at]) * back[at]
                known = hashes[length]
                at = at[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own]
                if len(at):
                    yield at, length


def _pieces(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows low to high, STEP bytes or one row each."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + STEP, "right")) - 1)
        yield low, high
        low = high


def _spotted(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name, n): each stretch of the texts (key, text) that has a name's hash, and how often."""
    found = _by_length(names)
    if not found[1]:
        return texts.limit(0).selectExpr("key", "text AS name", "0L AS n")
    held = texts.sparkSession.sparkContext.broadcast(found)  # of PART names at most
    longest = max(found[1])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, hashes = held.value
        for batch in batches:
            data, at = _bytes(batch.column(1))
            for low, high in _pieces(at):
                hits: Counter[tuple[int, bytes]] = Counter()
                for start in range(at[low], at[high], STEP):
                    tried = data[start : min(start + STEP + longest, at[high])]
                    for begin, length in _windows(tried, STEP, heads, hashes):
                        row = np.searchsorted(at, begin + start, "right") - 1
                        whole = begin + start + length <= at[row + 1]
                        hits.update((r, tried[b : b + length].tobytes()) for r, b in zip(row[whole].tolist(), begin[whole].tolist(), strict=True))
                yield from _hits(batch.column(0), hits)

    kind = texts.schema["key"].dataType.simpleString()
    rows = texts.select("key", F.col("text").cast("binary")).mapInArrow(search, f"key {kind}, name binary, n long")
    return rows.withColumn("name", F.col("name").cast("string"))


def _hits(keys: pa.Array, hits: Counter[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows = list(hits.items())
    for i in range(0, len(rows), HITS):
        some = rows[i : i + HITS]
        names, n = pa.array([name for (_, name), _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())
        yield pa.RecordBatch.from_arrays([keys.take(pa.array([r for (r, _), _ in some], pa.int64())), names, n], ["key", "name", "n"])


def _found(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]], bool]:
    """The texts as (key, text); what is spotted of each part of the distinct names, and that part; whether the
    empty name is one."""
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    known = names.select(F.col(name).cast("string").alias("name")).where("name is not null").distinct()
    chars, n, empty = known.agg(F.coalesce(F.sum(F.length("name") + 8), F.lit(0)), F.count("*"), F.count_if(F.col("name") == "")).first()
    if chars > MOST_CHARS:
        raise ValueError(f"the names take {chars} characters, more than {MOST_CHARS}")
    parts = max(1, -(-n // PART))
    own = [known.where((F.col("name") != "") & (F.pmod(F.xxhash64("name"), F.lit(parts)) == i)) for i in range(parts)]
    return rows, [(_spotted(rows, p), p) for p in own], empty > 0


def found(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """(key, name, n): which names occur in which texts, in equal case, and how often (overlaps count).

    A null text holds nothing; the empty name is in every text, once before each character and at
    the end. Repeated rows repeat; no texts or no names give no rows. Hashes of the names, PART at a
    time, are broadcast; texts are read where they lie, and only what has a name's hash is joined.
    """
    rows, parts, empty = _found(texts, key, text, names, name)
    hits = [spotted.join(part, "name", "left_semi").select("key", "name", "n") for spotted, part in parts]
    if empty:
        hits.append(rows.select("key", F.lit("").alias("name"), (F.length("text") + 1).cast("long").alias("n")))
    return reduce(DataFrame.unionAll, hits).withColumnRenamed("key", key)


def routed(tasks: DataFrame, rules: DataFrame, key: str = "task", text: str = "text", default: str = "keep") -> DataFrame:
    """(key, route, trigger, triggers) of each task: the route of the first rule whose trigger its text holds,
    that trigger, and how many triggers of all rules it holds; the default, null and 0 without one.

    rules: (rank, trigger, route), a table of any number of rows within the size of `found`. The
    least rank comes first, among equal ranks the longest trigger, then the first in order. Case
    doesn't matter. Keys tell tasks apart; a null text or key is routed by default.
    """
    low = tasks.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_text")).dropna()
    table = rules.select(F.lower("trigger").alias("name"), "rank", "trigger", "route").where("name <> ''")
    # The join also leaves out what only has a trigger's hash.
    spotted = reduce(DataFrame.unionAll, [s for s, _ in _found(low, "_key", "_text", table, "name")[1]])
    hits = spotted.withColumnRenamed("key", "_key").join(table, "name")
    first = F.min(F.struct("rank", (-F.length("trigger")).alias("minus"), "trigger", "route"))
    best = hits.groupBy("_key").agg(first.alias("first"), F.count_distinct("name").alias("n"))
    out = tasks.join(best, F.col(key) == F.col("_key"), "left")
    return out.select(key, F.coalesce("first.route", F.lit(default)).alias("route"), F.col("first.trigger").alias("trigger"), F.coalesce("n", F.lit(0).cast("long")).alias("triggers"))
