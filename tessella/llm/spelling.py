"""Spelling variants: words one code point apart, found through hashes of their deletions.

Two words differ by one replaced code point if deleting it at the same place leaves the
same string of both, and by one inserted code point if deleting it from the longer one
leaves the other. A word's polynomial hash is a sum over places, so the hash of the word
without place i follows from that of the prefix before i and that of the suffix after i,
moved by one power: all deletions of a batch of words are a few NumPy operations on
integers. The keys are dealt out by radix, each part is sorted, and only words that share
a key travel on; there the remaining strings themselves are compared.

Words that share what is left at one place are all near one another, so a group yields
each member's count and best partner from its size and its first two, and no pair is
ever a row. Such a group holds one word for each letter at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Workspace
from tessella.llm.words import bytes_of, mix64, slices

#: Letters of a word, after A-Z were lower-cased.
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A word's form occurs at least so many times as often as the word.
TIMES = 2
#: Keys in one part of the radix, about, and the least number of parts.
PART_KEYS, LEAST_PARTS = 200_000, 64
KEYS = "part int, key long, id long, place int, again boolean"
SHARED = "key long, place int, id long, cut int"
WHOLE = -1

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damage_one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of the whole texts with at least so many code points and occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z is
    lower-cased. damage_one_in puts slips into the runs first, always the same ones: where it
    divides h, the CRC-32 of `id:run`, the run loses its code point h mod length (a null id
    counts as the empty text). Null and empty texts have no words; repeated rows count each
    time. Counts are added up before the shuffle, so a very frequent word is a row per task.
    """
    low = F.translate(F.col(text_col), UPPER, LOWER)
    runs = F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))  # what is shorter gets no longer
    if damage_one_in is None:
        found = docs.select(F.explode(runs).alias("word"))
    else:
        rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
        rows = rows.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        found = rows.select(F.when(F.col("h") % damage_one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return found.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, place, again): for each word its own key at place WHOLE, and one for each code point deleted.

    Equal strings have equal keys, whatever was deleted from which word to get them. again: the
    code point before is the same, so deleting that one leaves the same string.
    """
    raw, offsets = bytes_of(words)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]  # where words begin, in code points
    n = np.diff(begins)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(points)) - begins[:-1][row]
    powers = np.ones(int(n.max(initial=0)) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * powers[place])])
    whole = sums[begins[1:]] - sums[begins[:-1]]
    at = np.arange(len(points))
    prefix = sums[at] - sums[begins[:-1]][row]
    suffix = sums[begins[1:]][row] - sums[at + 1]
    left = prefix + suffix * np.uint64(_BACK)
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == points[:-1]) & (place[1:] > 0)
    length = np.uint64(0xD6E8FEB86659FD93)
    keys = np.concatenate([mix64(whole + n.astype(np.uint64) * length), mix64(left + (n[row] - 1).astype(np.uint64) * length)])
    return keys, np.concatenate([np.arange(len(n)), row]), np.concatenate([np.full(len(n), WHOLE), place]), np.concatenate([np.zeros(len(n), bool), again])


def shared_keys(key: np.ndarray, word: np.ndarray, place: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, place, word, cut) of the words that share a key so that they may be near.

    Words cut at the same place share the group (key, place); a whole word and those that
    become it by a cut, each once, share the group (key, WHOLE). cut is where the word was cut.
    """
    order = np.lexsort((place, key))
    key, word, place, again = key[order], word[order], place[order], again[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    run = np.cumsum(new) - 1
    sizes = np.bincount(run) if len(run) else np.zeros(0, int)
    met = (place[new] == WHOLE)[run] & (sizes > 1)[run]  # a whole word comes first in its run
    same = np.zeros(len(key), bool)
    same[1:] = ~new[1:] & (place[1:] == place[:-1]) & (place[1:] != WHOLE)
    same[:-1] |= same[1:]
    a, b = np.flatnonzero(met & ~again), np.flatnonzero(same)
    return np.concatenate([key[a], key[b]]), np.concatenate([np.full(len(a), WHOLE), place[b]]), np.concatenate([word[a], word[b]]), np.concatenate([place[a], place[b]])


def near_words(words: DataFrame, n_parts: int) -> DataFrame:
    """(id, n_near, best) of the words (id, word, n) that have a near word: how many, and
    the one of largest n, the smallest in code-point order if several (struct minus_n, word, id)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, row, place, again = deletion_keys(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)[row]
            part = (key >> np.uint64(40)).astype(np.int64) % n_parts
            for a in range(0, len(key), 100_000):
                b = a + 100_000
                columns = [pa.array(part[a:b].astype(np.int32)), pa.array(key[a:b].view(np.int64)), pa.array(ids[a:b]), pa.array(place[a:b].astype(np.int32)), pa.array(again[a:b])]
                yield pa.RecordBatch.from_arrays(columns, ["part", "key", "id", "place", "again"])

    def sort_keys(rows: pa.Table) -> pa.Table:
        key, place, word, cut = shared_keys(rows["key"].to_numpy(), rows["id"].to_numpy(), rows["place"].to_numpy(), rows["again"].to_numpy())
        return pa.table([pa.array(key), pa.array(place.astype(np.int32)), pa.array(word), pa.array(cut.astype(np.int32))], ["key", "place", "id", "cut"])

    shared = words.select("id", "word").mapInArrow(keyed, KEYS).groupBy("part").applyInArrow(sort_keys, SHARED)
    text = F.col("word")
    rest = F.when(F.col("cut") == WHOLE, text).otherwise(F.concat(F.substring(text, F.lit(1), F.col("cut")), F.substring(text, F.col("cut") + 2, F.length(text))))
    # Hashes brought them together; the strings that are left decide.
    group = Window.partitionBy("key", "place", "rest")
    whole = F.col("cut") == WHOLE
    order = group.orderBy(whole.desc(), F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("minus_n"), "word", "id")
    rows = shared.join(words, "id").withColumn("rest", rest).withColumn("me", me)
    rows = rows.select("id", "place", whole.alias("whole"), F.col("me"), F.count("*").over(group).alias("size"), F.max(whole).over(group).alias("has_whole"), F.first("me").over(order).alias("one"), F.nth_value("me", 2).over(order).alias("two"))
    others = F.when((F.col("place") == WHOLE) & ~F.col("whole"), F.when(F.col("has_whole"), 1).otherwise(0)).otherwise(F.col("size") - 1)
    best = F.when(F.col("one.id") == F.col("id"), F.col("two")).otherwise(F.col("one"))
    rows = rows.select("id", others.cast("long").alias("others"), best.alias("best")).where("others > 0")
    return rows.groupBy("id").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """A row per row of counts (word, n; words distinct, none null): word, form, root, n, n_near, form_n.

    n_near counts the words that differ by exactly one inserted, deleted or replaced code
    point. form is the near word of largest n, the smallest in code-point order if several,
    if that n is at least `times` the word's; else null, and so is form_n. root is what
    following forms ends at, the word itself if it has none. No rows give none.

    Shuffled are a key for each code point of the distinct words, and the words that
    share one. n grows along forms by `times`, so roots are reached by doubling in few rounds.
    """
    space = Workspace(counts.sparkSession, "spelling")
    words = space.write(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n"), "words")
    n_keys, most = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    near = near_words(words, max(LEAST_PARTS, int(n_keys) // PART_KEYS))
    near = near.select(F.col("id").alias("of"), "n_near", "best")
    linked = words.join(near, F.col("id") == F.col("of"), "left").withColumn("form_n", -F.col("best.minus_n"))
    linked = linked.withColumn("form_n", F.when(F.col("form_n") >= times * F.col("n"), F.col("form_n")))
    form = lambda c: F.when(F.col("form_n").isNotNull(), F.col(f"best.{c}"))
    linked = space.write(linked.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form("id").alias("form_id"), form("word").alias("form"), "form_n"), "linked")
    up = linked.where("form_id is not null").select("id", F.col("form_id").alias("up"), F.col("form").alias("root"))
    reach, depth = 1, 0
    while times > 1 and times**depth <= most:
        depth += 1
    while reach < depth:  # each round leads twice as far up
        higher = up.select(F.col("id").alias("from"), F.col("up").alias("up2"), F.col("root").alias("root2"))
        step = up.join(higher, F.col("up") == F.col("from"), "left")
        before, up = up, space.write(step.select("id", F.coalesce("up2", "up").alias("up"), F.coalesce("root2", "root").alias("root"), F.col("up2").isNotNull().alias("moved")), "roots")
        if reach > 1:
            space.drop(before)
        moved = up.where("moved").limit(1).count()
        reach *= 2
        if not moved:
            break
    top = up.select(F.col("id").alias("of"), "root")
    out = linked.join(top, F.col("id") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
