"""Exact Jaccard self-join of word n-gram sets, with skips learned from set relations.

1. Which shingles do two documents share? Shingle fingerprints are dealt out in
   blocks by hash and counted. A document with fewer shared shingles than its least
   overlap links with nothing; in a corpus this leaves few documents, all exactly.
2. Equal sets become one. Shared shingles are counted again among those left, and a
   set's tokens are ordered rarest first. Two sets that link share a token within
   their prefixes.
3. Sets with a common prefix token are brought together: a set's home is the smallest
   set on any of its lists, and it visits the homes of all sets on its lists, so each
   pair to be tried meets where one of them lives. No list is held by one task, and
   no pair is ever a row.
4. Where sets meet, index lists are cut into blocks by the position of the token in
   their sets, and a block is skipped, unread, if no set in it can still reach the
   overlap; the sets in the blocks read are a set's candidates. Its overlaps with them
   are derived from those of the set answered before it, by the tokens in which the two
   differ, if these are fewer than its own. Only a spanning forest of the links leaves
   the task.

The blocks of step 1 are written once, with what stays behind for each, so every reply
meets its block however the input was partitioned or ordered, and whatever is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blobs import BLOB, OWN, blob_row, blob_table, dealt, deltas, fingerprints, narrow, packed, undeltas, unpacked
from tessella.llm.common import Workspace, parts
from tessella.llm.graph import components, forest
from tessella.llm.words import gather_ranges, shingle_sets, slices

#: Sets that live, and that visit, in one task; entries in a block of an index list.
HOMES, VISITORS, LIST_BLOCK = 1024, 4096, 64
#: Rows in an Arrow batch of texts.
BATCH_ROWS = 2_000
NO_ID = np.iinfo(np.int64).min


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """What a set of n must share with any other to link with it."""
    return -(-n * percent // 100)


def block_numbers() -> Iterator[int]:
    """Names for the blocks of a task that no other task uses."""
    first = TaskContext.get().partitionId() << 32
    return iter(range(first, first + (1 << 32)))


def deal_entries(block: int, tokens: np.ndarray, n_buckets: int, *values: np.ndarray) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    """(whether each token occurs again within the block, a blob for each bucket).

    A blob holds the fingerprints of the block's distinct tokens in order, and of those that
    occur once the values, which the reply repeats. What occurs again is known to be shared
    and needs no reply, so a token that all documents hold is one entry for each block.
    """
    names, first, back, counts = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    order, cuts = dealt(names, n_buckets)
    blobs = []
    for b in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[b] : cuts[b + 1]]
        single = counts[mine] == 1
        blobs.append(blob_row(block, int(b), *deltas(fingerprints(names[mine])), np.packbits(single), *(narrow(v[first[mine[single]]]) for v in values)))
    return counts[back] > 1, blobs


def shared_entries(blobs: pa.Table) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """For each blob of a bucket: fingerprints of its tokens that occur once in the block, their
    values, and whether other blocks hold the same."""
    opened = [unpacked(p) for p in blobs["payload"].to_pylist()]
    prints = [undeltas(u[:4]) for u in opened]
    everything = np.concatenate(prints)
    order = np.argsort(everything, kind="stable")
    ranked = everything[order]
    again = np.zeros(len(ranked), bool)
    again[1:] = ranked[1:] == ranked[:-1]
    again[:-1] |= again[1:]
    flags = np.empty(len(ranked), bool)
    flags[order] = again
    at = 0
    for u, p in zip(opened, prints, strict=True):
        single = np.unpackbits(u[4], count=len(p)).astype(bool)
        yield p[single], u[5:], flags[at : at + len(p)][single]
        at += len(p)


def checked(n_blobs: int, replies: pa.Table) -> list[list[np.ndarray]]:
    """The replies to a block, opened; each of its blobs must have one."""
    if len(replies) != n_blobs:
        raise RuntimeError(f"{len(replies)} of {n_blobs} replies came back to a block")
    return [unpacked(p) for p in replies["payload"].to_pylist()]


def sizes_and_candidates(docs: DataFrame, k: int, percent: int, n_buckets: int, space: Workspace) -> DataFrame:
    """(doc_id, n, candidate): set sizes, and whether enough of the set is shared with others."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_numbers()
        for batch in slices(batches):
            block = next(numbers)
            tokens, bounds = shingle_sets(batch.column(1), k)
            n = np.diff(bounds)
            owners = np.repeat(np.arange(len(n)), n)
            again, blobs = deal_entries(block, tokens, n_buckets, owners)
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            yield blob_row(block, OWN, ids, n, np.bincount(owners[again], minlength=len(n)), np.array([len(blobs)]))
            yield from blobs

    def count(blobs: pa.Table) -> pa.Table:
        replies = [packed(np.bincount(values[0][shared], minlength=1).astype(np.uint32)) for _, values, shared in shared_entries(blobs)]
        return blob_table(blobs["block"], blobs["bucket"], replies)

    def gather(own: pa.Table, replies: pa.Table) -> pa.Table:
        ids, n, shared, n_blobs = unpacked(own["payload"][0].as_py())
        shared = shared.copy()
        for (counts,) in checked(int(n_blobs[0]), replies):
            shared[: len(counts)] += counts
        known = ids != NO_ID
        candidate = (n > 0) & known & (shared >= least_overlap(n, percent))
        return pa.table([pa.array(ids, pa.int64(), mask=~known), pa.array(n), pa.array(candidate)], ["doc_id", "n", "candidate"])

    blobs = space.write(docs.mapInArrow(shingle, BLOB), "shingles", BATCH_ROWS)
    replies = blobs.where(f"bucket <> {OWN}").groupBy("bucket").applyInArrow(count, BLOB)
    own = blobs.where(f"bucket = {OWN}")
    sizes = space.write(own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(gather, "doc_id long, n long, candidate boolean"), "sizes")
    space.drop(blobs)
    return sizes


def ordered_sets(sets: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """(rep, n, tokens, prefix) of the sets (rep, tokens) that may still link: tokens rarest first;
    prefix holds its tokens, in that order, that some other set has too. sets is a written table."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks named by their content, so a reply can only meet what was asked."""
        for batch in slices(batches):
            lists = [np.frombuffer(b, np.uint64) for b in batch.column(1).to_pylist()]
            reps, n = batch.column(0).to_numpy(zero_copy_only=False), np.array([len(x) for x in lists], np.int64)
            tokens = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            name = hashlib.sha256(reps.tobytes() + n.tobytes() + tokens.tobytes()).digest()
            yield int.from_bytes(name[:8], "little", signed=True), reps, n, tokens

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, tokens in blocks(batches):
            names, counts = np.unique(tokens, return_counts=True)
            order, cuts = dealt(names, n_buckets)
            for b in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[b] : cuts[b + 1]]
                yield blob_row(block, int(b), *deltas(fingerprints(names[mine])), narrow(counts[mine]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, reps, n, tokens in blocks(batches):
            yield blob_row(block, OWN, reps, n, tokens)

    def count(blobs: pa.Table) -> pa.Table:
        opened = [unpacked(p) for p in blobs["payload"].to_pylist()]
        everything = np.concatenate([undeltas(u[:4]) for u in opened])
        _, back = np.unique(everything, return_inverse=True)
        held = np.bincount(back, np.concatenate([u[4] for u in opened]))[back].astype(np.int64)
        cuts = np.cumsum([len(u[4]) for u in opened])[:-1]
        return blob_table(blobs["block"], blobs["bucket"], [packed(narrow(x)) for x in np.split(held, cuts)])

    def arrange(own: pa.Table, replies: pa.Table) -> pa.Table:
        columns: tuple[list, ...] = ([], [], [], [])
        if not len(own):
            raise RuntimeError("counts came back for a block that isn't there: the input changed while it was read")
        reps, n, tokens = unpacked(own["payload"][0].as_py())
        names, back = np.unique(tokens, return_inverse=True)
        by_bucket = replies.sort_by("bucket")
        answers = np.concatenate([unpacked(p)[0].astype(np.int64) for p in by_bucket["payload"].to_pylist()]) if len(replies) else np.zeros(0, np.int64)
        if len(answers) != len(names):
            raise RuntimeError("the counts of a block's tokens came back incomplete")
        held = np.empty(len(names), np.int64)
        held[dealt(names, n_buckets)[0]] = answers
        held = held[back]
        ends = np.cumsum(n)
        for rep, a, b in zip(reps.tolist(), (ends - n).tolist(), ends.tolist(), strict=True):
            need = int(least_overlap(b - a, percent))
            if (held[a:b] > 1).sum() < need:
                continue
            order = np.lexsort((tokens[a:b], held[a:b]))
            mine, first = tokens[a:b][order], b - a - need + 1
            prefix = mine[:first][held[a:b][order][:first] > 1]
            if len(prefix):
                for column, value in zip(columns, (rep, b - a, mine.tobytes(), prefix.view(np.int64)), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["rep", "n", "tokens", "prefix"])

    replies = sets.mapInArrow(deal, BLOB).groupBy("bucket").applyInArrow(count, BLOB)
    own = sets.mapInArrow(whole, BLOB)
    return own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(arrange, "rep long, n long, tokens binary, prefix array<long>")


class PositionIndex:
    """Lists of the sets that hold a token, in order of its position in them, cut into blocks.

    Of each block it keeps the most tokens that any of its sets has from there on, so a
    block whose sets all have too few is skipped without a look at its entries.
    """

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((place, code))
        self.tokens, self.sizes, self.owner = tokens, sizes, owner[order]
        self.starts = np.searchsorted(code[order], np.arange(len(tokens) + 1))
        self.codes, self.bounds = code, np.concatenate([[0], np.cumsum(sizes)])
        # Blocks: where each begins, and the first block of each list.
        n_blocks = -(-np.diff(self.starts) // LIST_BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(n_blocks)])
        of_list = np.repeat(np.arange(len(tokens)), n_blocks)
        self.block_at = self.starts[of_list] + (np.arange(len(of_list)) - self.first_block[of_list]) * LIST_BLOCK
        self.most_left = np.maximum.reduceat((sizes[owner] - place)[order], self.block_at)
        self.entries_read = 0

    def codes_of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the tokens, codes) of the tokens that some set holds."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        known = np.flatnonzero(self.tokens[at] == tokens)
        return known, at[known]

    def candidates(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The sets that hold a token of the prefix in a block that can still reach the overlap.

        At a first common token, the overlap is at most what either set has from there on.
        """
        n = len(tokens)
        need = least_overlap(n, percent)
        place, code = self.codes_of(tokens[: n - need + 1])
        n_blocks = self.first_block[code + 1] - self.first_block[code]
        block = gather_ranges(self.first_block[code], n_blocks)
        block = block[np.minimum(np.repeat(n - place, n_blocks), self.most_left[block]) >= need]
        ends = np.append(self.block_at, len(self.owner))[block + 1]
        entry = gather_ranges(self.block_at[block], ends - self.block_at[block])
        self.entries_read += len(entry)
        return np.unique(self.owner[entry])

    def overlaps(self, code: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """How many of the coded tokens each of the sets holds: the shorter way of two, by the
        lists of the tokens or by the tokens of the sets."""
        by_list, by_set = self.starts[code + 1] - self.starts[code], self.sizes[sets]
        if by_list.sum() <= by_set.sum():
            self.entries_read += int(by_list.sum())
            return np.bincount(self.owner[gather_ranges(self.starts[code], by_list)], minlength=len(self.sizes))[sets]
        asked = np.zeros(len(self.tokens), np.int32)
        asked[code] = 1
        self.entries_read += int(by_set.sum())
        return np.add.reduceat(asked[self.codes[gather_ranges(self.bounds[sets], by_set)]], np.cumsum(by_set) - by_set)


def links_between(homes: list[np.ndarray], visitors: list[np.ndarray], percent: int, index: PositionIndex | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(visitor, home) numbers of all pairs with 100 * overlap >= percent * union."""
    index = index or PositionIndex(homes)
    order = sorted(range(len(visitors)), key=lambda i: (visitors[i][-1], len(visitors[i])))  # alike sets share their commonest token
    found_x, found_h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    counts, fresh = np.zeros(len(homes), np.int64), np.zeros(len(homes), bool)  # answers of the set before
    code_before = np.zeros(0, np.int64)
    for i in order:
        x = visitors[i]
        near = index.candidates(x, percent)
        if not len(near):
            continue
        code = index.codes_of(x)[1]
        derived = near[fresh[near]]
        gone, came = np.setdiff1d(code_before, code, assume_unique=True), np.setdiff1d(code, code_before, assume_unique=True)
        if len(derived) and len(gone) + len(came) < len(code):
            counts[derived] += index.overlaps(came, derived) - index.overlaps(gone, derived)
            anew = near[~fresh[near]]
        else:
            anew = near
        if len(anew):
            counts[anew] = index.overlaps(code, anew)
        fresh[:] = False
        fresh[near] = True
        code_before = code
        hits = near[100 * counts[near] >= percent * (len(x) + index.sizes[near] - counts[near])]
        found_x.append(np.full(len(hits), i))
        found_h.append(hits)
    return np.concatenate(found_x), np.concatenate(found_h)


def links_of(ordered: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """(u, v) links that connect whatever linking pairs of the ordered sets connect."""
    posted = ordered.select("rep", F.explode("prefix").alias("token"))
    low = posted.groupBy("token").agg(F.min("rep").alias("low"), F.count("*").alias("held")).where("held > 1")
    lists = posted.join(low.select("token", "low"), "token")
    homes = space.write(lists.groupBy("rep").agg(F.min("low").alias("home")), "homes")
    home_of_list = lists.select("token", "rep").join(homes, "rep").select("token", "home").distinct()
    visits = space.write(lists.select("token", "rep").join(home_of_list, "token").select("rep", "home").distinct(), "visits")
    grid = homes.groupBy("home").agg(F.ceil(F.count("*") / HOMES).cast("int").alias("h_blocks"))
    grid = grid.join(visits.groupBy("home").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("v_blocks")), "home")

    def dealt_out(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(grid, "home").withColumn(own[0], F.pmod(F.xxhash64(F.lit(9), "rep"), F.col(own)).cast("int"))
        rows = rows.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.join(ordered.select("rep", "tokens"), "rep").select(*[F.col(c).alias(c) for c in ("home", "h", "v", "rep", "tokens")])

    def meet(living: pa.Table, visiting: pa.Table) -> pa.Table:
        if not len(living) or not len(visiting):
            return pa.table([pa.array([], pa.int64())] * 2, ["u", "v"])
        sets = [[np.frombuffer(b, np.uint64) for b in t["tokens"].to_pylist()] for t in (living, visiting)]
        x, h = links_between(sets[0], sets[1], percent)
        u, v = visiting["rep"].to_numpy()[x], living["rep"].to_numpy()[h]
        u, v = forest(u[u != v], v[u != v])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    key = ["home", "h", "v"]
    living, visiting = dealt_out(homes, "h_blocks", "v_blocks"), dealt_out(visits, "v_blocks", "h_blocks")
    links = space.write(living.groupBy(*key).cogroup(visiting.groupBy(*key)).applyInArrow(meet, "u long, v long"), "met")
    space.drop(homes, visits)
    return links


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id.

    Documents link when 100 * overlap >= percent * union of their sets of k-word
    shingles (see words.shingle_sets); component_id is the smallest doc_id reachable.
    Without words, or with a null text, the set is empty and links with nothing. Rows
    with a null id keep it and have no component. Rows with equal ids are one document
    as to component_id. An empty table gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    space = Workspace(docs.sparkSession, "jaccard")
    sizes = sizes_and_candidates(docs, k, percent, parts(docs, 6.0), space)
    chosen = sizes.where("candidate").select(F.col("doc_id").alias("chosen")).distinct().hint("shuffle_hash")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, bounds = shingle_sets(batch.column(1), k)
            blobs = [tokens[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(b).hexdigest() for b in blobs], pa.string()), pa.array(blobs, pa.binary())], ["doc_id", "digest", "tokens"])

    sets = docs.join(chosen, F.col("doc_id") == F.col("chosen")).select("doc_id", "text").mapInArrow(to_sets, "doc_id long, digest string, tokens binary")
    sets = space.write(sets, "candidate-sets", BATCH_ROWS)
    reps = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"))
    reps = space.write(reps, "distinct-sets")
    same = sets.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    same = space.write(same, "equal-sets")
    space.drop(sets)
    ordered = space.write(ordered_sets(reps.select("rep", "tokens"), percent, parts(reps, 6.0)), "ordered-sets", BATCH_ROWS)
    space.drop(reps)
    met = links_of(ordered, percent, space)
    space.drop(ordered)
    groups = components(met.union(same), space)
    space.drop(met, same)
    return sizes.select("doc_id", F.col("n").alias("n_shingles")).join(groups, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents whose group has a smaller doc_id; all columns stay, whatever
    their names.

    Rows with a null id stay. Repeated rows of the kept id stay as they are.
    """
    gone = jaccard_groups(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
