"""Embedding near-duplicates through an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a grid of cells. A vector
lies in the cell of its nearest half-centroids, and as a query visits cells in order
of distance (multi-sequence order: the cell at ranks (a, b) of the two halves can
only be among the nearest T if (a + 1)(b + 1) <= T). T is calibrated on vectors moved
to just the similarity asked for, until the target recall is met. Vectors are
verified in double precision against all members of the visited cells; cells of any
size are met block by block. Exact copies are one vector with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Workspace
from tessella.llm.graph import components, forest
from tessella.llm.words import gather_ranges

#: Vectors the codebooks are fitted on, at most about; members of a cell and label, about.
TRAIN_ROWS, CELL_ROWS = 20_000, 64
#: Share of links at exactly the least similarity that one direction of a search must find.
TARGET_RECALL = 0.98
#: Rows on either side of a block.
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)[0].argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray]:
    return (np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0),)


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves, and how many cells a query visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return nearest(x[:, :half], self.first)[0], nearest(x[:, half:], self.second)[0]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return (a.argmin(1) * len(self.second) + b.argmin(1)).astype(np.int32)

    def visited(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest `visits` cells of each row, nearest first."""
        n = min(visits or self.visits, len(self.first) * len(self.second))
        a, b = self.distances(x)
        order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        pairs = np.array([(i, j) for i in range(min(n, a.shape[1])) for j in range(min(n // (i + 1), b.shape[1]))])
        rows = np.arange(len(x))[:, None]
        pick_a, pick_b = order_a[:, pairs[:, 0]], order_b[:, pairs[:, 1]]
        best = (a[rows, pick_a] + b[rows, pick_b]).argsort(1, kind="stable")[:, :n]
        return (pick_a * len(self.second) + pick_b)[rows, best].astype(np.int32)

    @classmethod
    def fit(cls, x: np.ndarray, k: int, least: float, target: float = TARGET_RECALL, seed: int = 3) -> MultiIndex:
        """Codebooks of k centres for unit rows x; visits so that rows moved to cosine `least`
        in random directions have their cell visited in `target` of the cases."""
        rng = np.random.default_rng(seed)
        half = x.shape[1] // 2
        index = cls(kmeans(x[:, :half], k, rng), kmeans(x[:, half:], k, rng))
        some = x[rng.choice(len(x), min(len(x), 2000), replace=False)]
        noise = rng.standard_normal(some.shape)
        noise -= (noise * some).sum(1, keepdims=True) * some
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        moved = least * some + np.sqrt(1 - least * least) * noise
        cells, everything = index.cells(moved), len(index.first) * len(index.second)
        visits = 4
        while visits < everything and (index.visited(some, visits) == cells[:, None]).any(1).mean() < target:
            visits = visits * 5 // 4 + 1
        return cls(index.first, index.second, min(visits, everything))


def unit_rows(vecs: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision from components of 4 bytes, where those are exact, or 8."""
    out = np.empty((len(vecs), dim))
    blobs = vecs.to_pylist()
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    for kind in (np.float32, np.float64):
        rows = np.flatnonzero(sizes == dim * kind().itemsize)
        out[rows] = np.frombuffer(b"".join(blobs[i] for i in rows), kind).reshape(len(rows), dim)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


PREPARED = "vec_id long, label string, dim int, key string, vec binary"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors, named by a digest of their components: those with id and label, and a
    finite length above 0."""
    for batch in batches:
        ids, labels, lists = batch.column(0), batch.column(1), batch.column(2)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
        named = pc.and_(ids.is_valid(), labels.is_valid()).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[named & (sizes > 0)]):
            rows = np.flatnonzero(named & (sizes == dim))
            x = flat[gather_ranges(starts[rows], sizes[rows])].reshape(len(rows), dim) + 0.0
            with np.errstate(all="ignore"):
                length = np.linalg.norm(x, axis=1)
                short = x.astype(np.float32)
            good = np.isfinite(length) & (length > 0)
            rows, x, short = rows[good], x[good], short[good]
            exact = (short == x).all(axis=1)
            vecs = [(short[i] if exact[i] else x[i]).tobytes() for i in range(len(rows))]
            keys = [hashlib.blake2b(v.tobytes(), digest_size=16).hexdigest() for v in x]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.array(np.full(len(rows), dim), pa.int32()), pa.array(keys, pa.string()), pa.array(vecs, pa.binary())], ["vec_id", "label", "dim", "key", "vec"])


def near_duplicates(vectors: DataFrame, least: float = 0.93, train_rows: int = TRAIN_ROWS, target: float = TARGET_RECALL, cell_rows: int = CELL_ROWS) -> DataFrame:
    """A row per input row: vec_id, n_links, component_id, kept.

    Vectors link if their labels (of any type) are equal and their cosine is at least
    `least`; n_links counts the other vectors linked directly (copies one by one),
    component_id is the smallest vec_id reachable, kept whether that is the row's own. A
    vector that is null, empty or zero, or holds a null or non-finite component, or whose
    label is null, links with nothing; so does a row without vec_id (component null,
    kept false). Vectors of different lengths don't link. No rows give none. Further
    columns are ignored.

    The grid is as fine as the largest label needs for cells of about cell_rows. Members
    and queries travel in single precision where that is exact, and are compared in
    double precision.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    space = Workspace(vectors.sparkSession, "vectors")
    group = ["label", "dim", "key"]
    usable = space.write(vectors.mapInArrow(_prepare, PREPARED), "usable")
    reps = space.write(usable.groupBy(*group).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "distinct")
    keys = space.write(usable.select("vec_id", *group), "keys")
    space.drop(usable)
    n, largest = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    k = max(2, int(np.ceil(np.sqrt(largest / cell_rows))))
    share = min(1.0, train_rows / max(n, 1))
    sample = reps.where(F.pmod(F.xxhash64(F.lit(6), "key"), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True))
    sample = sample.select("key", "dim", "vec").limit(2 * train_rows).toArrow().sort_by("key")
    dims = np.array(sample["dim"].to_pylist(), int)
    indexes = {int(d): MultiIndex.fit(unit_rows(sample.filter(pa.array(dims == d))["vec"], int(d)), k, least, target) for d in np.unique(dims) if d > 1}
    held = vectors.sparkSession.sparkContext.broadcast(indexes)  # 2 k half-centroids for each length in the bounded sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == d))
                index, n_rows = held.value.get(int(d)), len(rows)
                if index is None:
                    cells, visited = np.zeros(n_rows, np.int32), np.zeros((n_rows, 1), np.int32)
                else:
                    x = unit_rows(rows.column("vec"), int(d))
                    cells, visited = index.cells(x), index.visited(x)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(visited.ravel()), visited.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("rep", "label", "dim", "copies", "vec")), pa.array(cells), lists], ["rep", "label", "dim", "copies", "vec", "cell", "visited"])

    placed = reps.select("rep", "label", "dim", "copies", "vec").mapInArrow(assign, "rep long, label string, dim int, copies long, vec binary, cell int, visited array<int>")
    placed = space.write(placed, "cells")
    cell = ["label", "dim", "cell"]
    queries = placed.select("rep", "label", "dim", "copies", "vec", F.col("cell").alias("home"), F.explode("visited").alias("cell"))
    blocks = placed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m_blocks"))
    visits = queries.select(*cell).groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks"))
    grid = space.write(blocks.join(visits, cell), "cell-blocks")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows with a block of their own side, once for each block of the other side."""
        rows = rows.join(grid, cell).withColumn(own[0], F.pmod(F.xxhash64(F.lit(8), "rep"), F.col(own)).cast("int"))
        rows = rows.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("m_blocks", "q_blocks")
        return rows.select(*[F.col(c).alias(c) for c in rows.columns])  # both sides stem from one table

    members = dealt(placed, "m_blocks", "q_blocks")
    asked = dealt(queries, "q_blocks", "m_blocks")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, counts, u, v = [], [], [], []
        if len(left) and len(right):
            dim = right["dim"][0].as_py()
            y, y_rep, y_copies = unit_rows(right["vec"], dim), right["rep"].to_numpy(), right["copies"].to_numpy()
            seen = right["visited"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)  # all of a dim visit equally many
            for at in range(0, len(left), BLOCK):
                part = left.slice(at, BLOCK)
                x, x_rep, x_copies, home = unit_rows(part["vec"], dim), part["rep"].to_numpy(), part["copies"].to_numpy(), part["home"].to_numpy()
                for below in range(0, len(y), BLOCK):
                    i, j = np.nonzero(x @ y[below : below + BLOCK].T >= least)
                    j += below
                    other = x_rep[i] != y_rep[j]
                    i, j = i[other], j[other]
                    # The other direction counts for itself if the member visits the query's cell as well.
                    mutual = np.zeros(len(i), bool)
                    for column in seen.T:
                        mutual |= column[j] == home[i]
                    rows += [x_rep[i], y_rep[j[~mutual]]]
                    counts += [y_copies[j], x_copies[i[~mutual]]]
                    u.append(x_rep[i])
                    v.append(y_rep[j])
        names = ["rep", "links", "to"]
        if not rows or not sum(map(len, rows)):
            return pa.table([pa.array([], pa.int64())] * 3, names)
        ids, back = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        node, root = forest(np.concatenate(u), np.concatenate(v))
        none = np.zeros(len(node), np.int64)
        return pa.table([pa.array(np.concatenate([ids, node])), pa.array(np.concatenate([total, none])), pa.array(np.concatenate([ids, root]))], names)

    key = [*cell, "m", "q"]
    found = asked.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(verify, "rep long, links long, to long")
    found = space.write(found, "links")
    space.drop(placed, grid)
    names = space.write(reps.select(*group, "rep", "copies"), "names")
    space.drop(reps)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("rep <> to").select(F.col("rep").alias("u"), F.col("to").alias("v")), space)
    answers = names.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    answers = answers.select(*group, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    joined = keys.join(answers, group).select("vec_id", "links", "component")
    whole = joined.unionByName(vectors.select("vec_id").exceptAll(joined.select("vec_id")).withColumns({"links": F.lit(0).cast("long"), "component": F.col("vec_id")}))
    return whole.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
