"""Connected components of a link table of any size, by alternating large and small stars.

Every round points each node's neighbours at the smallest node it knows; rounds end
when all links lead from a node to its component's smallest. Links are first thinned
to a spanning forest within each partition, which keeps components as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Workspace


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the links (a, b) connect; root is the smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def thinned(links: DataFrame, batch: int = 1_000_000) -> DataFrame:
    """(u, v), u > v: a spanning forest of each stretch of a partition's links."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            u, v = forest(*np.concatenate(held, axis=1)) if held else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for rows in batches:
            held.append(np.stack([rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)]))
            n += len(rows)
            if n >= batch:
                yield out()
                held, n = [], 0
        yield out()

    return links.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(thin, "u long, v long")


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """(node, component) of every node that links (u, v: long) connect to a smaller one.

    component is the smallest node reachable. Nodes that are their own component's
    smallest, or without links, don't occur. Nulls and links to oneself don't count;
    no links give no rows. The last round's table stays in the workspace.
    """
    now = space.write(thinned(links).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        before, now = now, space.write(small.union(least.select("u", F.col("low").alias("v"))).distinct(), "links")
        space.drop(before)
