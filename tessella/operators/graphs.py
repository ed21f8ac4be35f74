"""Cycles in directed graphs, found in rounds that don't grow with the length of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.staging import stored


def _degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, loop, before, after) of all nodes; before and after are a predecessor and a successor."""
    ends = edges.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast(edges.schema["source"].dataType).alias("before"), F.col("target").alias("after"), (F.col("source") == F.col("target")).alias("l"))
    ends = ends.unionByName(edges.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("source").alias("before"), F.lit(None).cast(edges.schema["source"].dataType).alias("after"), F.lit(False).alias("l")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.max("l").alias("loop"), F.min("before").alias("before"), F.min("after").alias("after"))


def _named(nodes: DataFrame, side: str, *columns: str) -> DataFrame:
    return nodes.select(F.col("node").alias(f"{side}_node"), *[F.col(c).alias(f"{side}_{c}") for c in columns])


def behind_cycles(edges: DataFrame) -> tuple[DataFrame, int]:
    """((node) of all nodes on a cycle of (source, target) or reachable from one, rounds it took).

    Each round rakes and compresses. Raked is a node without predecessors (it lies behind no
    cycle) or without successors (it lies behind one if a predecessor does: they are noted).
    Compressed is a node in the middle of a chain (it lies behind one if its only predecessor
    does), of neighbours on a chain only the one of least hash. So chains and trees shrink by a share
    of their nodes in each round, however deep they are. What is left has a predecessor for
    each node: all of it is on or behind a cycle, and so is what the notes lead to from there.

    Null sources and targets are left out; repeated edges count once; an edge from a node to
    itself is a cycle. Shuffled: the edges left, by their ends.
    """
    left = stored(edges.select("source", "target").dropna().distinct(), "edges")
    notes: list[DataFrame] = []
    rounds, n = 0, left.count()
    while n:
        rounds += 1
        nodes = _degrees(left)
        both = left.join(_named(nodes, "s", "n_in"), F.col("source") == F.col("s_node")).join(_named(nodes, "t", "n_out"), F.col("target") == F.col("t_node"))
        both = stored(both.select("source", "target", (F.col("s_n_in") == 0).alias("free"), (F.col("t_n_out") == 0).alias("last")), "raked")
        notes.append(both.where("last and not free").select(F.col("target").alias("node"), F.col("source").alias("because")))
        kept = both.where("not free and not last").select("source", "target")
        nodes = _degrees(kept)
        chained = stored(nodes.where("n_in = 1 and n_out = 1 and not loop").withColumn("h", F.xxhash64("node", F.lit(rounds))), "chained")
        order = F.struct("h", "node")
        around = chained.select("node", "before", "after", order.alias("own"))
        for side in ("before", "after"):
            near = chained.select(F.col("node").alias(f"{side}_node"), order.alias(f"{side}_order"))
            around = around.join(near, F.col(side) == F.col(f"{side}_node"), "left")
        least = (F.col("before_order").isNull() | (F.col("own") < F.col("before_order"))) & (F.col("after_order").isNull() | (F.col("own") < F.col("after_order")))
        gone = stored(around.where(least).select("node", "before", "after"), "compressed")
        notes.append(gone.select("node", F.col("before").alias("because")))
        # A compressed node has one edge to it and one from it; both become one around it.
        cut = gone.select(F.col("before").alias("source"), F.col("node").alias("target")).union(gone.select("node", "after"))
        left = stored(kept.join(cut, ["source", "target"], "left_anti").union(gone.select("before", "after")).distinct(), "edges")
        before, n = n, left.count()
        if n == before:  # nothing raked, and nothing compressed, which takes away an edge each
            break
    found = left.select(F.col("source").alias("node")).union(left.select(F.col("target").alias("node"))).distinct()
    if not notes:
        return found, rounds
    why = notes[0]
    for note in notes[1:]:
        why = why.union(note)
    why = stored(why, "notes")
    newest, parts = stored(found, "found"), []
    while newest.limit(1).count():  # along the notes, which are as deep as there were rounds at most twice over
        parts.append(newest)
        why = stored(why.join(newest, "node", "left_anti"), "notes")
        newest = stored(why.join(newest.select(F.col("node").alias("because")), "because", "left_semi").select("node").distinct(), "found")
    found = parts[0] if parts else newest
    for part in parts[1:]:
        found = found.union(part)
    return found, rounds


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node) on a cycle or between two: what lies behind cycles and before cycles. An acyclic graph has none."""
    behind, _ = behind_cycles(edges)
    before, _ = behind_cycles(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return behind.join(before, "node", "left_semi")
