"""Pairs of places within a radius, on the sphere.

Places are points in space, cut into cubes whose side is the chord of the radius. Two places
within the radius lie in the same cube or in two that touch, everywhere: cubes know no date
line and no poles. Pairs that meet are then measured along the great circle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.audit import distance_km

EARTH_KM = 12742.0176 / 2
#: Places of one side that meet those of the other at once; fuller cubes are cut into blocks.
BLOCK = 2_000
#: The same for places that are counted, not paired.
CROWD = 100_000
#: Places and strips, or places and others, that a task sets side by side at once.
PIECE = 500_000


def _cells(rows: DataFrame, side: str, lat: str, lon: str, edge: float) -> DataFrame:
    """The rows that have a place, with their cube (three numbers)."""
    y, x = F.radians(F.col(f"`{lat}`").cast("double")), F.radians(F.col(f"`{lon}`").cast("double"))
    found = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(side), F.col(f"`{lat}`").cast("double").alias(f"{side}_lat"), F.col(f"`{lon}`").cast("double").alias(f"{side}_lon"), *[
        F.floor(EARTH_KM * c / edge).cast("long").alias(f"{side}{i}") for i, c in enumerate((F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)))
    ])
    usable = F.abs(f"{side}_lat") <= 90
    for c in (f"{side}_lat", f"{side}_lon"):
        usable &= F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    return found.where(usable).withColumn(f"{side}_mix", F.xxhash64(side))


def _around(side: str) -> Column:
    """The cube and the 26 that touch it."""
    steps = [-1, 0, 1]
    return F.explode(F.array(*[F.struct(*[(F.col(f"{side}{i}") + s).alias(f"c{i}") for i, s in enumerate((p, q, r))]) for p in steps for q in steps for r in steps]))


def within(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", prefix: str = "other_") -> DataFrame:
    """Pairs of rows at most km apart: left's columns, right's with prefix, and km, their distance.

    lat and lon (degrees, of both tables): rows without them, with NaN, or with a latitude beyond
    the poles have no place and pair with nothing; longitudes may run over 180. Repeated rows pair
    each. No rows on a side give none. Shuffled: left once, right 27 times its keys; a cube that
    holds very many places is cut into blocks of either side, which meet two by two.
    """
    if not 0 < km < math.pi * EARTH_KM:
        raise ValueError("the radius is above 0 and below half of the way around")
    edge = 2 * EARTH_KM * math.sin(km / (2 * EARTH_KM)) * (1 + 1e-9)
    a = _cells(left, "_a", lat, lon, edge).withColumnsRenamed({f"_a{i}": f"c{i}" for i in range(3)})
    b = _cells(right, "_b", lat, lon, edge).withColumn("_cell", _around("_b")).select("_b", "_b_lat", "_b_lon", "_b_mix", "_cell.*")
    cell = ["c0", "c1", "c2"]
    blocks = lambda rows, name: rows.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    full = blocks(a, "_na").join(blocks(b, "_nb"), cell)
    a = a.join(full, cell).withColumn("_i", F.pmod("_a_mix", F.col("_na"))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_na", "_nb")
    b = b.join(full, cell).withColumn("_j", F.pmod("_b_mix", F.col("_nb")).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_na") - 1))).drop("_na", "_nb")
    far = distance_km(F.col("_a_lat"), F.col("_a_lon"), F.col("_b_lat"), F.col("_b_lon"))
    met = a.withColumn("_i", F.col("_i").cast("int")).join(b, [*cell, "_i", "_j"]).withColumn("_km", far).where(F.col("_km") <= km)
    return met.select("_a.*", *[F.col(f"_b.`{c}`").alias(f"{prefix}{c}") for c in right.columns], F.col("_km").alias("km"))


def _km(lat: np.ndarray, lon: np.ndarray, other_lat: np.ndarray, other_lon: np.ndarray) -> np.ndarray:
    """distance_km over arrays."""
    h = np.sin(np.radians(other_lat - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(other_lat)) * np.sin(np.radians(other_lon - lon) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(h))


def _distinct(lat: np.ndarray, lon: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Latitude and longitude of the distinct places, the sums of their weights, least and second ranks (-1: none),
    and the place of each row."""
    order = np.lexsort((rank, lon, lat))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(lat[order]) != 0) | (np.diff(lon[order]) != 0)
    at, ranks = np.flatnonzero(new), rank[order]
    n = np.diff([*at, len(order)])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return lat[order][at], lon[order][at], np.add.reduceat(weight[order], at), ranks[at], np.where(n > 1, ranks[np.minimum(at + 1, len(ranks) - 1)], -1), of


def _turned(lon: np.ndarray) -> np.ndarray:
    return np.mod(np.mod(lon, 360), 360)


def _laid_out(of: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(of, position) for each of the n positions from start on, in pieces."""
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // PIECE)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(n)], strict=True):
        k = n[low:high]
        yield np.repeat(of[low:high], k), np.repeat(start[low:high] - np.cumsum(k) + k, k) + np.arange(k.sum())


class _Strips:
    """Places in strips of latitude with about equally many each, along the longitude: each strip a turn, then once
    more. A latitude is never cut; one with more places than a strip should have is a strip of its own."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, strips: int) -> None:
        by_lat = np.argsort(lat, kind="stable")
        some = lat[by_lat[np.linspace(0, len(lat), strips, endpoint=False).astype(np.int64)]]
        left, right = (np.searchsorted(lat[by_lat], some, side) for side in ("left", "right"))
        cuts = np.unique(np.concatenate([left, right[(right - left) * strips > len(lat)], [0, len(lat)]]))
        strips = len(cuts) - 1
        self.size, self.start = np.diff(cuts), 2 * cuts[:-1]
        self.bottom, self.top = lat[by_lat[cuts[:-1]]], lat[by_lat[cuts[1:] - 1]]
        strip, turn = np.repeat(np.arange(strips), self.size), _turned(lon[by_lat])
        order = np.lexsort((turn, strip))
        at = np.arange(len(lat)) + cuts[strip]
        self.place, self.along = np.empty(2 * len(lat), np.int64), np.empty(2 * len(lat))
        for more in (0, 1):
            self.place[at + more * self.size[strip]] = by_lat[order]
            self.along[at + more * self.size[strip]] = strip * 1024 + turn[order] + 360 * more

    def spans(self, lat: np.ndarray, lon: np.ndarray, km: np.ndarray) -> tuple[np.ndarray, ...]:
        """(i, first, inner, outer, last) for each place i and each strip within its reach. What lies within km is in
        [first, last) of the strip's positions, and all of [inner, outer) lies within."""
        reach = np.degrees(km / EARTH_KM) + 1e-9
        low = np.searchsorted(self.top, lat - reach)
        n = np.maximum(np.searchsorted(self.bottom, lat + reach, "right") - low, 0)
        i = np.repeat(np.arange(len(lat)), n)
        strip = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        y, share = lat[i], np.sin(km / (2 * EARTH_KM))[i] ** 2
        # A circle's width along the longitude turns only where a meridian touches it.
        touch = np.degrees(np.arcsin(np.clip(np.nan_to_num(np.sin(np.radians(y)) / np.cos(km / EARTH_KM)[i]), -1, 1)))
        ends = [self.bottom[strip], self.top[strip], np.clip(touch, self.bottom[strip], self.top[strip])]

        def widths(slack: float) -> list[np.ndarray]:
            over = [(share - np.sin(np.radians(e - y) / 2) ** 2 + slack) / (np.cos(np.radians(y)) * np.cos(np.radians(e))) for e in ends]
            return [np.where(h < 0, -1, np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))) for h in over]

        sure, most = np.minimum.reduce(widths(-1e-14)), np.maximum.reduce(widths(1e-14))
        met = most >= 0
        i, strip, sure, most = i[met], strip[met], sure[met], most[met]
        turn, slack = _turned(lon)[i], 1e-7
        middle = strip * 1024 + np.where(turn < 180, turn + 360, turn)
        first = np.searchsorted(self.along, middle - most - slack)
        last = np.minimum(np.searchsorted(self.along, middle + most + slack), first + self.size[strip])
        inner, outer = np.searchsorted(self.along, middle - sure + slack), np.searchsorted(self.along, middle + sure - slack)
        none, whole = sure <= slack, sure >= 180
        inner, outer = np.where(none, last, inner), np.where(none, last, outer)
        first, last = np.where(whole, self.start[strip], first), np.where(whole, self.start[strip] + self.size[strip], last)
        return i, first, np.where(whole, first, inner), np.where(whole, last, outer), last

    def beside(self, lat: np.ndarray, lon: np.ndarray) -> Iterator[np.ndarray]:
        """Some places near each: its neighbours along the longitude in its strip and the two beside that."""
        turn = _turned(lon)
        for step in (-1, 0, 1):
            strip = np.clip(np.searchsorted(self.top, lat) + step, 0, len(self.top) - 1)
            at = np.searchsorted(self.along, strip * 1024 + np.where(turn < 180, turn + 360, turn)) - self.start[strip]
            for k in (-2, -1, 0, 1):
                yield self.place[self.start[strip] + np.mod(at + k, self.size[strip])]


def _numbers(lat: np.ndarray, lon: np.ndarray, others: tuple[np.ndarray, ...], km: float) -> np.ndarray:
    """How much weight of the other places lies within km of each place. Only those at the rim are measured."""
    o_lat, o_lon, weight = others[:3]
    strips = _Strips(o_lat, o_lon, max(1, round(len(o_lat) ** 0.5 / 2)))
    sums = np.concatenate([[0], np.cumsum(weight[strips.place])])
    out, step = np.zeros(len(lat), np.int64), max(1, PIECE // len(strips.size))
    for at in range(0, len(lat), step):
        y, x = lat[at : at + step], lon[at : at + step]
        i, first, inner, outer, last = strips.spans(y, x, np.full(len(y), km))
        n = np.bincount(i, sums[outer] - sums[inner], len(y))
        for j, position in _laid_out(np.tile(i, 2), np.concatenate([first, outer]), np.concatenate([inner - first, last - outer])):
            place = strips.place[position]
            n += np.bincount(j, weight[place] * (_km(y[j], x[j], o_lat[place], o_lon[place]) <= km), len(y))
        out[at : at + step] = n.astype(np.int64)
    return out


def _nearest(lat: np.ndarray, lon: np.ndarray, others: tuple[np.ndarray, ...], km: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance and least rank of the nearest elsewhere within km of each place; infinite and -1 without one."""
    o_lat, o_lon, _, rank = others[:4]
    strips = _Strips(o_lat, o_lon, max(1, round(len(o_lat) ** 0.5)))
    best, which = np.full(len(lat), np.inf), np.full(len(lat), -1)
    step = max(1, PIECE // len(strips.size))
    for at in range(0, len(lat), step):
        y, x = lat[at : at + step], lon[at : at + step]
        bound = np.full(len(y), km)
        for place in strips.beside(y, x):
            far = _km(y, x, o_lat[place], o_lon[place])
            bound = np.where(((o_lat[place] != y) | (o_lon[place] != x)) & (far < bound), far, bound)
        i, first, _, _, last = strips.spans(y, x, bound)
        for j, position in _laid_out(i, first, last - first):
            place = strips.place[position]
            far = _km(y[j], x[j], o_lat[place], o_lon[place])
            use = (far <= km) & ((o_lat[place] != y[j]) | (o_lon[place] != x[j]))
            j, far, ranks = j[use], far[use], rank[place[use]]
            order = np.lexsort((ranks, far, j))
            order = order[np.diff(j[order], prepend=-1) != 0]
            j, far, ranks = j[order] + at, far[order], ranks[order]
            better = (far < best[j]) | ((far == best[j]) & (ranks < which[j]))
            best[j[better]], which[j[better]] = far[better], ranks[better]
    return best, which


def _met(a: pa.Table, b: pa.Table, km: float) -> pa.Table:
    """(key, n, at, km) of a's rows: how much of b's weight lies within km, itself included, and the nearest with
    another key."""
    names = ["key", "n", "at", "km"]
    keys, other_keys = (t.column("_key").combine_chunks() for t in (a, b))
    if not len(keys) or not len(other_keys):
        return pa.table([keys[:0], pa.array([], pa.int64()), other_keys[:0], pa.array([], pa.float64())], names)
    ranks = np.asarray(pc.rank(pa.concat_arrays([keys, other_keys]), tiebreaker="dense")).astype(np.int64)
    rank, other_rank = ranks[: len(keys)], ranks[len(keys) :]
    weight = lambda t: t.column("_weight").to_numpy() if "_weight" in t.column_names else np.ones(len(t), np.int64)
    (lat, lon, *_, of), others = (_distinct(t.column("_lat").to_numpy(), t.column("_lon").to_numpy(), r, weight(t)) for t, r in ((a, rank), (b, other_rank)))
    with np.errstate(all="ignore"):
        n, (far, which) = _numbers(lat, lon, others, km), _nearest(lat, lon, others, km)
    # At the same place stands the least other key, if any.
    here = dict(zip(zip(others[0].tolist(), others[1].tolist(), strict=True), range(len(others[0])), strict=True))
    spot = np.array([here.get(p, -1) for p in zip(lat.tolist(), lon.tolist(), strict=True)])[of]
    same = np.where(spot < 0, -1, np.where(others[3][spot] != rank, others[3][spot], others[4][spot]))
    far, which = far[of], which[of]
    closer = (same >= 0) & ((far > 0) | (same < which))
    far, which = np.where(closer, 0.0, far), np.where(closer, same, which)
    row = np.zeros(ranks.max() + 1, np.int64)
    row[other_rank] = np.arange(len(other_keys))
    none = which < 0
    return pa.table([keys, pa.array(n[of]), other_keys.take(pa.array(row[which], mask=none)), pa.array(far, mask=none)], names)


def _cornered(edge: float, side: float) -> Column:
    """The cubes of this side that lie within an edge of a place."""
    near = [[F.floor((F.col(c) + s * edge) / side).cast("long") for s in (-1, 1)] for c in "xyz"]
    return F.explode(F.array_distinct(F.array(*[F.struct(p.alias("c0"), q.alias("c1"), r.alias("c2")) for p in near[0] for q in near[1] for r in near[2]])))


def competitors(places: DataFrame, key: str, km: float, lat: str = "lat", lon: str = "lon", weight: str | None = None) -> DataFrame:
    """(key, competitors, nearest, nearest_km) of each place: how many others lie within km, and which is the
    nearest (ties: the smallest key); 0 and nulls without one. Keys tell places apart; null keys are left out.
    weight: a column of whole numbers, what each place counts for in place of 1.

    Pairs are not formed: the places of a cube, four times as wide as the radius' chord, meet those within a chord of
    it, and are counted along strips of latitude. Shuffled: places once and some three times for the cubes around
    theirs; cubes that hold over CROWD places are cut into blocks.
    """
    if not 0 < km < math.pi * EARTH_KM:
        raise ValueError("the radius is above 0 and below half of the way around")
    edge = 2 * EARTH_KM * math.sin(km / (2 * EARTH_KM)) * (1 + 1e-9)
    own = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = places.select(key, lat, lon, own.alias("_weight")).dropna(subset=[key]).dropDuplicates([key])
    y, x = F.radians("_lat"), F.radians("_lon")
    spots = rows.select(F.col(key).alias("_key"), "_weight", *[F.col(c).cast("double").alias(n) for c, n in ((lat, "_lat"), (lon, "_lon"))]).where((F.abs("_lat") <= 90) & (F.abs("_lon") < float("inf")))
    spots = spots.select("*", F.xxhash64("_key").alias("_mix"), *[(EARTH_KM * c).alias(n) for c, n in ((F.cos(y) * F.cos(x), "x"), (F.cos(y) * F.sin(x), "y"), (F.sin(y), "z"))])
    cell, kept = ["c0", "c1", "c2"], ["_key", "_lat", "_lon", "_weight", "_mix"]
    a = spots.select(*kept, *[F.floor(F.col(c) / (4 * edge)).cast("long").alias(f"c{i}") for i, c in enumerate("xyz")])
    b = spots.select(*[F.col(c).alias(c) for c in kept], _cornered(edge, 4 * edge).alias("_cell")).select(*kept, "_cell.*")
    blocks = lambda rows, name: rows.groupBy(*cell).agg(F.ceil(F.count("*") / CROWD).cast("int").alias(name))
    full = blocks(a, "_na").join(blocks(b, "_nb"), cell)
    if edge > EARTH_KM / 200:
        full = F.broadcast(full)  # some 50,000 cubes at most lie on the sphere
    cut = lambda rows, own, n, other, m: rows.join(full, cell).select(*kept[:4], *cell, F.pmod("_mix", n).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other))
    group = [*cell, "_i", "_j"]
    met = cut(a, "_i", "_na", "_j", "_nb").groupBy(*group).cogroup(cut(b, "_j", "_nb", "_i", "_na").groupBy(*group))
    kind = rows.schema[key].dataType.simpleString()
    found = met.applyInArrow(lambda left, right: _met(left, right, km), f"key {kind}, n long, at {kind}, km double")
    first = F.min(F.when(F.col("at").isNotNull(), F.struct("km", "at")))
    near = found.groupBy(F.col("key").alias("_key")).agg(F.sum("n").alias("n"), first.alias("first"))
    out = rows.join(near, F.col(key) == F.col("_key"), "left")
    return out.select(key, F.coalesce(F.col("n") - F.col("_weight"), F.lit(0).cast("long")).alias("competitors"), F.col("first.at").alias("nearest"), F.round("first.km", 3).alias("nearest_km"))
