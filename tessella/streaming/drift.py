"""Drift over a stream of page captures (an extension): each capture against the one before it in time.

pages: a stream of (url, captured_at, html). For each url, state holds the captures that the
watermark has not passed yet, in order of time, and the last one that it has. A timer fires
when the watermark passes a capture, so captures are compared in order of time whatever
order they came in; another one fires when a url was quiet for `keep`, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators import pages as web
from tessella.operators.pages import TRACKED, tracked
from tessella.operators.temporal import as_of

CHANGE = "url string, captured_at timestamp, element string, severity string, old string, new string"
#: Keyed state with timers needs Spark's store for it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Captures(StatefulProcessor):
    """State of one url: waiting (moment to capture) and before (the last capture compared)."""

    def __init__(self, keep: timedelta):
        self.keep = int(keep / timedelta(microseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "shot string")
        self.before = handle.getValueState("before", "at long, shot string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, shot in zip(part["at"].tolist(), part["shot"].tolist(), strict=True):
                known = self.waiting.getValue((at,))
                if known is None or known[0] < shot:  # of captures at one moment the largest counts, whatever their order
                    self.waiting.updateValue((at,), (shot,))
                    self.handle.registerTimer(at // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        before, out = self.before.get(), []
        for at, shot in sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= now):
            if before is not None and at - before[0] <= self.keep:
                out.append((key[0], at, before[1], shot))
            before = (at, shot)
            self.waiting.removeKey((at,))
            self.before.update(before)
            self.handle.registerTimer((at + self.keep) // 1000 + 1)
        if before is not None and before[0] + self.keep < now:  # whatever comes now is too far from it
            self.before.clear()
        if out:
            yield pd.DataFrame(out, columns=["url", "at", "old", "new"])


def _shots(pages: DataFrame) -> DataFrame:
    """url, captured_at and the tracked elements as one string, cut from HTML by Spark's own expressions."""
    shot = F.to_json(F.struct(*[c.cast("string").alias(k) for k, c in tracked("html").items()]))
    return pages.where("url is not null and captured_at is not null").select("url", "captured_at", shot.alias("shot"))


def _compared(pairs: DataFrame) -> DataFrame:
    """CHANGE rows of pairs (url, captured_at, old, new) of captures."""
    kind = ", ".join(f"{k} string" for k in TRACKED)
    rows = pairs.select("url", "captured_at", F.from_json("old", kind).alias("b"), F.from_json("new", kind).alias("a"))
    return web.differences(rows, "url", "captured_at").select("url", "captured_at", "element", "severity", "old", "new")


def drift_stream(pages: DataFrame, late: str = "1 hour", keep: timedelta = timedelta(days=90)) -> DataFrame:
    """A stream of CHANGE rows: what drift_table gives for the captures that the watermark has passed.

    A capture older than the watermark (the latest one less `late`) when it comes is dropped;
    all others are compared in order of time, however they come. State of a url is what came
    within `late` and one capture, which goes when the url has been quiet for `keep`.
    """
    spark = pages.sparkSession
    spark.conf.set(*STORE)
    shots = _shots(pages.withWatermark("captured_at", late)).select("url", "captured_at", F.unix_micros(F.col("captured_at").cast("timestamp")).alias("at"), "shot")
    pairs = shots.groupBy("url").transformWithStateInPandas(Captures(keep), "url string, at long, old string, new string", "append", "eventTime")
    return _compared(pairs.select("url", F.timestamp_micros("at").alias("captured_at"), "old", "new"))


def drift_table(pages: DataFrame, keep: timedelta = timedelta(days=90)) -> DataFrame:
    """CHANGE rows of a table of captures: each against the last earlier one of its url, if that is at most
    `keep` older. Of captures at one moment the one whose elements sort last counts. Null urls and times
    are left out; repeated rows count once; a url with most of the captures is cut into slices of time."""
    shots = _shots(pages).groupBy("url", "captured_at").agg(F.max("shot").alias("shot"))
    pairs = as_of(shots, shots, ["url"], "captured_at", "captured_at", ["shot"], "last_", strict=True, within=int(keep / timedelta(microseconds=1)))
    return _compared(pairs.where("last_shot is not null").select("url", "captured_at", F.col("last_shot").alias("old"), F.col("shot").alias("new")))
