"""Queries that read events and pages as streams; the SQL says what is final at the last watermark."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tessella.operators.pages import TRACKED
from tessella.plans.registry import _SNAP, query
from tessella.streaming import windows
from tessella.streaming.drift import drift_stream

_CLOSED = "date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR"


def _events(spark, sf_dir):
    return windows.files_stream(spark, f"{sf_dir}/events.parquet")


@query("events_hourly", f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, max(value) AS most FROM events GROUP BY ALL)
SELECT event_type, start, start + INTERVAL 1 HOUR AS "end", n, most FROM w WHERE start + INTERVAL 1 HOUR <= {_CLOSED}""")  # fmt: skip
def events_hourly(spark, sf_dir):
    return windows.drained(windows.counted(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], [F.max("value").alias("most")], "1 hour"), "hourly")[0]


@query("events_sliding", f"""WITH s AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INTEGER)) AS start, count(*) AS n FROM events, range(0, 6) t(k) GROUP BY ALL) SELECT event_type, start, start + INTERVAL 6 HOUR AS "end", n FROM s WHERE start + INTERVAL 6 HOUR <= {_CLOSED}""")
def events_sliding(spark, sf_dir):
    return windows.drained(windows.counted(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], [], "6 hours", "1 hour"), "sliding")[0]


@query("user_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER p + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS begins FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), a AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k) SELECT * FROM a WHERE "end" <= {_CLOSED}""")  # fmt: skip
def user_sessions(spark, sf_dir):
    return windows.drained(windows.counted(_events(spark, sf_dir), "ts", "1 hour", ["user_id"], [], gap="3 hours"), "sessions")[0]


@query("purchase_after_view", "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.event_type = 'view' AND p.event_type = 'purchase' AND v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 12 HOUR")
def purchase_after_view(spark, sf_dir):
    views, purchases = (_events(spark, sf_dir).where(F.col("event_type") == kind).select("event_id", "user_id", "ts") for kind in ("view", "purchase"))
    pairs = windows.answered(views, purchases, ["user_id"], "ts", "ts", "12 hours", "1 hour")
    return windows.drained(pairs.select(F.col("event_id").alias("view_id"), F.col("answer_event_id").alias("purchase_id")), "answered")[0]


@query("events_once", "SELECT event_id, user_id, ts FROM events")
def events_once(spark, sf_dir):
    twice = _events(spark, sf_dir).union(_events(spark, sf_dir)).select("event_id", "user_id", "ts")
    return windows.drained(windows.first_seen(twice, ["event_id"], "ts", "1 hour"), "once")[0]


_HOST_PAGES = "SELECT split_part(url, '/', 3) AS host, make_timestamp((1704067200 + page_id * 420) * 1000000) AS captured_at, html FROM pages"
_NOISE = "AND NOT (b <> 0 AND abs(a - b) / greatest(1, b) < 0.15)"


def _element_sql(element: str, severity: str) -> str:
    grave = f"CASE WHEN lower(CAST(a AS VARCHAR)) LIKE '%noindex%' THEN 'critical' ELSE '{severity}' END" if element == "meta_robots" else f"'{severity}'"
    pairs = f"SELECT host, captured_at, {element} AS a, lag({element}) OVER p AS b, lag(captured_at) OVER p AS since FROM s WINDOW p AS (PARTITION BY host ORDER BY captured_at)"
    return f"""SELECT host AS url, captured_at, '{element}' AS element, {grave} AS severity, CAST(b AS VARCHAR) AS old, CAST(a AS VARCHAR) AS new FROM ({pairs})
WHERE since >= captured_at - INTERVAL 5 HOUR AND a IS DISTINCT FROM b {_NOISE if element == 'word_count' else ''} AND captured_at <= (SELECT max(captured_at) FROM s) - INTERVAL 10 MINUTE"""


@query("drift_of_hosts", f"WITH h AS ({_HOST_PAGES}), s AS (SELECT url AS host, captured_at, * EXCLUDE (url) FROM ({_SNAP.replace('SELECT url,', 'SELECT host AS url, captured_at,')}h)) " + " UNION ALL ".join(_element_sql(*x) for x in TRACKED.items()))
def drift_of_hosts(spark, sf_dir):
    captures = windows.files_stream(spark, f"{sf_dir}/pages.parquet")
    captures = captures.select(F.element_at(F.split("url", "/"), 3).alias("url"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 420).alias("captured_at"), "html")
    return windows.drained(drift_stream(captures, "10 minutes", timedelta(hours=5)), "drift")[0]
