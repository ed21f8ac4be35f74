"""Queries along time over events, orders and line items: as-of and overlap joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import temporal
from tessella.plans.registry import load, query

#: The month of the events stretched over the years of the orders, in microseconds.
_EVENTS_FROM, _ORDERS_FROM, _STRETCH = 1_704_067_200_000_000, 788_918_400_000_000, 80
_T = f"make_timestamp({_ORDERS_FROM} + (epoch_us(ts) - {_EVENTS_FROM}) * {_STRETCH})"


def _stretched(spark, sf_dir):
    moved = F.timestamp_micros(F.lit(_ORDERS_FROM) + (F.unix_micros(F.col("ts").cast("timestamp")) - _EVENTS_FROM) * _STRETCH)
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("o_custkey"), moved.alias("t"))


@query("last_order_before_event", f"""WITH e AS (SELECT event_id, user_id, {_T} AS t FROM events), o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY ALL)
SELECT event_id, k AS last_o_orderkey, p AS last_o_totalprice, o_orderdate AS last_o_orderdate FROM e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.t >= o.o_orderdate""")  # fmt: skip
def last_order_before_event(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    found = temporal.as_of(_stretched(spark, sf_dir), orders, ["o_custkey"], "t", "o_orderdate", ["o_orderkey", "o_totalprice", "o_orderdate"], tie=["o_orderkey"])
    return found.select("event_id", "last_o_orderkey", "last_o_totalprice", "last_o_orderdate")


@query("next_order_of_status", """WITH l AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_shipdate FROM lineitem), o AS (SELECT o_orderstatus, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN o_orderdate - l_shipdate <= INTERVAL 2 DAY THEN k END AS next_o_orderkey FROM l ASOF LEFT JOIN o ON l_linestatus = o_orderstatus AND l_shipdate < o_orderdate""")  # fmt: skip
def next_order_of_status(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("o_orderstatus"), "l_shipdate")
    found = temporal.as_of(lines, load(spark, sf_dir, "orders"), ["o_orderstatus"], "l_shipdate", "o_orderdate", ["o_orderkey"], "next_", forward=True, strict=True, within=2 * 86_400_000_000)
    return found.select("l_orderkey", "l_linenumber", "next_o_orderkey")


_DAYS = "o_orderkey % 40 * 3"


@query("overlapping_orders", f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate AS s, o_orderdate + to_days(CAST({_DAYS} AS INTEGER)) AS e FROM orders)
SELECT a.o_orderkey AS earlier, b.o_orderkey AS later, greatest(a.s, b.s) AS since FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e""")  # fmt: skip
def overlapping_orders(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderdate as s", f"o_orderdate + make_interval(0, 0, 0, cast({_DAYS} as int)) as e")
    pairs = temporal.overlapping(orders, orders, ["o_custkey"], ("s", "e"), ("s", "e")).where("o_orderkey < other_o_orderkey")
    return pairs.select(F.col("o_orderkey").alias("earlier"), F.col("other_o_orderkey").alias("later"), F.greatest("s", "other_s").alias("since"))


@query("purchases_after_errors", "SELECT e.event_id AS error, p.event_id AS purchase FROM events e JOIN events p ON e.event_type = 'error' AND p.event_type = 'purchase' AND p.ts >= e.ts AND p.ts < e.ts + to_seconds(60 + e.event_id % 1000)")
def purchases_after_errors(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").selectExpr("event_id as error", "ts as s", "ts + make_interval(0, 0, 0, 0, 0, 0, 60 + event_id % 1000) as e")
    return temporal.overlapping(events.where("event_type = 'purchase'").selectExpr("event_id as purchase", "ts"), errors, [], ("ts", None), ("s", "e"), "").select("error", "purchase")


@query("order_in_force", f"""WITH e AS (SELECT event_id, user_id, {_T} AS t FROM events), o AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e FROM orders)
SELECT event_id, o_orderkey FROM e JOIN o ON user_id = o_custkey AND t >= o.s AND (o.e IS NULL OR t < o.e)""")  # fmt: skip
def order_in_force(spark, sf_dir):
    spans = load(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderdate as s", "lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as e")
    return temporal.overlapping(_stretched(spark, sf_dir), spans, ["o_custkey"], ("t", None), ("s", "e"), "in_force_").select("event_id", F.col("in_force_o_orderkey").alias("o_orderkey"))
