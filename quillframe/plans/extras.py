"""Queries on what the engine adds: text, time, map and JSON functions, time joins, pandas batches, approximate counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators.asof import asof_join, range_join
from quillframe.operators.frame import Frame
from quillframe.plans.registry import query


@query("strings", "SELECT c_custkey, lower(c_mktsegment) AS low, length(c_name) AS n, substr(c_name, 1, 4) AS head, replace(c_name, '#', '-') AS other, c_name || '/' || c_mktsegment AS joined, regexp_extract(c_name, '[0-9]+') AS digits, levenshtein(c_mktsegment, 'BUILDING') AS d FROM customer")
def strings(t):
    c = t.customer
    return c.select(
        "c_custkey", F.lower("c_mktsegment").alias("low"), F.length("c_name").cast("long").alias("n"), F.substring("c_name", 1, 4).alias("head"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("other"),
        F.concat_ws("/", "c_name", "c_mktsegment").alias("joined"), F.regexp_extract("c_name", "[0-9]+", 0).alias("digits"), F.levenshtein("c_mktsegment", F.lit("BUILDING")).cast("long").alias("d"),
    )


@query("dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate)::DATE AS first, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days, quarter(o_orderdate) AS q FROM orders")
def dates(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", *(f(d).cast("long").alias(n) for n, f in (("y", F.year), ("m", F.month), ("q", F.quarter))), F.trunc(d, "month").alias("first"), F.datediff(d, F.lit("1992-01-01").cast("date")).cast("long").alias("days"))


@query("json_functions", "SELECT event_id, props IS NOT NULL AND json_valid(props) AS ok FROM events")
def json_functions(t):
    return t.events.select("event_id", (F.col("props").isNotNull() & F.try_parse_json("props").isNotNull()).alias("ok"))


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def grouping_sets(t):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.groupingSets([[s], [p]], s, p).agg(F.count("*").alias("n"))


@query("count_distinct", "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderpriority) AS p FROM orders")
def count_distinct(t):
    return t.orders.agg(F.count_distinct("o_custkey").alias("n"), F.count_distinct("o_orderpriority").alias("p"))


@query("approx_distinct", "SELECT o_orderstatus, true AS near FROM orders GROUP BY 1")
def approx_distinct(t):
    """Within three deviations of the exact number."""
    near = F.abs(F.approx_count_distinct("o_custkey", 0.02) / F.count_distinct("o_custkey") - 1) <= 0.06
    return t.orders.groupBy("o_orderstatus").agg(near.alias("near"))


@query(
    "asof_join",
    """SELECT a.event_id, b.event_id AS last_event_id FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def asof(t):
    e = t.events
    return asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type <> 'click'").select("event_id", "user_id", "ts"), "ts", ["user_id"], ["event_id"]).select("event_id", "last_event_id")


@query("range_join", "SELECT p_partkey, lo FROM part JOIN (SELECT r_regionkey * 400.0 AS lo, r_regionkey * 400.0 + 250.0 AS hi FROM region) ON p_retailprice >= lo AND p_retailprice < hi")
def ranges(t):
    r = t.region.select((F.col("r_regionkey") * 400.0).alias("lo"), (F.col("r_regionkey") * 400.0 + 250.0).alias("hi"))
    return range_join(t.part.select("p_partkey", "p_retailprice"), r, "p_retailprice", "lo", "hi", 200.0).select("p_partkey", "lo")


@query("apply_batches", "SELECT n_nationkey, upper(n_name) AS name FROM nation")
def apply_batches(t):
    return Frame(t.nation.select("n_nationkey", "n_name")).apply(lambda b: b.assign(name=b["n_name"].str.upper())[["n_nationkey", "name"]], "n_nationkey int, name string").df
