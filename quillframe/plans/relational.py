"""Queries on scans, projections, cleaning, joins, sets, order, groups, windows and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators.frame import Frame
from quillframe.plans.registry import Tables, query

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "revenue_by_nation",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag = 'R' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 5""",
)
def revenue_by_nation(t: Tables):
    lines = Frame(t.lineitem).filter(F.col("l_returnflag") == "R").select(["l_orderkey", "l_extendedprice", "l_discount", "l_quantity"])
    orders = Frame(t.orders).select(["o_orderkey", "o_custkey"])
    customers = Frame(t.customer).select(["c_custkey", "c_nationkey"])
    joined = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey").merge(customers, left_on="o_custkey", right_on="c_custkey")
    joined = joined.merge(Frame(t.nation).select(["n_nationkey", "n_name"]), left_on="c_nationkey", right_on="n_nationkey")
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    out = joined.df.groupBy("n_name").agg(revenue.alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))
    return out.orderBy(F.col("revenue").desc(), "n_name").limit(5)


@query("filter_compound", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05 AND l_returnflag IN ('A', 'N')")
def filter_compound(t):
    wanted = (F.col("l_quantity") > 25) & (F.col("l_discount") < 0.05) & F.col("l_returnflag").isin("A", "N")
    return Frame(t.lineitem).filter(wanted).select(["l_orderkey", "l_quantity", "l_discount"]).df


@query("select_drop_rename", "SELECT p_partkey AS part, p_brand, p_size AS size FROM part")
def select_drop_rename(t):
    return Frame(t.part).drop(["p_name", "p_type", "p_retailprice"]).rename({"p_partkey": "part", "p_size": "size"}).df


def _holes(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))


HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders)"


@query("fillna", f"SELECT o_orderkey, coalesce(price, 0.0) AS price, priority FROM {HOLES}")
def fillna(t):
    return Frame(_holes(t), ["o_orderkey"]).fillna(0.0).df


@query("dropna", f"SELECT * FROM {HOLES} WHERE price IS NOT NULL AND priority IS NOT NULL")
def dropna(t):
    return Frame(_holes(t), ["o_orderkey"]).dropna().df


@query("isnull", f"SELECT price IS NULL AS price, count(*) AS n FROM {HOLES} GROUP BY 1")
def isnull(t):
    return Frame(_holes(t)).isnull().df.groupBy("price").agg(F.count("*").alias("n"))


@query("notnull", f"SELECT priority IS NOT NULL AS priority, count(*) AS n FROM {HOLES} GROUP BY 1")
def notnull(t):
    return Frame(_holes(t)).notnull().df.groupBy("priority").agg(F.count("*").alias("n"))


@query("replace_values", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replace_values(t):
    return Frame(t.orders).replace(["O", "P"], "open", ["o_orderstatus"]).select(["o_orderkey", "o_orderstatus"]).df


@query("clip", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 5000 THEN 5000.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def clip(t):
    return Frame(t.customer).clip(0, 5000, ["c_acctbal"]).select(["c_custkey", "c_acctbal"]).df


@query("drop_duplicates_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def drop_duplicates_first(t):
    return Frame(t.orders.select("o_custkey", "o_orderkey"), ["o_orderkey"]).drop_duplicates(["o_custkey"]).df


@query("drop_duplicates_last", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def drop_duplicates_last(t):
    return Frame(t.orders.select("o_custkey", "o_orderkey"), ["o_orderkey"]).drop_duplicates(["o_custkey"], "last").df


@query("drop_duplicates_none", "SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
def drop_duplicates_none(t):
    return Frame(t.orders.select("o_custkey", "o_orderkey"), ["o_orderkey"]).drop_duplicates(["o_custkey"], False).df


@query("duplicated_mask", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS duplicated FROM orders")
def duplicated_mask(t):
    return Frame(t.orders, ["o_orderkey"]).duplicated(["o_custkey"]).select(["o_orderkey", "duplicated"]).df


@query("head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def head(t):
    return Frame(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"]).head(10).df


@query("tail", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def tail(t):
    return Frame(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"]).tail(10).df


@query("iloc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 17")
def iloc(t):
    return Frame(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"]).iloc(17).df


@query("loc", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def loc(t):
    return Frame(t.customer).loc(7, "c_custkey").select(["c_custkey", "c_name"]).df


@query("reset_index", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, event_id FROM events")
def reset_index(t):
    return Frame(t.events.select("event_id"), ["event_id"]).reset_index("idx").df


# -- joins and sets ---------------------------------------------------------------------------------------------------


def _two(t):
    return Frame(t.documents.select("doc_id", "lang")), Frame(t.labels.where("quality = 1").select("doc_id", "quality"))


SIDES = "(SELECT doc_id, lang FROM documents WHERE lang <> 'en') d", "(SELECT doc_id, quality FROM labels WHERE quality = 1) l"
for _name, _how in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):

    def _join(t, how=_name):
        left, right = _two(t)
        return left.filter("lang <> 'en'").join(right, "doc_id", how).df

    query(f"join_{_name}", f"SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality FROM {SIDES[0]} {_how} {SIDES[1]} ON d.doc_id = l.doc_id")(_join)


@query("join_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_semi(t):
    left, right = _two(t)
    return left.join(right, "doc_id", "semi").df


@query("join_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_anti(t):
    left, right = _two(t)
    return left.join(right, "doc_id", "anti").df


@query(
    "join_suffixes",
    """SELECT c.k, c.name AS name_left, c.bal AS bal_left, s.name AS name_right, s.bal AS bal_right FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer) c
    JOIN (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier) s ON c.k = s.k""",
)
def join_suffixes(t):
    left = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    right = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return Frame(left).join(Frame(right), "k").df


@query("merge_diff_keys", "SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def merge_diff_keys(t):
    return Frame(t.orders.select("o_orderkey", "o_custkey")).merge(Frame(t.customer.select("c_custkey", "c_mktsegment")), left_on="o_custkey", right_on="c_custkey", how="left").df


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return Frame(t.region.select("r_name")).merge(Frame(t.nation.select("n_name")), how="cross").df


@query("concat_rows", "SELECT event_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value FROM events WHERE value > 50")
def concat_rows(t):
    e = Frame(t.events.select("event_id", "event_type", "value"), ["event_id"])
    return e.filter("event_type = 'click'").select(["event_id", "value"]).concat(e.filter("value > 50").select(["event_id", "value"])).df


@query(
    "concat_columns",
    """SELECT a.event_id, a.value AS value, b.value AS other FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE event_type = 'click') a
    FULL JOIN (SELECT value, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE event_type <> 'click') b ON a.i = b.i""",
)
def concat_columns(t):
    left = Frame(t.events.where("event_type = 'click'").select("event_id", "value"), ["event_id"])
    right = Frame(t.events.where("event_type <> 'click'").select(F.col("value").alias("other"), F.col("event_id").alias("at")), ["at"])
    return left.concat(right, 1).select(["event_id", "value", "other"]).df


@query("union_distinct", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def union_distinct(t):
    o = Frame(t.orders.select("o_orderstatus", "o_orderpriority", "o_custkey"))
    return o.filter("o_orderstatus = 'F'").select(["o_custkey"]).union(o.filter("o_orderpriority = '1-URGENT'").select(["o_custkey"])).df


@query("intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def intersect(t):
    o = Frame(t.orders.select("o_orderstatus", "o_orderpriority", "o_custkey"))
    return o.filter("o_orderstatus = 'F'").select(["o_custkey"]).intersect(o.filter("o_orderpriority = '1-URGENT'").select(["o_custkey"])).df


@query("subtract", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def subtract(t):
    o = Frame(t.orders.select("o_orderstatus", "o_orderpriority", "o_custkey"))
    return o.filter("o_orderstatus = 'F'").select(["o_custkey"]).subtract(o.filter("o_orderpriority = '1-URGENT'").select(["o_custkey"])).df


# -- order, groups --------------------------------------------------------------------------------------------------


@query("sort_multi", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders ORDER BY o_orderstatus, o_custkey, o_orderkey")
def sort_multi(t):
    return Frame(t.orders.select("o_orderkey", "o_orderstatus", "o_custkey"), ["o_orderkey"]).sort(["o_orderstatus", "o_custkey"]).df


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(t):
    return Frame(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"]).sort("o_totalprice", False).df.limit(20)


@query(
    "groupby_multi_agg",
    f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean, median(l_quantity) AS l_quantity_median,
    min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, round(stddev_samp(l_quantity), 6) AS l_quantity_std, round(var_samp(l_quantity), 6) AS l_quantity_var,
    count(l_quantity) AS l_quantity_count, arg_min(l_quantity, ({", ".join(LINE)})) AS l_quantity_first, arg_max(l_quantity, ({", ".join(LINE)})) AS l_quantity_last
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def groupby_multi_agg(t):
    names = ["sum", "mean", "median", "min", "max", "std", "var", "count", "first", "last"]
    out = Frame(t.lineitem, LINE).group_by(["l_returnflag", "l_linestatus"]).agg({"l_quantity": names})
    return out.withColumns({c: F.round(c, d) for c, d in (("l_quantity_sum", 2), ("l_quantity_mean", 6), ("l_quantity_std", 6), ("l_quantity_var", 6))})


@query("groupby_single_agg", "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS c_acctbal FROM customer GROUP BY c_mktsegment")
def groupby_single_agg(t):
    return Frame(t.customer).group_by("c_mktsegment").agg({"c_acctbal": "mean"}).withColumn("c_acctbal", F.round("c_acctbal", 6))


for _fn, _sql in (("sum", "round(sum(value), 4)"), ("mean", "round(avg(value), 6)"), ("median", "round(median(value), 6)"), ("min", "min(value)"), ("max", "max(value)"), ("std", "round(stddev_samp(value), 6)"), ("var", "round(var_samp(value), 4)")):

    def _grouped(t, name=_fn):
        g = Frame(t.events.select("event_type", "value")).group_by("event_type")
        digits = {"sum": 4, "var": 4}.get(name, 6)
        return getattr(g, name)().withColumn("value", F.round("value", digits) if name not in ("min", "max") else F.col("value"))

    query(f"groupby_{_fn}", f"SELECT event_type, {_sql} AS value FROM events GROUP BY event_type")(_grouped)


@query("groupby_count", "SELECT event_type, count(event_id) AS event_id, count(value) AS value FROM events GROUP BY event_type")
def groupby_count(t):
    return Frame(t.events.select("event_type", "event_id", "value")).group_by("event_type").count()


@query("value_counts", 'SELECT event_type, count(*) AS "count" FROM events GROUP BY event_type')
def value_counts(t):
    return Frame(t.events, ["event_id"]).value_counts("event_type")


@query("unique_values", "SELECT DISTINCT o_orderpriority FROM orders")
def unique_values(t):
    return Frame(t.orders, ["o_orderkey"]).unique("o_orderpriority")


@query(
    "describe",
    """WITH s AS (SELECT count(l_quantity)::DOUBLE a0, avg(l_quantity) a1, stddev_samp(l_quantity) a2, min(l_quantity) a3, quantile_cont(l_quantity, 0.25) a4, quantile_cont(l_quantity, 0.5) a5, quantile_cont(l_quantity, 0.75) a6, max(l_quantity) a7,
    count(l_discount)::DOUBLE b0, avg(l_discount) b1, stddev_samp(l_discount) b2, min(l_discount) b3, quantile_cont(l_discount, 0.25) b4, quantile_cont(l_discount, 0.5) b5, quantile_cont(l_discount, 0.75) b6, max(l_discount) b7 FROM lineitem)
    SELECT unnest(['count','mean','std','min','25%','50%','75%','max']) AS metric, round(unnest([a0,a1,a2,a3,a4,a5,a6,a7]), 6) AS l_quantity, round(unnest([b0,b1,b2,b3,b4,b5,b6,b7]), 6) AS l_discount FROM s""",
)
def describe(t):
    return Frame(t.lineitem).describe(["l_quantity", "l_discount"]).withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_discount")})


@query("quantile", "SELECT round(quantile_cont(o_totalprice, 0.9), 4) AS o_totalprice FROM orders")
def quantile(t):
    return Frame(t.orders).quantile(0.9, ["o_totalprice"]).select(F.round("o_totalprice", 4).alias("o_totalprice"))


def _cells(fn, digits):
    cols = ("l_quantity", "l_extendedprice", "l_discount")
    return " UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS \"col\", round({fn}({a}, {b}), {digits}) AS \"value\" FROM lineitem" for a in cols for b in cols)


@query("corr_matrix", _cells("corr", 8))
def corr_matrix(t):
    return Frame(t.lineitem).corr(["l_quantity", "l_extendedprice", "l_discount"]).withColumn("value", F.round("value", 8))


@query("cov_matrix", _cells("covar_samp", 3))
def cov_matrix(t):
    return Frame(t.lineitem).cov(["l_quantity", "l_extendedprice", "l_discount"]).withColumn("value", F.round("value", 3))


@query("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# -- positional windows ---------------------------------------------------------------------------------------------

_LOW = "rank() OVER (ORDER BY p_size)"
_TIES = "count(*) OVER (PARTITION BY p_size)"
for _method, _sql in (("min", _LOW), ("max", f"{_LOW} + {_TIES} - 1"), ("average", f"{_LOW} + ({_TIES} - 1) / 2.0"), ("dense", "dense_rank() OVER (ORDER BY p_size)"), ("first", "row_number() OVER (ORDER BY p_size, p_partkey)")):

    def _rank(t, method=_method):
        return Frame(t.part.select("p_partkey", "p_size"), ["p_partkey"]).rank("p_size", method).select(["p_partkey", "rank"]).df

    query(f"rank_{_method}", f'SELECT p_partkey, ({_sql})::DOUBLE AS "rank" FROM part')(_rank)


def _events(t):
    return Frame(t.events.select("event_id", "user_id", "value"), ["event_id"])


@query("diff", "SELECT event_id, round(value - lag(value, 2) OVER (ORDER BY event_id), 6) AS d FROM events")
def diff(t):
    return _events(t).diff("value", 2).df.select("event_id", F.round("diff", 6).alias("d"))


@query("pct_change", "SELECT event_id, round((value - lag(value) OVER (ORDER BY event_id)) / nullif(lag(value) OVER (ORDER BY event_id), 0), 4) AS d FROM events")
def pct_change(t):
    return _events(t).pct_change("value").df.select("event_id", F.round("pct_change", 4).alias("d"))


@query("shift", "SELECT event_id, lead(value, 3) OVER (ORDER BY event_id) AS shifted FROM events")
def shift(t):
    return _events(t).shift("value", -3).select(["event_id", "shifted"]).df


@query("rolling_mean", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) >= 5 THEN round(avg(value) OVER (ORDER BY event_id ROWS 4 PRECEDING), 6) END AS m FROM events")
def rolling_mean(t):
    return _events(t).rolling_mean("value", 5).df.select("event_id", F.round("rolling_mean", 6).alias("m"))


@query("cumsum", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 3) AS s FROM events")
def cumsum(t):
    return _events(t).cumsum("value").df.select("event_id", F.round("cumsum", 3).alias("s"))


@query("cummax", "SELECT event_id, max(value) OVER (ORDER BY event_id) AS cummax FROM events")
def cummax(t):
    return _events(t).cummax("value").select(["event_id", "cummax"]).df


@query("cummin", "SELECT event_id, min(value) OVER (ORDER BY event_id) AS cummin FROM events")
def cummin(t):
    return _events(t).cummin("value").select(["event_id", "cummin"]).df


@query("cumprod", "SELECT n_nationkey, round(exp(sum(ln(1 + n_nationkey / 100.0)) OVER (ORDER BY n_nationkey)), 6) AS p FROM nation")
def cumprod(t):
    f = Frame(t.nation.select("n_nationkey", (1 + F.col("n_nationkey") / 100.0).alias("x")), ["n_nationkey"])
    return f.cumprod("x").df.select("n_nationkey", F.round("cumprod", 6).alias("p"))


@query("cumsum_by_user", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS s FROM events")
def cumsum_by_user(t):
    return _events(t).cumsum("value", partition_by=["user_id"]).df.select("event_id", F.round("cumsum", 4).alias("s"))


# -- reshaping ------------------------------------------------------------------------------------------------------


@query(
    "pivot",
    """SELECT o_orderstatus, max(CASE WHEN o_orderpriority = '1-URGENT' THEN n END) AS "1-URGENT", max(CASE WHEN o_orderpriority = '5-LOW' THEN n END) AS "5-LOW"
    FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus""",
)
def pivot(t):
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return Frame(counts).pivot("o_orderstatus", "o_orderpriority", "n", ["1-URGENT", "5-LOW"])


@query("melt", "SELECT l_orderkey, 'l_discount' AS variable, l_discount AS \"value\" FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', l_tax FROM lineitem")
def melt(t):
    return Frame(t.lineitem.select("l_orderkey", "l_discount", "l_tax")).melt(["l_orderkey"], ["l_discount", "l_tax"])


@query("sample_n", "SELECT 100 AS n, 100 AS found, true AS same FROM region LIMIT 1")
def sample_n(t):
    """As many different rows of the table as asked for, the same at another partitioning."""
    orders = t.orders.select("o_orderkey", "o_totalprice")
    taken = Frame(orders, ["o_orderkey"]).sample(100, 7).df
    again = Frame(orders.repartition(7), ["o_orderkey"]).sample(100, 7).df
    found = taken.distinct().intersect(again)
    return taken.agg(F.count("*").cast("int").alias("n")).crossJoin(found.join(orders, ["o_orderkey", "o_totalprice"]).agg(F.count("*").cast("int").alias("found"))).withColumn("same", F.col("n") == F.col("found"))
