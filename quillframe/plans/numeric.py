"""Queries on element-wise functions, arrays, statistics, metrics and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import arrays, expr, metrics, stats
from quillframe.ml import prep
from quillframe.plans.registry import query

X, Y = "(l_quantity - 25)", "(l_discount - 0.05)"


def _lines(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return t.lineitem.select(*keys, (F.col("l_quantity") - 25).alias("x"), (F.round(F.col("l_discount") * 100) - 5).alias("y"))


LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 25 AS x, round(l_discount * 100) - 5 AS y FROM lineitem)"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(
    "math_arithmetic",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, x + y AS a, x - y AS s, x * y AS m, round(CASE WHEN y <> 0 THEN x / y END, 6) AS d, CASE WHEN y <> 0 THEN floor(x / y) END AS fd,
    CASE WHEN y <> 0 THEN round(x - floor(x / y) * y, 6) END AS md, -x AS n, abs(x) AS ab, sign(x)::DOUBLE AS sg, greatest(x, y) AS mx, least(x, y) AS mn FROM (SELECT * REPLACE (x + 0.5 AS x) FROM {LINES})""",
)
def math_arithmetic(t):
    some = lambda c: F.when(F.col("y") != 0, c)
    return _lines(t).withColumn("x", F.col("x") + 0.5).select(  # no zero, whose sign engines round away differently
        *KEYS, expr.add("x", "y").alias("a"), expr.sub("x", "y").alias("s"), expr.mul("x", "y").alias("m"), F.round(some(expr.div("x", "y")), 6).alias("d"), some(expr.floor_div("x", "y")).alias("fd"),
        F.round(some(expr.mod("x", "y")), 6).alias("md"), expr.neg("x").alias("n"), expr.absolute("x").alias("ab"), expr.sign("x").alias("sg"), expr.maximum("x", "y").alias("mx"), expr.minimum("x", "y").alias("mn"),
    )


@query("math_ieee", f"SELECT y = 0 AS zero, count(*) AS n, sum(CASE WHEN y = 0 AND x <> 0 THEN 1 ELSE 0 END)::BIGINT AS infinite, sum(CASE WHEN y = 0 AND x = 0 THEN 1 ELSE 0 END)::BIGINT AS undefined FROM {LINES} GROUP BY 1")
def math_ieee(t):
    q = expr.div("x", "y")
    return _lines(t).groupBy((F.col("y") == 0).alias("zero")).agg(F.count("*").alias("n"), F.sum(expr.is_inf(q).cast("long")).alias("infinite"), F.sum(expr.is_nan(q).cast("long")).alias("undefined"))


@query(
    "math_functions",
    """SELECT p_partkey, round(exp(p_size / 50.0), 8) AS e, round(ln(p_size), 8) AS l, round(sqrt(p_size), 8) AS s, p_size * p_size AS q, round(1 / sqrt(p_size), 8) AS rs, round(cbrt(p_size), 8) AS c,
    round(pow(2, p_size / 10.0), 6) AS e2, round(log2(p_size), 8) AS l2, round(log10(p_size), 8) AS l10, floor(p_retailprice) AS fl, ceil(p_retailprice) AS ce, floor(p_retailprice + 0.5) AS ro, trunc(p_retailprice) AS tr, round(1 / p_size::DOUBLE, 8) AS rc FROM part""",
)
def math_functions(t):
    z, r = F.col("p_size"), "p_retailprice"
    rounded = {"e": expr.exp(z / 50.0), "l": expr.log(z), "s": expr.sqrt(z), "rs": expr.rsqrt(z), "c": expr.cbrt(z), "l2": expr.log2(z), "l10": expr.log10(z), "rc": expr.reciprocal(z)}
    return t.part.select(
        "p_partkey", *(F.round(v, 8).alias(k) for k, v in rounded.items()), expr.square(z).alias("q"), F.round(expr.exp2(z / 10.0), 6).alias("e2"),
        expr.floor(r).alias("fl"), expr.ceil(r).alias("ce"), expr.round_half_up(r).alias("ro"), expr.trunc(r).alias("tr"),
    )


TRIG = ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh")


@query("math_trigonometry", "SELECT p_partkey, " + ", ".join(f"round({f}(p_size / 60.0), 8) AS {f}" for f in TRIG) + ", round(acosh(1 + p_size / 60.0), 8) AS acosh, round(atan2(p_size, p_retailprice), 8) AS atan2 FROM part")
def math_trigonometry(t):
    x = F.col("p_size") / 60.0
    return t.part.select("p_partkey", *(F.round(getattr(expr, f)(x), 8).alias(f) for f in TRIG), F.round(expr.acosh(x + 1), 8).alias("acosh"), F.round(expr.atan2("p_size", "p_retailprice"), 8).alias("atan2"))


@query(
    "activations",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-y)), 8) AS sigmoid, greatest(y, 0.0) AS relu, round(CASE WHEN y > 0 THEN y ELSE 0.01 * y END, 8) AS leaky, round(CASE WHEN y > 0 THEN y ELSE exp(y) - 1 END, 8) AS elu,
    round(0.5 * y * (1 + tanh(0.7978845608028654 * (y + 0.044715 * y * y * y))), 8) AS gelu, round(ln(1 + exp(y)), 8) AS softplus, round(y / (1 + exp(-y)), 8) AS swish, round(y * tanh(ln(1 + exp(y))), 8) AS mish FROM {LINES}""",
)
def activations(t):
    made = {"sigmoid": expr.sigmoid, "leaky": expr.leaky_relu, "elu": expr.elu, "gelu": expr.gelu, "softplus": expr.softplus, "swish": expr.swish, "mish": expr.mish}
    return _lines(t).select(*KEYS, expr.relu("y").alias("relu"), *(F.round(f("y"), 8).alias(k) for k, f in made.items()))


@query(
    "comparisons",
    f"SELECT x = y AS eq, x <> y AS ne, x > y AS gt, x >= y AS ge, x < y AS lt, x <= y AS le, abs(x - y) <= 1 + 0.1 * abs(y) AS close, x <> 0 AND y <> 0 AS both, x <> 0 OR y <> 0 AS either, (x <> 0) <> (y <> 0) AS one, x = 0 AS neither, count(*) AS n FROM {LINES} GROUP BY ALL",
)
def comparisons(t):
    made = {
        "eq": expr.equal, "ne": expr.not_equal, "gt": expr.greater, "ge": expr.greater_equal, "lt": expr.less, "le": expr.less_equal,
        "close": lambda a, b: expr.is_close(a, b, 0.1, 1.0), "both": expr.logical_and, "either": expr.logical_or, "one": expr.logical_xor, "neither": lambda a, b: expr.logical_not(a),
    }
    return _lines(t).select(*(f("x", "y").alias(k) for k, f in made.items())).groupBy(*made).agg(F.count("*").alias("n"))


# -- arrays -----------------------------------------------------------------------------------------------------------

E = "(embedding::DOUBLE[])"


@query(
    "array_reductions",
    f"""SELECT vec_id, round(list_sum({E}), 6) AS s, round(list_avg({E}), 8) AS m, list_min({E}) AS lo, list_max({E}) AS hi, round(list_median({E}), 8) AS md, round(list_var_pop({E}), 8) AS v, round(list_stddev_samp({E}), 8) AS sd,
    list_position({E}, list_max({E})) - 1 AS am FROM embeddings""",
)
def array_reductions(t):
    a = "embedding"
    return t.embeddings.select(
        "vec_id", F.round(arrays.total(a), 6).alias("s"), F.round(arrays.mean(a), 8).alias("m"), arrays.smallest(a).alias("lo"), arrays.largest(a).alias("hi"), F.round(arrays.median(a), 8).alias("md"),
        F.round(arrays.variance(a), 8).alias("v"), F.round(arrays.std(a, 1), 8).alias("sd"), arrays.arg_extreme(a, True).alias("am"),
    )


@query(
    "array_products",
    f"""SELECT vec_id, round(list_dot_product({E}, list_reverse({E})), 8) AS d, round(sqrt(list_dot_product({E}, {E})), 8) AS n2, round(list_sum(list_transform({E}, lambda x: abs(x))), 6) AS n1, round(list_cosine_similarity({E}, list_reverse({E})), 8) AS c FROM embeddings""",
)
def array_products(t):
    a, b = F.col("embedding"), F.reverse("embedding")
    return t.embeddings.select("vec_id", F.round(arrays.dot(a, b), 8).alias("d"), F.round(arrays.norm(a), 8).alias("n2"), F.round(arrays.norm(a, 1), 6).alias("n1"), F.round(arrays.cosine(a, b), 8).alias("c"))


@query("softmax", f"SELECT vec_id, round(exp({E}[1]) / list_sum(list_transform({E}, lambda x: exp(x))), 8) AS p0, round({E}[2] - ln(list_sum(list_transform({E}, lambda x: exp(x)))), 8) AS l1 FROM embeddings")
def softmax(t):
    return t.embeddings.select("vec_id", F.round(F.get(arrays.softmax("embedding"), 0), 8).alias("p0"), F.round(F.get(arrays.log_softmax("embedding"), 1), 8).alias("l1"))


@query(
    "array_scans",
    f"SELECT vec_id, round(list_sum({E}[1:10]), 8) AS c9, round({E}[4] - {E}[3], 8) AS d2, {E}[11] AS g, list_sort({E})[1] AS s0, len({E}[5:20]) AS n, list_reverse_sort({E})[1] AS r0 FROM embeddings",
)
def array_scans(t):
    a = "embedding"
    return t.embeddings.select(
        "vec_id", F.round(F.get(arrays.cumsum(F.slice(a, 1, 12)), 9), 8).alias("c9"), F.round(F.get(arrays.diff(a), 2), 8).alias("d2"), F.get(arrays.gather(F.col(a).cast("array<double>"), F.array(F.lit(10))), 0).alias("g"),
        F.get(arrays.sort(a), 0).alias("s0"), F.size(arrays.section(a, 4, 20)).cast("long").alias("n"), F.get(arrays.sort(a, True), 0).alias("r0"),
    )


def _long(t, low, high):
    m = t.embeddings.where((F.col("vec_id") >= low) & (F.col("vec_id") < high)).select((F.col("vec_id") - low).alias("i"), F.posexplode("embedding").alias("j", "v"))
    return m.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def _long_sql(low, high):
    return f"(SELECT vec_id - {low} AS i, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id >= {low} AND vec_id < {high})"


@query("matrix_matmul", f"SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) AS v FROM {_long_sql(0, 40)} a JOIN {_long_sql(40, 80)} b ON a.j = b.j GROUP BY ALL")
def matrix_matmul(t):
    return arrays.matmul(_long(t, 0, 40), arrays.matrix_transpose(_long(t, 40, 80))).withColumn("v", F.round("v", 6))


@query("matrix_add", f"SELECT i, j, round(sum(v), 8) AS v FROM (SELECT * FROM {_long_sql(0, 40)} UNION ALL SELECT i, j, -v FROM {_long_sql(40, 80)}) GROUP BY ALL HAVING sum(v) <> 0")
def matrix_add(t):
    return arrays.matrix_add(_long(t, 0, 40), _long(t, 40, 80), -1.0).withColumn("v", F.round("v", 8))


@query("matrix_hadamard", f"SELECT a.i, a.j, round(a.v * b.v, 10) AS v FROM {_long_sql(0, 40)} a JOIN {_long_sql(40, 80)} b ON a.i = b.i AND a.j = b.j")
def matrix_hadamard(t):
    return arrays.matrix_hadamard(_long(t, 0, 40), _long(t, 40, 80)).withColumn("v", F.round("v", 10))


@query("matrix_matvec", f"SELECT a.i, round(sum(a.v * a.j), 6) AS v FROM {_long_sql(0, 200)} a GROUP BY a.i")
def matrix_matvec(t):
    x = t.embeddings.sparkSession.range(64).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    return arrays.matvec(_long(t, 0, 200), x).withColumn("v", F.round("v", 6))


@query("matrix_trace", f"SELECT round(sum(v), 8) AS trace FROM {_long_sql(0, 64)} WHERE i = j")
def matrix_trace(t):
    return arrays.matrix_trace(_long(t, 0, 64)).select(F.round("trace", 8).alias("trace"))


# -- statistics -----------------------------------------------------------------------------------------------------


@query(
    "stats_summary",
    """WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem)
    SELECT round(avg(l_quantity), 8) AS mean, median(l_quantity) AS median, round(stddev_pop(l_quantity), 8) AS std, round(var_pop(l_quantity), 8) AS var,
    round(avg(pow(l_quantity - m, 3)) / pow(var_pop(l_quantity), 1.5), 6) AS skew, round(kurtosis_pop(l_quantity), 6) AS kurt, round(exp(avg(ln(l_quantity))), 6) AS gmean, round(count(*) / sum(1 / l_quantity), 6) AS hmean, quantile_cont(l_quantity, 0.1) AS q FROM lineitem, m""",
)
def stats_summary(t):
    v = "l_quantity"
    median, q = (F.lit(x).cast("double") for x in stats.quantiles_of(t.lineitem, v, [0.5, 0.1]))
    return t.lineitem.agg(
        F.round(stats.mean(v), 8).alias("mean"), median.alias("median"), F.round(stats.std(v), 8).alias("std"), F.round(stats.variance(v), 8).alias("var"), F.round(stats.skewness(v), 6).alias("skew"),
        F.round(stats.kurtosis(v), 6).alias("kurt"), F.round(stats.geometric_mean(v), 6).alias("gmean"), F.round(stats.harmonic_mean(v), 6).alias("hmean"), q.alias("q"),
    )


@query("stats_mode", "SELECT l_quantity AS mode FROM lineitem GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1")
def stats_mode(t):
    return t.lineitem.agg(stats.mode("l_quantity").alias("mode"))


@query("stats_moment", "SELECT round(avg(pow(l_quantity - m, 4)), 4) AS moment FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)")
def stats_moment(t):
    return stats.moment(t.lineitem, "l_quantity", 4).select(F.round("moment", 4).alias("moment"))


@query(
    "stats_trim_mean",
    "SELECT round(avg(v), 6) AS trim_mean FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders) WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1)",
)
def stats_trim_mean(t):
    return stats.trim_mean(t.orders, "o_totalprice", 0.1).select(F.round("trim_mean", 6).alias("trim_mean"))


def _row(t, statistic, digits=6):
    return t.region.sparkSession.createDataFrame([(round(float(statistic), digits),)], "statistic double")


@query("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS statistic FROM lineitem")
def pearson(t):
    return _row(t, stats.pearson(t.lineitem, "l_quantity", "l_extendedprice")[0])


@query(
    "spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)
    SELECT round(corr(a, b), 6) AS statistic FROM r""",
)
def spearman(t):
    return _row(t, stats.spearman(t.lineitem, "l_quantity", "l_discount")[0])


GROUPS = "(SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type)"


@query("anova", f"WITH g AS {GROUPS}, t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS mm FROM g) SELECT round((sum(n * (m - mm) * (m - mm)) / (max(k) - 1)) / (sum((n - 1) * v) / (max(nn) - max(k))), 6) AS statistic FROM g, t")
def anova(t):
    return _row(t, stats.f_oneway(t.events, "value", "event_type")[0])


@query(
    "bartlett",
    f"""WITH g AS {GROUPS}, s AS (SELECT sum(n) AS nn, count(*) AS k, sum((n - 1) * v) / (sum(n) - count(*)) AS p, sum((n - 1) * ln(v)) AS l, sum(1.0 / (n - 1)) AS c FROM g)
    SELECT round(((nn - k) * ln(p) - l) / (1 + (c - 1.0 / (nn - k)) / (3 * (k - 1))), 6) AS statistic FROM s""",
)
def bartlett(t):
    return _row(t, stats.bartlett(t.events, "value", "event_type")[0])


@query(
    "ttest_welch",
    "WITH a AS (SELECT avg(o_totalprice) FILTER (o_orderstatus = 'F') m1, avg(o_totalprice) FILTER (o_orderstatus = 'O') m2, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') v1, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') v2, count(*) FILTER (o_orderstatus = 'F') n1, count(*) FILTER (o_orderstatus = 'O') n2 FROM orders) SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS statistic FROM a",
)
def ttest_welch(t):
    return _row(t, stats.ttest_ind(t.orders.where("o_orderstatus in ('F', 'O')"), "o_totalprice", "o_orderstatus", False)[0])


@query("ttest_1samp", "SELECT round((avg(l_quantity) - 25) / sqrt(var_samp(l_quantity) / count(*)), 6) AS statistic FROM lineitem")
def ttest_1samp(t):
    return _row(t, stats.ttest_1samp(t.lineitem, "l_quantity", 25.0)[0])


@query("ttest_rel", "SELECT round(avg(l_tax - l_discount) / sqrt(var_samp(l_tax - l_discount) / count(*)), 6) AS statistic FROM lineitem")
def ttest_rel(t):
    return _row(t, stats.ttest_rel(t.lineitem, "l_tax", "l_discount")[0])


@query("chisquare", "SELECT round(sum((n - m) * (n - m) / m), 6) AS statistic FROM (SELECT n, avg(n) OVER () AS m FROM (SELECT count(*) AS n FROM events GROUP BY event_type))")
def chisquare(t):
    return _row(t, stats.chisquare(t.events.groupBy("event_type").count(), "count")[0])


@query(
    "kruskal",
    """WITH r AS (SELECT event_type AS g, value AS v, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events), n AS (SELECT count(*)::DOUBLE AS n FROM r), s AS (SELECT sum(q) AS s FROM (SELECT sum(r) * sum(r) / count(*) AS q FROM r GROUP BY g)),
    t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)) SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 5) AS statistic FROM n, s, t""",
)
def kruskal(t):
    return _row(t, stats.kruskal(t.events, "value", "event_type")[0], 5)


@query("levene", """WITH m AS (SELECT event_type, median(value) AS md FROM events GROUP BY event_type), d AS (SELECT event_type AS g, abs(value - md) AS d FROM events JOIN m USING (event_type)), g AS (SELECT g, count(*) AS n, avg(d) AS m, var_samp(d) AS v FROM d GROUP BY g),
    t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS mm FROM g) SELECT round((sum(n * (m - mm) * (m - mm)) / (max(k) - 1)) / (sum((n - 1) * v) / (max(nn) - max(k))), 5) AS statistic FROM g, t""")
def levene(t):
    return _row(t, stats.levene(t.events, "value", "event_type")[0], 5)


@query(
    "mann_whitney",
    """WITH r AS (SELECT o_orderstatus AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders WHERE o_orderstatus IN ('F', 'O')), s AS (SELECT g, sum(r) - count(*) * (count(*) + 1) / 2.0 AS u FROM r GROUP BY g) SELECT round(min(u), 2) AS statistic FROM s""",
)
def mann_whitney(t):
    return _row(t, stats.mann_whitney(t.orders.where("o_orderstatus in ('F', 'O')"), "o_totalprice", "o_orderstatus")[0], 2)


@query(
    "kendall",
    """WITH p AS (SELECT p_size AS x, floor(p_retailprice / 10) AS y FROM part), s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM p a, p b), n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS n FROM p),
    tx AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT count(*) AS c FROM p GROUP BY x)), ty AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT count(*) AS c FROM p GROUP BY y)) SELECT round(s / sqrt((n - tx.t) * (n - ty.t)), 6) AS statistic FROM s, n, tx, ty""",
)
def kendall(t):
    d = t.part.select(F.col("p_size").alias("x"), F.floor(F.col("p_retailprice") / 10).alias("y"))
    return _row(t, stats.kendall(d, "x", "y")[0])


@query("wilcoxon", """WITH d AS (SELECT l_tax - l_discount AS d FROM lineitem WHERE abs(l_tax - l_discount) > 1e-9), r AS (SELECT d, rank() OVER (ORDER BY round(abs(d), 6)) + (count(*) OVER (PARTITION BY round(abs(d), 6)) - 1) / 2.0 AS r FROM d) SELECT round(sum(r) FILTER (d > 0), 2) AS statistic FROM r""")
def wilcoxon(t):
    d = t.lineitem.select(F.round(F.col("l_tax") - F.col("l_discount"), 6).alias("d"), F.lit(0.0).alias("z"))
    return _row(t, stats.wilcoxon(d, "d", "z")[0], 2)


# -- metrics --------------------------------------------------------------------------------------------------------


@query(
    "classification_scores",
    """WITH c AS (SELECT sum((quality = 1 AND toxic = 1)::INT) tp, sum((quality = 0 AND toxic = 1)::INT) fp, sum((quality = 1 AND toxic = 0)::INT) fn, sum((quality = 0 AND toxic = 0)::INT) tn FROM labels)
    SELECT round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 8) AS f2,
    round(tp / (tp + fp + fn), 8) AS jaccard, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 8) AS mcc, round((fp + fn) / (tp + fp + fn + tn), 8) AS hamming FROM c""",
)
def classification_scores(t):
    a = ("quality", "toxic")
    made = {"accuracy": metrics.accuracy(*a), "precision": metrics.precision(*a), "recall": metrics.recall(*a), "f1": metrics.fbeta(*a), "f2": metrics.fbeta(*a, 2.0), "jaccard": metrics.jaccard(*a), "mcc": metrics.matthews(*a), "hamming": metrics.hamming_loss(*a)}
    return t.labels.agg(*(F.round(v, 8).alias(k) for k, v in made.items()))


@query("confusion", "SELECT quality AS truth, toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL")
def confusion(t):
    return metrics.confusion(t.labels, "quality", "toxic")


def _clusters(t):
    return t.embeddings.select("label", (F.col("vec_id") % 8).cast("int").alias("guess"))


@query(
    "per_class_scores",
    """WITH p AS (SELECT label AS t, (vec_id % 8)::INT AS g FROM embeddings), c AS (SELECT t AS label FROM p UNION SELECT g FROM p)
    SELECT label::INT AS label, round(coalesce(sum((t = label AND g = label)::INT) / nullif(sum((g = label)::INT), 0), 0), 8) AS precision, round(coalesce(sum((t = label AND g = label)::INT) / nullif(sum((t = label)::INT), 0), 0), 8) AS recall, sum((t = label)::INT)::BIGINT AS support FROM p, c GROUP BY label""",
)
def per_class_scores(t):
    return metrics.per_class(_clusters(t), "label", "guess").select("label", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"), "support")


@query("balanced_accuracy", "SELECT round(avg(r), 8) AS balanced_accuracy FROM (SELECT avg((label = vec_id % 8)::INT) AS r FROM embeddings GROUP BY label)")
def balanced_accuracy(t):
    return metrics.balanced_accuracy(_clusters(t), "label", "guess").select(F.round("balanced_accuracy", 8).alias("balanced_accuracy"))


@query(
    "cohen_kappa",
    """WITH p AS (SELECT label AS t, vec_id % 8 AS g FROM embeddings), n AS (SELECT count(*)::DOUBLE AS n, avg((t = g)::INT) AS o FROM p), e AS (SELECT sum(a * b) AS e FROM (SELECT t, count(*)::DOUBLE AS a FROM p GROUP BY t) JOIN (SELECT g, count(*)::DOUBLE AS b FROM p GROUP BY g) ON t = g)
    SELECT round((o - e / (n * n)) / (1 - e / (n * n)), 8) AS kappa FROM n, e""",
)
def cohen_kappa(t):
    return metrics.cohen_kappa(_clusters(t), "label", "guess").select(F.round("kappa", 8).alias("kappa"))


SCORED = "(SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id))"


def _scored(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").alias("s"))


@query("roc_auc", f"WITH r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM {SCORED}) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 8) AS roc_auc FROM r")
def roc_auc(t):
    return metrics.roc_auc(_scored(t), "y", "s").select(F.round("roc_auc", 8).alias("roc_auc"))


@query("average_precision", f"WITH g AS (SELECT s, sum(y) AS p, count(*) AS n FROM {SCORED} GROUP BY s), c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS nn, sum(p) OVER () AS al FROM g) SELECT round(sum(p / al * tp / nn), 8) AS average_precision FROM c")
def average_precision(t):
    return metrics.average_precision(_scored(t), "y", "s").select(F.round("average_precision", 8).alias("average_precision"))


@query("roc_curve", f"WITH g AS (SELECT s::DOUBLE AS s, sum(y) AS p, sum(1 - y) AS q FROM {SCORED} GROUP BY s) SELECT round(sum(q) OVER (ORDER BY s DESC) / sum(q) OVER (), 8) AS fpr, round(sum(p) OVER (ORDER BY s DESC) / sum(p) OVER (), 8) AS tpr, s AS threshold FROM g")
def roc_curve(t):
    return metrics.roc_curve(_scored(t), "y", "s").where("threshold < double('infinity')").select(F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"), "threshold")


@query("log_loss", "SELECT round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 8) AS log_loss FROM (SELECT quality AS y, (1 + n_chars % 98) / 100.0 AS p FROM labels JOIN documents USING (doc_id))")
def log_loss(t):
    return _scored(t).agg(F.round(metrics.log_loss("y", (1 + F.col("s") % 98) / 100.0), 8).alias("log_loss"))


GUESS = "(SELECT l_extendedprice AS y, 1000 * l_quantity AS p FROM lineitem)"


@query(
    "regression_scores",
    f"""SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 8) AS r2, round(100 * avg(abs((y - p) / y)), 6) AS mape,
    round(median(abs(y - p)), 4) AS medae, round(max(abs(y - p)), 4) AS maxe, round(1 - var_pop(y - p) / var_pop(y), 8) AS evs FROM {GUESS}""",
)
def regression_scores(t):
    d = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    made = {"mse": (metrics.mse, 2), "rmse": (metrics.rmse, 4), "mae": (metrics.mae, 4), "r2": (metrics.r2, 8), "mape": (metrics.mape, 6), "maxe": (metrics.max_error, 4), "evs": (metrics.explained_variance, 8)}
    middle = F.lit(metrics.median_error(d, "y", "p")).cast("double")
    return d.agg(*(F.round(f("y", "p"), digits).alias(k) for k, (f, digits) in made.items())).withColumn("medae", F.round(middle, 4))


@query(
    "clustering_scores",
    """WITH p AS (SELECT label AS t, vec_id % 8 AS g FROM embeddings), c AS (SELECT t, g, count(*)::DOUBLE AS n FROM p GROUP BY ALL), a AS (SELECT t, sum(n) AS n FROM c GROUP BY t), b AS (SELECT g, sum(n) AS n FROM c GROUP BY g), z AS (SELECT sum(n) AS z FROM c),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS pc, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb, (SELECT -sum(n / z * ln(n / z)) FROM c, z) AS hc, (SELECT -sum(n / z * ln(n / z)) FROM a, z) AS ha, (SELECT -sum(n / z * ln(n / z)) FROM b, z) AS hb, z FROM z)
    SELECT round((pc - pa * pb / (z * (z - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (z * (z - 1) / 2)), 8) AS ari, round((ha + hb - hc) / ((ha + hb) / 2), 8) AS nmi, round((ha + hb - hc) / ha, 8) AS homogeneity, round((ha + hb - hc) / hb, 8) AS completeness, round(2 * (ha + hb - hc) / (ha + hb), 8) AS v_measure, round(pc / sqrt(pa * pb), 8) AS fowlkes_mallows FROM s""",
)
def clustering_scores(t):
    s = metrics.clustering_scores(_clusters(t), "label", "guess")
    return s.select(*(F.round(c, 8).alias(c) for c in ("ari", "nmi", "homogeneity", "completeness", "v_measure", "fowlkes_mallows")))


@query(
    "silhouette",
    """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT p.vec_id, p.label, q.label AS o, sum(list_distance(p.e, q.e)) AS d, count(*) AS n FROM p, p q GROUP BY ALL),
    s AS (SELECT vec_id, max(CASE WHEN label = o AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN label <> o THEN d / n END) AS b FROM d GROUP BY vec_id) SELECT vec_id, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""",
)
def silhouette(t):
    names = [f"x{i}" for i in range(64)]
    d = t.embeddings.select("vec_id", "label", *(F.get("embedding", i).cast("double").alias(x) for i, x in enumerate(names)))
    return metrics.silhouette(d, names, "label", "vec_id").withColumn("silhouette", F.round("silhouette", 6))


# -- preprocessing --------------------------------------------------------------------------------------------------


def _balances(t):
    return t.customer.select("c_custkey", "c_acctbal")


for _name, _scaler, _sql in (
    ("standard", prep.StandardScaler, "(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer)"),
    ("minmax", prep.MinMaxScaler, "(c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer)"),
    ("maxabs", prep.MaxAbsScaler, "c_acctbal / (SELECT max(abs(c_acctbal)) FROM customer)"),
    ("robust", prep.RobustScaler, "(c_acctbal - (SELECT median(c_acctbal) FROM customer)) / (SELECT quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) FROM customer)"),
):

    def _scale(t, make=_scaler):
        return make(["c_acctbal"]).fit_transform(_balances(t)).withColumn("c_acctbal", F.round("c_acctbal", 8))

    query(f"scale_{_name}", f"SELECT c_custkey, round({_sql}, 8) AS c_acctbal FROM customer")(_scale)


@query("normalize_rows", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sqrt(l_quantity * l_quantity + l_tax * l_tax), 8) AS l_quantity, round(l_tax / sqrt(l_quantity * l_quantity + l_tax * l_tax), 8) AS l_tax FROM lineitem")
def normalize_rows(t):
    out = prep.normalize(t.lineitem.select(*KEYS, "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return out.withColumns({c: F.round(c, 8) for c in ("l_quantity", "l_tax")})


@query("label_encode", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment FROM customer")
def label_encode(t):
    d = t.customer.select("c_custkey", "c_mktsegment")
    return prep.LabelEncoder("c_mktsegment").fit(d).transform(d)


@query("onehot_encode", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"o_orderstatus_F\", CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"o_orderstatus_O\", CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"o_orderstatus_P\" FROM orders")
def onehot_encode(t):
    d = t.orders.select("o_orderkey", "o_orderstatus")
    return prep.OneHotEncoder(["o_orderstatus"]).fit(d).transform(d)


@query("k_fold", "SELECT doc_id, ntile(5) OVER (ORDER BY doc_id) - 1 AS fold FROM labels")
def k_fold(t):
    return prep.k_fold(t.labels.select("doc_id"), ["doc_id"], 5).select("doc_id", F.col("fold").cast("long").alias("fold"))


@query("stratified_k_fold", "SELECT doc_id, ntile(5) OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS fold FROM labels")
def stratified_k_fold(t):
    return prep.k_fold(t.labels.select("doc_id", "quality"), ["doc_id"], 5, "quality").select("doc_id", F.col("fold").cast("long").alias("fold"))


@query("train_test_split", "SELECT count(*) AS n, ceil(count(*) * 0.25)::BIGINT AS test FROM labels")
def train_test_split(t):
    return prep.train_test_split(t.labels, ["doc_id"], 0.25).agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("long")).alias("test"))
