"""Queries on functions by name, array shapes and makers, distribution functions, further statistics and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import arrays, expr, metrics, special, stats
from quillframe.plans.registry import query

E = "(embedding::DOUBLE[])"


@query("functions_scalar", "SELECT p_partkey, p_size + 2.5 AS s, p_size * 1.5 AS m, round(pow(p_size, 1.5), 6) AS p, round(exp(p_size / 100.0) - 1, 8) AS e1, round(ln(1 + p_size / 100.0), 8) AS l1, isfinite(CASE WHEN p_size % 7 = 0 THEN 'inf'::DOUBLE ELSE p_size END) AS f FROM part")
def functions_scalar(t):
    z = F.col("p_size")
    return t.part.select(
        "p_partkey", expr.add_scalar(z, 2.5).alias("s"), expr.mul_scalar(z, 1.5).alias("m"), F.round(expr.power(z, F.lit(1.5)), 6).alias("p"), F.round(expr.expm1(z / 100.0), 8).alias("e1"),
        F.round(expr.log1p(z / 100.0), 8).alias("l1"), expr.is_finite(F.when(z % 7 == 0, float("inf")).otherwise(z)).alias("f"),
    )


@query("functions_close", "SELECT l_returnflag, bool_and(abs(l_quantity - l_quantity * 1.000001) <= 1e-8 + 1e-5 * abs(l_quantity * 1.000001)) AS near, bool_and(l_quantity = round(l_quantity)) AS same, bool_and(l_tax = l_discount) AS other FROM lineitem GROUP BY 1")
def functions_close(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(expr.all_close(q, q * 1.000001).alias("near"), expr.array_equal(q, F.round(q)).alias("same"), expr.array_equal("l_tax", "l_discount").alias("other"))


@query(
    "array_shapes",
    f"""SELECT vec_id, {E}[20] AS grid, {E}[4 * 16 - 13] AS turned, 64 AS flat, {E}[3] AS lone, {E}[64] AS last, {E}[2] AS joined, {E}[1] AS stacked, {E}[17] AS part, {E}[1] AS tiled, {E}[2] AS rep,
    round({E}[1] * {E}[2] * {E}[3], 8) AS prod, list_position(list_sort({E}), {E}[1]) - 1 AS place FROM embeddings""",
)
def array_shapes(t):
    a = F.col("embedding").cast("array<double>")
    grid = arrays.reshape(a, 4, 16)
    get = lambda x, *at: get(F.get(x, at[0]), *at[1:]) if at else x
    places = arrays.argsort(a)
    return t.embeddings.select(
        "vec_id", get(grid, 1, 3).alias("grid"), get(arrays.transpose(grid, 16), 2, 3).alias("turned"), F.size(arrays.flatten(grid)).alias("flat"), get(arrays.squeeze(arrays.unsqueeze(a)), 2).alias("lone"), arrays.at(a, -1).alias("last"),
        get(arrays.concatenate(a, F.reverse(a)), 126).alias("joined"), get(arrays.stack(F.reverse(a), a), 1, 0).alias("stacked"), get(arrays.split(a, 4), 1, 0).alias("part"), get(arrays.tile(a, 3), 64).alias("tiled"),
        get(arrays.repeat(a, 3), 5).alias("rep"), F.round(get(arrays.cumprod(a), 2), 8).alias("prod"), (F.array_position(places, F.lit(0)).cast("long") - 1).alias("place"),
    )


@query(
    "array_makers",
    "SELECT " + ", ".join(f"'{[float(x) for x in v]}' AS {k}" for k, v in {"z": [0, 0], "o": [1, 1], "e": [0, 0], "f": [2.5, 2.5], "a": [0, 1, 2], "b": [1, 1.5, 2, 2.5], "l": [0, 0.25, 0.5, 0.75, 1], "lg": [1, 10, 100], "g": [1, 2, 4, 8], "x": [1.5, -2], "t": [1.5, -2]}.items()),
)
def array_makers(t):
    made = {
        "z": arrays.zeros(2), "o": arrays.ones(2), "e": arrays.empty(2), "f": arrays.full(2.5, 2), "a": arrays.arange(3), "b": arrays.arange(1, 3, 0.5), "l": arrays.linspace(0, 1, 5),
        "lg": arrays.logspace(0, 2, 3), "g": arrays.geomspace(1, 8, 4), "x": arrays.from_text(F.lit("[1.5, -2]")), "t": F.array(F.lit(1.5), F.lit(-2.0)),
    }
    return t.region.limit(1).select(*(arrays.to_text(v).alias(k) for k, v in made.items()))


@query("matrix_eye", "SELECT i, i + 1 AS j, 1.0::DOUBLE AS v FROM range(5) r(i) WHERE i < 3")
def matrix_eye(t):
    return arrays.eye(t.region.sparkSession, 5, 4, 1)


# -- sparse matrices: orders as (customer, priority) ----------------------------------------------------------------------

_COO = "(SELECT o_custkey % 50 AS i, o_orderkey % 30 AS j, sum(o_totalprice) AS v FROM orders GROUP BY ALL HAVING sum(o_totalprice) <> 0)"


def _sparse(t):
    entries = t.orders.select((F.col("o_custkey") % 50).alias("i"), (F.col("o_orderkey") % 30).alias("j"), F.col("o_totalprice").alias("v"))
    return arrays.Sparse.from_coo(entries, (50, 30))


@query("sparse_entries", f"SELECT 50 AS n_rows, 30 AS n_cols, count(*) AS nnz, round(coalesce(sum(v) FILTER (i = 3 AND j = 4), 0), 2) AS one FROM {_COO}")
def sparse_entries(t):
    m = _sparse(t)
    again = m.copy()
    return t.region.sparkSession.createDataFrame([(again.rows, again.cols, m.nnz(), round(again.get(3, 4), 2))], "n_rows int, n_cols int, nnz long, one double")


@query("sparse_dense", f"SELECT i, round(sum(v), 2) AS total, 30 AS width, round(coalesce(sum(v) FILTER (j = 7), 0), 2) AS seventh FROM {_COO} GROUP BY i")
def sparse_dense(t):
    return _sparse(t).to_dense().select("i", F.round(arrays.total("row"), 2).alias("total"), F.size("row").alias("width"), F.round(F.get("row", 7), 2).alias("seventh"))


@query("sparse_algebra", f"SELECT a.i, b.i AS j, round(sum(a.v * b.v) / 1e6 * 3, 2) AS v FROM {_COO} a JOIN {_COO} b ON a.j = b.j GROUP BY ALL HAVING sum(a.v * b.v) <> 0")
def sparse_algebra(t):
    m = _sparse(t).scale(1e-3)
    square = m.matmul(m.transpose())
    return square.add(square).add(square).df.withColumn("v", F.round("v", 2))


@query("sparse_elementwise", f"SELECT i, j, round(v * v / 1e6 - v, 2) AS v FROM {_COO}")
def sparse_elementwise(t):
    m = _sparse(t)
    return m.multiply(m).scale(1e-6).sub(m).df.withColumn("v", F.round("v", 2))


@query("sparse_matvec", f"SELECT i, round(sum(v * (j + 1)) / 1e6, 4) AS v FROM {_COO} GROUP BY i")
def sparse_matvec(t):
    x = t.region.sparkSession.range(30).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))
    return _sparse(t).matvec(x).withColumn("v", F.round(F.col("v") / 1e6, 4))


# -- distribution functions, where they have closed forms -----------------------------------------------------------------


@query(
    "distributions",
    """SELECT x::INT AS x, round(0.5 + atan(x / 2) / pi(), 10) AS t1, round(0.5 + x / 2 / (2 * sqrt(2 + x * x / 4)), 10) AS t2, round(1 - exp(-x / 2), 10) AS c2, round(1 - exp(-x / 2) * (1 + x / 2), 10) AS c4,
    round(1 - pow(1 + 2 * x / 6, -3), 10) AS f26, round(pow(x / 20, 3), 10) AS b31, round(1 - pow(1 - x / 20, 2.5), 10) AS b125, round(lgamma(x), 10) AS lg, round(1 - exp(-x), 10) AS g1 FROM (SELECT range::DOUBLE AS x FROM range(1, 20))""",
)
def distributions(t):
    made = [
        (x, special.t_cdf(x / 2, 1), special.t_cdf(x / 2, 2), special.chi2_cdf(x, 2), special.chi2_cdf(x, 4), special.f_cdf(x, 2, 6), special.regularized_beta(x / 20, 3, 1), special.regularized_beta(x / 20, 1, 2.5), special.log_gamma(x), special.regularized_gamma(1, x))
        for x in range(1, 20)
    ]
    names = ("x", "t1", "t2", "c2", "c4", "f26", "b31", "b125", "lg", "g1")
    rows = [(x, *(round(v, 10) for v in values)) for x, *values in made]
    return t.region.sparkSession.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'x' else 'double'}" for n in names))


@query("normal_distribution", "SELECT x::INT AS x, round(0.5 + (SELECT sum(exp(-((z * x / 10 / 4000) ** 2) / 2) * x / 10 / 4000) FROM (SELECT range + 0.5 AS z FROM range(4000))) / sqrt(2 * pi()), 7) AS p FROM (SELECT range::DOUBLE AS x FROM range(0, 40))")
def normal_distribution(t):
    """Against a sum of 4,000 strips under the density."""
    return t.region.sparkSession.createDataFrame([(x, round(special.normal_cdf(x / 10), 7)) for x in range(40)], "x int, p double")


# -- statistics -----------------------------------------------------------------------------------------------------


def _row(t, statistic, digits=6):
    return t.region.sparkSession.createDataFrame([(round(float(statistic), digits),)], "statistic double")


@query("percentile", "SELECT quantile_cont(o_totalprice, 0.9) AS p90, quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50 FROM orders")
def percentile(t):
    p90, p25, p50 = stats.percentiles_of(t.orders, "o_totalprice", [90, 25, 50])
    return t.region.sparkSession.createDataFrame([(p90, p25, p50)], "p90 double, p25 double, p50 double")


@query("rank_data", "SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS r FROM orders")
def rank_data(t):
    return stats.ranks(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "r").select("o_orderkey", "r")


@query(
    "kstest",
    """WITH u AS (SELECT l_tax / 0.09 AS v FROM lineitem), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM u) SELECT round(max(greatest(i / n - least(greatest(v, 0), 1), least(greatest(v, 0), 1) - (i - 1) / n)), 8) AS statistic FROM r""",
)
def kstest(t):
    d = t.lineitem.select((F.col("l_tax") / 0.09).alias("v"))
    return _row(t, stats.kstest(d, "v", lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))[0], 8)


_ERF = "sign({z}) * sqrt(1 - exp(-{z} * {z} * (4 / pi() + 0.147 * {z} * {z}) / (1 + 0.147 * {z} * {z})))"


@query("kstest_normal", f"WITH u AS (SELECT (l_quantity - 25) / 15 AS v FROM lineitem), r AS (SELECT v / sqrt(2) AS z, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM u), c AS (SELECT (1 + {_ERF.format(z='z')}) / 2 AS p, i, n FROM r) SELECT round(max(greatest(i / n - p, p - (i - 1) / n)), 8) AS statistic FROM c")
def kstest_normal(t):
    return _row(t, stats.kstest_normal(t.lineitem.select(((F.col("l_quantity") - 25) / 15).alias("v")), "v")[0], 8)


@query(
    "anderson",
    f"""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d FROM orders), r AS (SELECT (o_totalprice - m) / d / sqrt(2) AS z, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders, s),
    c AS (SELECT greatest((1 + {_ERF.format(z="z")}) / 2, 1e-300) AS p, greatest((1 - {_ERF.format(z="z")}) / 2, 1e-300) AS q, i, n FROM r) SELECT round(-max(n) - sum((2 * i - 1) * ln(p) + (2 * (n - i) + 1) * ln(q)) / max(n), 5) AS statistic FROM c""",
)
def anderson(t):
    return _row(t, stats.anderson_normal(t.orders, "o_totalprice"), 5)


@query(
    "normaltest",
    """WITH s AS (SELECT count(*)::DOUBLE AS n, avg(v) AS m FROM (SELECT c_acctbal AS v FROM customer)), c AS (SELECT max(n) AS n, avg((c_acctbal - m) ** 3) / avg((c_acctbal - m) ** 2) ** 1.5 AS g, avg((c_acctbal - m) ** 4) / avg((c_acctbal - m) ** 2) ** 2 AS k FROM customer, s),
    a AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2, (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM c), b AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w, 6 + 8 / r * (2 / r + sqrt(1 + 4 / r ** 2)) AS q FROM a),
    z AS (SELECT asinh(y / sqrt(2 / (w - 1))) / sqrt(0.5 * ln(w)) AS z1, (1 - 2 / (9 * q) - cbrt((1 - 2 / q) / (1 + x * sqrt(2 / (q - 4))))) / sqrt(2 / (9 * q)) AS z2 FROM b) SELECT round(z1 * z1 + z2 * z2, 5) AS statistic FROM z""",
)
def normaltest(t):
    return _row(t, stats.normaltest(t.customer, "c_acctbal")[0], 5)


_MARKS = ("a", "b", "c")


@query(
    "friedman",
    """WITH d AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 12 AS c FROM lineitem), r AS (SELECT [a, b, c] AS v FROM d), k AS (SELECT list_transform(v, lambda x: len(list_filter(v, lambda y: y < x)) + (len(list_filter(v, lambda y: y = x)) + 1) / 2.0) AS r,
    list_sum(list_transform(list_distinct(v), lambda x: len(list_filter(v, lambda y: y = x)) ** 3 - len(list_filter(v, lambda y: y = x)))) AS t FROM r), s AS (SELECT count(*)::DOUBLE AS n, sum(r[1]) AS x, sum(r[2]) AS y, sum(r[3]) AS z, sum(t) AS t FROM k)
    SELECT round((12 / (n * 12) * (x * x + y * y + z * z) - 12 * n) / (1 - t / (n * 24)), 4) AS statistic FROM s""",
)
def friedman(t):
    d = t.lineitem.select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 12).alias("c"))
    return _row(t, stats.friedman(d, _MARKS)[0], 4)


# -- metrics --------------------------------------------------------------------------------------------------------

GUESS = "(SELECT l_extendedprice AS y, 1000 * l_quantity AS p FROM lineitem)"


@query("adjusted_r2", f"SELECT round(1 - (sum((y - p) * (y - p)) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 3), 8) AS adjusted_r2 FROM {GUESS}")
def adjusted_r2(t):
    d = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    return d.agg(F.round(metrics.adjusted_r2("y", "p", 2), 8).alias("adjusted_r2"))


@query("precision_recall_curve", "WITH d AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), g AS (SELECT s::DOUBLE AS s, sum(y) AS p, count(*) AS n FROM d GROUP BY s) SELECT round(sum(p) OVER w / sum(n) OVER w, 8) AS precision, round(sum(p) OVER w / sum(p) OVER (), 8) AS recall, s AS threshold FROM g WINDOW w AS (ORDER BY s DESC)")
def precision_recall_curve(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return metrics.precision_recall_curve(d, "quality", "n_chars").where("threshold < double('infinity')").select(F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"), "threshold")


_P = "(SELECT label AS t, vec_id % 8 AS g FROM embeddings)"


@query(
    "v_measure",
    f"""WITH c AS (SELECT t, g, count(*)::DOUBLE AS n FROM {_P} GROUP BY ALL), z AS (SELECT sum(n) AS z FROM c), h AS (SELECT (SELECT -sum(n / z * ln(n / z)) FROM c, z) AS hc, (SELECT -sum(n / z * ln(n / z)) FROM (SELECT sum(n) AS n FROM c GROUP BY t), z) AS ha,
    (SELECT -sum(n / z * ln(n / z)) FROM (SELECT sum(n) AS n FROM c GROUP BY g), z) AS hb) SELECT round(2 * (ha + hb - hc) / (ha + hb), 8) AS v_measure FROM h""",
)
def v_measure(t):
    return metrics.clustering_scores(t.embeddings.select("label", (F.col("vec_id") % 8).alias("guess")), "label", "guess").select(F.round("v_measure", 8).alias("v_measure"))


@query(
    "adjusted_mutual_info",
    f"""WITH c AS (SELECT t, g, count(*)::DOUBLE AS n FROM {_P} GROUP BY ALL), z AS (SELECT sum(n) AS z FROM c), a AS (SELECT t, sum(n) AS a FROM c GROUP BY t), b AS (SELECT g, sum(n) AS b FROM c GROUP BY g),
    m AS (SELECT sum(n / z * ln(z * n / (a * b))) AS m FROM c JOIN a USING (t) JOIN b USING (g), z),
    k AS (SELECT a, b, z, unnest(range(greatest(1, (a + b - z)::BIGINT), least(a, b)::BIGINT + 1))::DOUBLE AS k FROM a, b, z),
    e AS (SELECT sum(k / z * ln(z * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(z - a + 1) + lgamma(z - b + 1) - lgamma(z + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(z - a - b + k + 1))) AS e FROM k),
    h AS (SELECT (SELECT -sum(a / z * ln(a / z)) FROM a, z) AS ha, (SELECT -sum(b / z * ln(b / z)) FROM b, z) AS hb) SELECT round((m - e) / ((ha + hb) / 2 - e), 7) AS statistic FROM m, e, h""",
)
def adjusted_mutual_info(t):
    return _row(t, metrics.adjusted_mutual_info(t.embeddings.select("label", (F.col("vec_id") % 8).alias("guess")), "label", "guess"), 7)


_AXES = [f"x{i}" for i in range(64)]
_MOMENTS = ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS m{i}" for i in range(64))


def _axes(t):
    return t.embeddings.select("vec_id", "label", *(F.get("embedding", i).cast("double").alias(x) for i, x in enumerate(_AXES)))


@query(
    "davies_bouldin",
    f"""WITH m AS (SELECT label, {_MOMENTS} FROM embeddings GROUP BY label), d AS (SELECT e.label, avg(sqrt({" + ".join(f"(embedding[{i + 1}]::DOUBLE - m{i}) ** 2" for i in range(64))})) AS s FROM embeddings e JOIN m ON e.label = m.label GROUP BY e.label),
    r AS (SELECT a.label, max((p.s + q.s) / sqrt({" + ".join(f"(a.m{i} - b.m{i}) ** 2" for i in range(64))})) AS r FROM m a JOIN m b ON a.label <> b.label JOIN d p ON p.label = a.label JOIN d q ON q.label = b.label GROUP BY a.label) SELECT round(avg(r), 6) AS statistic FROM r""",
)
def davies_bouldin(t):
    return _row(t, metrics.davies_bouldin(_axes(t), _AXES, "label"))


@query(
    "calinski_harabasz",
    f"""WITH m AS (SELECT label, {_MOMENTS} FROM embeddings GROUP BY label), w AS (SELECT sum({" + ".join(f"(embedding[{i + 1}]::DOUBLE - m{i}) ** 2" for i in range(64))}) AS w FROM embeddings e JOIN m ON e.label = m.label),
    t AS (SELECT count(*) AS n, count(DISTINCT label) AS k, count(*) * ({" + ".join(f"var_pop(embedding[{i + 1}]::DOUBLE)" for i in range(64))}) AS t FROM embeddings) SELECT round(((t - w) / (k - 1)) / (w / (n - k)), 6) AS statistic FROM t, w""",
)
def calinski_harabasz(t):
    return _row(t, metrics.calinski_harabasz(_axes(t), _AXES, "label"))


@query("classification_report", f"SELECT t::VARCHAR AS label, count(*) AS support FROM {_P} GROUP BY 1 UNION ALL SELECT lines, n FROM (SELECT 'lines' AS lines, 1 + count(DISTINCT x) AS n FROM (SELECT t AS x FROM {_P} UNION SELECT g FROM {_P}))")
def classification_report(t):
    text = metrics.report(t.embeddings.select("label", (F.col("vec_id") % 8).cast("int").alias("guess")), "label", "guess").splitlines()
    rows = [(line.split()[0], int(line.split()[-1])) for line in text[1:] if int(line.split()[-1])]
    return t.region.sparkSession.createDataFrame([*rows, ("lines", len(text))], "label string, support long")

