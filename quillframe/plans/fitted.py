"""Queries on fitted models, encoders, splits and dense algebra, each against SQL that takes the same steps or has the closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillframe.ml import linalg, linear, models, prep
from quillframe.plans.registry import query

N = 64
XS = [f"x{i}" for i in range(N)]


def _points(t):
    return t.embeddings.select("vec_id", "label", *(F.get("embedding", i).cast("double").alias(x) for i, x in enumerate(XS)))


# -- linear models by gradient steps --------------------------------------------------------------------------------------


def _descent(target, slope, steps, rate=0.1, result="(list_dot_product(w, e) + b >= 0)::INT"):
    """Steps from zero, one pair of subqueries each: every row's slope, then the weights without their mean gradient and penalty."""
    parts = [
        f"p AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, ({target})::DOUBLE AS y FROM embeddings)",
        f"w0 AS (SELECT list_transform(range({N}), lambda i: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b)",
    ]
    for k in range(steps):
        parts += [
            f"s{k} AS MATERIALIZED (SELECT e, {slope} AS s FROM (SELECT e, y, list_dot_product(w, e) + b AS z FROM p, w{k}))",
            f"g{k} AS (SELECT i, avg(s * x) AS g FROM (SELECT s, unnest(e) AS x, unnest(range({N})) AS i FROM s{k}) GROUP BY i)",
            f"w{k + 1} AS MATERIALIZED (SELECT list(v - {rate} * (g + v) ORDER BY i) AS w, any_value(b) - {rate} * (SELECT avg(s) FROM s{k}) AS b FROM (SELECT unnest(w) AS v, unnest(range({N})) AS i, b FROM w{k}) JOIN g{k} USING (i))",
        ]
    return f"WITH {', '.join(parts)} SELECT vec_id, {result} AS prediction FROM p, w{steps}"


def _two(t):
    return _points(t).withColumn("y", (F.col("label") < 4).cast("int"))


@query("logistic_regression", _descent("label < 4", "1 / (1 + exp(-z)) - y", 5, result="round(1 / (1 + exp(-(list_dot_product(w, e) + b))), 8)"))
def logistic_regression(t):
    d = _two(t)
    return linear.LogisticRegression(XS, "y", max_iter=5, tol=0.0).fit(d).predict_proba(d, "prediction").select("vec_id", F.round("prediction", 8).alias("prediction"))


@query("linear_svc", _descent("label < 4", "CASE WHEN (2 * y - 1) * z < 1 THEN 1 - 2 * y ELSE 0 END", 5))
def linear_svc(t):
    d = _two(t)
    return linear.LinearSVC(XS, "y", max_iter=5, tol=0.0).fit(d).predict(d).select("vec_id", "prediction")


@query("linear_svr", _descent("label / 10", "CASE WHEN abs(z - y) > 0.1 THEN sign(z - y) ELSE 0 END", 5, result="round(list_dot_product(w, e) + b, 8)"))
def linear_svr(t):
    d = _points(t).withColumn("y", F.col("label") / 10)
    return linear.LinearSVR(XS, "y", max_iter=5, tol=0.0).fit(d).predict(d).select("vec_id", F.round("prediction", 8).alias("prediction"))


# -- trees of one cut -------------------------------------------------------------------------------------------------


def _stump(target, of_side):
    """The cut of l_quantity that lowers the variance most (for 0 and 1 also the Gini index), and a value for each side."""
    return f"""WITH d AS (SELECT l_quantity AS q, ({target})::DOUBLE AS y FROM lineitem), v AS (SELECT q, count(*)::DOUBLE AS n, sum(y) AS s FROM d GROUP BY q),
    c AS (SELECT q, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER () AS nn, sum(s) OVER () AS ss FROM v WINDOW w AS (ORDER BY q)),
    best AS (SELECT q, s / n AS low, (ss - s) / (nn - n) AS high FROM c WHERE n < nn ORDER BY s * s / n + (ss - s) * (ss - s) / (nn - n) DESC LIMIT 1)
    SELECT l_orderkey, l_linenumber, l_partkey, {of_side.format(side="CASE WHEN l_quantity <= q THEN low ELSE high END")} AS prediction FROM lineitem, best"""


_CLASS, _VALUE = "(({side}) > 0.5)::INT::DOUBLE", "round({side}, 4)"


def _tree(t, kind, task, **options):
    y = (F.col("l_extendedprice") > 40_000).cast("double") if task == "classifier" else F.col("l_extendedprice")
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", y.alias("y"))
    out = models.Trees(["l_quantity"], "y", kind, task, maxDepth=1, maxBins=64, **options).fit(d).predict(d)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 4).alias("prediction"))


for _kind, _options in (("tree", {}), ("forest", {"numTrees": 3, "bootstrap": False, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}), ("boosting", {"maxIter": 1})):
    for _task, _sql in (("classifier", _stump("l_extendedprice > 40000", _CLASS)), ("regressor", _stump("l_extendedprice", _VALUE))):
        query(f"{_kind}_{_task}", _sql)(lambda t, kind=_kind, task=_task, options=_options: _tree(t, kind, task, **options))


# -- neighbours, clusters, components ---------------------------------------------------------------------------------


@query(
    "knn_classify",
    """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id, b.label, list_distance(a.e, b.e) AS d FROM p a, p b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0),
    n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) <= 5), v AS (SELECT vec_id, label, sum(1 / (d + 1e-10)) AS w FROM n GROUP BY ALL) SELECT vec_id, arg_max(label, w) AS prediction FROM v GROUP BY vec_id""",
)
def knn_classify(t):
    p = _points(t)
    return models.KNeighborsClassifier(XS, "label", 5, weights="distance").fit(p.where("vec_id % 100 <> 0")).predict(p.where("vec_id % 100 = 0"), "vec_id")


def _lloyd(steps, k=4):
    parts = ["p AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)", f"c0 AS (SELECT vec_id AS i, e AS c FROM p WHERE vec_id < {k})"]
    nearest = "SELECT vec_id, e, arg_min(i, struct_pack(d := d, i := i)) AS i FROM (SELECT vec_id, e, i, list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) ** 2)) AS d FROM p, c{n}) GROUP BY ALL"
    for n in range(steps):
        parts.append(f"n{n} AS MATERIALIZED ({nearest.format(n=n)})")
        mean = f"SELECT i, list(m ORDER BY j) AS c FROM (SELECT i, j, avg(x) AS m FROM (SELECT i, unnest(e) AS x, unnest(range({N})) AS j FROM n{n}) GROUP BY i, j) GROUP BY i"
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT i, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN ({mean}) m USING (i))")
    return f"WITH {', '.join(parts)} SELECT vec_id, i::INT AS cluster FROM ({nearest.format(n=steps)})"


@query("kmeans", _lloyd(6))
def kmeans(t):
    p = _points(t)
    start = np.array([[r[x] for x in XS] for r in p.where("vec_id < 4").orderBy("vec_id").collect()])
    return models.KMeans(XS, 4, max_iter=6, tol=0.0).fit(p, start).predict(p).select("vec_id", "cluster")


_EPS = 0.8


@query(
    "dbscan",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM p a, p b WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) ** 2)) <= {_EPS**2}),
    k AS MATERIALIZED (SELECT a AS c FROM n GROUP BY a HAVING count(*) >= 4), l AS MATERIALIZED (SELECT a, b FROM n WHERE a IN (SELECT c FROM k) AND b IN (SELECT c FROM k)),
    r AS (SELECT c, c AS m FROM k UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.c), m AS (SELECT c, min(m) AS m FROM r GROUP BY c), j AS (SELECT n.a, min(m.m) AS m FROM n JOIN m ON n.b = m.c GROUP BY n.a)
    SELECT vec_id, coalesce(m, -1) AS cluster FROM p LEFT JOIN j ON vec_id = a""",
)
def dbscan(t):
    return models.DBSCAN(XS, _EPS, 4).fit_predict(_points(t), "vec_id")


@query("pca_roundtrip", "SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS x{i}" for i in range(N)) + " FROM embeddings")
def pca_roundtrip(t):
    """All axes are a rotation: projected and turned back, a row is what it was."""
    p = _points(t)
    m = models.PCA(XS, whiten=True).fit(p)
    return m.inverse_transform(m.transform(p).drop(*XS)).select("vec_id", *(F.round(x, 6).alias(x) for x in XS))


@query("pca_transform", "SELECT range::INT AS axis, 0.0::DOUBLE AS mixed, 0.0::DOUBLE AS off, true AS descending FROM range(8)")
def pca_transform(t):
    """The projections on an axis are uncorrelated with those on the next and spread as their variance says, which no axis exceeds that comes later."""
    m = models.PCA(XS, 9).fit(_points(t))
    d = m.transform(_points(t))
    row = d.agg(*(F.covar_samp(f"pc{k}", f"pc{k + 1}").alias(f"c{k}") for k in range(8)), *(F.var_samp(f"pc{k}").alias(f"v{k}") for k in range(9))).first()
    rows = [(k, abs(round(row[f"c{k}"], 8)), abs(round(row[f"v{k}"] - float(m.explained_variance[k]), 8)), bool(row[f"v{k}"] >= row[f"v{k + 1}"])) for k in range(8)]
    return d.sparkSession.createDataFrame(rows, "axis int, mixed double, off double, descending boolean")


# -- dense algebra on the covariance of two columns -------------------------------------------------------------------------

_G = """g AS (SELECT var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS d FROM (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)),
e AS (SELECT *, a * d - b * b AS det, (a + d) / 2 AS m, sqrt((a - d) * (a - d) / 4 + b * b) AS r FROM g)"""
_ALGEBRA = {
    "det": "det", "logdet": "ln(abs(det))", "sign": "sign(det)::DOUBLE", "inv0": "d / det", "inv1": "-b / det", "solve0": "(d - 2 * b) / det", "solve1": "(2 * a - b) / det", "chol0": "sqrt(a)", "chol1": "b / sqrt(a)", "chol2": "sqrt(d - b * b / a)",
    "low": "m - r", "high": "m + r", "s0": "m + r", "s1": "m - r", "qr0": "sqrt(a * a + b * b)", "qr1": "abs(det) / sqrt(a * a + b * b)", "lu": "CASE WHEN abs(a) >= abs(b) THEN d - b * b / a ELSE b - a * d / b END",
    "cond": "(m + r) / (m - r)", "trace": "a + d", "fro": "sqrt(a * a + 2 * b * b + d * d)", "pinv": "d / det", "rank": "2.0", "tri0": "1 / a", "tri1": "(2 - b / a) / d", "lst": "(a + 2 * b) / (a * a + b * b)",
}


@query("linear_algebra", f"WITH {_G} SELECT " + ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in _ALGEBRA.items()) + " FROM e")
def linear_algebra(t):
    n, _, c = linear.gram(t.lineitem.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")), ["x", "y"])
    g, rhs = c / n, np.array([1.0, 2.0])
    inv, chol, low, s, (_, r) = linalg.inv(g), linalg.cholesky(g), linalg.eigvalsh(g), linalg.svd(g)[1], linalg.qr(g)
    p, lower, upper = linalg.lu(g)
    if not np.allclose(p @ lower @ upper, g) or not np.allclose(np.sort(linalg.eigvals(g)), low) or not np.allclose(linalg.eig(g)[0], linalg.eigh(g)[0]):
        raise AssertionError("the factors do not give the matrix")
    x, sign = linalg.solve(g, rhs), linalg.slogdet(g)
    tri = linalg.solve_triangular(np.tril(g), rhs)
    values = {
        "det": linalg.det(g), "logdet": sign[1], "sign": sign[0], "inv0": inv[0, 0], "inv1": inv[0, 1], "solve0": x[0], "solve1": x[1], "chol0": chol[0, 0], "chol1": chol[1, 0], "chol2": chol[1, 1], "low": low[0], "high": low[1],
        "s0": s[0], "s1": s[1], "qr0": abs(r[0, 0]), "qr1": abs(r[1, 1]), "lu": upper[1, 1], "cond": linalg.cond(g), "trace": linalg.trace(g), "fro": linalg.norm(g), "pinv": linalg.pinv(g)[0, 0], "rank": linalg.matrix_rank(g),
        "tri0": tri[0], "tri1": tri[1], "lst": linalg.lstsq(g[:, :1], rhs)[0][0],
    }
    return t.region.sparkSession.createDataFrame([tuple(round(float(values[k]), 6) for k in _ALGEBRA)], ", ".join(f"{k} double" for k in _ALGEBRA))


@query("table_svd", "WITH g AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS d FROM (SELECT l_quantity AS x, l_tax * 100 AS y FROM lineitem)) SELECT round(sqrt((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b)), 4) AS s0, round(sqrt((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b)), 4) AS s1 FROM g")
def table_svd(t):
    s, _ = linalg.table_svd(t.lineitem.select(F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y")), ["x", "y"])
    return t.region.sparkSession.createDataFrame([tuple(round(float(v), 4) for v in s)], "s0 double, s1 double")


# -- transformers, encoders, splits -----------------------------------------------------------------------------------


def _balances(t):
    return t.customer.select("c_custkey", "c_acctbal")


@query(
    "quantile_transform",
    """WITH q AS (SELECT quantile_cont(c_acctbal, list_transform(range(100), lambda k: k / 99.0)) AS q FROM customer), p AS (SELECT c_custkey, c_acctbal AS v, q, len(list_filter(q, lambda x: x <= c_acctbal)) AS i FROM customer, q)
    SELECT c_custkey, round(CASE WHEN v <= q[1] THEN 0 WHEN v >= q[100] THEN 1 ELSE (i - 1 + (v - q[i]) / (q[i + 1] - q[i])) / 99 END, 8) AS c_acctbal FROM p""",
)
def quantile_transform(t):
    return prep.QuantileTransformer(["c_acctbal"], 100).fit(_balances(t)).transform(_balances(t)).withColumn("c_acctbal", F.round("c_acctbal", 8))


_POWER = "CASE WHEN x >= 0 THEN (pow(x + 1, l) - 1) / l ELSE -(pow(1 - x, 2 - l) - 1) / (2 - l) END"


def _likeliest():
    """Yeo-Johnson's exponent by grids, each around the best of the grid before."""
    parts, around = ["x AS MATERIALIZED (SELECT c_acctbal / 1000 AS x FROM customer)"], ("0.00037", 20, 0.1)
    for k in range(4):
        middle, n, step = around
        source = f", b{k - 1}" if k else ""
        grid = f"SELECT {middle} + i * {step} AS l FROM range(-{n}, {n + 1}) r(i){source}"
        parts.append(f"b{k} AS MATERIALIZED (SELECT arg_max(l, f) AS l FROM (SELECT l, -count(*) / 2.0 * ln(var_pop({_POWER})) + (l - 1) * sum(sign(x) * ln(1 + abs(x))) AS f FROM x, ({grid}) GROUP BY l))")
        around = (f"b{k}.l", 15, step / 10)
    return "WITH " + ", ".join(parts)


@query("power_transform", f"{_likeliest()}, p AS (SELECT c_custkey, {_POWER} AS y FROM (SELECT c_custkey, c_acctbal / 1000 AS x, l FROM customer, b3)) SELECT c_custkey, round((y - (SELECT avg(y) FROM p)) / (SELECT stddev_pop(y) FROM p), 2) + 0 AS c_acctbal FROM p")
def power_transform(t):
    d = _balances(t).withColumn("c_acctbal", F.col("c_acctbal") / 1000)
    return prep.PowerTransformer(["c_acctbal"]).fit(d).transform(d).withColumn("c_acctbal", F.round("c_acctbal", 2) + 0.0)


@query("ordinal_encode", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS o_orderstatus, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS o_orderpriority, o_orderstatus AS back FROM orders")
def ordinal_encode(t):
    d = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    encoder = prep.OrdinalEncoder(["o_orderstatus", "o_orderpriority"]).fit(d)
    codes = encoder.transform(d)
    back = encoder.inverse_transform(codes).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("back"))
    return codes.join(back, F.col("o_orderkey") == F.col("k")).drop("k")


@query("label_binarize", 'SELECT o_orderkey, (o_orderstatus = \'F\')::INT::DOUBLE AS "o_orderstatus_F", (o_orderstatus = \'O\')::INT::DOUBLE AS "o_orderstatus_O", (o_orderstatus = \'P\')::INT::DOUBLE AS "o_orderstatus_P" FROM orders')
def label_binarize(t):
    d = t.orders.select("o_orderkey", "o_orderstatus")
    return prep.LabelBinarizer("o_orderstatus").fit(d).transform(d)


@query("multi_label_binarize", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS tags_F, (o_orderpriority LIKE '1%')::INT AS tags_1 FROM orders")
def multi_label_binarize(t):
    return prep.multi_label_binarize(t.orders.select("o_orderkey", F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("tags")), "tags", ["F", "1"])


@query(
    "group_k_fold",
    """WITH RECURSIVE g AS (SELECT c_nationkey, n, row_number() OVER (ORDER BY n DESC, c_nationkey::VARCHAR) AS i FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)),
    r AS (SELECT 0::BIGINT AS i, -1 AS k, 0 AS fold, [0, 0, 0, 0]::BIGINT[] AS load UNION ALL SELECT g.i, c_nationkey, (f - 1)::INT, list_transform(load, lambda x, j: CASE WHEN j = f THEN x + n ELSE x END) FROM (SELECT *, list_position(load, list_min(load)) AS f FROM r) r JOIN g ON g.i = r.i + 1)
    SELECT c_custkey, fold FROM customer JOIN r ON c_nationkey = k""",
)
def group_k_fold(t):
    return prep.group_k_fold(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", 4).select("c_custkey", "fold")


@query("leave_one_out", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS fold FROM customer")
def leave_one_out(t):
    return prep.leave_one_out(t.customer.select("c_custkey"), ["c_custkey"]).select("c_custkey", "fold")


@query("leave_p_out", "SELECT a.i::INT AS a, b.i::INT AS b, c.i::INT AS c FROM range(7) a(i), range(7) b(i), range(7) c(i) WHERE a.i < b.i AND b.i < c.i")
def leave_p_out(t):
    return t.region.sparkSession.createDataFrame(prep.leave_p_out(7, 3), "a int, b int, c int")


# -- scalers with their ways back and options ---------------------------------------------------------------------------


@query("scale_inverse", "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer")
def scale_inverse(t):
    d = _balances(t)
    for make in (prep.StandardScaler, prep.MinMaxScaler, prep.MaxAbsScaler, prep.RobustScaler):
        scaler = make(["c_acctbal"]).fit(d)
        d = scaler.inverse_transform(scaler.transform(d))
    return d.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("normalize_norms", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / (l_quantity + l_tax), 8) AS l1, round(l_tax / greatest(l_quantity, l_tax), 8) AS top FROM lineitem")
def normalize_norms(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    one = prep.normalize(t.lineitem.select(*keys, "l_quantity", "l_tax", F.col("l_quantity").alias("q"), F.col("l_tax").alias("x")), ["l_quantity", "l_tax"], "l1")
    both = prep.normalize(one, ["q", "x"], "max")
    return both.select(*keys, F.round("l_quantity", 8).alias("l1"), F.round("x", 8).alias("top"))
