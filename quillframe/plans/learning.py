"""Queries on learning, plot data, generated data and event-time windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillframe.functions import plotdata
from quillframe.ml import linear, models
from quillframe.plans.registry import query
from quillframe.sources import files
from quillframe.streaming import state, windows


def _row(t, **values):
    spark = t.region.sparkSession
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


@query("linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def linear_regression(t):
    m = linear.LinearRegression(["l_quantity"], "l_extendedprice").fit(t.lineitem)
    return _row(t, slope=round(m.coef[0], 4), intercept=round(m.intercept, 2))


@query(
    "ridge",
    "SELECT round(covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1000), 4) AS slope FROM lineitem",
)
def ridge(t):
    return _row(t, slope=round(linear.Ridge(["l_quantity"], "l_extendedprice", 1000.0).fit(t.lineitem).coef[0], 4))


@query("lasso", "SELECT round(sign(covar_pop(l_extendedprice, l_quantity)) * greatest(abs(covar_pop(l_extendedprice, l_quantity)) - 100, 0) / var_pop(l_quantity), 4) AS slope FROM lineitem")
def lasso(t):
    return _row(t, slope=round(linear.Lasso(["l_quantity"], "l_extendedprice", 100.0).fit(t.lineitem).coef[0], 4))


@query("linear_predict", "SELECT l_orderkey, l_linenumber, l_partkey, round(a + b * l_quantity, 2) AS prediction FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)")
def linear_predict(t):
    m = linear.LinearRegression(["l_quantity"], "l_extendedprice").fit(t.lineitem)
    return m.predict(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).drop("l_quantity").withColumn("prediction", F.round("prediction", 2))


def _points(t, n=64):
    return t.embeddings.select("vec_id", "label", *(F.get("embedding", i).cast("double").alias(f"x{i}") for i in range(n)))


XS = [f"x{i}" for i in range(64)]
POINTS = "(SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(64)) + " FROM embeddings)"


@query(
    "gaussian_nb",
    f"""WITH p AS {POINTS}, m AS (SELECT label AS k, ln(count(*) / (SELECT count(*) FROM p)::DOUBLE) AS prior, {", ".join(f"avg({x}) AS m{x}, var_pop({x}) + 1e-9 AS v{x}" for x in XS)} FROM p GROUP BY label),
    s AS (SELECT vec_id, k, prior - {" - ".join(f"(0.5 * ln(2 * pi() * v{x}) + ({x} - m{x}) * ({x} - m{x}) / (2 * v{x}))" for x in XS)} AS s FROM p, m) SELECT vec_id, arg_max(k, s) AS prediction FROM s GROUP BY vec_id""",
)
def gaussian_nb(t):
    p = _points(t)
    return models.GaussianNB(XS, "label").fit(p).predict(p).select("vec_id", "prediction")


@query(
    "kmeans_step",
    f"""WITH p AS {POINTS}, c AS (SELECT vec_id AS i, {", ".join(f"{x} AS c{x}" for x in XS)} FROM p WHERE vec_id < 4), d AS (SELECT p.*, i, {" + ".join(f"({x} - c{x}) * ({x} - c{x})" for x in XS)} AS d FROM p, c),
    n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1) SELECT i AS cluster, {", ".join(f"round(avg({x}), 8) AS {x}" for x in XS)} FROM n GROUP BY i""",
)
def kmeans_step(t):
    p = _points(t)
    start = np.array([[r[x] for x in XS] for r in p.where("vec_id < 4").orderBy("vec_id").collect()])
    m = models.KMeans(XS, 4)
    m.centres = start
    m.step(p)
    rows = [(i, *(round(float(v), 8) for v in c)) for i, c in enumerate(m.centres)]
    return p.sparkSession.createDataFrame(rows, "cluster long, " + ", ".join(f"{x} double" for x in XS))


@query(
    "knn_regress",
    f"""WITH p AS {POINTS}, d AS (SELECT a.vec_id, b.label, sqrt({" + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in XS)}) AS d FROM p a, p b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0),
    n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) <= 5) SELECT vec_id, round(avg(label), 6) AS prediction FROM n GROUP BY vec_id""",
)
def knn_regress(t):
    p = _points(t)
    m = models.KNeighborsRegressor(XS, "label", 5).fit(p.where("vec_id % 100 <> 0"))
    return m.predict(p.where("vec_id % 100 = 0"), "vec_id").withColumn("prediction", F.round("prediction", 6))


@query("pca_variance", f"WITH p AS {POINTS} SELECT round({' + '.join(f'var_samp({x})' for x in XS)}, 6) AS total FROM p")
def pca_variance(t):
    return _row(t, total=round(models.PCA(XS).fit(_points(t)).explained_variance.sum(), 6))


# -- plot data and generated data -----------------------------------------------------------------------------------


@query(
    "histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem), b AS (SELECT least(floor((l_extendedprice - lo) / w), 9)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT i::INT AS bin, round(lo + i * w, 4) AS low, coalesce(n, 0) AS n FROM range(10) r(i) CROSS JOIN e LEFT JOIN b ON bin = i""",
)
def histogram(t):
    return plotdata.histogram(t.lineitem, "l_extendedprice", 10).select("bin", F.round("low", 4).alias("low"), "n")


@query(
    "boxplot",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
    SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outside FROM events JOIN q USING (event_type) GROUP BY ALL""",
)
def boxplot(t):
    return plotdata.boxplot(t.events, "value", "event_type").withColumns({c: F.round(c, 6) for c in ("q1", "q2", "q3")})


@query("csv_typed", "SELECT 1.5::DOUBLE AS a, '01' AS b, true AS c UNION ALL SELECT NULL, 'x,y', false")
def csv_typed(t):
    raw = t.region.sparkSession.createDataFrame([("1.5", "01", "true"), ("", "x,y", "false")], "a string, b string, c string")
    return files.typed(raw)


@query("json_columns", "SELECT 1.0::DOUBLE AS a, 'x' AS b UNION ALL SELECT NULL, 'y'")
def json_columns(t):
    return files.from_json_text(t.region.sparkSession, '{"columns": ["a", "b"], "index": [0, 1], "data": {"a": [1, null], "b": ["x", "y"]}}')


# -- event time -----------------------------------------------------------------------------------------------------


@query("tumbling_window", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(t):
    out = windows.tumbling(t.events, "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.drop("end")


@query(
    "session_window",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def session_window(t):
    return windows.sessions(t.events, "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")]).drop("end")


@query("running_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def running_totals(t):
    return state.running_totals(t.events, "event_type", "value").withColumn("total", F.round("total", 4))


@query("sliding_window", """SELECT start, count(*) AS n FROM (SELECT ts, unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)]) AS start FROM events) GROUP BY start""")
def sliding_window(t):
    return windows.tumbling(t.events, "ts", "2 hours", [], [F.count("*").alias("n")], slide="1 hour").drop("end")
