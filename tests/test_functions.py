"""Distribution functions, tests, metrics and models against numbers known in closed form or from numpy."""

import math
import sys
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe import config, errors
from quillframe.functions import arrays, expr, metrics, pairwise, plotdata, special, stats
from quillframe.functions.quantiles import quantiles
from quillframe.ml import linalg, linear, models, prep
from quillframe.operators.frame import Frame
from quillframe.plans import catalogue, ordering
from quillframe.sources import files, generated


def one(df, *columns):
    return df.select(*columns).first()


def test_ieee(spark):
    d = spark.createDataFrame([(1.0, 0.0, -7.0, 3.0)], "a double, z double, m double, n double")
    r = one(d, expr.div("a", "z").alias("x"), expr.div(-1.0, "z").alias("y"), expr.mod("m", "n").alias("m"), expr.mod("n", "m").alias("k"), expr.log("z").alias("l"), expr.round_half_up(F.lit(-2.5)).alias("r"))
    assert (r.x, r.y, r.m, r.k, r.l, r.r) == (math.inf, -math.inf, 2, -4, -math.inf, -2)
    n = one(d, expr.equal(F.lit(float("nan")), F.lit(float("nan"))).alias("e"), expr.maximum(F.lit(float("nan")), "a").alias("m"), expr.div("z", "z").alias("u"))
    assert n.e is False and math.isnan(n.m) and math.isnan(n.u)


def test_distributions():
    assert special.normal_cdf(1.96) == pytest.approx(0.9750021, abs=1e-7)
    assert special.normal_cdf_closed(1.0) == pytest.approx(0.8413447, abs=2e-4)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)


def test_tests(spark):
    d = spark.createDataFrame([(float(i), 3.0 * i + (i % 2), "ab"[i % 2]) for i in range(1, 21)], "x double, y double, g string")
    assert stats.ttest_1samp(d, "x", 10.5)[0] == 0
    assert stats.ttest_1samp(d, "x", 10.5)[1] == pytest.approx(1)
    t, p = stats.ttest_ind(d, "x", "g")
    f, q = stats.f_oneway(d, "x", "g")
    assert f == pytest.approx(t * t) and p == pytest.approx(q)
    assert stats.spearman(d, "x", "y")[0] == pytest.approx(1)
    assert stats.kruskal(d, "x", "g")[1] > 0.5
    assert stats.friedman(spark.createDataFrame([(1.0, 2.0, 3.0)] * 5, "a double, b double, c double"), ["a", "b", "c"])[0] == pytest.approx(10)


def test_scores(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 0)], "t int, p int")
    assert metrics.adjusted_mutual_info(d, "t", "p") == pytest.approx(-0.25)
    assert metrics.clustering_scores(d, "t", "p").first().nmi == pytest.approx(0.3690702464285424)
    s = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert metrics.roc_auc(s, "y", "s").first()[0] == pytest.approx(0.75)
    assert metrics.average_precision(s, "y", "s").first()[0] == pytest.approx(0.8333333333)


def test_least_squares_and_gradients(spark):
    d = generated.make_regression(spark, 500, [2.0, -1.0, 0.5], 0.0)
    m = linear.LinearRegression(["x0", "x1", "x2"], "y").fit(d)
    assert m.coef == pytest.approx([2, -1, 0.5]) and m.intercept == pytest.approx(0, abs=1e-9)
    c = generated.make_classification(spark, 400, 2, 2, 4.0, 0.0)
    fitted = linear.LogisticRegression(["x0", "x1"], "label", max_iter=20).fit(c)
    assert fitted.predict(c).agg(metrics.accuracy("label", "prediction")).first()[0] > 0.95


def test_clusters(spark):
    d = generated.make_blobs(spark, 200, [[0.0, 0.0], [20.0, 20.0]], 1.0)
    k = models.KMeans(["x0", "x1"], 2).fit(d)
    assert metrics.clustering_scores(k.predict(d), "label", "cluster").first().ari == pytest.approx(1)
    found = models.DBSCAN(["x0", "x1"], 3.0, 5).fit_predict(d, "id")
    assert found.where("cluster >= 0").select("cluster").distinct().count() == 2


def test_pca_and_linear_algebra(spark):
    d = generated.make_regression(spark, 300, [1.0, 2.0], 0.5)
    x = np.array([[r.x0, r.x1, r.y] for r in d.collect()])
    p = models.PCA(["x0", "x1", "y"]).fit(d)
    assert p.explained_variance == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    a = np.array([[2.0, 1, 1], [4, 3, 3], [8, 7, 9]])
    pm, lo, up = linalg.lu(a)
    assert pm @ lo @ up == pytest.approx(a)
    assert linalg.solve_triangular(lo, lo @ [1.0, 2, 3]) == pytest.approx([1, 2, 3])


def test_scalers_invert_and_constants_survive(spark):
    d = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "v double, c double")
    for make in (prep.StandardScaler, prep.MinMaxScaler, prep.MaxAbsScaler, prep.RobustScaler):
        s = make(["v", "c"]).fit(d)
        back = s.inverse_transform(s.transform(d)).collect()
        assert [r.v for r in sorted(back)] == pytest.approx(list(range(10)))
        assert [r.c for r in back] == pytest.approx([5.0] * 10)
    with pytest.raises(Exception, match="unknown class"):
        prep.LabelEncoder("g").fit(spark.createDataFrame([("a",)], "g string")).transform(spark.createDataFrame([("b",)], "g string")).collect()


def test_csv_and_json_round_trips(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"x ""q"", y",true\n,01,false\n')
    d = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in d.collect()] == [(1.0, 'x "q", y', True), (None, "01", False)]
    again = files.from_json_text(spark, files.to_json_text(d))
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in d.collect()]
    assert files.to_csv_text(d) == 'a,b,c\n1,"x ""q"", y",true\n,01,false'


def test_generated_data_do_not_depend_on_partitions(spark):
    a = generated.make_blobs(spark, 100, [[0.0], [1.0]]).repartition(7).orderBy("id").collect()
    assert a == generated.make_blobs(spark, 100, [[0.0], [1.0]]).orderBy("id").collect()


def test_named_data_sets(spark):
    from quillframe.sources import datasets

    for name, shape in datasets.SETS.items():
        d = datasets.load(spark, name)
        assert sum(c.startswith("x") for c in d.columns) == shape.features
        assert d.count() == shape.rows
    assert datasets.load(spark, "iris").select("label").distinct().count() == 3


def test_rank_correlation_against_all_pairs(spark):
    rows = [(i * 7 % 31, i * 11 % 13) for i in range(120)]
    sign = lambda v: (v > 0) - (v < 0)
    s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(rows) for b in rows[:i])
    pairs = 120 * 119 / 2
    ties = [sum(n * (n - 1) / 2 for n in (sum(r[k] == v for r in rows) for v in {r[k] for r in rows})) for k in (0, 1)]
    tau, p = stats.kendall(spark.createDataFrame(rows, "x int, y int"), "x", "y")
    assert tau == pytest.approx(s / math.sqrt((pairs - ties[0]) * (pairs - ties[1])))
    assert 0 <= p <= 1


def test_registered_kendall_takes_every_part(spark, tmp_path):
    rows = [(i + 1, i * 7 % 31, float(i * 11 % 130)) for i in range(1300)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/region.parquet")  # results of one row start from it
    x, y = np.array([r[1] for r in rows]), np.array([r[2] // 10 for r in rows])
    s, over = [np.sign(v[:, None] - v[None, :]) for v in (x, y)], np.tril_indices(len(rows), -1)
    want = (s[0] * s[1])[over].sum() / math.sqrt(np.abs(s[0][over]).sum() * np.abs(s[1][over]).sum())
    got = catalogue.QUERIES["kendall"](spark, str(tmp_path)).first().statistic
    assert got == pytest.approx(want, abs=1e-6)


def test_kendall_over_many_buckets(spark, monkeypatch):
    rows = [(i * 7 % 61, i * 11 % 23) for i in range(300)]
    few = stats.kendall(spark.createDataFrame(rows, "x int, y int"), "x", "y")
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 3)
    assert stats.kendall(spark.createDataFrame(rows, "x int, y int").coalesce(1), "x", "y") == pytest.approx(few)


def test_inversions_against_all_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 60):
        for _ in range(20):
            y, w = rng.integers(0, 6, n), rng.integers(1, 4, n)
            assert stats.inversions(y, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


@pytest.mark.parametrize("column", ["l_returnflag", "l_quantity", "l_shipdate", "l_orderkey"])
def test_buckets_are_even_whatever_the_first_column(spark, column):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    for order, unique in (([column], False), ([column, "l_orderkey", "l_linenumber", "l_partkey"], True)):
        sizes = [r["count"] for r in ordering.bucketed(lines, order, 16, unique).groupBy(ordering.BUCKET).count().collect()]
        assert len(sizes) > 8 and max(sizes) <= 3 * sum(sizes) / 16


def test_positions_over_many_buckets(spark, monkeypatch):
    """Values that repeat, nulls, NaN and text, in tables of many small buckets."""
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 7)
    rows = [(None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i * 37 % 5), "x" * (i % 3), i) for i in range(300)]
    d = spark.createDataFrame(rows, "a double, b string, i int").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] is not None and r[0] != r[0], r[0] if r[0] is not None and r[0] == r[0] else 0, r[1], r[2]))
    got = ordering.numbered(d, ["a", "b", "i"]).orderBy(ordering.ORD).select(ordering.ORD, "i").collect()
    assert [tuple(r) for r in got] == [(k, r[2]) for k, r in enumerate(want)]
    same = spark.createDataFrame([(1, 5)] * 50, "a int, b int")  # rows that nothing tells apart
    assert sorted(r[0] for r in ordering.numbered(same, ["a"], "n", unique=False).select("n").collect()) == list(range(50))
    assert ordering.numbered(d.limit(0), ["a", "b", "i"]).count() == 0


@pytest.mark.parametrize("values", [[1.0, 1.0, 1.0], [5.0], [], [float(x) ** 9 * (-1) ** x for x in range(200)], [0.1 * (x % 7) for x in range(500)], [-1e300, 1e300, 0.0, None, 2.0]])
def test_quantiles_by_closing_histograms(spark, values):
    d = spark.createDataFrame([(v,) for v in values], "v double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    known = [v for v in values if v is not None]
    got = quantiles(d, {"v": F.col("v"), "w": -F.col("v")}, qs, buffered=0)
    assert got["v"] == (pytest.approx(list(np.quantile(known, qs))) if known else [None] * 6)
    assert got["w"] == (pytest.approx(list(np.quantile([-v for v in known], qs))) if known else [None] * 6)


def test_sparse_matrices_refuse_what_does_not_fit(spark):
    entries = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 2, -1.0), (1, 2, 1.0)], "i long, j long, v double")
    m = arrays.Sparse.from_coo(entries, (2, 3))
    assert (m.nnz(), m.get(0, 0), m.get(1, 2), m.shape, m.transpose().shape) == (1, 3.0, 0.0, (2, 3), (3, 2))
    assert [r.row for r in m.to_dense().orderBy("i").collect()] == [[3.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    for wrong in (lambda: m.get(2, 0), lambda: m.add(m.transpose()), lambda: m.matmul(m)):
        with pytest.raises((IndexError, ValueError)):
            wrong()
    with pytest.raises(Exception, match="outside the matrix"):
        arrays.Sparse.from_coo(entries, (1, 1)).nnz()


def test_checks_of_settings_and_shapes():
    config.set_seed(3)
    assert config.get_seed() == 3 and (config.clear_seed(), config.get_seed())[1] is None
    assert config.get_device() == "spark" and config.is_device("driver") and not config.is_device("gpu")
    assert config.broadcast_shape((3, 1), (2,)) == (3, 2) and config.dimension((4, 5), -1) == 5 and config.array((1, 2), "a") == [1, 2]
    for error, wrong in (
        (errors.DeviceError, lambda: config.set_device("gpu")), (errors.DTypeError, lambda: config.set_dtype("complex")), (errors.DTypeError, lambda: config.numeric_dtype("string")),
        (errors.BroadcastError, lambda: config.broadcast_shape((3,), (2,))), (errors.ShapeError, lambda: config.dimension((3,), 1)), (errors.DataValidationError, lambda: config.array([], "a", 1)),
    ):
        with pytest.raises(error):
            wrong()


def test_embedding_refuses_more_rows_than_it_takes(spark):
    d = spark.range(30).select("id", F.rand(1).alias("x"))
    with pytest.raises(errors.CapacityError):
        models.TSNE(["x"], most=20).fit_transform(d, "id")
    assert models.TSNE(["x"], steps=5).fit_transform(d, "id").count() == 30


def test_start_of_clusters_with_a_row_repeated_thousands_of_times(spark):
    d = spark.range(10_020).select(F.when(F.col("id") < 10_000, 0.0).otherwise(F.col("id") % 4 + 1.0).alias("x"))
    m = models.KMeans(["x"], 4).fit(d)
    assert sorted(np.round(m.centres.ravel(), 6))[0] == 0.0


def test_silhouette_in_blocks_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    points, labels = rng.normal(size=(400, 2)), rng.integers(0, 4, 400)
    want = {}
    for i in range(400):
        d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        a = d[labels == labels[i]].sum() / ((labels == labels[i]).sum() - 1)
        b = min(d[labels == c].mean() for c in range(4) if c != labels[i])
        want[i] = (b - a) / max(a, b)
    rows = spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(labels, points))], "k long, label int, a double, b double")
    got = {r.k: r.silhouette for r in metrics.silhouette(rows, ["a", "b"], "label", "k", 90).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_normality(spark):
    d = generated.make_regression(spark, 300, [1.0], 0.0).select("x0", (F.exp("x0")).alias("e"))
    assert stats.shapiro(d, "x0") > 0.98 > stats.shapiro(d, "e")
    assert stats.anderson_normal(d, "x0") < 1.2 < stats.anderson_normal(d, "e")
    assert stats.normaltest(d, "x0")[1] > 0.001 > stats.normaltest(d, "e")[1]
    assert stats.kstest_normal(d, "x0")[1] > 0.01 > stats.kstest_normal(d, "e")[1]


def test_settings():
    from quillframe import config

    config.set_config(seed=3)
    assert config.get_config()["seed"] == 3
    config.reset_config()
    assert config.get_config()["seed"] is None
    with pytest.raises(Exception, match="unknown setting"):
        config.set_config(nothing=1)
    assert config.normalize_axis(-1, 2) == 1


def test_random_columns(spark):
    d = spark.range(4000).select(generated.poisson(1, 3.0).alias("p"), generated.gamma(2, 3, 2.0).alias("g"), generated.beta(3, 2, 2).alias("b"), generated.binomial(4, 10, 0.3).alias("n"), generated.normal(5).alias("z"))
    m = d.agg(*(F.avg(c).alias(c) for c in d.columns)).first()
    assert (m.p, m.g, m.b, m.n, m.z) == pytest.approx((3, 6, 0.5, 3, 0), abs=0.15)
    assert generated.make_gaussian_quantiles(spark, 300).groupBy("label").count().agg(F.min("count")).first()[0] == 100


def test_embedding_and_splits(spark):
    d = generated.make_blobs(spark, 60, [[0.0] * 5, [30.0] * 5])
    e = {r.id: (r.t0, r.t1) for r in models.TSNE([f"x{i}" for i in range(5)], perplexity=10).fit_transform(d, "id").collect()}
    inside = np.mean([math.dist(e[i], e[i + 2]) for i in range(0, 50, 2)])
    across = np.mean([math.dist(e[i], e[i + 1]) for i in range(0, 50, 2)])
    assert across > 2 * inside
    assert len(prep.leave_p_out(5, 2)) == 10
    assert prep.leave_one_out(d, ["id"]).select("fold").distinct().count() == 60


def test_hot_keys_are_cut_and_give_what_windows_give(spark, monkeypatch):
    rows = [(i % 3 if i % 4 else None if i % 8 else 0, i, float(i * 7 % 11)) for i in range(400)]
    d = spark.createDataFrame(rows, "k int, i int, v double").repartition(6)
    f = Frame(d, ["i"])
    ways = [lambda: f.cumsum("v", "x", ["k"]), lambda: f.cummax("v", "x", ["k"]), lambda: f.shift("v", 2, into="x", partition_by=["k"]), lambda: f.rolling_mean("v", 5, "x", ["k"])]
    folds = lambda: prep.k_fold(d, ["i"], 3, "k")
    plain, even = [sorted(map(tuple, w().df.select("i", "x").collect())) for w in ways], sorted(map(tuple, folds().select("i", "fold").collect()))
    monkeypatch.setattr(ordering, "HOT_ROWS", 20)
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 30)
    monkeypatch.setattr(ordering, "CHUNK", 25)
    assert [sorted(map(tuple, w().df.select("i", "x").collect())) for w in ways] == plain
    assert sorted(map(tuple, folds().select("i", "fold").collect())) == even and len(even) == 400


@pytest.mark.parametrize("block", [4_000, 15])
def test_density_clusters_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(models.DBSCAN, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.2, (90, 2)), rng.normal(2, 0.2, (60, 2)), rng.uniform(-3, 5, (40, 2)), np.zeros((30, 2))])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.3
    core = near.sum(axis=1) >= 5
    label = np.where(core, np.arange(len(x)), 10**6)
    for _ in range(len(x)):
        label = np.where(core, np.where(near & core[None], label[None], 10**6).min(axis=1), 10**6)
    want = np.where(near & core[None], label[None], 10**6).min(axis=1)
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double")
    got = {r.i: r.cluster for r in models.DBSCAN(["a", "b"], 0.3, 5).fit_predict(d, "i").collect()}
    assert got == {i: -1 if c == 10**6 else c for i, c in enumerate(want.tolist())}


def test_quantiles_of_hot_groups(spark, monkeypatch):
    rows = [(i % 3 if i % 4 else None, float(i * i % 97) if i % 5 else None, i) for i in range(300)] + [(9, None, 0)]
    d = spark.createDataFrame(rows, "k int, v double, i int").repartition(5)
    medians = lambda: sorted(map(tuple, Frame(d, ["i"]).group_by("k").agg({"v": ["median", "count"]}).collect()), key=str)
    boxes = lambda: sorted(map(tuple, plotdata.boxplot(d.where("k < 3"), "v", "k").collect()))
    plain, drawn = medians(), boxes()
    monkeypatch.setattr(ordering, "HOT_ROWS", 10)
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 20)
    assert str(medians()) == str(plain) and boxes() == drawn and len(plain) == 5


def test_trim_mean_over_many_buckets(spark, monkeypatch):
    """A bucket's number, found from a grouped value, meets the totals of the buckets before."""
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 100)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    got = stats.trim_mean(orders, "o_totalprice", 0.1)
    assert "!Filter" not in got._jdf.queryExecution().optimizedPlan().toString()  # a filter on columns that its input lacks
    values = np.sort([r[0] for r in orders.select("o_totalprice").collect()])
    cut = len(values) // 10
    assert got.first().trim_mean == pytest.approx(values[cut : len(values) - cut].mean(), rel=1e-12)


def test_batches_lists_what_its_sql_lists(spark, tmp_path):
    """More than a hundred batches, of which the SQL lists the first hundred."""
    for name, rows in (("customer", spark.range(1, 90_001).select(F.col("id").alias("c_custkey"))), ("region", spark.range(1))):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalogue.QUERIES["batches"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, 700, True) for i in range(100)]


def test_squared_distances_of_wide_rows_keep_their_digits_in_little_memory():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(20_000, 64)) + 1e4
    x = np.concatenate([y[:20] + 1e-7 * rng.normal(size=(20, 64)), y[20:40], rng.normal(size=(260, 64)) + 1e4])
    tracemalloc.start()
    for a, b, d in pairwise.Squares(x, y).strips():
        want = np.stack([((y - x[i]) ** 2).sum(axis=1) for i in range(a, min(b, a + 2))])
        assert np.allclose(d[: len(want)], want, rtol=1e-9, atol=0)
    assert tracemalloc.get_traced_memory()[1] < 120e6  # all differences of 256 rows would be 2.6 GB
    tracemalloc.stop()
    x[0, 0] = np.inf
    assert pairwise.Squares(x[:2], y[:50]).block(0, 1, 0, 50).min() == np.inf
    assert list(pairwise.Squares(x[:2], y[:0]).strips())[0][2].shape == (2, 0)


def test_silhouette_of_wide_rows_in_pairs_of_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)) + np.arange(300)[:, None] % 3
    x[100:150] = x[:50]  # copies, some of them in other clusters
    label = np.arange(300) % 7
    names = [f"f{i}" for i in range(12)]
    rows = spark.createDataFrame([(i, int(label[i]), *map(float, x[i])) for i in range(300)], "k long, label long, " + ", ".join(f"{n} double" for n in names))
    got = {r.k: r.silhouette for r in metrics.silhouette(rows, names, "label", "k", 70).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for i in range(300):
        means = [d[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(7)]
        a, b = means[label[i]], min(m for c, m in enumerate(means) if c != label[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-12)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbours_of_wide_rows_against_all_pairs(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 12))
    x[100:160] = x[40:100]
    names = [f"f{i}" for i in range(12)]
    rows = spark.createDataFrame([(i, i % 5, *map(float, x[i])) for i in range(240)], "k long, label int, " + ", ".join(f"{n} double" for n in names))
    got = models.KNeighbors(names, "label", 4, metric, block_rows=50).fit(rows).neighbours(rows, "k").collect()
    found = {(r.k, r.rank): (r.distance, r.target) for r in got}
    assert len(found) == 960
    for i in range(240):
        gap = np.abs(x - x[i])
        d = gap.sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1))
        for rank, (distance, target) in enumerate(sorted(zip(d, np.arange(240) % 5, strict=True))[:4]):
            assert found[i, rank] == (pytest.approx(distance, abs=1e-12), target)


@pytest.mark.parametrize("block", [30, 16_000])
def test_density_clusters_of_wide_rows_with_copies(spark, monkeypatch, block):
    """Twelve features, copies, and pairs at exactly eps, which a product of matrices alone cannot tell from farther ones."""
    monkeypatch.setattr(models.DBSCAN, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(150, 12)) / 2, 2) * 4
    x[30:60], x[60:80] = x[0], x[1] + 0.5 * (np.arange(12) == 3)
    x[80:90] = x[1] - 0.5 * (np.arange(12) == 5)
    x[90:92] = x[1] - (np.arange(12) == 5)
    names = [f"f{i}" for i in range(12)]
    rows = spark.createDataFrame([(i, *map(float, x[i])) for i in range(150)], "k long, " + ", ".join(f"{n} double" for n in names))
    got = {r.k: r.cluster for r in models.DBSCAN(names, 0.5, 4).fit_predict(rows, "k").collect()}
    near = [[j for j in range(150) if ((x[i] - x[j]) ** 2).sum() <= 0.25] for i in range(150)]
    core = [i for i in range(150) if len(near[i]) >= 4]
    name = {i: i for i in core}
    for _ in range(150):
        for i in core:
            name[i] = min(name[j] for j in near[i] if j in name)
    assert got == {i: min((name[j] for j in near[i] if j in name), default=-1) for i in range(150)}
    assert len({c for c in got.values() if c >= 0}) >= 2


def test_density_clusters_of_many_copies_end(spark):
    """Four thousand copies are sixteen million links, which a task meets a row at a time."""
    rows = spark.range(4000).select(F.col("id").alias("k"), *(F.lit(float(i)).alias(f"f{i}") for i in range(10)))
    began = time.monotonic()
    got = models.DBSCAN([f"f{i}" for i in range(10)], 0.5, 4).fit_predict(rows, "k").groupBy("cluster").count().collect()
    assert [tuple(r) for r in got] == [(0, 4000)] and time.monotonic() - began < 60


def test_quantiles_of_whole_tables_need_no_buffer(spark, tmp_path, monkeypatch):
    """Percentiles and the median error of more rows than a buffer may hold, without the aggregates that hold them."""

    def refused(*_):
        raise AssertionError("a buffer of all values")

    rng = np.random.default_rng(7)
    y, q = rng.normal(size=3000) * 1000, rng.integers(1, 50, 3000).astype(float)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, q, strict=True)], "l_extendedprice double, l_quantity double")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows.select(F.col("l_extendedprice").alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/region.parquet")
    module = sys.modules["quillframe.functions.quantiles"]
    for at, name, value in ((module, "BUFFERED", 100), (F, "percentile", refused), (F, "median", refused)):
        monkeypatch.setattr(at, name, value, raising=False)
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).first()
    assert tuple(run("percentile")) == pytest.approx(np.percentile(y, [90, 25, 50]), rel=1e-12)
    assert run("regression_scores").medae == pytest.approx(np.median(np.abs(y - 1000 * q)), abs=1e-4)
    assert run("stats_summary").q == pytest.approx(np.quantile(q, 0.1))


def test_quantiles_with_values_that_no_bins_hold(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, math.inf, math.nan)], "v double")
    assert quantiles(rows, {"v": F.col("v")}, (0.0, 1 / 3), 2)["v"] == pytest.approx([1.0, 2.0])
