"""Bayes, neighbours, clusters, components and trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import CapacityError, DataValidationError, InvalidParameterError, NotFittedError
from quillframe.functions.pairwise import Squares
from quillframe.ml.linear import WIDE, appended, gram, matrix_of
from quillframe.plans.components import connected_components


class GaussianNB:
    """Class means and population variances from one aggregation; predicting is one expression."""

    def __init__(self, features: Sequence[str], target: str, smoothing: float = 1e-9):
        self.features, self.target, self.smoothing, self.classes = list(features), target, smoothing, {}

    def fit(self, df: DataFrame) -> GaussianNB:
        asked = [a.alias(f"{p}{i}") for i, c in enumerate(self.features) for p, a in (("m", F.avg(c)), ("v", F.var_pop(c)))]
        rows = df.groupBy(F.col(self.target).alias("label")).agg(F.count("*").alias("n"), *asked).orderBy("label").collect()
        total = sum(r.n for r in rows)
        self.kind = df.schema[self.target].dataType
        self.classes = {r.label: (math.log(r.n / total), [(r[f"m{i}"], r[f"v{i}"] + self.smoothing) for i in range(len(self.features))]) for r in rows}
        return self

    def _joint(self, label) -> Column:
        prior, moments = self.classes[label]
        out = F.lit(prior - sum(0.5 * math.log(2 * math.pi * v) for _, v in moments))
        for c, (m, v) in zip(self.features, moments, strict=True):
            out = out - (F.col(c) - m) * (F.col(c) - m) / (2 * v)
        return out

    def predict(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        if not self.classes:
            raise NotFittedError("fit comes first")
        if len(self.classes) * len(self.features) > WIDE and all(isinstance(k, int) for k in self.classes):
            return appended(df, self.features, lambda x, joint=self._joints(): {into: joint(x)[0]}, [T.StructField(into, self.kind)])
        best = F.array_max(F.array(*(F.struct(self._joint(k).alias("s"), F.lit(k).alias("k")) for k in self.classes)))
        return df.withColumn(into, best["k"])

    def _joints(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The best class of each row of a matrix, the last of several, and the joint log probabilities."""
        labels = np.array(list(self.classes))
        priors = np.array([p for p, _ in self.classes.values()])
        means, spreads = (np.array([[m[k] for m in moments] for _, moments in self.classes.values()]) for k in (0, 1))
        fixed = priors - 0.5 * np.log(2 * np.pi * spreads).sum(axis=1)
        kind = np.int32 if isinstance(self.kind, T.IntegerType) else np.int64

        def joint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = np.column_stack([c - ((x - m) ** 2 / (2 * v)).sum(axis=1) for c, m, v in zip(fixed, means, spreads, strict=True)])
            return labels[len(labels) - 1 - s[:, ::-1].argmax(axis=1)].astype(kind), s

        return joint

    def predict_proba(self, df: DataFrame, prefix: str = "p_") -> DataFrame:
        joints = {k: self._joint(k) for k in self.classes}
        top = F.greatest(*joints.values()) if len(joints) > 1 else next(iter(joints.values()))
        total = sum((F.exp(j - top) for j in joints.values()), F.lit(0.0))
        return df.withColumns({f"{prefix}{k}": F.exp(j - top) / total for k, j in joints.items()})


class KNeighbors:
    """Exact neighbours. Queries pass the training rows in blocks of bounded size; a heap of k a query merges the blocks."""

    def __init__(self, features: Sequence[str], target: str, k: int = 5, metric: str = "euclidean", weights: str = "uniform", block_rows: int = 20_000):
        if metric not in ("euclidean", "manhattan"):
            raise InvalidParameterError("unknown metric", "metric", metric)
        self.features, self.target, self.k, self.metric, self.weights, self.block_rows = list(features), target, k, metric, weights, block_rows

    def fit(self, df: DataFrame) -> KNeighbors:
        self.train = df.select(*(F.col(c).cast("double").alias(c) for c in self.features), self.target)
        return self

    def neighbours(self, df: DataFrame, key: str) -> DataFrame:
        """(key, rank, distance, target) of the k nearest, ties by target; training rows come in hashed blocks, not all at once."""
        n = self.train.count()
        blocks = max(1, math.ceil(n / self.block_rows))
        train = self.train.withColumn("__b", F.pmod(F.xxhash64(*self.features, self.target), F.lit(blocks)).cast("int"))
        names, target, k, metric = self.features, self.target, self.k, self.metric
        queries = df.select(F.col(key).alias("__q"), *(F.col(c).cast("double").alias(c) for c in names))
        spread = queries.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        label = self.train.schema[target].dataType.simpleString()
        schema = f"q {df.schema[key].dataType.simpleString()}, distance double, target {label}"

        def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"q": [], "distance": [], "target": []})
            x, y, labels = left[names].to_numpy(float), right[names].to_numpy(float), right[target].to_numpy()
            order = np.lexsort((labels,))
            y, labels, keys, parts = y[order], labels[order], left["__q"].to_numpy(), []

            def found(i: int, j: np.ndarray, d: np.ndarray) -> None:
                best = np.argsort(d, kind="stable")[:k]
                parts.append(pd.DataFrame({"q": np.repeat(keys[i : i + 1], len(best)), "distance": d[best], "target": labels[j[best]]}))

            if metric == "manhattan":
                for i in range(len(x)):
                    found(i, np.arange(len(y)), np.abs(x[i] - y).sum(axis=1))
            else:
                squares = Squares(x, y)
                for a, b, d in squares.strips():
                    # what may be among the k nearest, as far as the squares are exact; those are measured by differences
                    far = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1 : k]
                    near = ~(d > far + 2 * squares.slack(a, b))
                    for i in range(a, b):
                        j = np.flatnonzero(near[i - a])
                        found(i, j, np.sqrt(squares.exact(i, j)))
            return pd.concat(parts)

        # queries are dealt to tasks by block and a salt, so that no task holds more than its share of them
        salts = max(1, math.ceil(df.count() / self.block_rows))
        spread = spread.withColumn("__s", F.pmod(F.xxhash64("__q"), F.lit(salts)).cast("int"))
        copies = train.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = spread.groupBy("__b", "__s").cogroup(copies.groupBy("__b", "__s")).applyInPandas(nearest, schema)
        top = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "target"))), 1, k).alias("near"))
        return top.select(F.col("q").alias(key), F.posexplode("near").alias("rank", "x")).select(key, "rank", "x.distance", "x.target")

    def _weight(self) -> Column:
        return F.lit(1.0) / (F.col("distance") + 1e-10) if self.weights == "distance" else F.lit(1.0)


class KNeighborsClassifier(KNeighbors):
    def predict(self, df: DataFrame, key: str) -> DataFrame:
        votes = self.neighbours(df, key).groupBy(key, "target").agg(F.sum(self._weight()).alias("w"), F.min("rank").alias("r"))
        return votes.groupBy(key).agg(F.max_by("target", F.struct("w", -F.col("r"))).alias("prediction"))


class KNeighborsRegressor(KNeighbors):
    def predict(self, df: DataFrame, key: str) -> DataFrame:
        w = self._weight()
        return self.neighbours(df, key).groupBy(key).agg((F.sum(w * F.col("target")) / F.sum(w)).alias("prediction"))


class KMeans:
    """Lloyd's steps as one aggregation each; the centres, k rows, are literals of the next step's expression."""

    def __init__(self, features: Sequence[str], k: int, max_iter: int = 100, tol: float = 1e-4, seed: int = 0, sample: int = 10_000):
        self.features, self.k, self.max_iter, self.tol, self.seed, self.sample = list(features), k, max_iter, tol, seed, sample
        self.centres: np.ndarray | None = None
        self.inertia, self.n_iter = math.inf, 0

    def _start(self, df: DataFrame) -> np.ndarray:
        """k-means++ on about ``sample`` different rows, those with the smallest hashes, each as often as it occurs."""
        rows = df.select(*self.features)
        share = self.sample / max(1, rows.agg(F.approx_count_distinct(F.struct(*self.features), 0.02)).first()[0])
        if share < 1:
            rows = rows.where(F.xxhash64(*self.features, F.lit(self.seed)) < F.lit(int((2 * share - 1) * 2**63)))
        found = np.array([tuple(r) for r in rows.groupBy(*self.features).count().collect()], float).reshape(-1, len(self.features) + 1)
        found = found[np.lexsort(found.T)]  # the order of rows depends on partitions
        x, weight = found[:, :-1], found[:, -1]
        if len(x) < self.k:
            raise DataValidationError("fewer different rows than clusters")
        random = np.random.default_rng(self.seed)
        chosen = [x[random.choice(len(x), p=weight / weight.sum())]]
        while len(chosen) < self.k:
            d = weight * np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0)
            chosen.append(x[random.choice(len(x), p=d / d.sum())])
        return np.array(chosen)

    def _nearest(self) -> Column:
        """The struct (squared distance, number) of the nearest centre."""
        parts = [F.struct(sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(self.features, centre, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, centre in enumerate(self.centres)]
        return F.array_min(F.array(*parts))

    def step(self, df: DataFrame) -> float:
        """Move the centres once; returns the inertia before the move. A centre without rows stays."""
        if self.centres.size > WIDE:
            return self._wide_step(df)
        at = df.select(*self.features, self._nearest().alias("__n"))
        rows = at.groupBy(F.col("__n.i").alias("i")).agg(F.sum("__n.d").alias("d"), *(F.avg(c).alias(f"m{j}") for j, c in enumerate(self.features))).collect()
        for r in rows:
            self.centres[r.i] = [r[f"m{j}"] for j in range(len(self.features))]
        return float(sum(r.d for r in rows))

    def _wide_step(self, df: DataFrame) -> float:
        """As step, by products of matrices a batch: a row a task, centre and sum."""
        centres, names = self.centres.copy(), self.features

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), len(names) + 2))
            for batch in batches:
                x = matrix_of(batch, names)
                d, at = _closest(x, centres)
                member = np.eye(len(centres))[at]
                total += member.T @ np.column_stack([x, np.ones(len(x)), d])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

        found = {r.k: r.v for r in df.select(*names).mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        total = np.array([found.get(k, 0.0) for k in range(len(centres) * (len(names) + 2))]).reshape(len(centres), -1)
        own = total[:, -2] > 0
        self.centres[own] = total[own, :-2] / total[own, -2:-1]
        return float(total[:, -1].sum())

    def fit(self, df: DataFrame, start: np.ndarray | None = None) -> KMeans:
        rows = df.select(*(F.col(c).cast("double").alias(c) for c in self.features)).dropna().persist()
        try:
            self.centres = np.array(start, float) if start is not None else self._start(rows)
            for self.n_iter in range(1, self.max_iter + 1):
                before, self.inertia = self.inertia, self.step(rows)
                if abs(before - self.inertia) < self.tol:
                    break
        finally:
            rows.unpersist()
        return self

    def predict(self, df: DataFrame, into: str = "cluster") -> DataFrame:
        if self.centres is None:
            raise NotFittedError("fit comes first")
        if self.centres.size > WIDE:
            centres = self.centres.copy()
            return appended(df, self.features, lambda x: {into: _closest(x, centres)[1].astype(np.int32)}, [T.StructField(into, T.IntegerType())])
        return df.withColumn(into, self._nearest()["i"])


def _closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, number) of each row's nearest centre, the first of several; one centre at a time, so that memory is a batch's."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i, c in enumerate(centres):
        d = ((x - c) ** 2).sum(axis=1)
        closer = d < best
        best[closer], at[closer] = d[closer], i
    return best, at


class DBSCAN:
    """Density clusters by a grid join: rows meet only those of the same and the neighbouring cells, of side eps.

    The grid covers the first ``GRID`` features, as cells multiply with each. A cell's rows meet in blocks of bounded
    size, dealt by hashes; a task returns a number of neighbours a row, and then a spanning forest of its links between
    core rows, never the pairs. The links are contracted like any graph, and a row at a border joins the smallest of its
    core neighbours' clusters.
    """

    GRID, BLOCK = 2, 16_000

    def __init__(self, features: Sequence[str], eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean"):
        self.features, self.eps, self.min_samples, self.metric = list(features), eps, min_samples, metric

    def fit_predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, cluster), -1 for noise; a cluster is named by its smallest core key."""
        names, eps, manhattan = [f"x{i}" for i in range(len(self.features))], self.eps, self.metric == "manhattan"
        cells = [f"g{i}" for i in range(min(self.GRID, len(names)))]
        rows = df.select(F.col(key).alias("k"), *(F.col(c).cast("double").alias(x) for c, x in zip(self.features, names, strict=True)))
        home = rows.withColumns({g: F.floor(F.col(x) / eps) for g, x in zip(cells, names, strict=False)}).persist()
        # both sides of a cell in blocks: its own rows by rows, and those around it by columns
        others = [f"y{i}" for i in range(len(self.features))]
        away = home.toDF("o", *others, *cells)
        for g in cells:
            away = away.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
        blocks = lambda d, n: d.groupBy(*cells).agg(F.ceil(F.count("*") / self.BLOCK).alias(n))
        sizes = blocks(home, "rows").join(blocks(away, "columns"), cells)
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left, right = home.join(sizes, cells), away.join(sizes, cells)
        left = left.select(*cells, own("k", "rows").alias("row"), every("columns").alias("column"), "k", *names)
        right = right.select(*cells, every("rows").alias("row"), own("o", "columns").alias("column"), "o", *others)
        right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table
        at = [*cells, "row", "column"]
        kind = rows.schema["k"].dataType.simpleString()

        def near(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
            """Each row of a that has rows of b within eps, with their places, ascending."""
            x, y = a[names].to_numpy(float), b[others].to_numpy(float)
            if manhattan or not len(y):
                for i in range(len(x) if len(y) else 0):
                    if len(found := np.flatnonzero(np.abs(y - x[i]).sum(axis=1) <= eps)):
                        yield i, found
                return
            squares = Squares(x, y)
            for s, e, d in squares.strips():
                slack = squares.slack(s, e)
                for i in np.flatnonzero((d <= eps * eps + slack).any(axis=1)).tolist():
                    found = np.flatnonzero(d[i] <= eps * eps + slack[i])
                    doubtful = d[i, found] >= eps * eps - slack[i]  # too near eps for a product to tell
                    inside = ~doubtful
                    inside[doubtful] = squares.exact(s + i, found[doubtful]) <= eps * eps
                    if inside.any():
                        yield s + i, found[inside]

        def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            met = [(i, len(found)) for i, found in near(a, b)]
            return pd.DataFrame({"k": a["k"].to_numpy()[[i for i, _ in met]], "n": [n for _, n in met]})

        counted = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(count, f"k {kind}, n long")
        core = counted.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_samples).select("k").persist()

        def forest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            """Links that connect what links between core rows of a and b connect."""
            nodes, at = np.unique(np.concatenate([a["k"].to_numpy(), b["o"].to_numpy()]), return_inverse=True)
            root, own, other, links = np.arange(len(nodes)), at[: len(a)], at[len(a) :], []
            for i, found in near(a, b):
                js = other[found]
                up = root[js]
                while not np.array_equal(higher := root[up], up):
                    up = higher
                root[js] = up
                mine = int(own[i])
                while root[mine] != mine:
                    mine = int(root[mine])
                tops, first = np.unique(up, return_index=True)
                if new := [(int(t), int(f)) for t, f in zip(tops, first, strict=True) if t != mine]:
                    root[[mine, *(t for t, _ in new)]] = min(mine, new[0][0])
                    links += [(own[i], js[f]) for _, f in new]
            ends = np.array(links, dtype=int).reshape(-1, 2)
            return pd.DataFrame({"a": nodes[ends[:, 0]], "b": nodes[ends[:, 1]]})

        cores = core.select(F.col("k").alias("o"))
        linked = left.join(core, "k", "left_semi").groupBy(*at).cogroup(right.join(cores, "o", "left_semi").groupBy(*at)).applyInPandas(forest, f"a {kind}, b {kind}")
        found = connected_components(linked)
        of_core = core.join(found, F.col("k") == F.col("node"), "left").select("k", F.coalesce("component", "k").alias("c"))

        def border(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            """The smallest cluster among each row's core neighbours."""
            clusters = b["c"].to_numpy()
            best = [(i, clusters[found].min()) for i, found in near(a, b)]
            return pd.DataFrame({"k": a["k"].to_numpy()[[i for i, _ in best]], "c": [c for _, c in best]})

        edge = left.join(core, "k", "left_anti").groupBy(*at).cogroup(right.join(of_core.select(F.col("k").alias("o"), "c"), "o").groupBy(*at)).applyInPandas(border, f"k {kind}, c {kind}")
        joined = of_core.unionByName(edge.groupBy("k").agg(F.min("c").alias("c")))
        return rows.select("k").join(joined, "k", "left").select(F.col("k").alias(key), F.coalesce("c", F.lit(-1)).alias("cluster"))


class PCA:
    """Principal axes of the covariance (n - 1), which one aggregation makes; a projection is an expression."""

    def __init__(self, features: Sequence[str], n_components: int | None = None, whiten: bool = False):
        self.features, self.n, self.whiten = list(features), n_components or len(features), whiten
        self.components: np.ndarray | None = None

    def fit(self, df: DataFrame) -> PCA:
        n, mean, c = gram(df, self.features)
        values, vectors = np.linalg.eigh(c / max(1, n - 1))
        order = np.argsort(values)[::-1][: self.n]
        vectors = vectors[:, order].T
        vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
        self.mean, self.components, self.explained_variance = mean, vectors, values[order]
        self.explained_variance_ratio = self.explained_variance / values.sum()
        return self

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        if self.components is None:
            raise NotFittedError("fit comes first")
        if self.components.size > WIDE:
            axes = self.components / np.sqrt(self.explained_variance)[:, None] if self.whiten else self.components
            names, mean = [f"{prefix}{k}" for k in range(len(axes))], self.mean
            return appended(df, self.features, lambda x: dict(zip(names, ((x - mean) @ axes.T).T, strict=True)), [T.StructField(n, T.DoubleType()) for n in names])
        new = {}
        for k, axis in enumerate(self.components):
            value = sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(self.features, self.mean, axis, strict=True)), F.lit(0.0))
            new[f"{prefix}{k}"] = value / math.sqrt(self.explained_variance[k]) if self.whiten else value
        return df.withColumns(new)

    def inverse_transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        scale = np.sqrt(self.explained_variance) if self.whiten else np.ones(len(self.components))
        if self.components.size > WIDE:
            back, mean, names = self.components * scale[:, None], self.mean, self.features
            return appended(df, [f"{prefix}{k}" for k in range(len(back))], lambda x: dict(zip(names, (x @ back + mean).T, strict=True)), [T.StructField(c, T.DoubleType()) for c in names])
        return df.withColumns({c: sum((F.col(f"{prefix}{k}") * float(self.components[k, i] * scale[k]) for k in range(len(self.components))), F.lit(float(self.mean[i]))) for i, c in enumerate(self.features)})


class Trees:
    """Decision trees, forests and boosted trees of Spark's own library: binned splits, level by level over all rows."""

    KINDS = {
        ("tree", "classifier"): "DecisionTreeClassifier", ("tree", "regressor"): "DecisionTreeRegressor", ("forest", "classifier"): "RandomForestClassifier",
        ("forest", "regressor"): "RandomForestRegressor", ("boosting", "classifier"): "GBTClassifier", ("boosting", "regressor"): "GBTRegressor",
    }

    def __init__(self, features: Sequence[str], target: str, kind: str = "tree", task: str = "classifier", **options):
        from pyspark.ml import classification, regression
        from pyspark.ml.feature import VectorAssembler

        if (kind, task) not in self.KINDS:
            raise InvalidParameterError("unknown kind of tree", "kind", (kind, task))
        self.assembler = VectorAssembler(inputCols=list(features), outputCol="__x")
        make = getattr(classification if task == "classifier" else regression, self.KINDS[kind, task])
        self.learner, self.model = make(featuresCol="__x", labelCol=target, predictionCol="prediction", **options), None

    def fit(self, df: DataFrame) -> Trees:
        self.model = self.learner.fit(self.assembler.transform(df))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFittedError("fit comes first")
        return self.model.transform(self.assembler.transform(df)).select(*df.columns, "prediction")


def batches(df: DataFrame, order: Sequence[str], size: int, seed: int | None = None, drop_last: bool = False) -> Iterator[pd.DataFrame]:
    """Mini-batches in order, or in the order of a hash for a seed; rows stream to the driver a partition at a time."""
    keys = [F.xxhash64(*order, F.lit(seed)), *order] if seed is not None else list(order)
    held: list = []
    for row in df.orderBy(*keys).toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held and not drop_last:
        yield pd.DataFrame(held, columns=df.columns)


class TSNE:
    """Exact embedding on the driver, whose work grows with the square of the rows: a table of more than ``most`` is an error."""

    def __init__(self, features: Sequence[str], n_components: int = 2, perplexity: float = 30.0, steps: int = 300, rate: float = 200.0, seed: int = 0, most: int = 2000):
        self.features, self.n, self.perplexity, self.steps, self.rate, self.seed, self.most = list(features), n_components, perplexity, steps, rate, seed, most

    def fit_transform(self, df: DataFrame, key: str) -> DataFrame:
        rows = sorted(df.select(key, *self.features).limit(self.most + 1).collect())
        if len(rows) > self.most:
            raise CapacityError(f"more than {self.most} rows: sample them first")
        x = np.array([tuple(r)[1:] for r in rows], float).reshape(len(rows), -1)
        y = self._embed(x) if len(x) > 1 else np.zeros((len(x), self.n))
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([(r[0], *map(float, v)) for r, v in zip(rows, y, strict=True)], f"{key} {kind}, " + ", ".join(f"t{k} double" for k in range(self.n)))

    def _neighbours(self, d: np.ndarray) -> np.ndarray:
        """Joint probabilities whose rows have the wanted perplexity, by bisection of each row's precision."""
        n = len(d)
        wanted = math.log(min(self.perplexity, max(1.0, (n - 1) / 3)))
        low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
        for _ in range(60):
            p = np.exp(-(d - np.where(np.eye(n), np.inf, d).min(axis=1, keepdims=True)) * beta[:, None])
            np.fill_diagonal(p, 0)
            p /= p.sum(axis=1, keepdims=True)
            entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
            wide = entropy > wanted
            low, high = np.where(wide, beta, low), np.where(wide, high, beta)
            beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
        p = p + p.T
        return np.maximum(p / p.sum(), 1e-12)

    def _embed(self, x: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(axis=1)
        p = self._neighbours(np.maximum(squares[:, None] + squares - 2 * x @ x.T, 0))
        y = np.random.default_rng(self.seed).normal(0, 1e-4, (len(x), self.n))
        velocity, gains = np.zeros_like(y), np.ones_like(y)
        for step in range(self.steps):
            s = (y * y).sum(axis=1)
            near = 1 / (1 + np.maximum(s[:, None] + s - 2 * y @ y.T, 0))
            np.fill_diagonal(near, 0)
            force = ((4 if step < 100 else 1) * p - near / near.sum()) * near
            gradient = 4 * (force.sum(axis=1)[:, None] * y - force @ y)
            gains = np.maximum(np.where(np.sign(gradient) != np.sign(velocity), gains + 0.2, gains * 0.8), 0.01)
            velocity = (0.5 if step < 250 else 0.8) * velocity - min(self.rate, len(x) / 4) * gains * gradient
            y = y + velocity
            y -= y.mean(axis=0)
        return y
