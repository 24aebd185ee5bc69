"""A quality classifier as a generalised additive model with pairwise interactions.

Each feature of a text is binned, and boosting that visits the features in turn, one shallow tree of its bins a visit,
sums up to one lookup table a feature; then the pairs that reduce the rest of the loss most get tables of their own in
the same way. A score is the sigmoid of the sum of a row's table entries: additions of gathered bins, a batch at a time.

Features are counts of the whole text (``textstats``); labels, languages, sources and ids are no features. The model
is fitted on the driver on the rows of about ``SAMPLE`` labelled documents, those whose hashes lie below a bound (all, if
there are no more), equal rows as one with its number; counts cover all texts.

Defined results: null and empty texts are scored by their zero counts; labels other than 0 and 1 are ignored, repeated
ones count as often as they occur; without labels of both kinds all scores are the prior; repeated rows each get their
own row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._common import durable
from quillframe.llm.textstats import text_counts

SAMPLE = 100_000


def features() -> dict[str, Column]:
    """name -> value, from the columns of text_counts"""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.log1p("n_words"), "word_length": ratio("word_chars", "n_words"), "symbols": ratio("n_symbols", "n_words"), "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"), "line_words": ratio("n_words", "n_lines"), "short_lines": ratio("n_short_lines", "n_lines"), "bare_lines": ratio("n_bare_lines", "n_lines"),
        "upper": ratio("n_upper", "n_letters"), "letters": ratio("n_letters", "n_chars"), "digits": ratio("n_digits", "n_chars"), "sentences": ratio("n_sentence_ends", "n_words"),
        "pipes": ratio("n_pipes", "n_words"), "exclaims": ratio("n_exclaims", "n_words"), "variety": ratio("n_distinct_words", "n_words"), "runs": ratio("n_runs", "n_words"),
        "marked": ratio("n_marked_words", "n_words"), "long_words": ratio("n_long_words", "n_words"), "quotes": ratio("n_quotes", "n_words"), "upper_words": ratio("n_upper_words", "n_words"),
    }


def cut(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.zeros(0)


def shallow(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values of a tree over ordered bins that has gradient sums g and curvature sums h."""
    gs, hs = np.cumsum(g), np.cumsum(h)
    value = gs[-1] / (hs[-1] + 1)
    if depth and len(g) > 1:
        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > gs[-1] ** 2 / (hs[-1] + 1) + 1e-9:
            return np.concatenate((shallow(g[:k], h[:k], depth - 1), shallow(g[k:], h[k:], depth - 1)))
    return np.full(len(g), value)


def shallow_pair(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of one cut across, then one cut along on either side, over a grid of bins; and its gain."""
    best = (np.full(g.shape, g.sum() / (h.sum() + 1)), g.sum() ** 2 / (h.sum() + 1))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(a)):
            halves = [(shallow(a[s].sum(axis=0), b[s].sum(axis=0), 1), s) for s in (slice(0, k), slice(k, None))]
            gain = sum(2 * (v * a[s].sum(axis=0)).sum() - (v**2 * b[s].sum(axis=0)).sum() for v, s in halves)
            if gain > best[1] + 1e-9:
                table = np.concatenate([np.tile(v, (len(a[s]), 1)) for v, s in halves])
                best = (table.T if turned else table, gain)
    return best


class Gam:
    """Lookup tables of features and of pairs of features."""

    def __init__(self, bins: int = 48, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate = bins, pair_bins, rounds, pair_rounds, pairs, rate

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Gam:
        """w: how often each row counts."""
        n, n_features = x.shape
        w = np.ones(n) if w is None else w
        self.intercept = float(np.log(((w * y).sum() + 1) / ((w * (1 - y)).sum() + 1)))
        self.edges = [cut(x[:, f], self.bins) for f in range(n_features)]
        self.coarse = [cut(x[:, f], self.pair_bins) for f in range(n_features)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if n == 0 or y.min() == y.max():
            return self
        at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        wide = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
        score = np.full(n, self.intercept)
        for _ in range(self.rounds):
            for f in range(n_features):
                p = 1 / (1 + np.exp(-score))
                size = len(self.tables[f])
                step = self.rate * shallow(np.bincount(at[f], w * (y - p), size), np.bincount(at[f], w * p * (1 - p), size), 2)
                self.tables[f] += step
                score += step[at[f]]

        def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            cell = wide[i] * shape[1] + wide[j]
            return cell, np.bincount(cell, w * (y - p), shape[0] * shape[1]).reshape(shape), np.bincount(cell, w * p * (1 - p), shape[0] * shape[1]).reshape(shape)

        gains = {(i, j): shallow_pair(*grid(i, j)[1:])[1] for i, j in combinations(range(n_features), 2)}
        self.pairs = sorted(gains, key=lambda k: (-gains[k], k))[: self.n_pairs]
        self.pair_tables = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for k, (i, j) in enumerate(self.pairs):
                cell, g, h = grid(i, j)
                step = self.rate * shallow_pair(g, h)[0]
                self.pair_tables[k] += step
                score += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, entries) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += entries[np.searchsorted(edges, x[:, f], side="right")]
        for (i, j), entries in zip(self.pairs, self.pair_tables, strict=True):
            total += entries[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether the checksum of the id, as text, is a multiple of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(counted: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Gam:
    """A model of the rows of counted (id and features) that have labels and are not held out."""
    names = list(features())
    known = labels.select("doc_id", F.col(label_col).alias("label")).where("label in (0, 1)").where(~held_out())
    share = sample / max(known.count(), 1)
    if share < 1:
        known = known.where(F.xxhash64("doc_id", F.lit("sample")) < F.lit(int((2 * share - 1) * 2**63)))
    rows = counted.where(~held_out()).join(known, "doc_id").groupBy(*names, "label").agg(F.count("*").cast("double").alias("n"))
    data = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, len(names) + 2)
    data = data[np.lexsort(data.T)]  # the order of rows depends on partitions
    return Gam().fit(data[:, :-2], data[:, -2], data[:, -1])


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """A row for each document: doc_id, held_out, score (probability of label 1) and predicted."""
    names = list(features())
    counted = durable(text_counts(docs).select("doc_id", *(c.cast("double").alias(n) for n, c in features().items())))
    model = fit(counted, labels, sample=sample)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]) if batch.num_rows else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    id_type = counted.schema["doc_id"].dataType.simpleString()
    scored = counted.mapInArrow(add, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
