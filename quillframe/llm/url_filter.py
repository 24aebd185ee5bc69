"""URL filtering: host and path rules first, then gradient-boosted trees on lexical features.

Rules are (verdict, host, path): a rule fits its host and all subdomains if the path starts with its own; the longest
fitting rule decides. URLs that a rule decides are the labelled URLs. About ``SAMPLE`` different ones of them, those
whose hashes lie below a bound, go to the driver as numbers, each with how often it occurs; one in ``HELD_OUT`` is kept
from the training and sets the threshold. Trees are then nested conditions over feature columns: scoring runs in
generated code, without Python, in one pass and without a shuffle.

Statistics of suffixes are the smoothed shares of blocked URLs by last label and last two labels of the host, by
first segment and end of the path, and by last label and first segment, in tables of ``SLOTS`` entries that texts reach
by a hash: any number of suffixes has a place, and those that share one share its statistics.

Defined results: a null URL, or one without ``://``, has an empty host and path and the features of an empty text;
repeated rows each get their own row; an empty table gives no rows; without labelled URLs of both kinds every score is
the prior; columns named as the ones added are replaced, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SAMPLE = 20_000
SLOTS = 4_096
HELD_OUT = 5
SMOOTH = 10  # rows at the overall share that each statistic counts beside its own
LEXICAL = ("length", "host_length", "path_length", "depth", "digit_ratio", "path_digits", "entropy", "params", "query_length", "host_hyphens", "host_labels", "first_segment", "path_number")
SUFFIXES = ("last_label", "last_labels", "first_segment", "path_end", "label_and_segment")


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def rule_columns(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for say, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def count_of(value: Column, what: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(what), F.lit("")))


def entropy(value: Column) -> Column:
    """Bits a character of a short text."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.split(value, "")), lambda c: -share(c) * F.log2(share(c)))
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def suffix_slots() -> dict[str, Column]:
    """name -> the place of a URL's suffix in the table of that statistic, from host and path."""
    last = F.element_at(F.split("path", "/"), -1)
    end = F.when(F.endswith(F.col("path"), F.lit("/")), "/").when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1)).otherwise("")
    label, segment = F.substring_index("host", ".", -1), F.coalesce(F.get(F.split("path", "/"), 1), F.lit(""))
    texts = (label, F.substring_index("host", ".", -2), segment, end, F.concat_ws("/", label, segment))
    return {n: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int") for n, t in zip(SUFFIXES, texts, strict=True)}


def lexical(url: Column) -> dict[str, Column]:
    """name -> value, from a URL without nulls and the columns host and path."""
    host, path = F.col("host"), F.col("path")
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    query = F.when(F.contains(url, F.lit("?")), F.substring(url, F.locate("?", url) + 1, F.length(url))).otherwise("")
    number = F.try_to_number(F.substring(F.regexp_extract(path, "[0-9]+", 0), 1, 1), F.lit("9"))
    made = (
        F.length(url), F.length(host), F.length(path), count_of(path, "/"), digits(url) / F.greatest(F.length(url), F.lit(1)), digits(path), entropy(host), count_of(query, "="), F.length(query),
        count_of(host, "-"), count_of(host, "."), F.length(F.get(F.split(path, "/"), 1)), number,
    )
    return {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in zip(LEXICAL, made, strict=True)}


def fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10) -> tuple[float, list]:
    """Log-odds prior and trees of nested (feature, threshold, below, from there on), by Newton boosting on histograms; w: how often each row counts."""
    prior = float(np.log(((w * y).sum() + 1) / ((w * (1 - y)).sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return prior, []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), prior)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        value = float(rate * g[rows].sum() / (h[rows].sum() + 1))
        best = (1e-6, None, None)
        if left and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                gs, hs, ns = (np.cumsum(np.bincount(binned[rows, f], w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
        _, f, cut = best
        if f is None:
            score[rows] += value
            return value
        low = binned[rows, f] <= cut
        return f, float(edges[f][cut]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1)

    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grown.append(grow(np.arange(len(y)), w * (y - p), w * p * (1 - p), depth))
    return prior, grown


def tree_column(tree, names: Sequence[str]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, threshold, below, above = tree
    return F.when(F.col(names[f]) < threshold, tree_column(below, names)).otherwise(tree_column(above, names))


def tree_sums(trees: list, intercept: float, x: np.ndarray) -> np.ndarray:
    """The trees' sums over the rows of x, on the driver."""

    def add(tree, rows: np.ndarray) -> None:
        if isinstance(tree, float):
            out[rows] += tree
        else:
            f, threshold, below, above = tree
            low = x[rows, f] < threshold
            add(below, rows[low])
            add(above, rows[~low])

    out = np.full(len(x), intercept)
    for tree in trees:
        add(tree, np.arange(len(x)))
    return out


def auc(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The area under the ROC curve of weighted rows; 0.5 without rows of both kinds."""
    values, at = np.unique(score, return_inverse=True)
    yes, no = np.bincount(at, w * y, len(values)), np.bincount(at, w * (1 - y), len(values))
    return float((yes * (np.cumsum(no) - no / 2)).sum() / (yes.sum() * no.sum())) if yes.sum() and no.sum() else 0.5


def best_threshold(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The score from which blocking makes the fewest errors; of several the one nearest to 0.5."""
    values, at = np.unique(np.concatenate([score, [0.5, np.inf]]), return_inverse=True)
    yes, no = (np.bincount(at[: len(score)], w * v, len(values)) for v in (y, 1 - y))
    errors = np.cumsum(yes) - yes + no[::-1].cumsum()[::-1]
    least = np.flatnonzero(errors <= errors.min() + 1e-9)
    return float(values[min(least, key=lambda k: abs(values[k] - 0.5))])


class UrlFilter:
    """A fitted model; ``score`` adds block_score, the probability that a URL is one to block.

    ``auc`` and ``threshold`` are of the held-out rows.
    """

    def __init__(self, rates: dict[str, list[float]], intercept: float, trees: list, threshold: float = 0.5, auc: float = 0.5):
        self.rates, self.intercept, self.trees, self.threshold, self.auc = rates, intercept, trees, threshold, auc

    def score(self, pages: DataFrame, url_col: str = "url") -> DataFrame:
        """pages (with host and path) and block_score."""
        rate = lambda n, slot: F.get(F.lit(np.array(self.rates[n])), slot)
        made = [*lexical(F.coalesce(F.col(url_col), F.lit(""))).values(), *(rate(n, slot) for n, slot in suffix_slots().items())]
        names = [f"__f{k}" for k in range(len(made))]
        total = F.lit(self.intercept)
        for tree in self.trees:
            total = total + tree_column(tree, names)
        return pages.withColumns(dict(zip(names, made, strict=True))).withColumn("block_score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).drop(*names)


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """(url, label, n): about ``sample`` different URLs, those whose hashes are smallest, and how often each occurs; all URLs if there are no more."""
    urls = labelled.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    share = sample / max(urls, 1)
    if share < 1:
        labelled = labelled.where(F.xxhash64("url", F.lit("sample")) < F.lit(int((2 * share - 1) * 2**63)))
    return labelled.groupBy("url", "label").agg(F.count("*").alias("n"))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample: int = SAMPLE) -> UrlFilter:
    """Fit on about ``sample`` different labelled URLs (1 to block, or 0); one in HELD_OUT, by hash, gives the threshold instead."""
    rows = labelled.select(F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.col(label_col).cast("double").alias("label")).where("label is not null")
    rows = parsed(sampled(rows, sample))
    out = (F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(HELD_OUT)) == 0).cast("double")
    columns = {**lexical(F.col("url")), **{f"slot_{n}": c for n, c in suffix_slots().items()}, "label": F.col("label"), "n": F.col("n"), "out": out}
    data = np.array([tuple(r) for r in rows.select(*(c.cast("double").alias(n) for n, c in columns.items())).collect()], float).reshape(-1, len(columns))
    data = data[np.lexsort(data.T)]  # the order of rows depends on partitions
    x, slots, (y, w, out) = data[:, : len(LEXICAL)], data[:, len(LEXICAL) : -3].astype(int), data[:, -3:].T
    train = out == 0
    share = ((w * y)[train].sum() + 1) / (w[train].sum() + 2)
    rates, seen = {}, []
    for k, name in enumerate(SUFFIXES):
        yes, all_ = (np.bincount(slots[train, k], v[train], SLOTS) for v in (w * y, w))
        table = (yes + SMOOTH * share) / (all_ + SMOOTH)
        rates[name] = table.tolist()
        seen.append(table[slots[:, k]])
    x = np.column_stack([x, *seen])
    intercept, trees = fit_trees(x[train], y[train], w[train])
    score = 1 / (1 + np.exp(-tree_sums(trees, intercept, x[~train])))
    return UrlFilter(rates, intercept, trees, best_threshold(score, y[~train], w[~train]), auc(score, y[~train], w[~train]))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """row (pages' own columns), url, host, path, rule and rule_verdict."""
    rule, verdict = rule_columns(rules)
    packed = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(url_col).alias("url"))
    return parsed(packed).withColumns({"rule": rule, "rule_verdict": verdict})


def fit_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", sample: int = SAMPLE) -> UrlFilter:
    """The model of the URLs that rules decide."""
    train = ruled(pages, rules, url_col).where("rule is not null")
    return fit(train.select("url", (F.col("rule_verdict") == "block").cast("int").alias("label")), sample=sample)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float | None = None, url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """pages with host, path, rule, block_score and verdict: the rule's, else block from the threshold on, by default that of the held-out URLs."""
    model = fit_rules(pages, rules, url_col, sample)
    scored = model.score(ruled(pages, rules, url_col))
    own = F.when(F.col("block_score") >= (model.threshold if threshold is None else threshold), "block").otherwise("allow")
    scored = scored.withColumn("verdict", F.coalesce("rule_verdict", own))
    added = ("host", "path", "rule", "block_score", "verdict")
    return scored.select(*(F.col(f"row.`{c}`") for c in pages.columns if c not in added), *added)
