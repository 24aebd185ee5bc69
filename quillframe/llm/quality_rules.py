"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document's counts. Expectation-maximisation over the counts
of vote patterns estimates, without labels, how often each rule votes each way on good and on bad documents; the
posterior probability that a document is good replaces all-must-pass filtering.

The corpus is read once; its vote patterns are counted by Spark over all documents, and the driver gets at most
3 ** len(rules()) pattern counts, however large the corpus is.

Defined results: null and empty texts have zero counts and fail the base rules; repeated rows each get their own
row; an empty corpus gives no rows; a rule that abstains everywhere says nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._common import durable
from quillframe.llm.textstats import counted_rows, text_counts


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, bad: float) -> Column:
    """Bad from a bound up, else abstain."""
    return F.when(value >= bad, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """name -> vote, from the columns of text_counts. Passing a rule is rarely a proof of quality: most can only blame."""
    mean_word = _ratio("word_chars", "n_words")
    prose = (_ratio("n_words", "n_sentence_ends") <= 25) & (_ratio("n_symbols", "n_words") <= 0.01) & (_ratio("n_upper", "n_letters") <= 0.15)
    return {
        "symbols": _vote(_ratio("n_symbols", "n_words"), 0.15),
        "marked_words": _vote(_ratio("n_marked_words", "n_words"), 0.15),
        "shouting": _vote(_ratio("n_upper", "n_letters"), 0.30),
        "shouted_words": _vote(_ratio("n_upper_words", "n_words"), 0.25),
        "repeats": _vote(_ratio("n_repeat_words", "n_words"), 0.35),
        "runs": _vote(_ratio("n_runs", "n_words"), 0.10),
        "dup_lines": _vote(_ratio("n_dup_lines", "n_lines"), 0.30),
        "word_length": F.when((mean_word < 2) | (mean_word > 14), -1).otherwise(0),
        "prose": F.when((F.col("n_words") >= 20) & prose, 1).when(_ratio("n_words", "n_sentence_ends") >= 80, -1).otherwise(0),
    }


def fit_votes(patterns: np.ndarray, weights: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Prior of good and each rule's accuracy (how often its votes are right), by expectation-maximisation.

    Abstaining is taken to say nothing. Accuracies start at 0.9, count fifty documents at that rate beside the
    observed ones, and stay between 0.55 and 0.99: a rule is better than chance and never certain.
    """
    prior, accuracy = 0.8, np.full(patterns.shape[1], 0.9)
    for _ in range(rounds):
        good = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + patterns @ np.log(accuracy / (1 - accuracy)))))
        right = weights @ np.where(patterns > 0, good[:, None], np.where(patterns < 0, 1 - good[:, None], 0))
        now = np.clip((right + 45) / (weights @ (patterns != 0) + 50), 0.55, 0.99)
        prior_now = float(np.clip((weights @ good + 8) / (weights.sum() + 10), 0.01, 0.99))
        done = max(np.abs(now - accuracy).max(initial=0), abs(prior_now - prior)) < 1e-10
        prior, accuracy = prior_now, now
        if done:
            break
    return prior, accuracy


def posterior(votes: Sequence[str], prior: float, accuracy: np.ndarray) -> Column:
    """P(good | votes) as one expression over vote columns."""
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for name, weight in zip(votes, np.log(accuracy / (1 - accuracy)).tolist(), strict=True):
        odds = odds + F.col(name) * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _fit(voted: DataFrame, votes: list[str]) -> tuple[float, np.ndarray]:
    seen = voted.groupBy(*votes).count().orderBy(*votes).collect()
    patterns = np.array([[r[v] for v in votes] for r in seen], np.int64).reshape(-1, len(votes))
    return fit_votes(patterns, np.array([r["count"] for r in seen], float))


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def quality_posterior(docs: DataFrame) -> DataFrame:
    """text_counts with a vote_ column for each rule and p_good, the posterior of good quality."""
    votes = {f"vote_{k}": v for k, v in rules().items()}
    counted = durable(text_counts(docs).withColumns(votes))
    prior, accuracy = _fit(counted, list(votes))
    return counted.withColumn("p_good", posterior(list(votes), prior, accuracy))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """quality_posterior with base_failed and kept: not base_failed, and p_good at least ``least``."""
    return quality_posterior(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that judge would keep, with all their columns, each judged by its own text.

    The texts are counted once: the rows stand in the scratch folder with their votes until the rules are fitted.
    """
    votes = {f"vote_{k}": v for k, v in rules().items()}
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    counted = counted_rows(docs.select(row.alias("row"))).withColumns(votes)
    voted = durable(counted.select("row", base_failed().alias("base_failed"), *votes))
    prior, accuracy = _fit(voted, list(votes))
    return voted.where(~F.col("base_failed") & (posterior(list(votes), prior, accuracy) >= least)).select("row.*")
