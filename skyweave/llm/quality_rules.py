"""Learned decision lists: rules that reject, learnt from labelled statistics.

Sequential covering: a rule is grown condition by condition (the threshold with
the best information gain) on two thirds of the labelled rows, then pruned from
its end on the rest. A rule is kept while it is precise enough on both parts;
the rows that it covers are removed and the next is grown. The list becomes
one ordered Spark `CASE WHEN`, so the verdict runs inside Spark's plan.

Nulls: a null text counts as an empty one; null ids or labels don't teach.
Without labels of both classes the list is empty and only the base rules
reject. Repeated ids keep a row each; extra columns go.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, written
from .text import beside_stats, with_stats

#: What a condition can look at, as SQL over the statistics of a text.
MEASURES = {
    "words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaim / greatest(n_words, 1)",
    "stops_per_word": "n_commas_stops / greatest(n_words, 1)",
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Condition:
    measure: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.measure]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = F.expr(list(MEASURES.values())[self.measure])
        return v >= self.threshold if self.above else v <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _best_condition(x: np.ndarray, bad: np.ndarray, steps: int) -> Condition | None:
    """The threshold with the best gain: bad rows kept, times the rise of the log share of bad rows."""
    total, n_bad = len(x), bad.sum()
    best, found = 1e-9, None
    for m in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, m], np.linspace(0, 1, steps), method="nearest"))
        order = np.argsort(x[:, m], kind="stable")
        values, cum = x[order, m], np.concatenate([[0], np.cumsum(bad[order])])
        for above in (True, False):
            at = np.searchsorted(values, cuts, side="left" if above else "right")
            n = total - at if above else at
            p = n_bad - cum[at] if above else cum[at]
            gain = np.where(p > 0, p * (np.log(np.maximum(p, 1) / np.maximum(n, 1)) - np.log(n_bad / total)), -1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], Condition(m, above, float(cuts[k]))
    return found


def learn(x: np.ndarray, bad: np.ndarray, fold: np.ndarray, precision: float = 0.9, support: int = 5, conditions: int = 4, rules: int = 16, steps: int = 64) -> list[Rule]:
    """An ordered list of rejecting rules. x: a row of MEASURES for each text; fold: True for rows that grow, False for rows that prune."""
    found: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(found) < rules:
        grow, prune = left & fold, left & ~fold
        if bad[grow].sum() < support:
            break
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < conditions and bad[inside].any() and not bad[inside].all():
            c = _best_condition(x[inside], bad[inside], steps)
            if c is None:
                break
            rule += (c,)
            inside &= c.holds(x)
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray = prune) -> float:
            hit = covers(r, x[rows])
            p, n = bad[rows][hit].sum(), (~bad[rows][hit]).sum()
            return (p - n) / (p + n) if p + n else -1

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        hit = covers(rule, x) & left
        own = bad[hit]
        if own.sum() < support or own.mean() < precision or worth(rule) < 2 * precision - 1:
            break
        found.append(rule)
        left &= ~hit
    return found


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: true is keep."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def sampled(labels: DataFrame, label_col: str, folds: int = 5, held_fold: int = 0, sample: int = 50_000) -> DataFrame:
    """(doc_id, label_) of at most `sample` labels outside the held-out fold: the first by a hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label_")).where("label_ in (0, 1) and doc_id is not null")
    return known.where(remainder("doc_id", folds) != held_fold).orderBy(F.xxhash64("doc_id"), "doc_id", "label_").limit(sample)


def learn_from(stats: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held_fold: int = 0, sample: int = 50_000) -> list[Rule]:
    """Learn from at most `sample` labels, and as many rows, outside the held-out fold. The labels are broadcast, so no statistics move."""
    rows = stats.join(F.broadcast(sampled(labels, label_col, folds, held_fold, sample)), "doc_id")
    measured = rows.select(*(F.expr(v).alias(k) for k, v in MEASURES.items()), "label_", F.xxhash64("doc_id").alias("at_"))
    pdf = measured.orderBy("at_", "label_", *MEASURES).limit(sample).toPandas()
    if pdf["label_"].nunique() < 2:
        return []
    return learn(pdf[list(MEASURES)].to_numpy(float), pdf["label_"].to_numpy() == 0, pdf["at_"].to_numpy() % 3 != 0)


def apply_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs (doc_id, text)."""
    stats = written(with_stats(docs), "rule-stats")
    rules = learn_from(stats, labels, label_col)
    failed = F.expr(BASE_FAILED)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns, that neither the base rules nor the learned list rejects."""
    # statistics of labelled documents alone are made to learn from, then those of all documents once
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sampled(labels, label_col).select("doc_id").distinct()), "doc_id")
    rules = learn_from(with_stats(taught), labels, label_col)
    return beside_stats(docs).where(~F.expr(BASE_FAILED) & verdict(rules)).select("row_.*")
