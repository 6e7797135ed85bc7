"""Regularised quadratic discriminant over document statistics.

Statistics of every whole text are transformed to be near to normal. Class
counts, means and second moments of the labelled rows are sums that Spark
aggregates, so all labelled rows count. Each class covariance is shrunk towards
the pooled covariance (by `pool`) and then towards that one's diagonal (by
`shrink`); its Cholesky factor is computed once
and sent to the tasks, which score by Mahalanobis log-density differences.

Nulls: a null text scores as an empty one. A row whose label or text id is
null doesn't train; a null id belongs to fold 0, the held-out one. Labels that disagree for an id are all used. With fewer
than two classes among the labelled rows each score is the share of label 1
(0.5 without labels). Repeated ids keep a row each; extra columns go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, written
from .text import STATS, with_stats


def transform(stats: np.ndarray) -> np.ndarray:
    """Features of rows of STATS: logs of sizes, and logs of shares."""
    s = {name: stats[:, k].astype(float) for k, name in enumerate(STATS)}
    share = lambda a, b: np.log(0.003 + s[a] / np.maximum(s[b], 1))
    return np.stack(
        [
            np.log1p(s["n_words"]),
            np.log1p(s["word_chars"] / np.maximum(s["n_words"], 1)),
            share("n_symbols", "n_words"),
            share("n_dup_lines", "n_lines"),
            share("n_repeat_words", "n_words"),
            share("n_distinct_words", "n_words"),
            share("n_upper", "word_chars"),
            share("n_digits", "word_chars"),
            share("n_marks", "n_words"),
            share("n_exclaim", "n_words"),
            share("n_commas_stops", "n_words"),
            share("n_long_words", "n_words"),
            share("n_foreign", "word_chars"),
            np.log1p(s["n_words"] / np.maximum(s["n_lines"], 1)),
        ],
        axis=1,
    )


@dataclass
class Model:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, half its log determinant."""

    log_prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    half_log_det: np.ndarray

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = (x - self.mean[k]) @ self.whiten[k].T
        return self.log_prior[k] - self.half_log_det[k] - 0.5 * (z * z).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        gap = self.log_density(x, 1) - self.log_density(x, 0)
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        stats = np.stack([batch.column(k).to_numpy() for k in range(len(STATS))], axis=1)
        label = batch.column(len(STATS)).to_numpy()
        x = transform(stats)
        x = np.hstack([np.ones((len(x), 1)), x])
        for k in np.unique(label):
            own = x[label == k]
            sums[k] = sums.get(k, 0) + own.T @ own
    rows = [(int(k), i, v) for k, m in sums.items() for i, v in enumerate(m.ravel())]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["label", "cell", "value"])


def fit(stats: DataFrame, labels: DataFrame, label_col: str, pool: float = 0.1, shrink: float = 0.1, ridge: float = 0.02) -> Model | float:
    """From (doc_id, STATS...) and labels (doc_id, label_col). The moments of all labelled rows are summed by Spark.

    Returns the share of label 1 alone where only one class has rows.
    """
    rows = stats.join(labels.select("doc_id", F.col(label_col).cast("int").alias("label_")).where("label_ in (0, 1)"), "doc_id")
    sums = rows.select(*STATS, "label_").mapInArrow(_moments, "label long, cell long, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    size = len(transform(np.zeros((1, len(STATS)), np.int64))[0]) + 1
    moment = np.zeros((2, size * size))
    for r in sums:
        moment[r["label"], r["cell"]] = r["value"]
    moment = moment.reshape(2, size, size)
    n = moment[:, 0, 0]
    if min(n) < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    mean = moment[:, 0, 1:] / n[:, None]
    cov = moment[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    floor = ridge * np.diag(np.diag(pooled) + 1e-3)
    whiten, half = [], []
    for k in range(2):
        lower = np.linalg.cholesky((1 - shrink) * ((1 - pool) * cov[k] + pool * pooled) + shrink * np.diag(np.diag(pooled)) + floor)
        whiten.append(np.linalg.inv(lower))
        half.append(np.log(np.diag(lower)).sum())
    return Model(np.log(n / n.sum()), mean, np.array(whiten), np.array(half))


def score(stats: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of each row of (doc_id, STATS...)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = transform(np.stack([batch.column(k + 1).to_numpy() for k in range(len(STATS))], axis=1))
            p = model.score(x) if isinstance(model, Model) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return stats.select("doc_id", *STATS).mapInArrow(batches, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held_fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text), learnt from the folds that aren't held out."""
    stats = written(with_stats(docs), "quality-stats")
    model = fit(stats.where(remainder("doc_id", folds) != held_fold), labels, label_col)
    return score(stats, model).select("doc_id", (remainder("doc_id", folds) == held_fold).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
