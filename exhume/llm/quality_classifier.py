"""Quality classifier: regularised quadratic discriminant over text statistics, scored inside Spark expressions."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.llm.text_stats import ratio, with_stats

#: Part of the pooled covariance in each class covariance, and part of the diagonal in the result.
TO_POOLED, TO_DIAGONAL = 0.3, 0.2
THRESHOLD = 0.3


def features() -> dict[str, Column]:
    """Transformed statistics: ratios on a logarithmic scale with a floor, counts as logarithms."""
    log = lambda c, floor=0.02: F.log(c + floor)
    return {
        "length": F.log1p(F.col("stats.n_words").cast("double")),
        "word_length": F.log1p(ratio("word_chars", "n_words")),
        "symbols": log(ratio("n_symbols", "n_words")),
        "stop": log(ratio("n_stop", "n_words")),
        "upper": log(ratio("n_upper", "word_chars")),
        "marks": log(ratio("n_marks", "n_words")),
        "repeats": log(ratio("n_repeat_words", "n_words")),
        "distinct": log(ratio("n_distinct", "n_words")),
        "lines": log(ratio("n_dup_lines", "n_lines")),
    }


class Model(NamedTuple):
    """Means and inverse Cholesky factors by class, in scaled space, and the log odds of the classes."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    offset: float


def fit(training: DataFrame, label: str = "quality") -> Model | float:
    """Class moments from one aggregation over all rows of ``training`` (columns of ``features()`` and the label).

    Only classes x features x features numbers reach the driver. With one class or none there is nothing
    to tell apart: the constant score (1, 0 or 0.5) is returned. Rows with a null label don't count.
    """
    names = list(features())
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    got = (
        training.filter(F.col(label).isin(0, 1)).groupBy(label)
        .agg(
            F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(names)],
            *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
        ).collect()
    )
    rows = {r[label]: r for r in got}
    if len(rows) < 2:
        return float(next(iter(rows), 0.5))
    n = np.array([rows[c]["n"] for c in (0, 1)], dtype=float)
    means = np.array([[rows[c][f"m{i}"] for i in range(len(names))] for c in (0, 1)])
    covariances = np.zeros((2, len(names), len(names)))
    for c in (0, 1):
        for i, j in pairs:
            covariances[c, i, j] = covariances[c, j, i] = rows[c][f"c{i}_{j}"] or 0.0
    center = (n[:, None] * means).sum(0) / n.sum()
    within = (n[:, None, None] * covariances).sum(0) / n.sum()
    between = means - center
    total = within + np.einsum("c,ci,cj->ij", n / n.sum(), between, between)
    scale = np.sqrt(np.maximum(np.diag(total), 1e-6))
    within = within / np.outer(scale, scale)
    shrunk, factors, logdet = [], [], []
    for c in (0, 1):
        mixed = (1 - TO_POOLED) * covariances[c] / np.outer(scale, scale) + TO_POOLED * within
        # what is left of the spread goes to every direction alike, so that constant features stay harmless
        even = np.eye(len(names)) * max(np.trace(mixed) / len(names), 1e-3)
        shrunk.append((1 - TO_DIAGONAL) * mixed + TO_DIAGONAL * even)
        lower = np.linalg.cholesky(shrunk[c])
        factors.append(np.linalg.inv(lower))
        logdet.append(2 * np.log(np.diag(lower)).sum())
    offset = math.log(n[1] / n[0]) - 0.5 * (logdet[1] - logdet[0])
    return Model(center, scale, tuple((means - center) / scale), tuple(factors), offset)


def log_odds(model: Model) -> Column:
    """Difference of the classes' Mahalanobis log densities; a triangular factor is a handful of sums per class."""
    scaled = [(F.col(x) - float(m)) / float(s) for x, m, s in zip(features(), model.center, model.scale)]

    def distance(mean: np.ndarray, factor: np.ndarray) -> Column:
        total = F.lit(0.0)
        for i in range(len(scaled)):
            part = F.lit(0.0)
            for j in range(i + 1):
                part = part + (scaled[j] - float(mean[j])) * float(factor[i, j])
            total = total + part * part
        return total

    zero, one = (distance(m, f) for m, f in zip(model.means, model.factors))
    return F.lit(float(model.offset)) + (zero - one) * 0.5


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column per feature; null and empty texts have the values of no words."""
    counted = with_stats(docs, text)
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {*features(), "stats"}], *[c.alias(n) for n, c in features().items()])


def score(featured: DataFrame, model: Model | float) -> DataFrame:
    """``score`` (0 to 1, higher: label 1 likelier, six decimals) and ``predicted`` for every row; features are dropped."""
    if isinstance(model, Model):
        value = 1 / (1 + F.exp(-F.greatest(F.least(log_odds(model), F.lit(40.0)), F.lit(-40.0))))
    else:
        value = F.lit(model)
    scored = featured.withColumn("score", F.round(value, 6))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)).drop(*features())
