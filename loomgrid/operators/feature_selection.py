"""Greedy choice of features that say much about the label and little about one another."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.base import Operator, as_list, centred


def f_regression(df: DataFrame, features: list[str], label: str) -> np.ndarray:
    n, _, s = centred(df, [*features, label])
    d = np.diag(s)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = s[:-1, -1] ** 2 / (d[:-1] * d[-1])
        return np.nan_to_num(r2 / (1 - r2) * (n - 2))


def f_classification(df: DataFrame, features: list[str], label: str) -> np.ndarray:
    """ANOVA F of each feature over the labels, from one grouped aggregation around the overall means."""
    _, means, _ = centred(df, features)
    x = {c: F.col(c).cast("double") - float(m) for c, m in zip(features, means)}
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s_{c}") for c, v in x.items()], *[F.sum(v * v).alias(f"q_{c}") for c, v in x.items()]).collect()
    n = np.array([r.n for r in rows], float)
    s, q = (np.array([[r[f"{k}_{c}"] for c in features] for r in rows]) for k in "sq")
    between = (s**2 / n[:, None]).sum(0) - s.sum(0) ** 2 / n.sum()
    within = q.sum(0) - (s**2 / n[:, None]).sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num((between / max(len(rows) - 1, 1)) / (within / max(n.sum() - len(rows), 1)))


class MaximumRelevanceMinimumRedundancy(Operator):
    """Keeps ``k`` features. ``kind`` is regression, classification or auto (classification for labels that aren't
    floating-point). Functions may replace relevance ``f`` (df, features, label) and redundancy ``p`` (correlations,
    selected, left); all correlations come from one aggregation."""

    def __init__(self, features, label: str, k: int, relevance_func: str | Callable = "f", redundancy_func: str | Callable = "p", kind: str = "auto") -> None:
        self.features, self.label, self.k, self.relevance_func, self.redundancy_func, self.kind = as_list(features), label, k, relevance_func, redundancy_func, kind

    def _fit(self, df: DataFrame) -> None:
        if not isinstance(self.k, int) or not 1 <= self.k <= len(self.features):
            raise ValueError(f"k has to be a whole number from 1 to {len(self.features)}")
        if self.kind not in ("auto", "regression", "classification"):
            raise ValueError("kind has to be auto, regression or classification")
        if not (callable(self.relevance_func) or self.relevance_func == "f") or not (callable(self.redundancy_func) or self.redundancy_func == "p"):
            raise ValueError("relevance_func has to be 'f' and redundancy_func 'p', or functions")
        if self.k == len(self.features):
            warnings.warn("k equals the number of features: all are kept", stacklevel=3)
            self.selected_features_, self.scores_ = list(self.features), np.ones(self.k)
            return
        regression = self.kind == "regression" or (self.kind == "auto" and dict(df.dtypes)[self.label] in ("float", "double"))
        relevance = self.relevance_func if callable(self.relevance_func) else f_regression if regression else f_classification
        gain = np.asarray(relevance(df, self.features, self.label), float)
        _, _, s = centred(df, self.features)
        with np.errstate(divide="ignore", invalid="ignore"):
            correlations = np.nan_to_num(s / np.sqrt(np.outer(np.diag(s), np.diag(s))))
        redundancy = self.redundancy_func if callable(self.redundancy_func) else lambda r, chosen, left: np.abs(r[np.ix_(left, chosen)]).sum(1)
        left, chosen, scores = list(range(len(self.features))), [], []
        while len(chosen) < self.k:
            cost = redundancy(correlations, chosen, left) / len(chosen) if chosen else np.ones(len(left))
            with np.errstate(divide="ignore"):
                score = gain[left] / cost
            best = int(np.argmax(score))
            scores.append(float(score[best]))
            chosen.append(left.pop(best))
        self.selected_features_, self.scores_ = [self.features[i] for i in chosen], np.array(scores)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.selected_features_)
