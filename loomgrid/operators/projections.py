"""Linear maps learned from one Gram matrix, applied as one projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.base import Operator, as_list, gram, linear, solve


def scalar_projection(df: DataFrame, vec: str, unto: str) -> float:
    """The multiple of column ``unto`` nearest to column ``vec``."""
    a, b = F.col(vec).cast("double"), F.col(unto).cast("double")
    return df.agg(F.try_divide(F.sum(a * b), F.sum(b * b))).first()[0] or 0.0


def vector_projection(df: DataFrame, vec: str, unto: str, output: str = "projection") -> DataFrame:
    return df.withColumn(output, F.col(unto) * F.lit(scalar_projection(df, vec, unto)))


class Projection(Operator):
    """Features times a learned matrix."""

    def _map(self, df: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
        return df.withColumns({n: linear(self.features, matrix[:, k]) for k, n in enumerate(names)})


class LinearEmbedder(Projection):
    """Scales each feature by its ridge coefficient (no intercept); of several labels the mean coefficient counts."""

    def __init__(self, features, label, alpha: float = 1.0) -> None:
        self.features, self.label, self.alpha = as_list(features), as_list(label), alpha

    def _fit(self, df: DataFrame) -> None:
        d, g = len(self.features), gram(df, [*self.features, *self.label])
        self.coef_ = solve(g[:d, :d] + self.alpha * np.eye(d), g[:d, d:]).mean(1)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, self.features, np.diag(self.coef_))


class OrthogonalTransformer(Projection):
    """Makes columns orthogonal to those before them; ``normalize`` also makes them of length one over the fitted rows.

    R of the QR decomposition is the Cholesky factor of the Gram matrix, with a positive diagonal.
    """

    def __init__(self, features, normalize: bool = False) -> None:
        self.features, self.normalize = as_list(features), normalize

    def _fit(self, df: DataFrame) -> None:
        r = np.linalg.cholesky(gram(df, self.features)).T
        self.inv_R_ = np.linalg.inv(r)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, self.features, self.inv_R_)


class InformationFilter(Projection):
    """Removes what sensitive columns say linearly about the others; ``alpha`` 1 removes all, 0 nothing."""

    def __init__(self, features, columns, alpha: float = 1) -> None:
        self.features, self.columns, self.alpha = as_list(features), as_list(columns), alpha

    def _fit(self, df: DataFrame) -> None:
        if missing := [c for c in self.columns if c not in self.features]:
            raise KeyError(f"sensitive columns {missing} are not among the features")
        s = [self.features.index(c) for c in self.columns]
        self.col_ids_, g = s, gram(df, self.features)
        selected = np.eye(len(g))[:, s]
        fair = np.eye(len(g)) - selected @ solve(g[np.ix_(s, s)], g[s])
        keep = [i for i in range(len(g)) if i not in s]
        self.names_ = [self.features[i] for i in keep]
        self.projection_ = (self.alpha * fair + (1 - self.alpha) * np.eye(len(g)))[:, keep]

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, self.names_, self.projection_).drop(*self.columns)
