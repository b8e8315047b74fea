"""Outliers by the error of a low-dimensional reconstruction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.base import Detector, centred, total


class PCAOutlierDetection(Detector):
    """Outliers are rows whose absolute reconstruction error (over the row's sum if ``relative``) is above the threshold.

    ``whiten`` scales what lies between projection and reconstruction, which undoes it: it is accepted and changes nothing."""

    def __init__(self, features, n_components: int | float | None = None, threshold: float | None = None, variant: str = "relative", whiten: bool = False, **names) -> None:
        super().__init__(features, **names)
        if variant not in ("relative", "absolute"):
            raise ValueError("variant has to be relative or absolute")
        self.n_components, self.threshold, self.variant, self.whiten = n_components, threshold, variant, whiten

    def _fit(self, df: DataFrame) -> None:
        if not self.threshold:
            raise ValueError("set a threshold other than 0")
        n, self.mean_, s = centred(df, self.features)
        values, vectors = np.linalg.eigh(s / max(n - 1, 1))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        k = len(values) if self.n_components is None else self.n_components
        if isinstance(k, float) and k < 1:
            k = int(np.searchsorted(values.cumsum() / values.sum(), k) + 1)
        self.explained_variance_, self.components_ = values[: int(k)], vectors[:, : int(k)].T
        self.offset_ = -self.threshold

    def difference(self) -> Column:
        gaps = [F.col(c).cast("double") - float(m) for c, m in zip(self.features, self.mean_)]
        lost = np.eye(len(gaps)) - self.components_.T @ self.components_
        error = total([F.abs(total([g * float(lost[i, j]) for i, g in enumerate(gaps)])) for j in range(len(gaps))])
        return F.try_divide(error, total([F.col(c).cast("double") for c in self.features])) if self.variant == "relative" else error

    def score_samples(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return df.withColumn(self.score, -self.difference())

    def decision(self) -> Column:
        return F.coalesce(self.threshold - self.difference(), F.lit(0.0))


class UMAPOutlierDetection(Detector):
    """Needs the umap-learn package, which can't be replaced by another projection; absent here."""

    def __init__(self, features, n_components: int = 2, threshold: float | None = None, variant: str = "relative", n_neighbors: int = 15, min_dist: float = 0.1, metric: str = "euclidean", random_state: int | None = None, **names) -> None:
        super().__init__(features, **names)
        self.n_components, self.threshold, self.variant = n_components, threshold, variant
        self.options = {"n_neighbors": n_neighbors, "min_dist": min_dist, "metric": metric, "random_state": random_state}

    def _fit(self, df: DataFrame) -> None:
        if not self.threshold:
            raise ValueError("set a threshold other than 0")
        try:
            import umap
        except ImportError as e:
            raise ImportError("UMAPOutlierDetection needs umap-learn: pip install umap-learn") from e
        rows = np.array(df.select(*self.features).collect(), float)  # the method itself needs all training rows at once
        self.umap_ = umap.UMAP(n_components=self.n_components, **self.options).fit(rows)

    def decision(self) -> Column:
        model, relative, threshold = self.umap_, self.variant == "relative", self.threshold

        @F.pandas_udf("double")
        def left(frame: pd.DataFrame) -> pd.Series:
            x = frame.to_numpy(float)
            d = np.abs(model.inverse_transform(model.transform(x)) - x).sum(1)
            return pd.Series(threshold - (d / x.sum(1) if relative else d))

        return left(F.struct(*self.features))
