"""Splits for validation, as filters of the same DataFrame; bounds come from one small aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TimeGapSplit:
    """Folds along a timestamp column: training, a gap, validation, then on by a stride; ``window`` rolling or expanding."""

    def __init__(self, date_col: str, valid_duration: timedelta, train_duration: timedelta | None = None, gap_duration: timedelta = timedelta(0), stride_duration: timedelta | None = None, n_splits: int | None = None, window: str = "rolling") -> None:
        if train_duration is None and n_splits is None:
            raise ValueError("give train_duration, n_splits or both")
        if window not in ("rolling", "expanding"):
            raise ValueError("window has to be rolling or expanding")
        if train_duration is not None and train_duration <= gap_duration:
            raise ValueError("the gap has to be shorter than the training time")
        if stride_duration is not None and stride_duration <= timedelta(0):
            raise ValueError("stride_duration has to be positive")
        self.date_col, self.valid_duration, self.train_duration, self.gap_duration = date_col, valid_duration, train_duration, gap_duration
        self.stride_duration, self.n_splits, self.window = stride_duration or valid_duration, n_splits, window

    def bounds(self, df: DataFrame) -> list[tuple]:
        """(train from, train to, valid from, valid to) of each fold; ends are exclusive."""
        first, last = df.agg(F.min(self.date_col), F.max(self.date_col)).first()
        if first is None:
            raise ValueError("no dates")
        length, gap, valid, stride = last - first, self.gap_duration, self.valid_duration, self.stride_duration
        train = self.train_duration if self.train_duration is not None else length - (gap + valid + (self.n_splits - 1) * stride)
        if train <= gap:
            raise ValueError("the gap has to be shorter than the training time")
        most = 1 + (length - train - gap - valid) / stride
        if self.n_splits and most < self.n_splits:
            raise ValueError(f"{self.n_splits} folds were requested, but only {most:.2f} are possible")
        shift = stride * (most / self.n_splits) if self.n_splits is not None else stride
        out, at = [], first
        while at + train + shift + gap <= last:
            out.append((at if self.window == "rolling" else first, at + train, at + train + gap, at + train + gap + valid))
            at = at + shift
        return out

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        c = F.col(self.date_col)
        for a, b, v, w in self.bounds(df):
            yield df.where((c >= a) & (c < b)), df.where((c >= v) & (c < w))

    def get_n_splits(self, df: DataFrame) -> int:
        return len(self.bounds(df))

    def summary(self, df: DataFrame) -> DataFrame:
        """A row for each fold and part, from one pass over the dates."""
        c, asks, parts = F.col(self.date_col), [], []
        for k, (a, b, v, w) in enumerate(self.bounds(df)):
            for part, low, high in (("train", a, b), ("valid", v, w)):
                hit = F.when((c >= low) & (c < high), c)
                asks.append(F.struct(F.lit(k).alias("fold"), F.lit(part).alias("part"), F.min(hit).alias("start_date"), F.max(hit).alias("end_date"), F.count(hit).alias("n_rows"), F.count_distinct(hit).alias("unique_dates")))
                parts.append(part)
        rows = df.agg(*[a.alias(f"f{i}") for i, a in enumerate(asks)])
        each = rows.select(F.explode(F.array(*[F.col(f"f{i}") for i in range(len(asks))])).alias("r")).select("r.*")
        return each.withColumn("period", F.date_diff("end_date", "start_date")).select("fold", "part", "start_date", "end_date", "period", "unique_dates", "n_rows")


class ClusterFoldValidation:
    """Each cluster is the test part of one fold. ``cluster_method`` is an MLlib clusterer (fitted or not)."""

    def __init__(self, features, cluster_method=None, fold: str = "fold") -> None:
        from pyspark.ml.clustering import KMeans

        self.features, self.fold = list(features), fold
        self.cluster_method = cluster_method or KMeans(k=5, seed=1)

    def tagged(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        rows = VectorAssembler(inputCols=self.features, outputCol="__features").transform(df)
        m = self.cluster_method
        if hasattr(m, "fit"):
            m = m.fit(rows, {m.getParam("featuresCol"): "__features", m.getParam("predictionCol"): "__cluster"})
        else:
            m = m.copy({m.getParam("featuresCol"): "__features", m.getParam("predictionCol"): "__cluster"})
        return m.transform(rows).select(*df.columns, F.col("__cluster").alias(self.fold))

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        tagged = self.tagged(df)
        folds = sorted(r[0] for r in tagged.select(self.fold).distinct().collect())
        if len(folds) < 2:
            raise ValueError("all rows are in one cluster, which leaves nothing to train on")
        for k in folds:
            yield tagged.where(F.col(self.fold) != k).drop(self.fold), tagged.where(F.col(self.fold) == k).drop(self.fold)


class KlusterFoldValidation(ClusterFoldValidation):
    """Other name of ClusterFoldValidation."""


class GroupTimeSeriesSplit:
    """Sorted groups are cut into n_splits + 1 runs of nearly equal rows; fold i trains on run i and tests on run i + 1."""

    MOST_GROUPS = 5000

    def __init__(self, group_col: str, n_splits: int) -> None:
        if n_splits < 1:
            raise ValueError("n_splits has to be at least 1")
        self.group_col, self.n_splits = group_col, n_splits

    @staticmethod
    def cuts(sizes: list[int], parts: int) -> list[int]:
        """First group of each run but the first: least sum of distances from the mean size, the earliest cuts of ties.

        The first run may only end, and the last only begin, where they hold nearly a mean size (over nine tenths).
        """
        n, total = len(sizes), sum(sizes)
        if n < parts:
            raise ValueError(f"{parts} runs need at least as many groups, found {n}")
        ends, ideal = np.concatenate([[0], np.cumsum(sizes)]), total / parts
        best: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {}

        low = next((i for i in range(n) if ends[i + 1] - 1 >= 0.9 * ideal), n)
        high = n - next((i for i in range(n) if total - ends[n - 1 - i] - 1 >= 0.9 * ideal), n) + 1
        allowed = set(range(max(low, 1), min(high, n)))
        allowed = allowed if len(allowed) >= parts - 1 else set(range(1, n))

        def cost(a: int, b: int) -> int:  # in whole numbers, so that ties are ties
            return abs(int(ends[b] - ends[a]) * parts - total)

        for a in range(n):
            best[1, a] = (cost(a, n), ())
        for k in range(2, parts + 1):
            for a in range(n):
                options = [(cost(a, b) + best[k - 1, b][0], (b, *best[k - 1, b][1])) for b in range(a + 1, n) if b in allowed and (k - 1, b) in best]
                if options:
                    best[k, a] = min(options)
        return list(best[parts, 0][1])

    def blocks(self, df: DataFrame) -> list[tuple]:
        """(first group, last group, rows, groups) of each run."""
        found = df.where(F.col(self.group_col).isNotNull()).groupBy(self.group_col).count().limit(self.MOST_GROUPS + 1).collect()
        if len(found) > self.MOST_GROUPS:
            raise ValueError(f"more than {self.MOST_GROUPS} groups: the search over all cuts is for fewer, such as days or weeks")
        counts = sorted((r[0], r[1]) for r in found)
        cuts = [0, *self.cuts([n for _, n in counts], self.n_splits + 1), len(counts)]
        return [(counts[a][0], counts[b - 1][0], sum(n for _, n in counts[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]

    def block_of(self, blocks: list[tuple]) -> Column:
        c, out = F.col(self.group_col), None
        for k, (_, last, _, _) in enumerate(blocks):
            out = F.when(c <= F.lit(last), k) if out is None else out.when(c <= F.lit(last), k)
        return out

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        blocks, c = self.blocks(df), F.col(self.group_col)
        for (a, b, _, _), (x, y, _, _) in zip(blocks, blocks[1:]):
            yield df.where(c.between(a, b)), df.where(c.between(x, y))

    def get_n_splits(self) -> int:
        return self.n_splits

    def summary(self, df: DataFrame) -> DataFrame:
        blocks = self.blocks(df)
        tagged = df.withColumn("block", self.block_of(blocks))
        return tagged.groupBy("block").agg(F.min(self.group_col).alias("first_group"), F.max(self.group_col).alias("last_group"), F.count("*").alias("n_rows"), F.count_distinct(self.group_col).alias("n_groups"))
