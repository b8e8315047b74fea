"""Column features: lags, periodic and spline bases, capping, and encoding by intervals of the label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.base import Operator, as_list, finite, number, refuse_stream, temp, total


def add_lags(df: DataFrame, cols, lags, order_by, partition_by=None, drop_na: bool = True) -> DataFrame:
    """Appends each column as it is ``lag`` rows later (earlier for negative lags), named column + lag.

    Rows are ordered by ``order_by`` within ``partition_by``; without keys one task orders all rows. With ``drop_na``
    rows with a null in any column go.
    """
    refuse_stream(df, "add_lags")
    cols = [df.columns[c] if isinstance(c, int) else c for c in as_list(cols)]
    if missing := [c for c in cols if c not in df.columns]:
        raise KeyError(f"no such columns: {missing}")
    if not all(isinstance(lag, int) for lag in as_list(lags)):
        raise ValueError("lags have to be whole numbers")
    place = Window.partitionBy(*as_list(partition_by)).orderBy(*as_list(order_by))
    shifted = {f"{c}{lag}": F.lead(c, lag).over(place) if lag >= 0 else F.lag(c, -lag).over(place) for c in cols for lag in as_list(lags)}
    out = df.withColumns(shifted)
    return out.dropna() if drop_na else out


ONE_PASS_ROWS = 2_000_000
BUCKETS = 1024
LAST_ROWS = 4096


def values_at(df: DataFrame, usable: Column, ranks: list[int], buckets: int = BUCKETS, last_rows: int = LAST_ROWS) -> dict[int, float]:
    """The exact values of some ranks (0-based) of a column, without one task ever holding its values.

    Each pass counts the rows of equal buckets of the intervals that hold a wanted rank, and goes on with the bucket of the
    rank; an interval of one value, or of no more than ``last_rows`` rows, which are then read, ends it.
    """
    column = df.select(usable.alias("v")).where(F.col("v").isNotNull())
    low, high, n = column.agg(F.min("v"), F.max("v"), F.count("*")).first()
    found: dict[int, float] = {}
    # Each interval: lowest and highest value, rows below it, rows in it, the ranks wanted of it.
    todo = [(low, high, 0, n, sorted(set(ranks)))]
    while todo:
        small = [t for t in todo if t[0] < t[1] and t[3] <= last_rows]
        for a, b, before, _, wanted in small:
            held = sorted(r[0] for r in column.where(F.col("v").between(a, b)).collect())  # at most last_rows
            found |= {r: held[r - before] for r in wanted}
        for a, b, _, _, wanted in todo:
            if a == b:
                found |= dict.fromkeys(wanted, a)
        todo = [t for t in todo if t[0] < t[1] and t[3] > last_rows]
        if not todo:
            break
        place = None
        for k, (a, b, _, _, _) in enumerate(todo):
            width = (b - a) / buckets or 5e-324
            at = F.struct(F.lit(k).alias("k"), F.least(F.floor((F.col("v") - a) / F.lit(width)), F.lit(buckets - 1)).alias("at"))
            inside = F.col("v").between(a, b)
            place = F.when(inside, at) if place is None else place.when(inside, at)
        counted = column.select("v", place.alias("p")).where("p is not null").groupBy("p.k", "p.at").agg(F.min("v"), F.max("v"), F.count("*")).orderBy("k", "at").collect()
        after = []
        for k, (_, _, before, _, wanted) in enumerate(todo):
            for _, _, a, b, size in (r for r in counted if r[0] == k):
                if inner := [r for r in wanted if before <= r < before + size]:
                    after.append((a, b, before, size, inner))
                before += size
        todo = after
    return found


MANY_RANKS = 64


def many_values_at(df: DataFrame, usable: Column, ranks: list[int]) -> dict[int, float]:
    """The same for many ranks: the distinct values are counted and dealt out in ranges, and each range finds its own ranks."""
    column = df.select(usable.alias("v")).where(F.col("v").isNotNull())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = column.groupBy("v").agg(F.count("*").alias("n")).repartitionByRange(parts, "v").sortWithinPartitions("v")
    counted = counted.withColumn("part", F.spark_partition_id()).cache()
    starts, before = {}, 0
    for part, _, n in counted.groupBy("part").agg(F.min("v"), F.sum("n")).orderBy(F.min("v")).collect():  # one row for each range
        starts[part], before = before, before + n
    wanted = np.array(sorted(set(ranks)))

    def find(batches):
        at = None
        for batch in batches:
            v, n, part = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(v):
                continue
            at = starts[int(part[0])] if at is None else at
            ends = at + np.cumsum(n)
            inside = wanted[(wanted >= at) & (wanted < ends[-1])]
            yield pa.RecordBatch.from_arrays([pa.array(inside, pa.int64()), pa.array(v[np.searchsorted(ends, inside, side="right")], pa.float64())], names=["r", "v"])
            at = int(ends[-1])

    found = dict(counted.mapInArrow(find, "r long, v double").collect())
    counted.unpersist()
    return found


def quantile(df: DataFrame, columns: list[str], points: list[float], interpolation: str = "linear", accuracy: int | None = None) -> dict[str, list[float | None]]:
    """Quantiles of the finite values of each column: exact, or with ``accuracy`` Spark's approximate ones (relative error of
    the rank 1 / accuracy; ``interpolation`` then says nothing). Up to ``ONE_PASS_ROWS`` rows one aggregation gives them."""
    modes = ("linear", "lower", "higher", "midpoint", "nearest")
    if interpolation not in modes:
        raise ValueError(f"interpolation has to be one of {modes}")
    usable = {c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    if accuracy is not None:
        row = df.agg(*[F.percentile_approx(usable[c], [float(p) for p in points], accuracy).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(points) for c in columns}
    counts = df.agg(*[F.count(usable[c]).alias(c) for c in columns]).first()
    wanted: dict[str, list[tuple[int, int, float]]] = {}
    for c in columns:
        wanted[c] = []
        for p in points:
            at = p * (counts[c] - 1) if counts[c] else 0.0
            low, high = int(np.floor(at)), int(np.ceil(at))
            near = low if at - low < 0.5 or (at - low == 0.5 and low % 2 == 0) else high
            wanted[c].append({"linear": (low, high, at - low), "lower": (low, low, 0.0), "higher": (high, high, 0.0), "nearest": (near, near, 0.0), "midpoint": (low, high, 0.5)}[interpolation])
    found = {}
    for c in columns:
        ranks = sorted({r for low, high, _ in wanted[c] for r in (low, high)})
        if not counts[c]:
            found[c] = {}
        elif len(ranks) > MANY_RANKS:  # one aggregation would look through all values for each of them
            found[c] = many_values_at(df, usable[c], ranks)
        elif counts[c] > ONE_PASS_ROWS:
            found[c] = values_at(df, usable[c], ranks)
        else:
            # The value of a rank r of n is the exact percentile r / (n - 1), which falls on it; rounding can't reach a neighbour.
            got = df.agg(F.percentile(usable[c], F.array(*[F.lit(r / max(counts[c] - 1, 1)) for r in ranks]))).first()[0]
            found[c] = dict(zip(ranks, got))
    return {c: [found[c][low] + (found[c][high] - found[c][low]) * part if found[c] else None for low, high, part in wanted[c]] for c in columns}


class ColumnCapper(Operator):
    """Clips columns to quantiles, exact ones unless ``accuracy`` is given. NaN and null stay; infinities become the caps, or
    null with ``discard_infs``."""

    def __init__(self, columns, quantile_range=(5.0, 95.0), interpolation: str = "linear", discard_infs: bool = False, accuracy: int | None = None) -> None:
        self.features, self.quantile_range, self.interpolation, self.discard_infs, self.accuracy = as_list(columns), quantile_range, interpolation, discard_infs, accuracy

    def _fit(self, df: DataFrame) -> None:
        low, high = self.quantile_range if len(self.quantile_range) == 2 else (1, 0)
        if not 0 <= low <= high <= 100:
            raise ValueError("quantile_range has to be two ascending numbers from 0 to 100")
        self.quantiles_ = quantile(df, self.features, [low / 100, high / 100], self.interpolation, self.accuracy)
        if empty := [c for c, q in self.quantiles_.items() if q[0] is None]:
            raise ValueError(f"columns {empty} hold no finite value")

    def _transform(self, df: DataFrame) -> DataFrame:
        def capped(c: str) -> Column:
            x, (low, high) = F.col(c).cast("double"), self.quantiles_[c]
            out = F.when(x.isNull() | F.isnan(x), x)
            if self.discard_infs:
                out = out.when(F.abs(x) == float("inf"), F.lit(None))
            return out.otherwise(F.greatest(F.least(x, F.lit(high)), F.lit(low)))

        return df.withColumns({c: capped(c) for c in self.features})


class RepeatingBasisFunction(Operator):
    """Gaussian bumps around ``n_periods`` places of a cycle: column_0 .. column_{n-1}. ``remainder`` keeps the others."""

    def __init__(self, column: str, remainder: str = "drop", n_periods: int = 12, input_range: tuple | None = None, width: float = 1.0) -> None:
        self.features, self.remainder, self.n_periods, self.input_range, self.width = [column], remainder, n_periods, input_range, width

    def _fit(self, df: DataFrame) -> None:
        c = F.col(self.features[0]).cast("double")
        self.range_ = tuple(map(float, self.input_range)) if self.input_range is not None else tuple(df.agg(F.min(c), F.max(c)).first())
        if self.range_[0] is None:
            raise ValueError("no value to take the range from")

    def _transform(self, df: DataFrame) -> DataFrame:
        (low, high), name = self.range_, self.features[0]
        x = (F.col(name).cast("double") - low) / F.lit((high - low) or 1.0)
        out = []
        for k in range(self.n_periods):
            gap = F.abs(x - k / self.n_periods)
            out.append(F.exp(-F.pow(F.least(gap, 1 - gap) / F.lit(self.width / self.n_periods), F.lit(2.0))).alias(f"{name}_{k}"))
        rest = [c for c in df.columns if c != name] if self.remainder == "passthrough" else []
        return df.select(*out, *rest)


class MonotonicSplineTransformer(Operator):
    """I-splines: column_k is the sum of the last k + 1 B-splines, rising from 0 to 1. Values beyond the knots act as the ends."""

    def __init__(self, columns, n_knots: int = 3, degree: int = 3, knots: str = "uniform", accuracy: int | None = None) -> None:
        self.features, self.n_knots, self.degree, self.knots, self.accuracy = as_list(columns), n_knots, degree, knots, accuracy

    def _fit(self, df: DataFrame) -> None:
        if self.knots not in ("uniform", "quantile"):
            raise ValueError("knots has to be uniform or quantile")
        points = [0.0, 1.0] if self.knots == "uniform" else [k / (self.n_knots - 1) for k in range(self.n_knots)]
        found = quantile(df, self.features, points, accuracy=self.accuracy if self.knots == "quantile" else None)
        self.knots_ = {c: np.linspace(q[0], q[-1], self.n_knots) if self.knots == "uniform" else np.array(q) for c, q in found.items()}

    def _basis(self, c: str) -> list[Column]:
        base, p = self.knots_[c], self.degree
        # Knots go on outside at the distance of the first and last pair, so that the pieces inside sum to one.
        t = np.concatenate([base[0] - (base[1] - base[0]) * np.arange(p, 0, -1), base, base[-1] + (base[-1] - base[-2]) * np.arange(1, p + 1)])
        x = F.greatest(F.least(F.col(c).cast("double"), F.lit(float(base[-1]))), F.lit(float(base[0])))
        last = len(base) - 2 + p  # the piece that holds the right end
        level = [F.when((x >= float(t[i])) & ((x <= float(t[i + 1])) if i == last else (x < float(t[i + 1]))), 1.0).otherwise(0.0) if i <= last else F.lit(0.0) for i in range(len(t) - 1)]
        for d in range(1, p + 1):
            share = lambda a, b, i: (a / F.lit(float(b))) * level[i] if b else F.lit(0.0)  # noqa: B023, E731
            level = [share(x - float(t[i]), t[i + d] - t[i], i) + share(F.lit(float(t[i + d + 1])) - x, t[i + d + 1] - t[i + 1], i + 1) for i in range(len(level) - 1)]
        return level

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.features:
            pieces, packed = self._basis(c), temp("basis")
            out = out.withColumn(packed, F.array(*pieces))
            last = [F.aggregate(F.slice(packed, len(pieces) - k, k + 1), F.lit(0.0), lambda a, b: a + b) for k in range(len(pieces))]
            out = out.withColumns({f"{c}_{k}": x for k, x in enumerate(last)}).drop(packed)
        return out.drop(*self.features)


def isotonic(y: np.ndarray, w: np.ndarray, increasing: bool = True) -> np.ndarray:
    """Weighted least squares under a monotone order, by pooling neighbours that violate it."""
    if not increasing:
        return -isotonic(-y, w)
    pools: list[list[float]] = []
    for v, k in zip(y, w):
        pools.append([v, k, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, k2, n2 = pools.pop()
            v1, k1, n1 = pools.pop()
            pools.append([(v1 * k1 + v2 * k2) / (k1 + k2), k1 + k2, n1 + n2])
    return np.concatenate([[v] * int(n) for v, _, n in pools]) if pools else np.zeros(0)


class IntervalEncoder(Operator):
    """Replaces columns by the label's level around quantile knots, linear between knots and flat beyond.

    ``average`` weighs the rows below knot + span by their nearness to the knot, ``normal`` all rows by a normal
    kernel of that width; ``increasing`` and ``decreasing`` fit monotone steps that change at the knots.
    """

    METHODS = ("average", "normal", "increasing", "decreasing")

    def __init__(self, columns, label: str, n_chunks: int = 10, span: float = 1, method: str = "normal", accuracy: int | None = None) -> None:
        self.features, self.label, self.n_chunks, self.span, self.method, self.accuracy = as_list(columns), label, n_chunks, span, method, accuracy

    def _fit(self, df: DataFrame) -> None:
        if self.method not in self.METHODS:
            raise ValueError(f"method has to be one of {self.METHODS}")
        if self.span > 1 or self.span < 0:
            raise ValueError("span has to be from 0 to 1")
        if self.n_chunks <= 0:
            raise ValueError("n_chunks has to be positive")
        points = np.linspace(0, 1, self.n_chunks)
        self.knots_, self.heights_ = {}, {}
        for c, q in quantile(df, self.features, list(points), accuracy=self.accuracy).items():
            knots = np.array(q, float)
            x, y = F.col(c).cast("double"), F.col(self.label).cast("double")
            if self.method in ("average", "normal"):
                gap = [F.abs(x - float(k)) for k in knots]
                near = [F.when(x < float(k) + self.span, 1 / (g + 0.01)).otherwise(0.0) for k, g in zip(knots, gap)]
                weight = near if self.method == "average" else [F.exp(-g * g / self.span) for g in gap]
                row = df.agg(*[F.try_divide(F.sum(w * y), F.sum(w)).alias(f"h{i}") for i, w in enumerate(weight)]).first()
                heights = np.array([np.nan if h is None else h for h in row])
            else:
                at = total([F.when(x >= float(k), 1.0).otherwise(0.0) for k in knots]).cast("int") - 1
                got = {r[0]: (r[1], r[2]) for r in df.where(x.isNotNull() & y.isNotNull()).groupBy(at.alias("k")).agg(F.avg(y), F.count("*")).collect()}
                seen = sorted(got)
                levels = isotonic(np.array([got[k][0] for k in seen]), np.array([got[k][1] for k in seen], float), self.method == "increasing")
                heights = np.interp(np.arange(len(knots)), seen, levels)  # knots without rows of their own lie between
            keep = np.r_[True, np.diff(knots) > 0]
            self.knots_[c], self.heights_[c] = knots[keep], heights[keep]

    def _transform(self, df: DataFrame) -> DataFrame:
        def encoded(c: str) -> Column:
            x, knots, heights = F.col(c).cast("double"), self.knots_[c], self.heights_[c]
            out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(x <= float(knots[0]), number(heights[0]))
            for a, b, u, v in zip(knots, knots[1:], heights, heights[1:]):
                out = out.when(x <= float(b), F.lit(float(u)) + (x - float(a)) * float((v - u) / (b - a)))
            return out.otherwise(number(heights[-1]))

        return df.withColumns({c: encoded(c) for c in self.features})
