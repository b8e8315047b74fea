"""Regressors and classifiers whose loss is a sum over rows: each step is one aggregation, solved on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.base import GRAM_EXPRESSIONS, Classifier, Regressor, as_list, check_small, gram, let, linear, normalised, shares, solve, total


class LinearRegression(Regressor):
    """Least squares with an optional ridge penalty that spares the intercept."""

    def __init__(self, features, label: str, alpha: float = 0.0, fit_intercept: bool = True, **names) -> None:
        super().__init__(features, label, **names)
        self.alpha, self.fit_intercept = alpha, fit_intercept

    def _fit(self, df: DataFrame) -> None:
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        d, means = len(self.features), np.zeros(len(self.features) + 1)
        if self.fit_intercept:
            row = df.agg(F.sum(w), *[F.sum(F.col(c).cast("double") * w) for c in [*self.features, self.label]]).first()
            means = np.array([x or 0.0 for x in row[1:]]) / (row[0] or 1.0)
        g = gram(df, [F.col(c).cast("double") - float(m) for c, m in zip([*self.features, self.label], means)], w)
        self.coef_ = solve(g[:d, :d] + self.alpha * np.eye(d), g[:d, d])
        self.intercept_ = float(means[d] - self.coef_ @ means[:d])

    def expr(self) -> Column:
        return linear(self.features, self.coef_, self.intercept_)


class RandomRegressor(Regressor):
    """Random predictions from the label's range (``uniform``) or its mean and population deviation (``normal``)."""

    def __init__(self, label: str, strategy: str = "uniform", random_state: int | None = None, features=(), **names) -> None:
        super().__init__(list(features), label, **names)
        self.strategy, self.random_state = strategy, random_state

    def _fit(self, df: DataFrame) -> None:
        if self.strategy not in ("uniform", "normal"):
            raise ValueError("strategy has to be uniform or normal")
        y = F.col(self.label).cast("double")
        self.min_, self.max_, self.mu_, self.sigma_ = df.agg(F.min(y), F.max(y), F.avg(y), F.stddev_pop(y)).first()

    def expr(self) -> Column:
        if self.strategy == "uniform":
            return self.min_ + F.rand(self.random_state) * (self.max_ - self.min_)
        return self.mu_ + F.randn(self.random_state) * self.sigma_


class LowessRegression(Regressor):
    """Weighted mean of the labels of near training rows: weight exp(-d^2 / sigma), and only rows within the
    ``span`` quantile of the distance. Every distinct point meets every training row: quadratic by nature, so
    more than ``most_rows`` training rows are an error, and no more are broadcast."""

    def __init__(self, features, label: str, sigma: float = 1.0, span: float | None = None, most_rows: int = 1_000_000, **names) -> None:
        super().__init__(features, label, **names)
        self.sigma, self.span, self.most_rows = sigma, span, most_rows

    def _fit(self, df: DataFrame) -> None:
        if self.span is not None and not 0 < self.span <= 1:
            raise ValueError("span has to be above 0 and at most 1")
        self.train_ = df.select(*[F.col(c).cast("double").alias(f"t{i}") for i, c in enumerate(self.features)], F.col(self.label).cast("double").alias("ty"))
        check_small(self.train_, self.most_rows)

    def expr(self) -> Column:
        raise NotImplementedError("Lowess compares rows with rows: use predict")

    def predict(self, df: DataFrame) -> DataFrame:
        self.check(df)
        names = [f.name for f in df.schema]
        point = F.struct(*[F.col(c).cast("double").alias(c) for c in self.features])
        distinct = df.select(point.alias("__point")).distinct()
        gap = F.sqrt(total([F.pow(F.col("__point")[c] - F.col(f"t{i}"), F.lit(2.0)) for i, c in enumerate(self.features)]))
        pairs = distinct.crossJoin(F.broadcast(self.train_)).select("__point", "ty", gap.alias("d"))
        weight = F.exp(-F.col("d") * F.col("d") / F.lit(self.sigma))
        if self.span is not None:
            near = pairs.groupBy("__point").agg(F.percentile("d", self.span).alias("cut"))
            pairs = pairs.join(near, "__point").where(F.col("d") <= F.col("cut"))
        means = pairs.groupBy("__point").agg(F.sum(weight * F.col("ty")).alias("wy"), F.sum(weight).alias("w"))
        mean = F.when(F.col("w") > 0, F.col("wy") / F.col("w")).otherwise(F.raise_error(F.lit("all weights are zero: raise sigma")).cast("double"))
        table = means.select("__point", mean.alias(self.prediction))
        return df.withColumn("__point", point).join(table, "__point").select(*names, self.prediction)

    _transform = predict


class ProbWeightRegression(Regressor):
    """Least squares with coefficients that sum to one and, by default, aren't negative; no intercept."""

    def __init__(self, features, label: str, non_negative: bool = True, **names) -> None:
        super().__init__(features, label, **names)
        self.non_negative = non_negative

    def _fit(self, df: DataFrame) -> None:
        g, d = gram(df, [*self.features, self.label]), len(self.features)
        a, b = g[:d, :d], g[:d, d]

        def on(active: list[int]) -> tuple[np.ndarray, float]:
            k = len(active)
            system = np.block([[a[np.ix_(active, active)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
            x = solve(system, np.append(b[active], 1.0))
            return x[:-1], x[-1]

        if not self.non_negative:
            self.coef_ = on(list(range(d)))[0]
            return
        # Active set: from one vertex, free the variable whose gradient says most, step back to the border if needed.
        best = int(np.argmin(np.diag(a) - 2 * b))
        x, active = np.eye(d)[best], [best]
        for _ in range(50 * d):
            while True:
                goal, _ = on(active)
                if (goal >= -1e-12).all():
                    x = np.zeros(d)
                    x[active] = np.maximum(goal, 0)
                    break
                now = x[active]
                step = min((n / (n - t), i) for i, (n, t) in enumerate(zip(now, goal)) if t < 0 and n > t)
                x[active] = now + step[0] * (goal - now)
                x[active[step[1]]] = 0
                active = [v for i, v in enumerate(active) if i != step[1]]
            slope = a @ x - b
            base = slope[active].mean()
            worst = int(np.argmin(slope))
            if worst in active or slope[worst] >= base - 1e-10 * max(1.0, np.abs(slope).max()):
                break
            active.append(worst)
        self.coef_ = x / x.sum()

    def expr(self) -> Column:
        return linear(self.features, self.coef_)


# ---------------------------------------------------------------- iterative minimisers


def bfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Quasi-Newton descent; each evaluation of value and gradient is one job."""
    h = np.eye(len(x))
    f, g = value(x)
    for _ in range(steps):
        if np.abs(g).max(initial=0) < tol:
            break
        p = -h @ g
        if p @ g >= 0:
            h, p = np.eye(len(x)), -g
        t = 1.0
        while True:
            x2 = x + t * p
            f2, g2 = value(x2)
            if f2 <= f + 1e-4 * t * (p @ g) or t < 1e-10:
                break
            t /= 2
        s, y = x2 - x, g2 - g
        if f - f2 <= tol * 1e-2 * max(1.0, abs(f)) and t < 1e-9:
            break
        done = abs(f - f2) <= 1e-13 * max(1.0, abs(f))
        x, f, g = x2, f2, g2
        if s @ y > 1e-14:
            r = 1 / (s @ y)
            v = np.eye(len(x)) - r * np.outer(s, y)
            h = v @ h @ v.T + r * np.outer(s, s)
        if done:
            break
    return x


class Rows:
    """The rows of a fit as numbers, kept by Spark between steps; sums of per-block numpy functions over all of them."""

    def __init__(self, df: DataFrame, columns: list[Column]) -> None:
        self.width = len(columns)
        self.table = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).cache()

    def sums(self, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches):
            out = None
            for batch in batches:
                part = np.asarray(function(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])), float)
                out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], names=["k", "v"])

        rows = self.table.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect()
        return np.array([v for _, v in sorted(rows)])

    def close(self) -> None:
        self.table.unpersist()


class MinimizeRegressor(Regressor):
    """Linear predictions under any row loss, plus alpha * (l1_ratio |w| + (1 - l1_ratio) / 2 w^2) over all parameters.

    Newton steps on the loss, whose corner is rounded within a width that shrinks as the steps go on; a subclass says in Spark's
    and in numpy's terms what the rounded loss is. Learning begins on the driver with at most ``SAMPLE_ROWS`` rows (those of the
    smallest hashes), so the whole table is passed over a dozen times or so, each one aggregation in the JVM. A table that
    small is its own sample and is passed over once. ``method`` is accepted for compatibility; there is one solver.
    ``positive`` keeps coefficients at 0 or above.
    """

    SAMPLE_ROWS = 20_000
    MOST_STEPS = 16
    corner = False  # whether the loss has one

    def __init__(self, features, label: str, alpha: float = 0.0, l1_ratio: float = 0.0, fit_intercept: bool = True, positive: bool = False, method: str = "SLSQP", **names) -> None:
        super().__init__(features, label, **names)
        if method not in ("SLSQP", "TNC", "L-BFGS-B"):
            raise ValueError("method has to be SLSQP, TNC or L-BFGS-B")
        self.alpha, self.l1_ratio, self.fit_intercept, self.positive, self.method = alpha, l1_ratio, fit_intercept, positive, method

    def parts(self, r, width: float, when: Callable) -> tuple:
        """(loss, slope, curvature, upper bound of the curvature) at residual r; ``when(condition, a, b)`` chooses."""
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> None:
        k = (F.col(self.weight) if self.weight else F.lit(1.0)).cast("double")
        inputs = [F.lit(1.0)] * self.fit_intercept + [F.col(c).cast("double") for c in self.features]
        y, d = F.col(self.label).cast("double"), len(inputs)
        rows = df.dropna(subset=[*self.features, self.label])
        n, mass, square = rows.agg(F.count("*"), F.sum(k), F.sum(k * y * y)).first()
        if not n:
            raise ValueError("no rows to learn from")
        near = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(inputs)], y.alias("y"), k.alias("k"))
        if n > self.SAMPLE_ROWS:
            share = F.pmod(F.xxhash64(*near.columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
            near = near.where(share < 0.9 * self.SAMPLE_ROWS / n).limit(self.SAMPLE_ROWS)
        table = near.toArrow()
        m = np.column_stack([table[c].to_numpy() for c in table.column_names])
        x, t, w = m[:, :d], m[:, d], m[:, d + 1]
        theta = solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ t)
        spread = float(np.sqrt(np.mean((t - x @ theta) ** 2))) if len(m) else 0.0
        spread = spread or float(np.sqrt(square / mass)) * 1e-6 or 1.0

        def sampled(theta, width):
            r = t - x @ theta
            loss, slope, _, bound = self.parts(r, width, lambda c, a, b: np.where(c, a, b))
            return (w * loss).sum() / w.sum(), x.T @ (w * slope) / w.sum(), (x * (w * bound * np.ones(len(w)))[:, None]).T @ x / w.sum(), len(w)

        pairs = [(i, j) for i in range(d) for j in range(i, d)]

        def whole(theta, width):
            r = y - total([c * float(v) for c, v in zip(inputs, theta)])
            loss, slope, curve, _ = self.parts(r, width, lambda c, a, b: F.when(c, a).otherwise(b))
            asks = [F.sum(k * loss), *[F.sum(k * slope * c) for c in inputs], *[F.sum(k * curve * inputs[i] * inputs[j]) for i, j in pairs], F.sum(F.when(F.abs(r) < width, 1).otherwise(0))]
            got = np.array([v or 0.0 for v in rows.agg(*[a.alias(f"s{i}") for i, a in enumerate(asks)]).first()], float)
            h = np.zeros((d, d))
            for (i, j), v in zip(pairs, got[1 + d : -1]):
                h[i, j] = h[j, i] = v
            return got[0] / mass, got[1 : d + 1] / mass, h / mass, got[-1]

        if len(m):
            theta = self._descend(sampled, theta, spread, 1e-9 * spread, 400, 0)
        if n > self.SAMPLE_ROWS:
            theta = self._descend(whole, theta, 0.03 * spread, 1e-6 * spread, self.MOST_STEPS, 20 * d)
        self.coef_, self.intercept_ = (theta[1:], float(theta[0])) if self.fit_intercept else (theta, 0.0)

    def _descend(self, sums: Callable, theta: np.ndarray, width: float, least: float, steps: int, inside: int) -> np.ndarray:
        """Steps that lower the penalised loss, while its rounded corner gets narrower; it stays as wide as to hold ``inside`` rows."""
        d, l1, l2 = len(theta), self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)

        def at(theta, width):
            loss, slope, h, rows = sums(theta, width)
            return loss + 0.5 * l2 * theta @ theta + l1 * np.abs(theta).sum(), slope, h, rows

        if self.positive:
            theta = np.where(np.arange(d) >= int(self.fit_intercept), np.maximum(theta, 0), theta)
        value, slope, h, rows = at(theta, width)
        damp = 0.0
        for _ in range(steps - 1):
            ridge = np.full(d, l2) + l1 / np.maximum(np.abs(theta), 1e-8)
            a = h + np.diag(ridge) + damp * np.diag(np.maximum(np.diag(h), 1e-12))
            goal = a @ theta + slope - ridge * theta
            free, new = np.ones(d, bool), np.zeros(d)
            while True:
                new[:] = 0
                new[free] = solve(a[np.ix_(free, free)], goal[free])
                below = free & (new < 0) & (np.arange(d) >= int(self.fit_intercept))
                if not self.positive or not below.any():
                    break
                free &= ~below
            narrower = max(0.3 * width, least) if self.corner and rows >= 4 * inside else width
            found = at(new, narrower)
            if found[0] > value + 1e-14 * abs(value):  # too far: shorter steps from where it was
                damp = max(4 * damp, 1e-2)
                if damp > 1e6:
                    break
                continue
            gained, moved = value - found[0], np.abs(new - theta).max()
            theta, damp, (value, slope, h, rows) = new, damp / 10 if damp > 1e-6 else 0.0, found
            if narrower == width and (gained <= 1e-12 * abs(value) and moved <= 1e-9 * np.abs(theta).max() or gained <= 1e-15 * abs(value)):
                break
            width = narrower
        return theta

    def expr(self) -> Column:
        return linear(self.features, self.coef_, self.intercept_)


BaseScipyMinimizeRegressor = MinimizeRegressor


class ImbalancedLinearRegression(MinimizeRegressor):
    """Squares of overestimates count ``overestimation_punishment_factor`` times."""

    def __init__(self, features, label: str, overestimation_punishment_factor: float = 1.0, **options) -> None:
        super().__init__(features, label, **options)
        self.overestimation_punishment_factor = overestimation_punishment_factor

    def parts(self, r, width, when):
        factor = when(r < 0, float(self.overestimation_punishment_factor), 1.0)
        return factor * r * r / 2, factor * r, factor, factor


class QuantileRegression(MinimizeRegressor):
    """Pinball loss: |r| / 2 + (quantile - 1/2) r, its corner rounded within a shrinking width."""

    corner = True

    def __init__(self, features, label: str, quantile: float = 0.5, **options) -> None:
        super().__init__(features, label, **options)
        if not 0 <= quantile <= 1:
            raise ValueError("quantile has to be from 0 to 1")
        self.quantile = quantile

    def parts(self, r, width, when):
        size, tilt = when(r < 0, -r, r), self.quantile - 0.5
        inside = size < width
        loss = when(inside, r * r / (4 * width) + width / 4, size / 2) + tilt * r
        return loss, when(inside, r / (2 * width), when(r < 0, -0.5, 0.5)) + tilt, when(inside, 1 / (2 * width), 0.0), 0.5 / when(inside, width, size)


class LADRegression(QuantileRegression):
    """Least absolute deviations."""

    def __init__(self, features, label: str, **options) -> None:
        super().__init__(features, label, quantile=0.5, **options)


class DeadZoneRegressor(Regressor):
    """No loss within ``threshold`` of the label (of its size with ``relative``); beyond, linear, quadratic or constant.
    The constant effect has no slope, so its coefficients stay 0; no intercept."""

    def __init__(self, features, label: str, threshold: float = 0.3, relative: bool = False, effect: str = "linear", **names) -> None:
        super().__init__(features, label, **names)
        if effect not in ("linear", "quadratic", "constant"):
            raise ValueError("effect has to be linear, quadratic or constant")
        self.threshold, self.relative, self.effect = threshold, relative, effect

    def _fit(self, df: DataFrame) -> None:
        d, limit, relative, linear_effect = len(self.features), self.threshold, self.relative, self.effect == "linear"
        self.coef_ = np.zeros(d)
        if self.effect == "constant":
            return
        rows = Rows(df.dropna(subset=[*self.features, self.label]), [*[F.col(c) for c in self.features], F.col(self.label)])

        def value(theta, soft):
            def part(m):
                x, y = m[:, :-1], m[:, -1]
                size = np.where(y == 0, 1.0, np.abs(y)) if relative else 1.0
                r = (x @ theta - y) / size
                over = np.abs(r) - limit
                on = np.maximum(over, 0)
                # The linear effect's corner is rounded within ``soft`` of the zone.
                loss, slope = (np.where(on < soft, on**2 / (2 * soft), on - soft / 2), np.minimum(on / soft, 1)) if linear_effect else (on**2, 2 * on)
                return np.append(loss.sum(), x.T @ (slope * np.sign(r) / size))

            s = rows.sums(part)
            return s[0] / n, s[1:] / n

        g = rows.sums(lambda m: np.concatenate([(m.T @ m).ravel(), [len(m)]]))
        n, g = g[-1], g[:-1].reshape(d + 1, d + 1)
        theta = solve(g[:d, :d], g[:d, d])
        for soft in (0.1, 0.01, 0.001) if linear_effect else (1.0,):
            theta = bfgs(lambda t: value(t, soft), theta, 60)  # noqa: B023
        rows.close()
        self.coef_ = theta

    def expr(self) -> Column:
        return linear(self.features, self.coef_)


# ---------------------------------------------------------------- fair classifiers


class LogisticClassifier(Classifier):
    """Binary logistic regression; penalty l1 (sum) or l2 (norm, not squared) of the coefficients over C, or none.

    Learning begins on the driver with at most ``SAMPLE_ROWS`` rows; from there Newton steps read the whole table, a few times in
    all, each one aggregation in the JVM (at most ``max_iter`` steps). Rows with a null or NaN feature are left out.
    """

    SAMPLE_ROWS = 20_000
    constraint_rows: Callable | None = None

    def __init__(self, features, label: str, C: float = 1.0, penalty: str | None = None, fit_intercept: bool = True, max_iter: int = 100, **names) -> None:
        super().__init__(features, label, **names)
        if penalty not in ("l1", "l2", None, "none"):
            raise ValueError("penalty has to be l1, l2 or None")
        self.C, self.penalty, self.fit_intercept, self.max_iter = C, penalty, fit_intercept, max_iter

    def _inputs(self) -> list[str]:
        return self.features

    def _constraints(self, df: DataFrame, x: list[Column]) -> tuple[np.ndarray, float]:
        """Rows c and a bound b: |c . (intercept, coef)| <= b."""
        return np.zeros((0, len(x) + 1)), 0.0

    def _fit(self, df: DataFrame) -> None:
        self.learn_classes(df)
        if len(self.classes_) != 2:
            raise ValueError(f"expected 2 classes, found {self.classes_}")
        self.inputs_ = self._inputs()
        y = F.when(F.col(self.label) == self.classes_[1], 1.0).otherwise(0.0)
        c, bound = self._constraints(df, [F.col(k).cast("double") for k in self.inputs_])
        d = len(self.inputs_) + 1
        rows = Rows(df.where(F.col(self.label).isNotNull()).dropna(subset=self.inputs_), [*[F.col(k) for k in self.inputs_], y])
        n = rows.table.count()
        if not n:
            rows.close()
            raise ValueError("no rows to learn from")
        near = rows.table if n <= self.SAMPLE_ROWS else rows.table.sample(0.9 * self.SAMPLE_ROWS / n, seed=0).limit(self.SAMPLE_ROWS)
        m = np.array(near.collect(), float).reshape(-1, d)

        def part(m, theta):
            x, t = np.column_stack([np.ones(len(m)), m[:, :-1]]), m[:, -1]
            z = x @ theta
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return np.concatenate([[(np.logaddexp(0, z) - t * z).sum()], x.T @ (p - t), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        def whole(theta):
            if d > GRAM_EXPRESSIONS:
                s = rows.sums(lambda m: part(m, theta))
                return s[0] / n, s[1 : d + 1] / n, s[d + 1 :].reshape(d, d) / n
            x, t = [F.lit(1.0), *[F.col(f"c{i}") for i in range(d - 1)]], F.col(f"c{d - 1}")
            at = rows.table.withColumn("z", total([v * float(w) for v, w in zip(x, theta)]))
            at = at.withColumn("e", F.exp(-F.abs("z"))).withColumn("p", F.when(F.col("z") >= 0, 1 / (1 + F.col("e"))).otherwise(F.col("e") / (1 + F.col("e"))))
            curve = F.col("p") * (1 - F.col("p"))
            pairs = [(i, j) for i in range(d) for j in range(i, d)]
            asks = [F.sum(F.greatest(F.col("z"), F.lit(0.0)) + F.log1p("e") - t * F.col("z")), *[F.sum((F.col("p") - t) * v) for v in x], *[F.sum(curve * x[i] * x[j]) for i, j in pairs]]
            got, h = np.array(at.agg(*[a.alias(f"s{i}") for i, a in enumerate(asks)]).first(), float) / n, np.zeros((d, d))
            for (i, j), v in zip(pairs, got[1 + d :]):
                h[i, j] = h[j, i] = v
            return got[0], got[1 : d + 1], h

        def sampled(theta):
            s = part(m, theta) / len(m)
            return s[0], s[1 : d + 1], s[d + 1 :].reshape(d, d)

        theta, small = np.zeros(d), n <= self.SAMPLE_ROWS
        if len(m):
            theta = self._descend(sampled, theta, n, c, bound, 1e-12 if small else 1e-5)
        if not small:
            theta = self._descend(whole, theta, n, c, bound, 1e-12)
        rows.close()
        self.intercept_, self.coef_ = float(theta[0]), theta[1:]

    def _penalty(self, theta: np.ndarray, n: int) -> tuple[float, np.ndarray]:
        """Its share for each row, and the slope of that; corners are rounded."""
        w, slope = theta[1:], np.zeros(len(theta))
        if self.penalty == "l1":
            root = np.sqrt(w * w + 1e-10)
            slope[1:] = w / root / self.C / n
            return root.sum() / self.C / n, slope
        if self.penalty == "l2":
            root = np.sqrt(w @ w + 1e-10)
            slope[1:] = w / root / self.C / n
            return root / self.C / n, slope
        return 0.0, slope

    def _descend(self, sums: Callable, theta: np.ndarray, n: int, c: np.ndarray, bound: float, tol: float) -> np.ndarray:
        """Newton steps to the least of loss and penalty within the constraints, until a step can't gain more than ``tol``."""
        value, slope, h = sums(theta)
        if value + self._penalty(theta, n)[0] > np.log(2) + self._penalty(np.zeros(len(theta)), n)[0]:  # a start worse than none
            theta = np.zeros(len(theta))
            value, slope, h = sums(theta)
        for _ in range(self.max_iter):
            goal = self._nearest(theta, slope, h, n, c, bound)
            step, now = goal - theta, value + self._penalty(theta, n)[0]
            gain = slope @ step + self._penalty(goal, n)[0] - self._penalty(theta, n)[0]
            if gain >= -tol:
                return goal if np.abs(step @ h @ step) <= 4 * tol else theta
            t = 1.0
            while True:
                new = theta + t * step
                found = sums(new)
                after = found[0] + self._penalty(new, n)[0]
                if after <= now + 1e-4 * t * gain or t < 1e-6:
                    break
                t /= 2
            if after > now:
                break
            theta, (value, slope, h) = new, found
            if now - after <= 1e-14 * max(1.0, abs(now)) or (not self.penalty and not len(c) and np.abs(slope[0 if self.fit_intercept else 1 :]).max(initial=0) < 1e-9):
                break
        return theta

    def _nearest(self, theta: np.ndarray, slope: np.ndarray, h: np.ndarray, n: int, c: np.ndarray, bound: float) -> np.ndarray:
        """Where the quadratic model of the loss around ``theta``, with penalty and constraints, is least: no pass over the table."""
        free = np.arange(0 if self.fit_intercept else 1, len(theta))
        size = np.sqrt(np.maximum(np.diag(h)[free], 1e-300))
        h = h[np.ix_(free, free)]
        if not self.penalty and not len(c):
            out = theta.copy()
            out[free] -= solve(h / np.outer(size, size), slope[free] / size) / size
            return out
        # In coordinates in which the model is a sphere: correlated columns or columns of other units don't slow the search.
        values, vectors = np.linalg.eigh(h / np.outer(size, size))
        back = vectors / np.sqrt(np.maximum(values, 1e-10)) / size[:, None]
        dual, rho = np.zeros(len(c)), 10.0

        def at(u):
            out = theta.copy()
            out[free] += back @ u
            return out

        def model(u):
            x = at(u)
            step = x[free] - theta[free]
            f, g = self._penalty(x, n)
            f, g = f + slope[free] @ step + 0.5 * step @ h @ step, g[free] + slope[free] + h @ step
            for row, v, k in zip(c, c @ x, dual):
                over = max(0.0, v - bound + k / rho) if v >= 0 else min(0.0, v + bound + k / rho)
                f, g = f + rho / 2 * over**2, g + rho * over * row[free]
            return f, back.T @ g

        u = np.zeros(len(free))
        for _ in range(40 if len(c) else 1):
            u = bfgs(model, u, 500, 1e-10)
            v = c @ at(u)
            if (np.abs(v) <= bound + 1e-7).all():
                break
            dual = np.where(v >= 0, np.maximum(0, dual + rho * (v - bound)), np.minimum(0, dual + rho * (v + bound)))
            rho = min(3 * rho, 1e4)
        return at(u)

    def decision(self) -> Column:
        return linear(self.inputs_, self.coef_, self.intercept_)

    def probabilities(self) -> Column:
        p = 1 / (1 + F.exp(-self.decision()))
        return let(p, lambda x: F.array(1 - x, x))


class DemographicParityClassifier(LogisticClassifier):
    """The decision's covariance with each sensitive column (around its mean over all rows) stays within the
    threshold; sensitive columns aren't learned from unless ``train_sensitive_cols``."""

    def __init__(self, features, label: str, sensitive_cols, covariance_threshold: float | None, train_sensitive_cols: bool = False, penalty: str | None = "l1", **options) -> None:
        super().__init__(features, label, penalty=penalty, **options)
        self.sensitive_cols, self.covariance_threshold, self.train_sensitive_cols = as_list(sensitive_cols), covariance_threshold, train_sensitive_cols

    def _inputs(self) -> list[str]:
        return [f for f in self.features if self.train_sensitive_cols or f not in self.sensitive_cols]

    def _counted(self) -> Column:
        return F.lit(True)

    def _constraints(self, df: DataFrame, x: list[Column]) -> tuple[np.ndarray, float]:
        if self.covariance_threshold is None:
            return super()._constraints(df, x)
        means = df.agg(*[F.avg(F.col(s).cast("double")) for s in self.sensitive_cols]).first()
        asks = [F.avg(F.when(self._counted(), (F.col(s).cast("double") - m) * v)) for s, m in zip(self.sensitive_cols, means) for v in [F.lit(1.0), *x]]
        row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(asks)]).first()
        return np.array([v or 0.0 for v in row]).reshape(len(self.sensitive_cols), -1), float(self.covariance_threshold)


class EqualOpportunityClassifier(DemographicParityClassifier):
    """The same over the rows whose label is ``positive_target``."""

    def __init__(self, features, label: str, sensitive_cols, covariance_threshold: float | None, positive_target, **options) -> None:
        super().__init__(features, label, sensitive_cols, covariance_threshold, **options)
        self.positive_target = positive_target

    def _counted(self) -> Column:
        return F.col(self.label) == F.lit(self.positive_target)


class OneVsRest(Classifier):
    """One binary model for each label; probabilities in proportion to theirs."""

    def __init__(self, model: Classifier) -> None:
        super().__init__(model.features, model.label, model.prediction, model.probability)
        self.model = model

    def _fit(self, df: DataFrame) -> None:
        import copy

        self.learn_classes(df)
        self.models_ = []
        for c in self.classes_:
            one = copy.copy(self.model)
            one.label = "__is"
            if hasattr(one, "positive_target"):
                one.positive_target = 1
            self.models_.append(one.fit(df.withColumn("__is", F.when(F.col(self.label) == c, 1).otherwise(0))))

    def probabilities(self) -> Column:
        p = [F.element_at(m.probabilities(), 2) for m in self.models_]
        return normalised(p)


class OneVsOne(OneVsRest):
    """One binary model for each pair of labels; probabilities are the shares of pairs won, ties by their confidence."""

    def _fit(self, df: DataFrame) -> None:
        self.learn_classes(df)
        pairs = [(a, b) for i, a in enumerate(self.classes_) for b in self.classes_[i + 1 :]]
        self.models_ = {(a, b): self.model.fit(df.where(F.col(self.label).isin(a, b))) for a, b in pairs}

    def probabilities(self) -> Column:
        pairs = list(self.models_)

        def scores(p: Column) -> Column:
            won = {c: [] for c in self.classes_}
            for k, (a, b) in enumerate(pairs):
                x = F.element_at(p, k + 1)
                won[b].append(F.when(x > 0.5, 1.0).otherwise(0.0) + x / 1e3)
                won[a].append(F.when(x > 0.5, 0.0).otherwise(1.0) + (1 - x) / 1e3)
            return F.array(*[total(won[c]) for c in self.classes_])

        return shares(let(F.array(*[F.element_at(self.models_[k].probabilities(), 2) for k in pairs]), scores))
