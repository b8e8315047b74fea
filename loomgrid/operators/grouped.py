"""One model for each group, for every prefix of the groups, or per-group scaling, as state tables and joins.

An inner estimator says how to learn its parameters as aggregates (``params``) and how to predict from them
(``predicted``), so all groups are fitted by one grouped aggregation and applied by a left join whose state is broadcast
up to ``SMALL_STATE`` bytes. ``PandasEstimator`` runs any Python model with one group at a time instead.
"""

from __future__ import annotations

import copy
import pickle
import weakref
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.base import Classifier, Operator, as_list, best_class, distinct_values, finite, let, softmax, temp, total
from loomgrid.functions.shrinkage import weights
from loomgrid.operators.features import values_at

# ---------------------------------------------------------------- inner estimators


class MeanEstimator:
    """The mean of the label."""

    classifier = False

    def __init__(self, label: str) -> None:
        self.label, self.features = label, []

    def prepare(self, df: DataFrame) -> MeanEstimator:
        return self

    def params(self) -> Column:
        return F.struct(F.avg(F.col(self.label).cast("double")).alias("mean"))

    def predicted(self, p: Column) -> Column:
        return p["mean"]


class QuantileEstimator(MeanEstimator):
    """A quantile of the label, the median by default: exact, or with ``accuracy`` Spark's approximate one. One aggregation gives
    the exact ones of groups up to about ``HELD_VALUES`` distinct values; those of larger groups are narrowed group by group."""

    def __init__(self, label: str, quantile: float = 0.5, accuracy: int | None = None) -> None:
        super().__init__(label)
        self.quantile, self.accuracy = quantile, accuracy

    def params(self) -> Column:
        return F.struct(quantile_of(F.col(self.label).cast("double"), self.quantile, self.accuracy).alias("mean"))

    def large(self, df: DataFrame, levels: list[list[str]]) -> list[list[tuple[Column, float]]]:
        """For each level, which rows are of a group with more than ``HELD_VALUES`` distinct values, and its quantile."""
        if self.accuracy is not None:
            return [[] for _ in levels]
        v, deepest = F.col(self.label).cast("double"), max(levels, key=len)
        inf = float("inf")
        kinds = [v == -inf, (v > -inf) & (v < inf), v == inf, F.isnan(v)]  # in ascending order
        counts = [F.count(F.when(kind, 1)).alias(f"__n{i}") for i, kind in enumerate(kinds)]
        values = F.approx_count_distinct(v).alias("__values")
        gid = F.grouping_id() if deepest else F.max(F.lit(0))
        table = df.rollup(*deepest) if deepest else df.groupBy()
        rows = table.agg(gid.alias("__gid"), values, *counts).where(F.col("__values") > HELD_VALUES).collect()
        out = []
        for keys in levels:
            own = [r for r in rows if r["__gid"] == (1 << (len(deepest) - len(keys))) - 1]
            of = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys], F.lit(True)) for r in own]
            out.append([(rows_of, self._narrowed(df.where(rows_of), F.when(kinds[1], v), [r[f"__n{i}"] for i in range(4)])) for rows_of, r in zip(of, own)])
        return out

    def _narrowed(self, df: DataFrame, finite_value: Column, sizes: list[int]) -> float:
        at = self.quantile * (sum(sizes) - 1)
        low, high = int(np.floor(at)), int(np.ceil(at))
        first, last = sizes[0], sizes[0] + sizes[1]
        inner = [r - first for r in (low, high) if first <= r < last]
        found = values_at(df, finite_value, inner) if inner else {}
        value = lambda r: -np.inf if r < first else found[r - first] if r < last else np.inf if r < last + sizes[2] else np.nan
        a, b = value(low), value(high)
        return float(a if a == b else (high - at) * a + (at - low) * b)


HELD_VALUES = 1_000_000


def quantile_of(value: Column, point: float, accuracy: int | None) -> Column:
    return F.percentile(value, point) if accuracy is None else F.percentile_approx(value, point, accuracy)


def _solve(sums: Column) -> Column:
    """Coefficients from the upper triangle of the Gram matrix of (features.., label), batch by batch."""

    def one(row) -> list[float]:
        d = int((np.sqrt(8 * len(row) + 1) - 1) / 2)
        g = np.zeros((d, d))
        g[np.triu_indices(d)] = row
        g += np.triu(g, 1).T
        return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0].tolist()

    @F.pandas_udf("array<double>")
    def solved(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    return solved(sums)


class LinearEstimator(MeanEstimator):
    """Least squares with ridge penalty ``alpha``. The sums are taken around the table's means."""

    def __init__(self, features, label: str, alpha: float = 0.0, fit_intercept: bool = True) -> None:
        self.features, self.label, self.alpha, self.fit_intercept = as_list(features), label, alpha, fit_intercept
        self.offsets = [0.0] * (len(self.features) + 1)

    def prepare(self, df: DataFrame) -> LinearEstimator:
        ready = LinearEstimator(self.features, self.label, self.alpha, self.fit_intercept)
        if self.fit_intercept:
            ready.offsets = [m or 0.0 for m in df.agg(*[F.avg(F.col(c).cast("double")) for c in [*self.features, self.label]]).first()]
        return ready

    def _inputs(self) -> list[Column]:
        x = [F.col(c).cast("double") - m for c, m in zip(self.features, self.offsets)]
        return [F.lit(1.0)] * self.fit_intercept + x

    def params(self) -> Column:
        cols = [*self._inputs(), F.col(self.label).cast("double") - self.offsets[-1]]
        n = len(cols)
        ridge = lambda i, j: self.alpha if i == j and int(self.fit_intercept) <= i < n - 1 else 0.0
        return F.struct(F.array(*[F.sum(cols[i] * cols[j]) + ridge(i, j) for i in range(n) for j in range(i, n)]).alias("sums"))

    def finish(self, state: DataFrame, column: str) -> DataFrame:
        return state.withColumn(column, F.struct(_solve(F.col(f"{column}.sums")).alias("coef")))

    def predicted(self, p: Column) -> Column:
        return total([F.element_at(p["coef"], i + 1) * x for i, x in enumerate(self._inputs())]) + self.offsets[-1]


class FrequencyClassifier(MeanEstimator):
    """The label's shares in the group."""

    classifier = True
    classes: list = []

    def prepare(self, df: DataFrame) -> FrequencyClassifier:
        ready = type(self)(*([self.features] if self.features else []), self.label)
        ready.classes = distinct_values(df, self.label)
        return ready

    def params(self) -> Column:
        return F.struct(F.array(*[F.avg(F.when(F.col(self.label) == c, 1.0).otherwise(0.0)) for c in self.classes]).alias("p"))

    def predicted(self, p: Column) -> Column:
        return p["p"]


class GaussianClassifier(FrequencyClassifier):
    """Naive Bayes with a normal density for each feature; labels that a group lacks get probability 0."""

    smoothing = 1e-9

    def __init__(self, features, label: str) -> None:
        self.features, self.label = as_list(features), label

    def params(self) -> Column:
        hit = lambda c: F.col(self.label) == c
        one = lambda c: F.struct(F.count(F.when(hit(c), 1)).alias("n"), F.array(*[F.avg(F.when(hit(c), F.col(x).cast("double"))) for x in self.features]).alias("m"), F.array(*[F.var_pop(F.when(hit(c), F.col(x).cast("double"))) for x in self.features]).alias("v"))
        return F.struct(F.array(*[one(c) for c in self.classes]).alias("by"))

    def predicted(self, p: Column) -> Column:
        def score(k: int) -> Column:
            s = F.element_at(p["by"], k + 1)
            logs = [F.log(s["n"].cast("double"))]
            for i, x in enumerate(self.features, 1):
                v = F.element_at(s["v"], i) + self.smoothing
                logs.append(-0.5 * (F.log(v) + F.pow(F.col(x).cast("double") - F.element_at(s["m"], i), F.lit(2.0)) / v))
            return F.when(s["n"] > 0, total(logs))

        return softmax([score(k) for k in range(len(self.classes))])


class PandasEstimator:
    """Any Python model: ``fit(frame) -> model`` and ``predict(model, frame) -> values``.

    A model learns in one task from at most about ``most_rows`` rows of its group, those of the smallest hashes: so neither the global
    model nor that of a hot group ever brings its whole group to one place. Predictions are made for all rows.
    """

    classifier = False

    def __init__(self, features, label: str, fit: Callable, predict: Callable, most_rows: int = 500_000) -> None:
        self.features, self.label, self.fit, self.apply, self.most_rows = as_list(features), label, fit, predict, most_rows

    def prepare(self, df: DataFrame) -> PandasEstimator:
        return self

    def state(self, df: DataFrame, keys: list[str], column: str) -> DataFrame:
        fit, schema = self.fit, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", " * bool(keys) + f"n long, {column} struct<model: binary>"

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            out = frame[keys].head(1).reset_index(drop=True) if keys else pd.DataFrame(index=[0])
            n = frame.pop(total).iloc[0]
            n = len(frame) if pd.isna(n) else int(n)
            return out.assign(n=n, **{column: [{"model": pickle.dumps(fit(frame))}]})

        # How many rows each group has says which hashes are kept; only groups of more rows than a model learns from are broadcast, so
        # that the rest of them goes before rows are brought together.
        total = temp("rows")
        counts = df.groupBy(*keys).agg(F.count("*").alias(total))
        named = counts.where(F.col(total) > self.most_rows).select(*[F.col(k).alias(f"__k_{k}") for k in keys], total)
        share = (F.xxhash64(*[F.col(c) for c in df.columns]).cast("double") / 2.0**64 + 0.5) * F.col(total) < self.most_rows
        if keys:
            on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named[f"__k_{k}"]) for k in keys])
            rows = df.join(F.broadcast(named), on, "left").drop(*[f"__k_{k}" for k in keys])
        else:
            rows = df.join(F.broadcast(named), F.lit(True), "left")  # one row at most
        kept = rows.where(F.col(total).isNull() | share)
        return kept.groupBy(*keys).applyInPandas(run, schema)

    def predicted(self, p: Column) -> Column:
        apply, names = self.apply, self.features

        @F.pandas_udf("double")
        def run(models: pd.Series, inputs: pd.DataFrame) -> pd.Series:
            out = pd.Series(np.nan, index=models.index)
            inputs.columns = names
            for model, rows in models.dropna().groupby(models.dropna().map(bytes)):
                out[rows.index] = np.asarray(apply(pickle.loads(model), inputs.loc[rows.index]), float)
            return out

        return run(p["model"], F.struct(*self.features))


def fit_levels(df: DataFrame, estimator, levels: list[list[str]], column: str, owner=None) -> list[DataFrame]:
    """For each list of keys, which are prefixes of one another, a table (keys.., n, column)."""
    if hasattr(estimator, "state"):
        kept = [estimator.state(df, keys, column).cache() for keys in levels]
        for state in kept:
            weakref.finalize(owner or estimator, state.unpersist)
        return [sized(state, F.octet_length(F.col(column)["model"])) for state in kept]
    if any(large := estimator.large(df, levels) if hasattr(estimator, "large") else []):
        return [large_quantiles(df, estimator, keys, column, found, owner) for keys, found in zip(levels, large)]
    deepest = max(levels, key=len)
    if not deepest:
        states = df.agg(F.count("*").alias("n"), estimator.params().alias(column)).withColumn("__gid", F.lit(0))
    else:
        states = df.rollup(*deepest).agg(F.grouping_id().alias("__gid"), F.count("*").alias("n"), estimator.params().alias(column))
    states = states.where(F.col("__gid").isin([(1 << (len(deepest) - len(keys))) - 1 for keys in levels]))
    if hasattr(estimator, "finish"):
        states = estimator.finish(states, column)
    states = states.cache()  # one row for each group; every level and prediction reads it, until no model holds it
    weakref.finalize(owner or estimator, states.unpersist)
    states = sized(states, F.octet_length(F.to_json(F.struct(column))))
    return [states.where(F.col("__gid") == (1 << (len(deepest) - len(keys))) - 1).select(*keys, "n", column) for keys in levels]


def large_quantiles(df: DataFrame, estimator: QuantileEstimator, keys: list[str], column: str, found: list, owner=None) -> DataFrame:
    """A level's table where the quantiles of large groups are known; their values aren't aggregated."""
    known = reduce(lambda a, b: a | b, [rows for rows, _ in found], F.lit(False))
    label = F.when(~known, F.col(estimator.label).cast("double"))
    rest = df.groupBy(*keys).agg(F.count("*").alias("n"), F.struct(quantile_of(label, estimator.quantile, None).alias("mean")).alias(column))
    mean = reduce(lambda other, one: F.when(one[0], F.lit(one[1])).otherwise(other), found, F.col(column)["mean"])
    state = rest.withColumn(column, F.struct(mean.alias("mean"))).cache()
    weakref.finalize(owner or estimator, state.unpersist)
    return sized(state, F.octet_length(F.to_json(F.struct(column))))


SMALL_STATE = 8 << 20


def sized(states: DataFrame, size: Column) -> DataFrame:
    """Computes cached states; those of at most ``SMALL_STATE`` bytes are marked for broadcast. Spark's own estimate of a state is that
    of the table it was learned from, and a join by shuffle would bring all rows of a group to one task."""
    n, held = states.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(states) if 64 * n + (held or 0) <= SMALL_STATE else states


def check_groups(df: DataFrame, groups: list[str]) -> None:
    if missing := [g for g in groups if g not in df.columns]:
        raise ValueError(f"group column(s) {missing} are not in the DataFrame")
    if groups and any(df.agg(*[F.count(F.when(F.col(g).isNull(), 1)) for g in groups]).first()):
        raise ValueError(f"group columns {groups} hold nulls")


def attach(df: DataFrame, state: DataFrame, keys: list[str], column: str, n: str) -> DataFrame:
    """Left join of a level's state; the root's one row joins every row."""
    named = state.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("n").alias(n), F.col(state.columns[-1]).alias(column))
    if not keys:
        root = named.first()
        if root is None:
            return df.withColumns({n: F.lit(None).cast("long"), column: F.lit(None).cast(named.schema[column].dataType)})
        return df.crossJoin(F.broadcast(named))  # one row
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named[f"__k_{k}"]) for k in keys])
    return df.join(named, on, "left").drop(*[f"__k_{k}" for k in keys])


# ---------------------------------------------------------------- any operator, group by group


def with_groups(out: DataFrame, rows: DataFrame, groups: list[str]) -> DataFrame:
    """The transformed rows, where group columns that the operator dropped are an error rather than guessed."""
    if lost := [g for g in groups if g not in out.columns]:
        raise ValueError(f"the operator drops the group column(s) {lost}: apply it to other columns")
    return out


class EachGroup:
    """One fitted copy of an operator for each group, and one of all rows for groups not seen. Rows of a group are a filter of
    the table, and the result the union of them: meant for few groups, at most ``most_groups``."""

    def __init__(self, operator: Operator, groups: list[str], use_global_model: bool, most_groups: int) -> None:
        self.operator, self.groups, self.use_global_model, self.most_groups = operator, groups, use_global_model, most_groups

    def _is(self, values: list) -> Column:
        return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.lit(v)) for g, v in zip(self.groups, values)])

    def fit(self, df: DataFrame) -> EachGroup:
        self.whole = self.operator.fit(df) if self.use_global_model or not self.groups else None
        found = df.select(*self.groups).distinct().limit(self.most_groups + 1).collect() if self.groups else []
        if len(found) > self.most_groups:
            raise ValueError(f"more than {self.most_groups} groups: raise most_groups, or use an estimator that learns all groups at once")
        self.models = [(list(r), self.operator.fit(df.where(self._is(list(r))))) for r in sorted(found, key=str)]
        return self

    def apply(self, df: DataFrame, use: Callable[[Operator, DataFrame], DataFrame]) -> DataFrame:
        if not self.groups:
            return use(self.whole, df)
        known = reduce(lambda a, b: a | b, [self._is(v) for v, _ in self.models], F.lit(False))
        rest = df.where(~known)
        if self.whole is None:
            message = F.concat(F.lit("no model was fitted for group: "), F.to_json(F.struct(*self.groups)))
            rest = rest.where(F.raise_error(message).cast("boolean"))
        out = use(self.whole or self.models[0][1], rest)
        for values, model in self.models:
            out = out.unionByName(use(model, df.where(self._is(values))))
        return out


# ---------------------------------------------------------------- grouped and hierarchical


class GroupedPredictor(Operator):
    """A model for each value of ``groups``, with a global one for groups not seen. With ``shrinkage`` (regressors) the
    predictions of all prefixes of the groups are blended, and a new group is an error.

    The inner estimators of this module learn all groups at once, however many there are. Any other regressor or classifier of
    this library, MLlib's among them, is fitted once for each of at most ``most_groups`` groups (no shrinkage).
    """

    def __init__(self, estimator, groups, shrinkage: str | Callable | None = None, use_global_model: bool = True, prediction: str = "prediction", probability: str = "probability", most_groups: int = 64, **shrinkage_options) -> None:
        self.estimator, self.groups, self.shrinkage, self.use_global_model = estimator, as_list(groups), shrinkage, use_global_model
        self.prediction, self.probability, self.most_groups, self.options = prediction, probability, most_groups, shrinkage_options
        if isinstance(estimator, Operator):
            self.estimator = copy.copy(estimator)
            self.estimator.prediction = prediction
            if isinstance(estimator, Classifier):
                self.estimator.probability = probability

    @property
    def classifies(self) -> bool:
        return isinstance(self.estimator, Classifier) or getattr(self.estimator, "classifier", False)

    def uses(self) -> list[str]:
        return [*self.groups, *self.estimator.features]

    def _levels(self) -> list[list[str]]:
        if self.shrinkage is None:
            return [[], self.groups] if self.use_global_model else [self.groups]
        return [self.groups[:k] for k in range(len(self.groups) + 1 - (not self.use_global_model))] if self.use_global_model else [self.groups[:k] for k in range(1, len(self.groups) + 1)]

    def _fit(self, df: DataFrame) -> None:
        if self.shrinkage is not None and self.classifies:
            raise ValueError("shrinkage is only for regressors")
        if isinstance(self.estimator, Operator):
            if self.shrinkage is not None:
                raise ValueError("shrinkage needs an estimator that learns all groups at once")
            check_groups(df, self.groups)
            self.each_ = EachGroup(self.estimator, self.groups, self.use_global_model, self.most_groups).fit(df)
            self.classes_ = sorted({c for _, m in self.each_.models for c in m.classes_}) if self.classifies else None
            return
        if self.shrinkage is not None and len(self._levels()) < 2:
            raise ValueError("shrinkage needs more than one level of groups")
        check_groups(df, self.groups)
        self.estimator_, self.levels_ = self.estimator.prepare(df), self._levels()
        self.states_ = fit_levels(df, self.estimator_, self.levels_, "params", self)
        self.classes_ = getattr(self.estimator_, "classes", None)

    def _joined(self, df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        ps, ns = [temp("p") for _ in self.levels_], [temp("n") for _ in self.levels_]
        for keys, state, p, n in zip(self.levels_, self.states_, ps, ns):
            df = attach(df, state, keys, p, n)
        return df, ps, ns

    def _value(self, ps: list[str], ns: list[str]) -> Column:
        of = [self.estimator_.predicted(F.col(p)) for p in ps]
        unseen = F.raise_error(F.concat(F.lit("no model was fitted for group: "), F.to_json(F.struct(*self.groups))))
        kind = "array<double>" if self.estimator_.classifier else "double"
        if self.shrinkage is None:
            known = F.when(F.col(ns[-1]).isNotNull(), of[-1])
            return known.otherwise(of[0] if self.use_global_model else unseen.cast(kind))
        blend = total([w * v for w, v in zip(weights([F.col(n) for n in ns], self.shrinkage, **self.options), of)])
        return F.when(F.col(ns[-1]).isNotNull(), blend).otherwise(unseen.cast(kind))

    def _aligned(self, model: Operator, rows: DataFrame) -> DataFrame:
        """A model's probabilities in the order of all classes; those that its group lacks have 0."""
        out = model.predict_proba(rows)
        places = [model.classes_.index(c) + 1 if c in model.classes_ else 0 for c in self.classes_]
        return out.withColumn(self.probability, F.array(*[F.element_at(self.probability, k).cast("double") if k else F.lit(0.0) for k in places]))

    def predict(self, df: DataFrame) -> DataFrame:
        self.check(df)
        if isinstance(self.estimator, Operator):
            if not self.classifies:
                return self.each_.apply(df, lambda model, rows: model.predict(rows))
            out = self.each_.apply(df, self._aligned)
            return out.withColumn(self.prediction, best_class(F.col(self.probability), self.classes_))
        out, ps, ns = self._joined(df)
        if self.estimator_.classifier:
            out = out.withColumn(self.probability, self._value(ps, ns))
            return out.withColumn(self.prediction, best_class(F.col(self.probability), self.classes_)).drop(*ps, *ns)
        return out.withColumn(self.prediction, self._value(ps, ns)).drop(*ps, *ns)

    _transform = predict

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if not self.classifies:
            raise AttributeError("the estimator gives no probabilities")
        return self.predict(df).drop(self.prediction)

    def decision_function(self, df: DataFrame, decision: str = "decision") -> DataFrame:
        """Log odds of the second of two classes, or the logarithms of all classes' probabilities; never infinite."""
        logs = F.transform(self.probability, lambda p: F.log(F.greatest(p, F.lit(1e-300))))
        value = F.element_at(logs, 2) - F.element_at(logs, 1) if len(self.classes_ or []) == 2 else logs
        return self.predict_proba(df).withColumn(decision, value).drop(self.probability)


class GroupedRegressor(GroupedPredictor):
    def _fit(self, df: DataFrame) -> None:
        if self.classifies:
            raise ValueError("GroupedRegressor needs a regressor")
        super()._fit(df)


class GroupedClassifier(GroupedPredictor):
    def _fit(self, df: DataFrame) -> None:
        if not self.classifies:
            raise ValueError("GroupedClassifier needs a classifier")
        super()._fit(df)


class HierarchicalPredictor(GroupedPredictor):
    """Models for every prefix of the groups, the global one included. A row whose group is new uses the nearest
    known prefix (``fallback_method`` parent) or fails (raise); weights are those of the deepest known prefix."""

    def __init__(self, estimator, groups, shrinkage: str | Callable | None = None, fallback_method: str = "parent", **options) -> None:
        super().__init__(estimator, groups, shrinkage, True, **options)
        self.fallback_method = fallback_method

    def _fit(self, df: DataFrame) -> None:
        if self.fallback_method not in ("parent", "raise"):
            raise ValueError("fallback_method has to be parent or raise")
        if isinstance(self.estimator, Operator):
            raise ValueError("a hierarchy needs an estimator that learns all groups at once")
        check_groups(df, self.groups)
        self.estimator_ = self.estimator.prepare(df)
        self.levels_ = [self.groups[:k] for k in range(len(self.groups) + 1)]
        self.states_ = fit_levels(df, self.estimator_, self.levels_, "params", self)
        self.classes_ = getattr(self.estimator_, "classes", None)

    def _value(self, ps: list[str], ns: list[str]) -> Column:
        of = [self.estimator_.predicted(F.col(p)) for p in ps]
        out, parts = None, len(self.classes_) if self.estimator_.classifier else 0
        for depth in reversed(range(len(ps))):  # the deepest known prefix
            w = weights([F.col(n) for n in ns[: depth + 1]], self.shrinkage, **self.options)
            if parts:
                value = let(F.array(*of), lambda vs: F.array(*[total([x * F.element_at(F.element_at(vs, i + 1), k + 1) for i, x in enumerate(w)]) for k in range(parts)]))  # noqa: B023
            else:
                value = total([x * v for x, v in zip(w, of)])
            known = F.col(ns[depth]).isNotNull()
            out = F.when(known, value) if out is None else out.when(known, value)
            if self.fallback_method == "raise":
                missing = F.raise_error(F.concat(F.lit("no model for group: "), F.to_json(F.struct(*self.groups))))
                return out.otherwise(missing.cast("array<double>" if parts else "double"))
        return out


class HierarchicalRegressor(HierarchicalPredictor):
    def _fit(self, df: DataFrame) -> None:
        if self.classifies:
            raise ValueError("HierarchicalRegressor needs a regressor")
        super()._fit(df)


class HierarchicalClassifier(HierarchicalPredictor):
    def _fit(self, df: DataFrame) -> None:
        if not self.classifies:
            raise ValueError("HierarchicalClassifier needs a classifier")
        super()._fit(df)


# ---------------------------------------------------------------- grouped transformers


class GroupScaler:
    """``standard``: (x - mean) / population deviation; ``minmax``: to 0..1; ``robust``: median and quartiles. A constant
    column is only shifted. Medians and quartiles are exact unless ``accuracy`` is given."""

    def __init__(self, columns, method: str = "standard", accuracy: int | None = None) -> None:
        if method not in ("standard", "minmax", "robust"):
            raise ValueError("method has to be standard, minmax or robust")
        self.columns, self.method, self.accuracy = as_list(columns), method, accuracy

    def params(self) -> Column:
        def one(c: str) -> Column:
            x = F.when(finite(F.col(c).cast("double")), F.col(c).cast("double"))
            low, scale = {
                "standard": lambda: (F.avg(x), F.stddev_pop(x)),
                "minmax": lambda: (F.min(x), F.max(x) - F.min(x)),
                "robust": lambda: (quantile_of(x, 0.5, self.accuracy), quantile_of(x, 0.75, self.accuracy) - quantile_of(x, 0.25, self.accuracy)),
            }[self.method]()
            return F.struct(low.alias("low"), F.when(scale > 0, scale).otherwise(1.0).alias("scale")).alias(c)

        return F.struct(*[one(c) for c in self.columns])


class GroupedTransformer(Operator):
    """Transforms rows within groups; rows of new groups use the global state or fail. Group columns are dropped unless
    ``keep_groups``.

    A ``GroupScaler`` learns all groups by one aggregation and is applied by a join, so there may be any number of them. Any other
    operator is fitted once for each group, of which there may be ``most_groups``.
    """

    def __init__(self, transformer, groups=None, use_global_model: bool = True, keep_groups: bool = False, most_groups: int = 64) -> None:
        self.transformer, self.groups, self.use_global_model, self.keep_groups, self.most_groups = transformer, as_list(groups), use_global_model, keep_groups, most_groups

    def uses(self) -> list[str]:
        return [*self.groups, *(self.transformer.uses() if isinstance(self.transformer, Operator) else self.transformer.columns)]

    def _fit(self, df: DataFrame) -> None:
        check_groups(df, self.groups)
        self.levels_ = [[], self.groups] if self.groups and self.use_global_model else [self.groups]
        if isinstance(self.transformer, Operator):
            self.each_ = EachGroup(self.transformer, self.groups, self.use_global_model, self.most_groups).fit(df)
        else:
            self.states_ = fit_levels(df, self.transformer, self.levels_, "params", self)

    def _transform(self, df: DataFrame) -> DataFrame:
        if isinstance(self.transformer, Operator):
            out = self.each_.apply(df, lambda model, rows: with_groups(model.transform(rows), rows, self.groups))
            return out if self.keep_groups else out.drop(*self.groups)
        ps, ns = [temp("p") for _ in self.levels_], [temp("n") for _ in self.levels_]
        out = df
        for keys, state, p, n in zip(self.levels_, self.states_, ps, ns):
            out = attach(out, state, keys, p, n)
        used = F.when(F.col(ns[-1]).isNotNull(), F.col(ps[-1]))
        used = used.otherwise(F.col(ps[0]) if len(ps) > 1 else F.raise_error(F.lit("no model was fitted for this group")).cast(out.schema[ps[0]].dataType))
        scaled = {c: (F.col(c).cast("double") - used[c]["low"]) / used[c]["scale"] for c in self.transformer.columns}
        return out.withColumns(scaled).drop(*ps, *ns, *([] if self.keep_groups else self.groups))
