"""What every operator shares: fit gives a fitted copy, transform is a lazy projection.

``fit`` runs Spark aggregations and keeps their small result (numbers, or a state table for grouped models);
``transform`` and ``predict`` only add expressions, so Catalyst plans them with what comes before and after, and they
work on streams as well.
"""

from __future__ import annotations

import copy
import math
import uuid
from functools import reduce
from operator import add
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM_EXPRESSIONS = 24


class NotFitted(RuntimeError):
    """Raised where an operator is applied before ``fit``."""


class Operator:
    """Base of all operators: ``fit(df)`` returns a fitted copy and leaves the operator as it was."""

    schema_ = None

    def fit(self, df: DataFrame) -> Operator:
        model = copy.copy(self)
        model._fit(df)
        model.schema_ = df.schema
        return model

    def _fit(self, df: DataFrame) -> None:
        """Operators that learn nothing keep this."""

    def transform(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return self._transform(df)

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def check(self, df: DataFrame) -> None:
        """The columns the operator was fitted on have to be there; no job runs for this."""
        if self.schema_ is None:
            raise NotFitted(f"{type(self).__name__} has to be fitted first")
        missing = [c for c in self.uses() if c not in df.columns]
        if missing:
            raise KeyError(f"columns {missing} are not in the DataFrame")

    def uses(self) -> list[str]:
        return list(getattr(self, "features", None) or [])


class Regressor(Operator):
    """Predicts ``label`` from ``features``; ``expr`` is the fitted prediction as a Column."""

    def __init__(self, features: list[str], label: str, prediction: str = "prediction", weight: str | None = None) -> None:
        self.features, self.label, self.prediction, self.weight = as_list(features), label, prediction, weight

    def expr(self) -> Column:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return df.withColumn(self.prediction, self.expr())

    _transform = predict


class Classifier(Operator):
    """``classes_`` in ascending order; ``probabilities`` is an array Column in that order."""

    classes_: list

    def __init__(self, features: list[str], label: str, prediction: str = "prediction", probability: str = "probability", weight: str | None = None) -> None:
        self.features, self.label, self.prediction, self.probability, self.weight = as_list(features), label, prediction, probability, weight

    def learn_classes(self, df: DataFrame) -> None:
        self.classes_ = distinct_values(df, self.label)
        if not self.classes_:
            raise ValueError("no label to learn from")

    def probabilities(self) -> Column:
        raise NotImplementedError

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return df.withColumn(self.probability, self.probabilities())

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).withColumn(self.prediction, best_class(F.col(self.probability), self.classes_))

    _transform = predict


class Detector(Operator):
    """Outliers: ``prediction`` is -1 for outliers and 1 for others; ``score`` is larger for ordinary rows."""

    def __init__(self, features: list[str], prediction: str = "prediction", score: str = "score") -> None:
        self.features, self.prediction, self.score = as_list(features), prediction, score

    def decision(self) -> Column:
        """At least 0 for ordinary rows."""
        raise NotImplementedError

    def decision_function(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return df.withColumn(self.score, self.decision())

    def predict(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return df.withColumn(self.prediction, F.when(self.decision() >= 0, 1).otherwise(-1))

    _transform = predict


@runtime_checkable
class ProbabilisticClassifier(Protocol):
    """Anything with probabilities."""

    def predict_proba(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Clusterer(Protocol):
    """Anything that tags rows with their cluster."""

    def tagged(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class OutlierModel(Protocol):
    """Anything whose decision is at least 0 for ordinary rows."""

    def decision(self) -> Column: ...


# ---------------------------------------------------------------- helpers


def as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [] if value is None else [value]


def flatten(nested) -> list:
    """All items of lists within lists."""
    return [x for item in nested for x in (flatten(item) if isinstance(item, (list, tuple, set)) else [item])]


def temp(name: str) -> str:
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def total(columns: list[Column]) -> Column:
    return reduce(add, columns, F.lit(0.0)) if columns else F.lit(0.0)


def linear(features: list[str], coef, intercept: float = 0.0) -> Column:
    return total([F.col(c).cast("double") * float(w) for c, w in zip(features, coef)]) + F.lit(float(intercept))


def number(x) -> Column:
    return F.lit(None if x is None else float(x)).cast("double")


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def best_class(p: Column, classes: list) -> Column:
    """The first class of the largest probability."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(p, F.array_max(p)).cast("int"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it: long expressions don't multiply."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shares(p: Column) -> Column:
    """An array in proportion to its sum; zeros if that is zero."""
    whole = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return let(p, lambda a: let(whole(a), lambda w: F.transform(a, lambda x: F.coalesce(F.try_divide(x, w), F.lit(0.0)))))


def normalised(p: list[Column]) -> Column:
    return shares(F.array(*p))


def softmax(logs: list[Column]) -> Column:
    """Exponentials in proportion, safe for any size of the logarithms; a null logarithm gets probability 0."""
    return shares(let(F.array(*logs), lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0))))))


MOST_LABELS = 10_000


def distinct_values(df: DataFrame, column: str) -> list:
    """Labels or levels, sorted. More than ``MOST_LABELS`` are an error: such a column is no label, and the driver doesn't hold it."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"{column} has more than {MOST_LABELS} different values")
    return sorted(r[0] for r in rows)


def check_small(df: DataFrame, most_rows: int) -> None:
    """An error if a table that every row is compared with has more than ``most_rows`` rows."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} training rows, with each of which every row is compared: learn from a sample of them")


def refuse_stream(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} needs the order or all rows of the table and can't run on a stream")


def gram(df: DataFrame, columns: list, weight: Column | None = None) -> np.ndarray:
    """Sums of products of all pairs of columns (names or Columns), in one pass."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    d, w = len(cols), F.lit(1.0) if weight is None else weight
    if d <= GRAM_EXPRESSIONS:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = df.agg(*[F.sum(cols[i].cast("double") * cols[j].cast("double") * w).alias(f"s{k}") for k, (i, j) in enumerate(pairs)]).first()
        out = np.zeros((d, d))
        for (i, j), v in zip(pairs, row):
            out[i, j] = out[j, i] = v or 0.0
        return out

    def partial(batches):
        sums = np.zeros((d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            sums += (x[:, :d] * x[:, d:]).T @ x[:, :d]
        yield pa.RecordBatch.from_arrays([pa.array(range(d * d), pa.int32()), pa.array(sums.ravel())], names=["k", "v"])

    rows = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)], w.cast("double").alias("w"))
    sums = dict(rows.mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v")).collect())
    return np.array([sums.get(k, 0.0) for k in range(d * d)]).reshape(d, d)


def centred(df: DataFrame, columns: list, weight: Column | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(number, means, sums of centred products): a second pass around the means keeps large offsets exact."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    w = F.lit(1.0) if weight is None else weight
    first = df.agg(F.sum(w).alias("n"), *[F.sum(c.cast("double") * w).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if not first[0]:
        raise ValueError("no rows to learn from")
    means = np.array([m or 0.0 for m in first[1:]]) / first[0]
    return float(first[0]), means, gram(df, [c.cast("double") - float(m) for c, m in zip(cols, means)], w)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-norm solution: a singular matrix is no error."""
    return np.linalg.lstsq(a, b, rcond=None)[0]


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))
