"""Operators around a model: thresholds, corrections by the confusion matrix, ordinal and zero-inflated labels."""

from __future__ import annotations

import copy
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.base import Classifier, Detector, Operator, Regressor, as_list, literal_array, number, total
from loomgrid.functions.decay import with_decay
from loomgrid.operators.linear import LinearRegression


class MLlibRegressor(Regressor):
    """Any MLlib regressor by column names."""

    def __init__(self, model, features, label: str, **names) -> None:
        super().__init__(features, label, **names)
        self.model = model

    def _assembled(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="__features").transform(df)

    def _params(self) -> dict:
        names = {"featuresCol": "__features", "labelCol": "__label", "predictionCol": "__prediction"}
        if self.weight:
            names["weightCol"] = self.weight
        return {self.model.getParam(k): v for k, v in names.items() if self.model.hasParam(k)}

    def _fit(self, df: DataFrame) -> None:
        rows = self._assembled(df.where(F.col(self.label).isNotNull()).withColumn("__label", F.col(self.label).cast("double")))
        self.model_ = self.model.copy().fit(rows, self._params())

    def predict(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return self.model_.transform(self._assembled(df)).select(*df.columns, F.col("__prediction").alias(self.prediction))

    _transform = predict


class MLlibClassifier(Classifier):
    """Any probabilistic MLlib classifier; labels of any type."""

    def __init__(self, model, features, label: str, **names) -> None:
        super().__init__(features, label, **names)
        self.model = model

    _assembled = MLlibRegressor._assembled
    _params = MLlibRegressor._params

    def _fit(self, df: DataFrame) -> None:
        self.learn_classes(df)
        index = F.array_position(F.array(*[F.lit(c) for c in self.classes_]), F.col(self.label)) - 1
        rows = self._assembled(df.where(F.col(self.label).isNotNull()).withColumn("__label", index.cast("double")))
        self.model_ = None if len(self.classes_) < 2 else self.model.copy().fit(rows, self._params())

    def predict_proba(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        self.check(df)
        if self.model_ is None:  # one class: nothing to tell apart
            return df.withColumn(self.probability, F.array(F.lit(1.0)))
        out = self.model_.transform(self._assembled(df))
        return out.select(*df.columns, vector_to_array(self.model_.getProbabilityCol()).alias(self.probability))


def fitted(model: Operator, df: DataFrame, refit: bool = True) -> Operator:
    return model if not refit and model.schema_ is not None else model.fit(df)


class EstimatorTransformer(Operator):
    """A model's output as feature columns: ``predict``, ``predict_proba`` (one column for each class) or ``decision_function``."""

    def __init__(self, estimator, predict_func: str = "predict", output: str = "feature") -> None:
        self.estimator, self.predict_func, self.output = estimator, predict_func, output

    def _fit(self, df: DataFrame) -> None:
        if not hasattr(self.estimator, self.predict_func):
            raise AttributeError(f"the estimator has no {self.predict_func}")
        self.estimator_ = self.estimator.fit(df)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = getattr(self.estimator_, self.predict_func)(df)
        if self.predict_func == "predict_proba":
            p = F.col(self.estimator_.probability)
            return out.select(*df.columns, *[F.element_at(p, k + 1).alias(f"{self.output}_{k}") for k in range(len(self.estimator_.classes_))])
        name = self.estimator_.score if self.predict_func == "decision_function" else self.estimator_.prediction
        return out.select(*df.columns, F.col(name).alias(self.output))


class DecayEstimator(Operator):
    """Fits a model with weights that fade with age; the model has to take weights."""

    def __init__(self, model, order_by, decay_func: str | Callable = "exponential", partition_by=None, **decay_options) -> None:
        self.model, self.order_by, self.decay_func, self.partition_by, self.options = model, order_by, decay_func, partition_by, decay_options

    def _fit(self, df: DataFrame) -> None:
        if not hasattr(self.model, "weight"):
            raise TypeError(f"{type(self.model).__name__} takes no weights")
        one = copy.copy(self.model)
        one.weight = "__decay"
        self.estimator_ = one.fit(with_decay(df, self.order_by, self.decay_func, "__decay", self.partition_by, **self.options))
        self.classes_ = getattr(self.estimator_, "classes_", None)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.estimator_.predict(df)

    _transform = predict

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.estimator_.predict_proba(df)


class _Around(Classifier):
    """A classifier that corrects another one's probabilities."""

    def __init__(self, model: Classifier) -> None:
        super().__init__(model.features, model.label, model.prediction, model.probability, model.weight)
        self.model = model

    def _fit(self, df: DataFrame) -> None:
        self.model_ = fitted(self.model, df)
        self.classes_ = self.model_.classes_

    def confusion_(self, df: DataFrame) -> np.ndarray:
        """Counts by (label, prediction), in one grouped aggregation."""
        at = {c: i for i, c in enumerate(self.classes_)}
        out = np.zeros((len(at), len(at)))
        scored = self.model_.predict(df.where(F.col(self.label).isNotNull()))
        for y, p, n in scored.groupBy(self.label, self.model_.prediction).count().collect():
            out[at[y], at[p]] = n
        return out

    def corrected(self, p: list[Column]) -> Column:
        raise NotImplementedError

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self.check(df)
        out = self.model_.predict_proba(df)
        given = F.col(self.model_.probability)
        return out.withColumn(self.probability, self.corrected([F.element_at(given, k + 1) for k in range(len(self.classes_))]))


class Thresholder(_Around):
    """Binary: the second class where its probability is above the threshold. ``refit=False`` keeps a fitted model."""

    def __init__(self, model: Classifier, threshold: float, refit: bool = False) -> None:
        super().__init__(model)
        self.threshold, self.refit = threshold, refit

    def _fit(self, df: DataFrame) -> None:
        self.model_ = fitted(self.model, df, self.refit)
        self.classes_ = self.model_.classes_
        if len(self.classes_) != 2:
            raise ValueError("the Thresholder needs two classes")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return self.model_.predict_proba(df)

    def predict(self, df: DataFrame) -> DataFrame:
        over = F.element_at(F.col(self.probability), 2) > self.threshold
        return self.predict_proba(df).withColumn(self.prediction, F.when(over, F.lit(self.classes_[1])).otherwise(F.lit(self.classes_[0])))

    _transform = predict


class ConfusionBalancer(_Around):
    """Blends probabilities with what the training rows say of each predicted class."""

    def __init__(self, estimator: Classifier, alpha: float = 0.5, cfm_smooth: float = 0) -> None:
        super().__init__(estimator)
        self.alpha, self.cfm_smooth = alpha, cfm_smooth

    def _fit(self, df: DataFrame) -> None:
        super()._fit(df)
        by_prediction = self.confusion_(df).T + self.cfm_smooth
        whole = by_prediction.sum(1, keepdims=True)
        self.cfm_ = np.divide(by_prediction, whole, out=np.full_like(by_prediction, np.nan), where=whole > 0)

    def corrected(self, p: list[Column]) -> Column:
        k = len(p)
        # A class that was never predicted says nothing: its probability stays as it is.
        c = np.where(np.isnan(self.cfm_), np.eye(k), self.cfm_)
        return F.array(*[(1 - self.alpha) * p[j] + self.alpha * total([p[i] * float(c[i, j]) for i in range(k)]) for j in range(k)])


class SubjectiveClassifier(_Around):
    """Weighs probabilities by the user's prior of the classes; evidence is predict_proba, confusion_matrix or both."""

    def __init__(self, estimator: Classifier, prior: dict, evidence: str = "both") -> None:
        super().__init__(estimator)
        if evidence not in ("predict_proba", "confusion_matrix", "both"):
            raise ValueError("evidence has to be predict_proba, confusion_matrix or both")
        if abs(sum(prior.values()) - 1) > 1e-9:
            raise ValueError("the prior has to sum to 1")
        self.prior, self.evidence = prior, evidence

    @staticmethod
    def posterior(confusion: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """By (class, predicted class): Bayes' rule with the confusion matrix' rows as likelihoods."""
        rows = confusion.sum(1, keepdims=True)
        likelihood = np.divide(confusion, rows, out=np.zeros_like(confusion, dtype=float), where=rows > 0)
        joint = likelihood * prior[:, None]
        whole = joint.sum(0)
        return np.where(whole > 0, joint / np.where(whole > 0, whole, 1), prior[:, None])

    def _fit(self, df: DataFrame) -> None:
        super()._fit(df)
        if missing := [c for c in self.classes_ if c not in self.prior]:
            raise ValueError(f"no prior defined for classes {missing}")
        self.prior_ = np.array([self.prior[c] for c in self.classes_], float)
        self.posterior_matrix_ = self.posterior(self.confusion_(df), self.prior_)

    def corrected(self, p: list[Column]) -> Column:
        k = len(p)
        scaled = lambda xs: F.array(*[F.coalesce(F.try_divide(x, total(xs)), F.lit(0.0)) for x in xs])
        if self.evidence == "predict_proba":
            return scaled([p[i] * float(self.prior_[i]) for i in range(k)])
        best = F.array_position(F.array(*p), F.greatest(*p) if k > 1 else p[0]).cast("int")
        after = [F.element_at(literal_array(self.posterior_matrix_[i]), best) for i in range(k)]
        return scaled([a * x for a, x in zip(after, p)]) if self.evidence == "both" else F.array(*after)


def platt(df: DataFrame, score: Column, target: Column) -> tuple[float, float]:
    """(a, b) of the sigmoid 1 / (1 + exp(-(a score + b))), by Newton steps with smoothed targets, one aggregation each."""
    table = df.select(score.cast("double").alias("s"), target.cast("double").alias("t")).dropna().cache()
    n1, n, m, d = table.agg(F.sum("t"), F.count("t"), F.avg("s"), F.stddev_pop("s")).first()
    if not n:
        table.unpersist()
        return 1.0, 0.0
    d = d or 1.0
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (n - n1 + 2)
    theta = np.array([0.0, np.log((n1 + 1) / (n - n1 + 1))])
    z, t = (F.col("s") - m) / d, F.when(F.col("t") > 0, hi).otherwise(lo)
    for _ in range(30):
        p = 1 / (1 + F.exp(-(z * float(theta[0]) + float(theta[1]))))
        w = p * (1 - p)
        g0, g1, a, b, c = table.agg(F.sum((p - t) * z), F.sum(p - t), F.sum(w * z * z), F.sum(w * z), F.sum(w)).first()
        step = np.linalg.solve(np.array([[a + 1e-9, b], [b, c + 1e-9]]), np.array([g0, g1]))
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    table.unpersist()
    return float(theta[0] / d), float(theta[1] - theta[0] * m / d)


class OrdinalClassifier(Classifier):
    """Ordered labels: one binary model for each border; probabilities are differences and may be slightly negative.
    ``use_calibration`` fits a sigmoid to each model's log odds of rows that it didn't learn from: ``folds`` models, each without
    one part of the rows (by a hash of features and label), score that part."""

    def __init__(self, estimator: Classifier, use_calibration: bool = False, folds: int = 5) -> None:
        super().__init__(estimator.features, estimator.label, estimator.prediction, estimator.probability, estimator.weight)
        if folds < 2:
            raise ValueError("folds has to be at least 2")
        self.estimator, self.use_calibration, self.folds = estimator, use_calibration, folds

    def _fit(self, df: DataFrame) -> None:
        self.learn_classes(df)
        if len(self.classes_) < 3:
            raise ValueError("an ordinal label needs at least 3 classes")
        self.estimators_, self.sigmoids_ = [], []
        for c in self.classes_[:-1]:
            one = copy.copy(self.estimator)
            one.label, one.probability = "__up_to", "__p"
            rows = df.withColumn("__up_to", F.when(F.col(self.label) <= F.lit(c), 1).otherwise(0))
            self.estimators_.append(one.fit(rows))
            if self.use_calibration:
                p = F.greatest(F.least(F.element_at("__p", 2), F.lit(1 - 1e-9)), F.lit(1e-9))
                fold, scored = F.pmod(F.xxhash64(*self.features, self.label), F.lit(self.folds)), None
                for k in range(self.folds):
                    part = one.fit(rows.where(fold != k)).predict_proba(rows.where(fold == k))
                    scored = part if scored is None else scored.union(part)
                self.sigmoids_.append(platt(scored, F.log(p / (1 - p)), F.col("__up_to")))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self.check(df)
        out, names = df, []
        for k, one in enumerate(self.estimators_):
            out = one.predict_proba(out)
            p = F.element_at(F.col("__p"), 2)
            if self.use_calibration:
                a, b = self.sigmoids_[k]
                q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
                p = 1 / (1 + F.exp(-(a * F.log(q / (1 - q)) + b)))
            names.append(f"__p{k}")
            out = out.withColumn(names[-1], p).drop("__p")
        ends = [F.lit(0.0), *[F.col(n) for n in names], F.lit(1.0)]
        return out.withColumn(self.probability, F.array(*[b - a for a, b in zip(ends, ends[1:])])).drop(*names)


class RegressionOutlierDetector(Detector):
    """Outliers by the error of a regression of one column on the others: beyond ``lower`` and ``upper`` deviations
    (``sd``), shares of the value (``relative``) or units (``absolute``)."""

    def __init__(self, columns, column: str, model: Regressor | None = None, lower: float = 2, upper: float = 2, method: str = "sd", **names) -> None:
        super().__init__(columns, **names)
        if method not in ("sd", "relative", "absolute"):
            raise ValueError("method has to be sd, relative or absolute")
        self.column, self.lower, self.upper, self.method = column, lower, upper, method
        self.model = model or LinearRegression([c for c in self.features if c != column], column)

    def uses(self) -> list[str]:
        return sorted({*self.features, self.column})

    def _fit(self, df: DataFrame) -> None:
        self.model_ = self.model.fit(df)
        self.sd_ = df.agg(F.stddev_pop(F.col(self.column) - self.model_.expr())).first()[0]

    def decision(self) -> Column:
        y = F.col(self.column).cast("double")
        gap = y - self.model_.expr()
        unit = {"sd": lambda: F.lit(float(self.sd_ or 0.0)), "relative": lambda: F.lit(1.0), "absolute": lambda: F.lit(1.0)}[self.method]()
        size = F.try_divide(gap, y) if self.method == "relative" else gap
        return F.coalesce(F.least(size + self.lower * unit, self.upper * unit - size), F.lit(0.0))


class OutlierClassifier(Classifier):
    """An outlier detector as a classifier: class 1 are outliers; probabilities by a sigmoid of the decision."""

    def __init__(self, model: Detector, label: str, prediction: str = "prediction", probability: str = "probability") -> None:
        super().__init__(model.features, label, prediction, probability)
        self.model = model

    def _fit(self, df: DataFrame) -> None:
        self.model_, self.classes_ = self.model.fit(df), [0, 1]
        self.sigmoid_ = platt(df, self.model_.decision(), F.when(F.col(self.label) > 0, 1).otherwise(0))

    def probabilities(self) -> Column:
        p = 1 / (1 + F.exp(-(self.sigmoid_[0] * self.model_.decision() + self.sigmoid_[1])))
        return F.array(1 - p, p)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).withColumn(self.prediction, F.when(self.model_.decision() < 0, 1).otherwise(0))

    _transform = predict


class ZeroInflatedRegressor(Regressor):
    """Zero where the classifier says so, else a regression of the rows that aren't zero."""

    def __init__(self, classifier: Classifier, regressor: Regressor, handle_zero: str = "error", prediction: str = "prediction") -> None:
        super().__init__(sorted({*classifier.features, *regressor.features}), regressor.label, prediction)
        if handle_zero not in ("error", "ignore"):
            raise ValueError("handle_zero has to be error or ignore")
        self.classifier, self.regressor, self.handle_zero = classifier, regressor, handle_zero

    def _fit(self, df: DataFrame) -> None:
        one = copy.copy(self.classifier)
        one.label, one.prediction, one.probability = "__nonzero", "__is", "__p"
        self.classifier_ = one if one.schema_ is not None else one.fit(df.withColumn("__nonzero", F.when(F.col(self.label) != 0, 1).otherwise(0)))
        rest = df.where(F.col(self.label) != 0)
        if rest.isEmpty():
            if self.handle_zero == "error":
                raise ValueError("the label is zero everywhere: nothing to regress on")
            rest = df
        two = copy.copy(self.regressor)
        two.prediction = "__value"
        self.regressor_ = two if two.schema_ is not None else two.fit(rest)

    def _both(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return self.regressor_.predict(self.classifier_.predict(df))

    def predict(self, df: DataFrame) -> DataFrame:
        value = F.when(F.col("__is") == 1, F.col("__value")).otherwise(0.0)
        return self._both(df).withColumn(self.prediction, value).drop("__is", "__p", "__value")

    _transform = predict

    def score_samples(self, df: DataFrame) -> DataFrame:
        """Probability of a value other than zero times the value."""
        classes = self.classifier_.classes_
        p = F.element_at(F.col("__p"), classes.index(1) + 1) if 1 in classes else number(0)
        return self._both(df).withColumn(self.prediction, p * F.col("__value")).drop("__is", "__p", "__value")
