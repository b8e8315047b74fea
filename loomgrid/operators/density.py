"""Classifiers and outlier detectors from densities: normal mixtures (maximum likelihood or variational) and kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.base import Classifier, Detector, best_class, check_small, let, softmax, total
from loomgrid.operators.features import quantile
from loomgrid.operators.linear import Rows

LOG_2PI = math.log(2 * math.pi)


def digamma(x: np.ndarray) -> np.ndarray:
    """By the recurrence up to 6 and the asymptotic series from there."""
    x, out = np.array(x, float), np.zeros_like(np.array(x, float))
    for _ in range(6):
        small = x < 6
        out = out - np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


class Mixture:
    """A mixture of normals over numeric columns. Each step is one pass that sums responsibilities, means and squares.

    ``bayesian`` adds a prior on the weights (a stick-breaking Dirichlet process, or a symmetric Dirichlet distribution) and a
    normal-Wishart prior on the components (variational). The starting means of several components are sought in a sample of at
    most ``START_ROWS`` rows; every step after that reads all of them.
    """

    START_ROWS = 10_000


    def __init__(self, n_components: int = 1, covariance_type: str = "full", tol: float = 1e-3, reg_covar: float = 1e-6, max_iter: int = 100, random_state: int | None = None, bayesian: bool = False, weight_concentration_prior_type: str = "dirichlet_process", weight_concentration_prior: float | None = None, mean_precision_prior: float | None = None, degrees_of_freedom_prior: float | None = None) -> None:
        if covariance_type not in ("full", "tied", "diag", "spherical"):
            raise ValueError("covariance_type has to be full, tied, diag or spherical")
        if n_components < 1:
            raise ValueError("n_components has to be at least 1")
        if weight_concentration_prior_type not in ("dirichlet_process", "dirichlet_distribution"):
            raise ValueError("weight_concentration_prior_type has to be dirichlet_process or dirichlet_distribution")
        self.prior_type = weight_concentration_prior_type
        self.n_components, self.covariance_type, self.tol, self.reg_covar, self.max_iter, self.random_state = n_components, covariance_type, tol, reg_covar, max_iter, random_state
        self.bayesian, self.weight_prior, self.mean_prior, self.dof_prior = bayesian, weight_concentration_prior, mean_precision_prior, degrees_of_freedom_prior

    def fit(self, df: DataFrame, features: list[str]) -> Mixture:
        d, k = len(features), self.n_components
        self.features = list(features)
        rows = Rows(df.dropna(subset=self.features), [F.col(c) for c in self.features])
        first = rows.sums(lambda m: np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()]))
        if not len(first):
            rows.close()
            raise ValueError("no rows to learn from")
        n, centre = first[0], first[1 : d + 1] / first[0]
        spread = first[d + 1 :].reshape(d, d) / n - np.outer(centre, centre)
        rng = np.random.default_rng(self.random_state if self.random_state is not None else 0)
        if k > 1:
            wanted = min(1.0, max(2000, 50 * k) / n)
            sample = np.array(rows.table.sample(wanted, seed=int(rng.integers(1 << 31))).limit(self.START_ROWS).collect(), float).reshape(-1, d)
            sample = sample if len(sample) >= k else np.array(rows.table.limit(max(k, 2000)).collect(), float).reshape(-1, d)
            means = self._spread_out(sample, k, rng)
        else:
            means = centre[None]
        self.weights_, self.means_ = np.full(k, 1 / k), means
        self.covariances_ = np.repeat((spread / (k if k > 1 else 1) + self.reg_covar * np.eye(d))[None], k, 0)
        self.prior_mean_, self.prior_cov_ = centre, spread + self.reg_covar * np.eye(d)
        self.extra_ = np.zeros(k)
        self.converged_, last = False, -np.inf
        for self.n_iter_ in range(1, (self.max_iter if k > 1 or self.bayesian else 1) + 1):
            log = self.log_terms

            def step(m):
                logs = log(m)
                top = logs.max(1, keepdims=True)
                p = np.exp(logs - top)
                whole = p.sum(1, keepdims=True)
                p /= whole
                square = np.einsum("nk,ni,nj->kij", p, m - centre, m - centre, optimize=True)
                return np.concatenate([[(top + np.log(whole)).sum()], p.sum(0), (p.T @ (m - centre)).ravel(), square.ravel()])

            s = rows.sums(step)
            bound, nk = s[0] / n, np.maximum(s[1 : k + 1], 1e-10)
            mean = s[k + 1 : k + 1 + k * d].reshape(k, d) / nk[:, None]
            second = s[k + 1 + k * d :].reshape(k, d, d) / nk[:, None, None]
            self._update(n, nk, mean + centre, second - np.einsum("ki,kj->kij", mean, mean))
            if abs(bound - last) < self.tol:
                self.converged_ = True
                break
            last = bound
        rows.close()
        self.lower_bound_ = bound
        return self

    @staticmethod
    def _spread_out(sample: np.ndarray, k: int, rng) -> np.ndarray:
        """Starting means: each next one is drawn by its squared distance from those before, then a few rounds of k-means."""
        means = sample[[rng.integers(len(sample))]]
        while len(means) < k:
            gap = ((sample[:, None] - means) ** 2).sum(2).min(1)
            p = gap / gap.sum() if gap.sum() > 0 else None
            means = np.vstack([means, sample[rng.choice(len(sample), p=p)]])
        for _ in range(10):
            near = ((sample[:, None] - means) ** 2).sum(2).argmin(1)
            means = np.array([sample[near == i].mean(0) if (near == i).any() else means[i] for i in range(k)])
        return means

    def _update(self, n: float, nk: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> None:
        k, d = means.shape
        if self.bayesian:
            a0 = self.weight_prior if self.weight_prior is not None else 1 / k
            b0 = self.mean_prior if self.mean_prior is not None else 1.0
            v0 = self.dof_prior if self.dof_prior is not None else float(d)
            beta, nu = b0 + nk, v0 + nk
            gap = means - self.prior_mean_
            scatter = self.prior_cov_ + nk[:, None, None] * covariances + (b0 * nk / beta)[:, None, None] * np.einsum("ki,kj->kij", gap, gap)
            self.means_ = (b0 * self.prior_mean_ + nk[:, None] * means) / beta[:, None]
            covariances = scatter / nu[:, None, None]
            if self.prior_type == "dirichlet_process":  # of what the components before left, the share of each
                taken, left = 1 + nk, a0 + np.append(np.cumsum(nk[::-1])[::-1][1:], 0)
                both = digamma(taken + left)
                self.weights_ = np.exp(digamma(taken) - both + np.append(0, np.cumsum(digamma(left) - both)[:-1]))
            else:
                alpha = a0 + nk
                self.weights_ = np.exp(digamma(alpha) - digamma(np.array(alpha.sum())))
            # What the uncertainty of precision and mean adds to the expected log density of each component.
            self.extra_ = 0.5 * (digamma(0.5 * (nu[:, None] - np.arange(d))).sum(1) + d * math.log(2) - d * np.log(nu) - d / beta)
        else:
            self.weights_, self.means_ = nk / n, means
        eye = np.eye(d)
        if self.covariance_type == "tied":
            covariances = np.repeat(np.average(covariances, axis=0, weights=nk)[None], k, 0)
        elif self.covariance_type == "diag":
            covariances = covariances * eye
        elif self.covariance_type == "spherical":
            covariances = np.trace(covariances, axis1=1, axis2=2)[:, None, None] / d * eye
        self.covariances_ = covariances + self.reg_covar * eye

    def factors(self) -> list[tuple[np.ndarray, float]]:
        """For each component a matrix that whitens it, and its log determinant."""
        out = []
        for c in self.covariances_:
            low = np.linalg.cholesky(c)
            out.append((np.linalg.inv(low).T, -np.log(np.diag(low)).sum()))
        return out

    def log_terms(self, m: np.ndarray) -> np.ndarray:
        parts = []
        for w, mu, e, (white, logdet) in zip(self.weights_, self.means_, self.extra_, self.factors()):
            z = (m - mu) @ white
            parts.append(np.log(w) - 0.5 * (m.shape[1] * LOG_2PI + (z * z).sum(1)) + logdet + e)
        return np.column_stack(parts)

    def log_density(self) -> Column:
        """The log density of a row (numerically safe)."""
        terms, d = [], len(self.features)
        for w, mu, e, (white, logdet) in zip(self.weights_, self.means_, self.extra_, self.factors()):
            gaps = [F.col(c).cast("double") - float(x) for c, x in zip(self.features, mu)]
            z = [total([g * float(white[i, j]) for i, g in enumerate(gaps) if white[i, j]]) for j in range(d)]
            constant = float(np.log(w) - 0.5 * d * LOG_2PI + logdet + e)
            terms.append(constant - 0.5 * total([x * x for x in z]))
        if len(terms) == 1:
            return terms[0]
        top = F.greatest(*terms)
        return top + F.log(total([F.exp(t - top) for t in terms]))


class GMMClassifier(Classifier):
    """A mixture for each label, compared without class priors."""

    bayesian = False

    def __init__(self, features, label: str, n_components: int = 1, prediction: str = "prediction", probability: str = "probability", **mixture) -> None:
        super().__init__(features, label, prediction, probability)
        self.mixture = {"n_components": n_components, **mixture}

    def _fit(self, df: DataFrame) -> None:
        self.learn_classes(df)
        if self.mixture.get("n_components", 1) == 1 and not self.bayesian:
            self.gmms_ = self._one_each(df)
        else:
            self.gmms_ = {c: Mixture(bayesian=self.bayesian, **self.mixture).fit(df.where(F.col(self.label) == c), self.features) for c in self.classes_}

    def _one_each(self, df: DataFrame) -> dict:
        """One normal for each label, of all labels by one aggregation."""
        x, d = [F.col(c).cast("double") for c in self.features], len(self.features)
        asks = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]]
        rows = {r[self.label]: r for r in df.dropna(subset=self.features).groupBy(self.label).agg(*asks).collect()}  # one for each label
        out = {}
        for c in self.classes_:
            if c not in rows:
                raise ValueError("no rows to learn from")
            one, r = Mixture(**self.mixture), rows[c]
            one.features, one.extra_, one.converged_, one.n_iter_ = list(self.features), np.zeros(1), True, 1
            spread = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
            one._update(r["n"], np.array([float(r["n"])]), np.array([[r[f"m{i}"] for i in range(d)]]), spread[None])
            out[c] = one
        return out

    def probabilities(self) -> Column:
        return softmax([self.gmms_[c].log_density() for c in self.classes_])


class BayesianGMMClassifier(GMMClassifier):
    bayesian = True


class GaussianMixtureNB(GMMClassifier):
    """A one-dimensional mixture for each label and feature; the log densities add up, without class priors."""

    def _fit(self, df: DataFrame) -> None:
        self.learn_classes(df)
        simple = self.mixture == {"n_components": 1} and not self.bayesian
        if simple:  # one aggregation for all labels
            asks = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(self.features) for n, f in (("m", F.avg), ("v", F.var_pop))]
            rows = {r[self.label]: r for r in df.dropna(subset=self.features).groupBy(self.label).agg(*asks).collect()}
        self.gmms_ = {}
        for c in self.classes_:
            self.gmms_[c] = []
            for i, f in enumerate(self.features):
                if simple:
                    one = Mixture()
                    one.features, one.weights_, one.extra_ = [f], np.ones(1), np.zeros(1)
                    one.means_, one.covariances_ = np.array([[rows[c][f"m{i}"]]]), np.array([[[rows[c][f"v{i}"] + one.reg_covar]]])
                else:
                    one = Mixture(bayesian=self.bayesian, **self.mixture).fit(df.where(F.col(self.label) == c), [f])
                self.gmms_[c].append(one)

    def probabilities(self) -> Column:
        return softmax([total([m.log_density() for m in self.gmms_[c]]) for c in self.classes_])


class BayesianGaussianMixtureNB(GaussianMixtureNB):
    bayesian = True


class GMMOutlierDetector(Detector):
    """Rows of low likelihood. ``quantile``: below the 1 - threshold quantile of the training rows; ``stddev``: more than
    threshold deviations below the mean, the deviation taken from the rows left of the most common likelihood, which is sought in a
    smoothed density of 1001 exact percentiles of all rows."""

    bayesian = False

    def __init__(self, features, threshold: float = 0.99, method: str = "quantile", n_components: int = 1, prediction: str = "prediction", score: str = "score", **mixture) -> None:
        super().__init__(features, prediction, score)
        self.threshold, self.method, self.mixture = threshold, method, {"n_components": n_components, **mixture}

    def _fit(self, df: DataFrame) -> None:
        if self.method not in ("quantile", "stddev"):
            raise ValueError("method has to be quantile or stddev")
        if self.method == "quantile" and not 0 <= self.threshold <= 1:
            raise ValueError("threshold has to be from 0 to 1")
        if self.method == "stddev" and self.threshold < 0:
            raise ValueError("threshold has to be at least 0")
        self.gmm_ = Mixture(bayesian=self.bayesian, **self.mixture).fit(df, self.features)
        log = df.dropna(subset=self.features).select(self.gmm_.log_density().alias("l"))
        if self.method == "quantile":
            self.offset_ = quantile(log, ["l"], [1 - self.threshold])["l"][0]
            return
        n, mean, deviation = log.agg(F.count("l"), F.avg("l"), F.stddev_samp("l")).first()
        marks, width = np.array(quantile(log, ["l"], [k / 1000 for k in range(1001)])["l"]), (deviation or 1.0) * n**-0.2
        grid = np.linspace(marks[0], marks[-1], 2001)
        density = np.exp(-0.5 * ((grid[:, None] - marks) / width) ** 2).sum(1)
        mode = float(grid[density.argmax()])
        left = log.where(F.col("l") < mode).agg(F.stddev_pop("l")).first()[0] or 0.0
        self.offset_ = mean - self.threshold * left

    def score_samples(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return df.withColumn(self.score, self.gmm_.log_density())

    def decision(self) -> Column:
        return self.gmm_.log_density() - self.offset_


class BayesianGMMOutlierDetector(GMMOutlierDetector):
    bayesian = True


class BayesianKernelDensityClassifier(Classifier):
    """Kernel density of each label times its share. Each row meets all training rows: quadratic by nature, so more than
    ``most_rows`` training rows are an error, and no more are broadcast. Sums are kept by powers of exp(500), so that far rows neither
    vanish nor need a pass of their own for the largest. ``metric`` is euclidean, manhattan or chebyshev."""

    METRICS = {
        "euclidean": lambda gaps: F.sqrt(total([g * g for g in gaps])),
        "manhattan": lambda gaps: total([F.abs(g) for g in gaps]),
        "chebyshev": lambda gaps: F.greatest(F.lit(0.0), *[F.abs(g) for g in gaps]),
    }

    KERNELS = {
        "gaussian": lambda d, h: -0.5 * d * d / (h * h),
        "exponential": lambda d, h: -d / h,
        "tophat": lambda d, h: F.when(d < h, 0.0),
        "epanechnikov": lambda d, h: F.when(d < h, F.log(1 - d * d / (h * h))),
        "linear": lambda d, h: F.when(d < h, F.log(1 - d / h)),
        "cosine": lambda d, h: F.when(d < h, F.log(F.cos(d * (math.pi / 2 / h)))),
    }

    def __init__(self, features, label: str, bandwidth: float = 0.2, kernel: str = "gaussian", prediction: str = "prediction", probability: str = "probability", metric: str = "euclidean", most_rows: int = 1_000_000) -> None:
        super().__init__(features, label, prediction, probability)
        if kernel not in self.KERNELS:
            raise ValueError(f"kernel has to be one of {sorted(self.KERNELS)}")
        if metric not in self.METRICS:
            raise ValueError(f"metric has to be one of {sorted(self.METRICS)}")
        self.bandwidth, self.kernel, self.metric, self.most_rows = bandwidth, kernel, metric, most_rows

    def _fit(self, df: DataFrame) -> None:
        self.learn_classes(df)
        known = df.where(F.col(self.label).isNotNull())
        # Class share times the mean of kernels: the share cancels against the number of rows, so plain sums compare.
        self.train_ = known.select(*[F.col(c).cast("double").alias(f"t{i}") for i, c in enumerate(self.features)], F.col(self.label).alias("ty"))
        check_small(self.train_, self.most_rows)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self.check(df)
        names, point = df.columns, F.struct(*[F.col(c).cast("double").alias(c) for c in self.features])
        distinct = df.select(point.alias("__point")).distinct()
        gap = self.METRICS[self.metric]([F.col("__point")[c] - F.col(f"t{i}") for i, c in enumerate(self.features)])
        logs = distinct.crossJoin(F.broadcast(self.train_)).select("__point", "ty", self.KERNELS[self.kernel](gap, F.lit(self.bandwidth)).alias("l")).where("l is not null")
        power = F.floor(F.col("l") / 500.0)
        sums = logs.groupBy("__point", "ty", power.alias("k")).agg(F.sum(F.exp(F.col("l") - 500.0 * power)).alias("s"))
        parts = sums.groupBy("__point", "ty").agg(F.collect_list(F.log("s") + 500.0 * F.col("k")).alias("ls"))  # a few powers
        summed = parts.select("__point", "ty", let(F.array_max("ls"), lambda top: top + F.log(F.aggregate("ls", F.lit(0.0), lambda a, x: a + F.exp(x - top)))).alias("l"))
        by = summed.groupBy("__point").agg(*[F.max(F.when(F.col("ty") == c, F.col("l"))).alias(f"l{k}") for k, c in enumerate(self.classes_)])
        ls = [F.coalesce(F.col(f"l{k}"), F.lit(-1e300)) for k in range(len(self.classes_))]
        table = by.select("__point", softmax(ls).alias(self.probability))
        even = F.array(*[F.lit(1.0 / len(ls)) for _ in ls])
        out = df.withColumn("__point", point).join(table, "__point", "left")
        return out.withColumn(self.probability, F.coalesce(self.probability, even)).select(*names, self.probability)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).withColumn(self.prediction, best_class(F.col(self.probability), self.classes_))

    _transform = predict
