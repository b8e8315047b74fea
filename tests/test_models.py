import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from loomgrid.operators import density, linear, meta, outliers


def frame(spark, x, y=None, names=None):
    names = names or [f"x{i}" for i in range(x.shape[1])]
    rows = [(*map(float, r), *([v.item() if hasattr(v, "item") else v] if y is not None else [])) for r, v in zip(x, y if y is not None else x)]
    kind = "" if y is None else ", y double" if np.asarray(y).dtype.kind == "f" else ", y long"
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + kind)


def column(df, name):
    return np.array([r[0] for r in df.select(name).collect()])


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, 0.0, -2.0] + 3 + rng.normal(0, 0.1, 400)
    return x, y, frame(spark, x, y)


FEATURES = ["x0", "x1", "x2"]


def test_least_squares(line):
    x, y, df = line
    model = linear.LinearRegression(FEATURES, "y").fit(df)
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    assert np.allclose([model.intercept_, *model.coef_], want)
    weighted = linear.LinearRegression(FEATURES, "y", weight="w").fit(df.withColumn("w", F.when(F.col("x0") > 0, 1.0).otherwise(0.0)))
    on = x[:, 0] > 0
    assert np.allclose(weighted.coef_, np.linalg.lstsq(np.c_[np.ones(on.sum()), x[on]], y[on], rcond=None)[0][1:])


def expectile_loss(x, y, theta, factor):
    r = y - np.c_[np.ones(len(x)), x] @ theta
    return (np.where(r < 0, factor, 1) * r**2).mean()


def test_imbalanced(line):
    x, y, df = line
    model = linear.ImbalancedLinearRegression(FEATURES, "y", 5.0).fit(df)
    theta = np.array([model.intercept_, *model.coef_])
    best, rng = expectile_loss(x, y, theta, 5.0), np.random.default_rng(1)
    assert all(expectile_loss(x, y, theta + rng.normal(0, 1e-3, 4), 5.0) >= best for _ in range(300))


@pytest.mark.parametrize("quantile", [0.1, 0.5, 0.8])
def test_quantile(line, quantile):
    x, y, df = line
    model = linear.QuantileRegression(FEATURES, "y", quantile).fit(df)
    pinball = lambda t: np.maximum(quantile * (r := y - np.c_[np.ones(400), x] @ t), (quantile - 1) * r).mean()
    theta, rng = np.array([model.intercept_, *model.coef_]), np.random.default_rng(1)
    assert all(pinball(theta + rng.normal(0, 3e-3, 4)) >= pinball(theta) - 1e-6 for _ in range(300))
    assert abs((y <= column(model.predict(df), "prediction")).mean() - quantile) < 0.03
    with pytest.raises(ValueError):
        linear.QuantileRegression(FEATURES, "y", 2)


def test_positive_and_penalties(line):
    _, _, df = line
    assert (linear.LADRegression(FEATURES, "y", positive=True).fit(df).coef_ >= 0).all()
    free, held = (linear.ImbalancedLinearRegression(FEATURES, "y", 1.0, alpha=a).fit(df) for a in (0.0, 10.0))
    assert np.abs(held.coef_).sum() < np.abs(free.coef_).sum()
    sparse = linear.ImbalancedLinearRegression(FEATURES, "y", 1.0, alpha=0.3, l1_ratio=1.0).fit(df)
    assert abs(sparse.coef_[1]) < 1e-3 < abs(sparse.coef_[0])


@pytest.mark.parametrize("effect", ["linear", "quadratic"])
def test_dead_zone(spark, effect):
    rng = np.random.default_rng(42)
    x = np.c_[np.ones(100), rng.normal(size=100)]
    y = x @ [3.1, 2.0]
    model = linear.DeadZoneRegressor(["x0", "x1"], "y", 0.1, effect=effect).fit(frame(spark, x, y))
    assert np.abs(x @ model.coef_ - y).max() < 0.15
    assert not linear.DeadZoneRegressor(["x0"], "y", effect="constant").fit(frame(spark, x, y)).coef_.any()


def test_prob_weight(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = x @ [0.5, 0.5, 0.0, 0.0] + 0.05 * rng.normal(size=300)
    df = frame(spark, x, y)
    names = [f"x{i}" for i in range(4)]
    model = linear.ProbWeightRegression(names, "y").fit(df)
    loss = lambda w: ((x @ w - y) ** 2).sum()
    assert np.isclose(model.coef_.sum(), 1) and (model.coef_ >= 0).all()
    assert all(loss(w) >= loss(model.coef_) - 1e-9 for w in rng.dirichlet(np.ones(4), 2000))
    hard = linear.ProbWeightRegression(names, "y").fit(frame(spark, x, x @ [2.0, -3.0, 1.0, 0.5]))
    other = lambda w: ((x @ w - x @ [2.0, -3.0, 1.0, 0.5]) ** 2).sum()
    assert all(other(w) >= other(hard.coef_) - 1e-9 for w in rng.dirichlet(np.ones(4) * 0.3, 4000))
    assert np.isclose(linear.ProbWeightRegression(names, "y", non_negative=False).fit(df).coef_.sum(), 1)


def test_random_and_lowess(spark):
    x = np.sort(np.random.default_rng(8).uniform(0, 1, 40))[:, None]
    y = np.sin(5 * x[:, 0])
    df = frame(spark, x, y)
    got = column(linear.RandomRegressor("y", "uniform", 1).fit(df).predict(df), "prediction")
    assert got.min() >= y.min() and got.max() <= y.max() and len(set(got)) == 40
    model = linear.LowessRegression("x0", "y", sigma=0.01).fit(df)
    d = np.abs(x - x.T)
    w = np.exp(-(d**2) / 0.01)
    out = np.array([[r.x0, r.prediction] for r in model.predict(df).collect()])
    assert np.allclose(out[np.argsort(out[:, 0]), 1], (w * y).sum(1) / w.sum(1))
    spanned = linear.LowessRegression("x0", "y", sigma=0.01, span=0.3).fit(df).predict(df).collect()
    near = w * (d <= np.quantile(d, 0.3, axis=1, keepdims=True) + 1e-12)
    assert np.allclose([r.prediction for r in sorted(spanned)], (near * y).sum(1) / near.sum(1))


@pytest.fixture(scope="module")
def fair(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 2, 600)
    x = np.c_[rng.normal(size=600) + 1.5 * z, rng.normal(size=600), z]
    y = (x[:, 0] + x[:, 1] + rng.normal(size=600) > 0.7).astype(int)
    return x, y, frame(spark, x, y)


def test_fair_classifiers(fair):
    x, y, df = fair
    free = linear.DemographicParityClassifier(FEATURES, "y", "x2", None, penalty=None).fit(df)
    for model, rows, limit in (
        (linear.DemographicParityClassifier(FEATURES, "y", "x2", 0.05, penalty="l1"), np.ones(600, bool), 0.05),
        (linear.EqualOpportunityClassifier(FEATURES, "y", "x2", 0.05, 1, penalty="l2"), y == 1, 0.05),
    ):
        fitted = model.fit(df)
        assert fitted.inputs_ == ["x0", "x1"]
        cov = lambda m: np.mean(((x[:, 2] - x[:, 2].mean()) * (x[:, :2] @ m.coef_ + m.intercept_))[rows])  # noqa: B023, E731
        assert abs(cov(fitted)) <= limit + 2e-3 < abs(cov(free))
        assert (column(fitted.predict(df), "prediction") == y).mean() > 0.6
    ours = linear.LogisticClassifier(["x0", "x1"], "y").fit(df)
    theirs = LogisticRegression(maxIter=200, tol=1e-10)
    other = meta.MLlibClassifier(theirs, ["x0", "x1"], "y").fit(df)
    assert np.allclose(ours.coef_, other.model_.coefficients.toArray(), atol=1e-3)
    with pytest.raises(ValueError):
        linear.LogisticClassifier(["x0"], "y").fit(df.withColumn("y", F.col("x2") * 0))


def test_one_vs_rest_and_one(spark):
    rng = np.random.default_rng(0)
    y = np.repeat([0, 1, 2], 60)
    x = np.array([[0, 0], [4, 0], [0, 4]])[y] + rng.normal(size=(180, 2))
    df = frame(spark, x, y)
    for wrap in (linear.OneVsRest, linear.OneVsOne):
        out = wrap(linear.LogisticClassifier(["x0", "x1"], "y", penalty="l2", C=100, max_iter=30)).fit(df).predict(df)
        assert (column(out, "prediction") == y).mean() > 0.9
        assert np.allclose([sum(r.probability) for r in out.collect()], 1)


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1], 150)
    x = np.where(y[:, None] == 0, -3, 3) + rng.normal(size=(300, 2)) @ [[1, 0.5], [0, 1]]
    return x, y, frame(spark, x, y)


@pytest.mark.parametrize("kind", [density.GMMClassifier, density.BayesianGMMClassifier, density.GaussianMixtureNB, density.BayesianGaussianMixtureNB])
@pytest.mark.parametrize("options", [{}, {"n_components": 2, "max_iter": 15, "random_state": 1}, {"covariance_type": "diag"}])
def test_mixture_classifiers(clouds, kind, options):
    if options.get("n_components") == 2 and kind is density.BayesianGaussianMixtureNB:
        options = {**options, "max_iter": 5}
    x, y, df = clouds
    out = kind(["x0", "x1"], "y", **options).fit(df).predict(df).collect()
    assert np.mean([r.prediction == r.y for r in out]) > 0.98
    assert np.allclose([sum(r.probability) for r in out], 1)


@pytest.mark.parametrize("shape", ["full", "tied", "diag", "spherical"])
def test_mixture_density(clouds, shape):
    x, _, df = clouds
    one = density.Mixture(covariance_type=shape).fit(df, ["x0", "x1"])
    cov = np.cov(x.T, bias=True)
    want = {"full": cov, "tied": cov, "diag": np.diag(np.diag(cov)), "spherical": np.eye(2) * np.trace(cov) / 2}[shape] + 1e-6 * np.eye(2)
    assert np.allclose(one.covariances_[0], want, rtol=1e-5)
    z = x - x.mean(0)
    logs = -0.5 * (np.einsum("ni,ij,nj->n", z, np.linalg.inv(want), z) + np.log(np.linalg.det(want)) + 2 * np.log(2 * np.pi))
    assert np.allclose(column(df.select(one.log_density().alias("l")), "l"), logs)
    two = density.Mixture(2, shape, random_state=0, tol=1e-6).fit(df, ["x0", "x1"])
    assert two.lower_bound_ > logs.mean() and sorted(np.round(two.means_[:, 0] / 3)) == [-1, 1]
    with pytest.raises(ValueError):
        density.Mixture(covariance_type="zz")


def test_digamma():
    assert np.allclose(density.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890])


def test_outlier_detectors(spark):
    rng = np.random.default_rng(42)
    df = frame(spark, rng.normal(-10, 1, (2000, 2)))
    model = density.GMMOutlierDetector(["x0", "x1"], 0.99).fit(df)
    assert (column(model.predict(df), "prediction") == -1).sum() == 20
    for kind in (density.GMMOutlierDetector, density.BayesianGMMOutlierDetector):
        strict = kind(["x0", "x1"], 4.0, "stddev", max_iter=5).fit(df)
        far = frame(spark, np.array([[100.0, 100.0], [-10.0, -10.0]]))
        assert column(strict.predict(far), "prediction").tolist() == [-1, 1]
    with pytest.raises(ValueError):
        density.GMMOutlierDetector(["x0"], 10).fit(df)
    with pytest.raises(ValueError):
        density.GMMOutlierDetector(["x0"], -1, "stddev").fit(df)


def test_kernel_density(clouds, spark):
    x, y, df = clouds
    asked = frame(spark, np.array([[-3.0, -3.0], [3.0, 3.0], [500.0, 500.0]]))
    for kernel in density.BayesianKernelDensityClassifier.KERNELS:
        model = density.BayesianKernelDensityClassifier(["x0", "x1"], "y", 1.0, kernel).fit(df)
        out = {r.x0: r.probability for r in model.predict_proba(asked).collect()}
        assert out[-3][0] > 0.9 and out[3][1] > 0.9 and np.isclose(sum(out[500]), 1)
    gaussian = density.BayesianKernelDensityClassifier(["x0", "x1"], "y", 1.0).fit(df)
    k = np.exp(-0.5 * ((x - [-1.0, 0.5]) ** 2).sum(1))
    got = gaussian.predict_proba(frame(spark, np.array([[-1.0, 0.5]]))).first().probability
    assert np.allclose(got, [k[y == 0].sum() / k.sum(), k[y == 1].sum() / k.sum()])


def test_pca_outliers(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=(500, 1))
    x = np.c_[t, 2 * t, -t] + 10 + 0.01 * rng.normal(size=(500, 3))
    x[7] += [3, -3, 3]
    df = frame(spark, x)
    model = outliers.PCAOutlierDetection(FEATURES, 1, 1.0, "absolute").fit(df)
    assert np.flatnonzero(column(model.predict(df), "prediction") == -1).tolist() == [7]
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = np.abs((x - x.mean(0)) - (x - x.mean(0)) @ vt[:1].T @ vt[:1]).sum(1)
    assert np.allclose(column(df.select(model.difference().alias("d")), "d"), want)
    assert np.allclose(column(df.select(outliers.PCAOutlierDetection(FEATURES, 1, 1.0).fit(df).difference().alias("d")), "d"), want / x.sum(1))
    with pytest.raises(ValueError):
        outliers.PCAOutlierDetection(FEATURES).fit(df)
    with pytest.raises(ImportError):
        outliers.UMAPOutlierDetection(FEATURES, threshold=0.1).fit(df)


# ---------------------------------------------------------------- meta


def test_thresholder_and_transformer(clouds):
    x, y, df = clouds
    inner = linear.LogisticClassifier(["x0", "x1"], "y", penalty="l2")
    low, high = (meta.Thresholder(inner, t).fit(df).predict(df) for t in (0.0, 1.0))
    assert column(low, "prediction").all() and not column(high, "prediction").any()
    fitted = inner.fit(df)
    assert meta.Thresholder(fitted, 0.5).fit(df).model_ is fitted
    out = meta.EstimatorTransformer(inner, "predict_proba", "p").fit_transform(df)
    assert out.columns == ["x0", "x1", "y", "p_0", "p_1"]
    with pytest.raises(AttributeError):
        meta.EstimatorTransformer(inner, "zz").fit(df)


def test_confusion_balancer(spark):
    rng = np.random.default_rng(42)
    x = np.r_[rng.normal(0, 1, (100, 2)), rng.normal(2, 1, (500, 2))]
    y = np.r_[np.zeros(100, int), np.ones(500, int)]
    df = frame(spark, x, y)
    inner = linear.LogisticClassifier(["x0", "x1"], "y").fit(df)
    model = meta.ConfusionBalancer(inner, 0.5).fit(df)
    p = np.array([r.probability for r in model.model_.predict_proba(df).collect()])
    pred = p.argmax(1)
    cfm = np.array([[np.mean(y[pred == i] == j) for j in (0, 1)] for i in (0, 1)])
    assert np.allclose([r.probability for r in model.predict_proba(df).collect()], 0.5 * p + 0.5 * p @ cfm)


@pytest.mark.parametrize(
    ("prior", "confusion", "expected"),
    [([0.8, 0.2], [[90, 10], [10, 90]], 0.9729729), ([0.5, 0.5], [[50, 50], [50, 50]], 0.5), ([0.7, 0.3], [[0, 10], [0, 10]], 0.7), ([1.0, 0.0], [[9, 1], [1, 9]], 1.0)],
)
def test_posterior(prior, confusion, expected):
    assert np.isclose(meta.SubjectiveClassifier.posterior(np.array(confusion, float), np.array(prior))[0, 0], expected)


def test_subjective(clouds):
    x, y, df = clouds
    inner = linear.LogisticClassifier(["x0", "x1"], "y", penalty="l2")
    for evidence in ("predict_proba", "confusion_matrix", "both"):
        out = meta.SubjectiveClassifier(inner, {0: 0.5, 1: 0.5}, evidence).fit(df).predict(df)
        assert (column(out, "prediction") == y).mean() > 0.95
    with pytest.raises(ValueError):
        meta.SubjectiveClassifier(inner, {0: 0.5, 1: 0.6})
    with pytest.raises(ValueError):
        meta.SubjectiveClassifier(inner, {0: 1.0}).fit(df)


def test_ordinal(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(0, 2, (500, 2))
    y = np.digitize(x @ [1, 1] + rng.normal(0, 0.3, 500), [-2, 2])
    df = frame(spark, x, y)
    for calibrated in (False, True):
        model = meta.OrdinalClassifier(linear.LogisticClassifier(["x0", "x1"], "y", max_iter=40), calibrated).fit(df)
        out = model.predict(df).collect()
        assert np.mean([r.prediction == r.y for r in out]) > 0.9 and np.allclose([sum(r.probability) for r in out], 1)
    with pytest.raises(ValueError):
        meta.OrdinalClassifier(linear.LogisticClassifier(["x0"], "y")).fit(df.where("y < 2"))


def test_regression_outliers(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=100)
    y = 1 + x + rng.normal(0, 0.2, 100)
    y[[20, 25, 50, 80]] += 10
    df = frame(spark, np.c_[x, y])
    model = meta.RegressionOutlierDetector(["x0", "x1"], "x1").fit(df)
    assert np.flatnonzero(column(model.predict(df), "prediction") == -1).tolist() == [20, 25, 50, 80]
    for method, limit in (("absolute", 5.0), ("relative", 0.7)):
        assert meta.RegressionOutlierDetector(["x0", "x1"], "x1", lower=limit, upper=limit, method=method).fit(df).predict(df).where("prediction = -1").count() >= 4
    with pytest.raises(ValueError):
        meta.RegressionOutlierDetector(["x0"], "x0", method="zz")


def test_outlier_classifier(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(300, 2)), rng.normal(0, 8, (15, 2))]
    y = np.r_[np.zeros(300, int), np.ones(15, int)]
    df = frame(spark, x, y)
    model = meta.OutlierClassifier(density.GMMOutlierDetector(["x0", "x1"], 0.95), "y").fit(df)
    out = model.predict(df).collect()
    p = np.array([r.probability[1] for r in out])
    assert p[y == 1].mean() > p[y == 0].mean() + 0.3 and {r.prediction for r in out} == {0, 1}


def test_zero_inflated(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)) * np.abs(x[:, 2] * x[:, 3] ** 2)
    names = [f"x{i}" for i in range(4)]
    df = frame(spark, x, y)
    from pyspark.ml.classification import DecisionTreeClassifier

    tree = meta.MLlibClassifier(DecisionTreeClassifier(maxDepth=5, seed=1), names, "y")
    model = meta.ZeroInflatedRegressor(tree, meta.MLlibRegressor(DecisionTreeRegressor(maxDepth=10, maxBins=128, seed=1), names, "y")).fit(df)
    out = model.predict(df)
    got = column(out, "prediction")
    assert out.columns == [*df.columns, "prediction"]
    assert 1 - ((got - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.85
    assert (column(model.score_samples(df), "prediction") >= 0).all()
    zero = df.withColumn("y", F.lit(0.0))
    with pytest.raises(ValueError):
        model.fit(zero)
    easy = meta.ZeroInflatedRegressor(tree, linear.LinearRegression(names, "y"), handle_zero="ignore").fit(zero)
    assert not column(easy.predict(zero), "prediction").any()


def test_decay_estimator(spark):
    df = spark.range(50).selectExpr("id", "cast(0 as double) as zero", "cast(id as double) as y")
    model = meta.DecayEstimator(linear.LinearRegression(["zero"], "y"), "id", "exponential", decay_rate=0.9).fit(df)
    w = 0.9 ** (50 - np.arange(50))
    assert np.allclose(model.predict(df).first().prediction, (w * np.arange(50)).sum() / w.sum())
    with pytest.raises(TypeError):
        meta.DecayEstimator(density.GMMOutlierDetector(["zero"]), "id").fit(df)


def pinball(x, y, theta, quantile):
    r = y - np.c_[np.ones(len(x)), x] @ theta
    return np.maximum(quantile * r, (quantile - 1) * r).mean()


@pytest.mark.parametrize("quantile", [0.1, 0.5, 0.9])
def test_quantile_of_more_rows_than_the_sample(spark, quantile, monkeypatch):
    """The passes over the whole table reach the loss of the exact solver, which tries all lines through two rows."""
    monkeypatch.setattr(linear.MinimizeRegressor, "SAMPLE_ROWS", 300)
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, (3000, 1))
    y = 2 * x[:, 0] + rng.exponential(3, 3000) * (1 + x[:, 0])
    df = frame(spark, x, y).cache()
    model = linear.QuantileRegression(["x0"], "y", quantile).fit(df)
    best = np.array([model.intercept_, *model.coef_])
    loss = pinball(x, y, best, quantile)
    near = np.argsort(np.abs(y - np.c_[np.ones(3000), x] @ best))[:60]
    exact = min(pinball(x, y, np.linalg.solve(np.c_[np.ones(2), x[[i, j], 0]], y[[i, j]]), quantile) for i in near for j in near if i < j and x[i, 0] != x[j, 0])
    assert loss <= exact * (1 + 2e-5)
    small = linear.QuantileRegression(["x0"], "y", quantile)
    small.SAMPLE_ROWS = 10_000
    theta = small.fit(df)
    assert pinball(x, y, np.array([theta.intercept_, *theta.coef_]), quantile) <= exact * (1 + 1e-7)
    df.unpersist()


def test_quantile_passes_are_few(spark, monkeypatch):
    monkeypatch.setattr(linear.MinimizeRegressor, "SAMPLE_ROWS", 300)
    df = spark.range(20_000).select((F.col("id") % 97).cast("double").alias("x0"), (F.col("id") % 97 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("y"))
    tracker, group = spark.sparkContext.statusTracker(), "few passes"
    spark.sparkContext.setJobGroup(group, "")
    linear.LADRegression(["x0"], "y").fit(df)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs <= 44  # an aggregation is two jobs where Spark plans its stages one by one


def test_kernel_metrics_and_size_check(spark):
    rng = np.random.default_rng(3)
    x, ask = rng.normal(size=(40, 2)), rng.normal(size=(7, 2)) * 3
    y = (x[:, 0] > 0).astype(int)
    for metric, gap in (("euclidean", lambda d: np.sqrt((d * d).sum(2))), ("manhattan", lambda d: np.abs(d).sum(2)), ("chebyshev", lambda d: np.abs(d).max(2))):
        model = density.BayesianKernelDensityClassifier(["x0", "x1"], "y", 0.05, metric=metric).fit(frame(spark, x, y))
        logs = -0.5 * (gap(ask[:, None] - x[None]) / 0.05) ** 2  # down to exp(-10000): as sums of plain exponentials they vanish
        top = np.array([[logs[i][y == k].max() + np.log(np.exp(logs[i][y == k] - logs[i][y == k].max()).sum()) for k in (0, 1)] for i in range(7)])
        want = 1 / (1 + np.exp(np.clip(top[:, 0] - top[:, 1], -700, 700)))
        got = {round(r.x0, 9): r.probability[1] for r in model.predict_proba(frame(spark, ask)).collect()}
        assert np.allclose([got[round(a, 9)] for a in ask[:, 0]], want, atol=1e-9)
    with pytest.raises(ValueError, match="training rows"):
        density.BayesianKernelDensityClassifier(["x0", "x1"], "y", most_rows=39).fit(frame(spark, x, y))
    with pytest.raises(ValueError, match="training rows"):
        linear.LowessRegression("x0", "x1", most_rows=39).fit(frame(spark, x))


def test_stick_breaking_weights(spark):
    """The weights after an update are the geometric means of drawn sticks, or of draws of the symmetric distribution."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(-5, 1, 300), rng.normal(5, 1, 100)])[:, None]
    one = density.Mixture(2, bayesian=True, random_state=1).fit(frame(spark, x), ["x0"])
    assert np.allclose(np.sort(one.weights_), [0.25, 0.75], atol=0.03) and np.allclose(np.sort(one.means_[:, 0]), [-5, 5], atol=0.3)
    m, nk = density.Mixture(3, bayesian=True, weight_concentration_prior=0.5), np.array([5.0, 2.0, 1.0])
    m.prior_mean_, m.prior_cov_ = np.zeros(1), np.eye(1)
    m._update(8.0, nk, np.zeros((3, 1)), np.ones((3, 1, 1)))
    draws = rng.beta(1 + nk, 0.5 + np.array([3.0, 1.0, 0.0]), (400_000, 3))
    left = np.cumprod(np.c_[np.ones(len(draws)), 1 - draws[:, :2]], 1)
    assert np.allclose(np.log(m.weights_), np.log(draws * left).mean(0), atol=0.02)
    flat = density.Mixture(3, bayesian=True, weight_concentration_prior_type="dirichlet_distribution", weight_concentration_prior=0.5)
    flat.prior_mean_, flat.prior_cov_ = np.zeros(1), np.eye(1)
    flat._update(8.0, nk, np.zeros((3, 1)), np.ones((3, 1, 1)))
    assert np.allclose(np.log(flat.weights_), np.log(rng.dirichlet(0.5 + nk, 400_000)).mean(0), atol=0.02)
    with pytest.raises(ValueError):
        density.Mixture(weight_concentration_prior_type="other")


def test_gmm_of_all_labels_by_one_aggregation(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 2)) @ [[1, 0.4], [0, 2]], rng.integers(0, 3, 200)
    df = frame(spark, x, y)
    for kind in ("full", "diag", "spherical"):
        model = density.GMMClassifier(["x0", "x1"], "y", covariance_type=kind).fit(df)
        for c in range(3):
            alone = density.Mixture(covariance_type=kind).fit(df.where(F.col("y") == c), ["x0", "x1"])
            assert np.allclose(model.gmms_[c].means_, alone.means_) and np.allclose(model.gmms_[c].covariances_, alone.covariances_)


def test_ordinal_calibration_uses_other_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 1))
    y = np.digitize(x[:, 0] + rng.normal(0, 0.7, 200), [-0.6, 0.6])
    df = frame(spark, x, y)
    seen = []

    class Spy(linear.LogisticClassifier):
        def _fit(self, rows):
            seen.append(rows.count())
            super()._fit(rows)

    model = meta.OrdinalClassifier(Spy(["x0"], "y"), use_calibration=True, folds=2).fit(df)
    assert len(seen) == 2 * 3 and [n for n in seen if n == 200] == [200, 200] and sum(n for n in seen if n < 200) == 2 * 200
    p = np.array([r.probability for r in model.predict_proba(df).orderBy("x0").collect()])
    assert np.allclose(p.sum(1), 1) and p[0, 0] > 0.8 and p[-1, 2] > 0.8
    with pytest.raises(ValueError):
        meta.OrdinalClassifier(linear.LogisticClassifier(["x0"], "y"), folds=1)


def test_logistic_passes_over_the_table_few_times(spark):
    """Found on the whole table from a sampled start; a pass for each step of a line search over and over took minutes at size."""
    df = spark.range(60_000).select((F.col("id") % 50).cast("double").alias("a"), (F.pmod(F.xxhash64("id"), F.lit(1000)) * 100.0).alias("b"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("r"))
    df = df.withColumn("y", F.when(F.col("r") < 1000 / (1 + F.exp(1 - F.col("a") / 25 + F.col("b") / 40_000)), 1).otherwise(0)).cache()
    group, tracker = "logistic-passes", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    model = linear.LogisticClassifier(["a", "b"], "y").fit(df)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 24
    p = F.element_at("probability", 2)
    sums = model.predict_proba(df).agg(*[F.avg((p - F.col("y")) * F.col(c)) for c in ("a", "b")], F.avg(p - F.col("y"))).first()
    assert np.abs(np.array(sums) / [25, 50_000, 1]).max() < 1e-7
    df.unpersist()


def test_logistic_penalties_and_constraints_on_the_whole_table(spark):
    """The passes over a table larger than the sample end where the driver's solution of all its rows does."""
    df = spark.range(3_000).select(F.randn(1).alias("x0"), F.randn(2).alias("x1"), F.randn(3).alias("e"), F.col("id"))
    df = df.withColumn("y", F.when(F.col("x0") - F.col("x1") / 2 + F.col("e") > 0.3, 1).otherwise(0)).cache()
    makers = [lambda k=penalty: linear.LogisticClassifier(["x0", "x1"], "y", C=0.01, penalty=k) for penalty in ("l1", "l2")]
    makers += [lambda: linear.DemographicParityClassifier(["x0", "x1"], "y", "x0", 0.1, train_sensitive_cols=True)]
    for make in makers:
        alone, passed = make(), make()
        passed.SAMPLE_ROWS = 200
        a, b = alone.fit(df), passed.fit(df)
        assert np.allclose([a.intercept_, *a.coef_], [b.intercept_, *b.coef_], atol=1e-4)
    df.unpersist()


def test_logistic_leaves_out_rows_without_features(spark):
    rows = [(float(i % 7), int((i * 37) % 11 > i % 7)) for i in range(200)]
    whole = linear.LogisticClassifier("x", "y").fit(spark.createDataFrame(rows, "x double, y int"))
    holes = linear.LogisticClassifier("x", "y").fit(spark.createDataFrame([*rows, (None, 1), (float("nan"), 0)], "x double, y int"))
    assert np.allclose([whole.intercept_, *whole.coef_], [holes.intercept_, *holes.coef_])
