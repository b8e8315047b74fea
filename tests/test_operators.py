import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.base import NotFitted, gram
from loomgrid.operators import features, feature_selection, projections, select
from loomgrid.operators.meta import RegressionOutlierDetector


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    return frame(spark, "a long, b double, c string, d string, e long", [(1, 1.5, "x", "p", 1), (2, 2.5, "y", "q", 0), (3, 3.5, "x", "p", 1)])


def test_selector_and_dropper(mixed):
    assert select.ColumnSelector(["c", "a"]).fit_transform(mixed).columns == ["c", "a"]
    assert select.ColumnSelector("b").fit_transform(mixed).columns == ["b"]
    assert select.ColumnDropper(["a", "b"]).fit_transform(mixed).columns == ["c", "d", "e"]
    for bad in (select.ColumnSelector(["zz"]), select.ColumnDropper(["zz"])):
        with pytest.raises(KeyError):
            bad.fit(mixed)
    with pytest.raises(ValueError):
        select.ColumnSelector([]).fit(mixed)
    with pytest.raises(ValueError):
        select.ColumnDropper(list("abcde")).fit(mixed)
    with pytest.raises(NotFitted):
        select.ColumnSelector("a").transform(mixed)


def test_type_selector(mixed):
    assert select.TypeSelector(include="number").fit_transform(mixed).columns == ["a", "b", "e"]
    assert select.TypeSelector(exclude="number").fit_transform(mixed).columns == ["c", "d"]
    assert select.TypeSelector(include=["number", "string"], exclude="bigint").fit_transform(mixed).columns == ["b", "c", "d"]
    with pytest.raises(ValueError):
        select.TypeSelector().fit(mixed)
    with pytest.raises(ValueError):
        select.TypeSelector(include="bool").fit(mixed)
    model = select.TypeSelector(include="number").fit(mixed)
    with pytest.raises(ValueError):
        model.transform(mixed.withColumn("a", F.col("a").cast("string")))


def test_dict_mapper(spark):
    df = frame(spark, "k string", [("a",), ("b",), ("zz",), (None,)])
    assert values(select.DictMapper({"a": 1, "b": 2}, -1).fit_transform(df), "k") == [1, 2, -1, -1]
    big = select.DictMapper({f"k{i}": i for i in range(500)} | {"a": 7}, -1)
    assert sorted(values(big.fit_transform(df), "k")) == [-1, -1, -1, 7]


def test_formula(mixed):
    out = select.FormulaicTransformer("a + c").fit_transform(mixed)
    assert out.columns == ["Intercept", "a", "c[T.y]"]
    assert [tuple(r) for r in out.collect()] == [(1, 1, 0), (1, 2, 1), (1, 3, 0)]
    assert select.FormulaicTransformer("c + d - 1").fit_transform(mixed).columns == ["c[x]", "c[y]", "d[T.q]"]
    assert select.FormulaicTransformer("a*b").fit_transform(mixed).columns == ["Intercept", "a", "b", "a:b"]
    with pytest.raises(ValueError):
        select.FormulaicTransformer("y ~ a").fit(mixed)
    with pytest.raises(KeyError):
        select.FormulaicTransformer("zz").fit(mixed)


def test_identity_checks_numbers(spark):
    df = frame(spark, "x double", [(1.0,), (float("inf"),)])
    with pytest.raises(ValueError):
        select.IdentityTransformer(check_X=True).fit(df)
    assert select.IdentityTransformer().fit_transform(df) is df


def test_add_lags(spark):
    df = frame(spark, "i long, X1 long, X2 string", [(0, 0, "178"), (1, 1, None), (2, 2, "180")])
    out = features.add_lags(df, "X1", -1, "i", drop_na=False).orderBy("i")
    assert values(out, "X1-1") == [None, 0, 1]
    assert out.columns[-1] == "X1-1"
    matrix = frame(spark, "i long, a long, b long", [(0, -4, 2), (1, -2, 0), (2, 4, -6)])
    lagged = features.add_lags(matrix, ["a", "b"], [1, 2], "i").drop("i").collect()
    assert [tuple(r) for r in lagged] == [(-4, 2, -2, 4, 0, -6)]
    with pytest.raises(KeyError):
        features.add_lags(df, "zz", 1, "i")
    with pytest.raises(ValueError):
        features.add_lags(df, "X1", ["1"], "i")


def test_capper_keeps_nan_and_handles_infinities(spark):
    inf, nan = float("inf"), float("nan")
    df = frame(spark, "i int, x double", [(0, 1.0), (1, nan), (2, 3.0), (3, 4.0), (4, inf), (5, None), (6, -inf)])
    out = values(features.ColumnCapper("x", (10, 90)).fit_transform(df).orderBy("i"), "x")
    low, high = np.quantile([1, 3, 4], [0.1, 0.9])
    assert np.allclose([out[0], out[3], out[4], out[6]], [low, high, high, low]) and np.isnan(out[1]) and out[5] is None
    gone = values(features.ColumnCapper("x", discard_infs=True).fit_transform(df).orderBy("i"), "x")
    assert gone[4] is None and gone[6] is None
    with pytest.raises(ValueError):
        features.ColumnCapper("x").fit(df.where("isnan(x)"))
    with pytest.raises(ValueError):
        features.ColumnCapper("x", (90, 10)).fit(df)


@pytest.mark.parametrize("mode", ["linear", "lower", "higher", "midpoint", "nearest"])
def test_quantile_modes_match_numpy(spark, mode):
    rng = np.random.default_rng(3)
    x = rng.normal(size=37)
    df = frame(spark, "x double", [(float(v),) for v in x])
    points = [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]
    assert np.allclose(features.quantile(df, ["x"], points, mode)["x"], np.quantile(x, points, method=mode))


def test_repeating_basis(spark):
    df = frame(spark, "x double, y int", [(0.0, 1), (6.0, 2), (12.0, 3)])
    out = features.RepeatingBasisFunction("x", "passthrough", 4).fit_transform(df)
    assert out.columns == ["x_0", "x_1", "x_2", "x_3", "y"]
    rows = out.orderBy("y").collect()
    assert rows[0].x_0 == 1 and rows[2].x_0 == 1 and rows[1].x_2 == 1 and rows[0].x_2 < 0.02


def test_spline_is_monotone_and_ends_at_one(spark):
    df = spark.range(101).select((F.col("id") / 10).alias("x"))
    for knots in ("uniform", "quantile"):
        model = features.MonotonicSplineTransformer("x", 4, 3, knots).fit(df)
        out = np.array(model.transform(df.withColumn("i", F.col("x"))).orderBy("i").drop("i").collect())
        assert out.shape == (101, 6)
        assert (np.diff(out, axis=0) >= -1e-9).all()
        assert np.allclose(out[:, -1], 1) and (out <= 1 + 1e-9).all() and (out >= -1e-9).all()
        far = np.array(model.transform(df.limit(1).select(F.lit(99.0).alias("x"))).collect())
        assert np.allclose(far, out[-1])


def test_interval_encoder(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 400)
    y = x**2 + rng.normal(0, 1, 400)
    df = frame(spark, "x double, y double", [(float(a), float(b)) for a, b in zip(x, y)])
    for method in features.IntervalEncoder.METHODS:
        model = features.IntervalEncoder("x", "y", 8, 1, method).fit(df)
        out = np.array(model.transform(df.withColumn("i", F.col("x"))).orderBy("i").select("x").collect())[:, 0]
        if method in ("increasing", "decreasing"):
            sign = 1 if method == "increasing" else -1
            assert (sign * np.diff(out) >= -1e-9).all()
        knots = model.knots_["x"]
        if method == "normal":
            w = np.exp(-((x[None] - knots[:, None]) ** 2))
            assert np.allclose(model.heights_["x"], (w * y).sum(1) / w.sum(1))
    with pytest.raises(ValueError):
        features.IntervalEncoder("x", "y", method="zz").fit(df)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    y, w = rng.normal(size=6), rng.uniform(0.5, 2, 6)
    fit = features.isotonic(y, w)
    assert (np.diff(fit) >= -1e-12).all()
    best = (w * (fit - y) ** 2).sum()
    for _ in range(2000):
        other = np.sort(fit + rng.normal(0, 0.3, 6))
        assert (w * (other - y) ** 2).sum() >= best - 1e-9


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1313)
    x = rng.normal(size=(50, 4))
    x[:, 3] += 2 * x[:, 0]
    return x, frame(spark, "i int, a double, b double, c double, d double", [(i, *map(float, r)) for i, r in enumerate(x)])


def test_orthogonal(cloud):
    x, df = cloud
    out = np.array(projections.OrthogonalTransformer(list("abcd")).fit_transform(df).orderBy("i").drop("i").collect())
    assert np.allclose(out.T @ out, np.eye(4), atol=1e-9)
    q, _ = np.linalg.qr(x)
    assert np.allclose(np.abs(out), np.abs(q), atol=1e-9)


def test_information_filter(cloud):
    x, df = cloud
    out = projections.InformationFilter(list("abcd"), ["a", "b"]).fit_transform(df).orderBy("i")
    assert out.columns == ["i", "c", "d"]
    fair = np.array(out.drop("i").collect())
    assert np.allclose(fair.T @ x[:, :2], 0, atol=1e-9)
    same = np.array(projections.InformationFilter(list("abcd"), ["a"], alpha=0).fit_transform(df).orderBy("i").select("b", "c", "d").collect())
    assert np.allclose(same, x[:, 1:])


def test_linear_embedder_and_projection(cloud):
    x, df = cloud
    df = df.withColumn("y", F.col("a") * 2 - F.col("b"))
    out = np.array(projections.LinearEmbedder(list("ab"), "y", alpha=0.0).fit_transform(df).orderBy("i").select("a", "b").collect())
    assert np.allclose(out, x[:, :2] * [2, -1])
    v = projections.scalar_projection(df, "a", "d")
    assert np.isclose(v, (x[:, 0] @ x[:, 3]) / (x[:, 3] @ x[:, 3]))


def test_wide_gram_matches_expressions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 30))
    df = frame(spark, ", ".join(f"c{i} double" for i in range(30)), [tuple(map(float, r)) for r in x])
    assert np.allclose(gram(df, df.columns), x.T @ x)
    assert np.allclose(gram(df, df.columns[:5]), x[:, :5].T @ x[:, :5])


def test_mrmr(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 300))
    rows = [(float(u), float(u + 0.01 * e), float(v), float(u + v)) for u, v, e in zip(a, b, rng.normal(size=300))]
    df = frame(spark, "u double, copy double, v double, y double", rows)
    model = feature_selection.MaximumRelevanceMinimumRedundancy(["u", "copy", "v"], "y", 2).fit(df)
    assert set(model.selected_features_) == {"v", model.selected_features_[0]} and "v" in model.transform(df).columns
    with pytest.warns(UserWarning):
        assert feature_selection.MaximumRelevanceMinimumRedundancy(["u", "v"], "y", 2).fit(df).transform(df).columns == ["u", "v"]
    with pytest.raises(ValueError):
        feature_selection.MaximumRelevanceMinimumRedundancy(["u", "v"], "y", 3).fit(df)
    classes = df.withColumn("k", (F.col("u") > 0).cast("int"))
    f = feature_selection.f_classification(classes, ["u", "v"], "k")
    g = [np.array(a)[a > 0], np.array(a)[a <= 0]]
    m = a.mean()
    between = sum(len(x) * (x.mean() - m) ** 2 for x in g)
    within = sum(((x - x.mean()) ** 2).sum() for x in g)
    assert np.isclose(f[0], between / (within / 298))


def test_train_only(spark):
    df = frame(spark, "x double, y double", [(float(i), 2.0 * i + (50 if i == 7 else 0)) for i in range(20)])
    adder = select.RandomAdder(1.0, 3, ["x"]).fit(df)
    assert values(adder.transform(df), "x") != values(df, "x")
    other = df.where("x < 100")
    assert values(adder.transform(other), "x") == values(other, "x")
    assert values(adder.transform(other, training=True), "x") != values(other, "x")
    remover = select.OutlierRemover(RegressionOutlierDetector(["x", "y"], "y")).fit(df)
    assert remover.transform(df).count() == 19 and remover.transform(other).count() == 20


@pytest.mark.parametrize("interpolation", ["linear", "lower", "higher", "midpoint", "nearest"])
def test_quantiles_of_large_tables_are_the_same(spark, interpolation, monkeypatch):
    from loomgrid.operators import features

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=700), rng.lognormal(3, 2, 300), np.full(400, 0.25), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v), float(k % 5)) for k, v in enumerate(values)] + [(None, float("nan")), (float("inf"), None)], "a double, b double")
    points = [0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0]
    small = features.quantile(df, ["a", "b"], points, interpolation)
    assert np.allclose(small["a"], np.quantile(values, points, method=interpolation))
    monkeypatch.setattr(features, "ONE_PASS_ROWS", 10)
    assert features.quantile(df, ["a", "b"], points, interpolation) == small
    ranks = list(range(0, len(values), 37))
    found = features.values_at(df, features.F.when(features.finite(features.F.col("a")), features.F.col("a")), ranks, buckets=4, last_rows=3)
    assert [found[r] for r in ranks] == np.sort(values)[ranks].tolist()
    near = features.quantile(df, ["a"], [0.5], accuracy=10_000)["a"][0]
    assert abs((values <= near).mean() - 0.5) < 0.2
    assert features.quantile(df.where("a is null"), ["a"], [0.5])["a"] == [None]


def test_labels_of_too_many_values_are_an_error(spark):
    from loomgrid import base

    with pytest.raises(ValueError, match="different values"):
        base.distinct_values(spark.range(base.MOST_LABELS + 1), "id")


def test_quantiles_of_many_ranks(spark):
    """Ranges of distinct values find their own ranks; no task holds all values."""
    from loomgrid.operators.features import many_values_at, quantile

    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 30, 5_000), 1)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    points = [k / 1000 for k in range(1001)]
    assert np.allclose(quantile(df, ["v"], points)["v"], np.quantile(v, points), rtol=0, atol=1e-12)
    assert many_values_at(df.where("v = v and v < 1e9"), F.col("v"), [0, 4_999]) == {0: v.min(), 4_999: v.max()}
    same = spark.range(300).select(F.lit(2.5).alias("v"))
    assert set(quantile(same, ["v"], points)["v"]) == {2.5}
