import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomgrid.functions.shrinkage import weights
from loomgrid.operators import grouped as g


@pytest.fixture(scope="module")
def planets(spark):
    rows = [("Earth", "NL", "Amsterdam", 1), ("Earth", "NL", "Rotterdam", 3), ("Earth", "BE", "Antwerp", 2), ("Earth", "BE", "Brussels", 4)]
    return spark.createDataFrame(rows, "Planet string, Country string, City string, Target long")


def predicted(df, *order):
    return [r.prediction for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(
    ("shrinkage", "options", "expected"),
    [
        ("constant", {"alpha": 0.1}, None),
        ("relative", {}, None),
        ("equal", {}, None),
        ("min_n_obs", {"min_n_obs": 2}, [2.0, 2.0, 3.0, 3.0]),
        (None, {}, [1.0, 3.0, 2.0, 4.0]),
        (lambda sizes: [0, 0, 1, 0], {}, [2.0, 2.0, 3.0, 3.0]),
    ],
)
def test_shrinkage(planets, shrinkage, options, expected):
    keys = ["Planet", "Country", "City"]
    model = g.GroupedPredictor(g.MeanEstimator("Target"), keys, shrinkage, **options).fit(planets)
    got = predicted(model.predict(planets), F.desc("Country"), "City")
    levels = np.array([[2.5, 2.5, 2.0, 1], [2.5, 2.5, 2.0, 3], [2.5, 2.5, 3.0, 2], [2.5, 2.5, 3.0, 4]])
    if expected is None:
        w = {"constant": [0.1**3, 0.1**2 * 0.9, 0.1 * 0.9, 0.9], "relative": [4, 4, 2, 1], "equal": [1, 1, 1, 1]}[shrinkage]
        expected = levels @ np.array(w) / sum(w)
    assert np.allclose(got, expected)


def test_new_groups(spark, planets):
    asked = spark.createDataFrame([("Mars",)], "Planet string")
    model = g.GroupedRegressor(g.MeanEstimator("Target"), "Planet").fit(planets)
    assert predicted(model.predict(asked), "Planet") == [2.5]
    strict = g.GroupedPredictor(g.MeanEstimator("Target"), "Planet", use_global_model=False).fit(planets)
    with pytest.raises(PySparkException, match="no model was fitted"):
        strict.predict(asked).collect()
    blended = g.GroupedPredictor(g.MeanEstimator("Target"), "Planet", "equal").fit(planets)
    with pytest.raises(PySparkException, match="no model was fitted"):
        blended.predict(asked).collect()
    with pytest.raises(ValueError):
        g.GroupedPredictor(g.MeanEstimator("Target"), "Nowhere").fit(planets)
    with pytest.raises(ValueError):
        g.GroupedPredictor(g.MeanEstimator("Target"), "Planet").fit(planets.withColumn("Planet", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        g.GroupedRegressor(g.FrequencyClassifier("Target"), "Planet").fit(planets)
    with pytest.raises(ValueError):
        weights([F.lit(1)], "zz")


def test_linear_and_pandas_estimators(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 40), "x": rng.normal(5, 1, 80), "z": rng.normal(size=80)})
    pdf["y"] = np.where(pdf.k == "a", 1 + 2 * pdf.x, 5 - pdf.x) + 3 * pdf.z
    df = spark.createDataFrame(pdf)
    fast = g.GroupedRegressor(g.LinearEstimator(["x", "z"], "y"), "k").fit(df)
    slow = g.GroupedRegressor(
        g.PandasEstimator(["x", "z"], "y", lambda f: np.linalg.lstsq(np.c_[np.ones(len(f)), f[["x", "z"]]], f["y"], rcond=None)[0], lambda m, f: np.c_[np.ones(len(f)), f[["x", "z"]]] @ m), "k"
    ).fit(df)
    for model in (fast, slow):
        out = model.predict(df).toPandas()
        assert np.allclose(out.prediction, out.y)
    assert predicted(fast.predict(spark.createDataFrame([("zz", 1.0, 0.0)], "k string, x double, z double")), "x")[0] is not None


def test_classifiers(spark):
    df = spark.createDataFrame([("A", -1.0, "n"), ("A", -1.2, "n"), ("A", 1.0, "y"), ("A", 1.1, "y"), ("B", 0.0, "m"), ("B", 0.5, "m")], "g string, x double, y string")
    model = g.GroupedClassifier(g.GaussianClassifier("x", "y"), "g").fit(df)
    out = model.predict(df).collect()
    assert model.classes_ == ["m", "n", "y"] and all(r.prediction == r.y for r in out)
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in out)
    assert next(r for r in out if r.g == "A").probability[0] == 0
    with pytest.raises(ValueError):
        g.GroupedClassifier(g.FrequencyClassifier("y"), "g", "equal").fit(df)


@pytest.fixture(scope="module")
def hierarchy(spark):
    rows = [("A", "X", 0), ("A", "Y", 1), ("B", "W", 1), ("B", "Z", 0)]
    train = spark.createDataFrame([(a, b, t) for a, b, t in rows for _ in range(250)], "g_1 string, g_2 string, target long")
    asked = spark.createDataFrame([(0, "A", "X"), (1, "A", "Y"), (2, "A", "new"), (3, "B", "new"), (4, "B", "W"), (5, "B", "Z"), (6, "new", "X")], "i int, g_1 string, g_2 string")
    return train, asked


@pytest.mark.parametrize(
    ("shrinkage", "expected"),
    [(None, [0, 1, 0.5, 0.5, 1, 0, 0.5]), (lambda s: [1, 0, 0][: len(s)], [0.5] * 7), (lambda s: [1, 0, 1][: len(s)], [0.25, 0.75, 0.5, 0.5, 0.75, 0.25, 0.5])],
)
def test_hierarchy_falls_back_to_parents(hierarchy, shrinkage, expected):
    train, asked = hierarchy
    model = g.HierarchicalRegressor(g.MeanEstimator("target"), ["g_1", "g_2"], shrinkage).fit(train)
    assert np.allclose(predicted(model.predict(asked), "i"), expected)


def test_hierarchy_raise_and_classifier(hierarchy):
    train, asked = hierarchy
    strict = g.HierarchicalRegressor(g.MeanEstimator("target"), ["g_1", "g_2"], fallback_method="raise").fit(train)
    assert predicted(strict.predict(asked.where("i < 2")), "i") == [0, 1]
    with pytest.raises(PySparkException, match="no model for"):
        strict.predict(asked).collect()
    classifier = g.HierarchicalClassifier(g.FrequencyClassifier("target"), ["g_1", "g_2"], "equal").fit(train)
    out = classifier.predict(asked).orderBy("i").collect()
    assert [r.prediction for r in out[:2]] == [0, 1] and np.allclose(out[0].probability, [2 / 3, 1 / 3])
    with pytest.raises(ValueError):
        g.HierarchicalPredictor(g.MeanEstimator("target"), "g_1", fallback_method="zz").fit(train)


def test_grouped_transformer(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 10.0)], "g string, x double")
    for method, expected in (("standard", [-1, 0, 0, 1]), ("minmax", [0, 0, 0, 1])):
        model = g.GroupedTransformer(g.GroupScaler("x", method), "g").fit(df)
        out = model.transform(df)
        assert out.columns == ["x"] and np.allclose(sorted(r.x for r in out.collect()), expected)
        assert model.transform(spark.createDataFrame([("zz", 6.0)], "g string, x double")).count() == 1
    plain = g.GroupedTransformer(g.GroupScaler("x")).fit_transform(df.select("x"))
    assert abs(sum(r.x for r in plain.collect())) < 1e-9
    strict = g.GroupedTransformer(g.GroupScaler("x"), "g", use_global_model=False).fit(df)
    with pytest.raises(PySparkException, match="no model was fitted"):
        strict.transform(spark.createDataFrame([("zz", 6.0)], "g string, x double")).collect()


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(7)
    rows = [(f"g{i % 3}", float(x), float((i % 3 + 1) * x + 5), int(x > 0.2 * (i % 3))) for i, x in enumerate(rng.normal(size=150))]
    return spark.createDataFrame(rows, "g string, x double, y double, c long")


def test_any_transformer_within_groups(three):
    from loomgrid.operators.features import ColumnCapper

    model = g.GroupedTransformer(ColumnCapper("x", (10, 90)), "g", keep_groups=True).fit(three)
    rows = three.toPandas()
    want = rows.groupby("g").x.transform(lambda s: s.clip(s.quantile(0.1), s.quantile(0.9)))
    got = model.transform(three).toPandas()
    assert np.allclose(np.sort(got.x), np.sort(want)) and len(got) == 150 and set(got.columns) == {"g", "x", "y", "c"}
    new = three.limit(3).withColumn("g", F.lit("new")).withColumn("x", F.lit(99.0))
    assert {r.x for r in model.transform(new).collect()} == {rows.x.quantile(0.9)}
    assert "g" not in g.GroupedTransformer(ColumnCapper("x"), "g").fit_transform(three).columns
    strict = g.GroupedTransformer(ColumnCapper("x"), "g", use_global_model=False).fit(three)
    assert strict.transform(three).count() == 150
    with pytest.raises(PySparkException, match="no model was fitted"):
        strict.transform(new).collect()
    with pytest.raises(ValueError, match="more than 2 groups"):
        g.GroupedTransformer(ColumnCapper("x"), "g", most_groups=2).fit(three)


def test_any_model_for_each_group(three):
    from pyspark.ml.regression import DecisionTreeRegressor

    from loomgrid.operators import linear, meta

    rows = three.toPandas()
    line = g.GroupedRegressor(linear.LinearRegression("x", "y"), "g").fit(three).predict(three).toPandas()
    assert np.allclose(line.prediction, line.y) and len(line) == 150
    tree = g.GroupedPredictor(meta.MLlibRegressor(DecisionTreeRegressor(maxDepth=2, seed=1), "x", "y"), "g").fit(three)
    assert tree.predict(three).count() == 150
    odds = g.GroupedClassifier(linear.LogisticClassifier("x", "c"), "g").fit(three)
    out = odds.predict(three).toPandas()
    assert (out.prediction == out.c).mean() > 0.9 and np.allclose(np.stack(out.probability).sum(1), 1)
    said = odds.decision_function(three).toPandas()
    merged = out.merge(said, on=["g", "x", "y", "c"])
    assert ((merged.decision > 0) == (merged.prediction == 1)).all()
    shares = g.GroupedClassifier(g.FrequencyClassifier("c"), "g").fit(three).decision_function(three).toPandas()
    by = rows.groupby("g").c.mean()
    assert np.allclose(shares.decision, np.log(shares.g.map(by) / (1 - shares.g.map(by))))
    for bad in (lambda: g.GroupedPredictor(linear.LinearRegression("x", "y"), "g", "equal").fit(three), lambda: g.HierarchicalPredictor(linear.LinearRegression("x", "y"), "g").fit(three)):
        with pytest.raises(ValueError, match="learns all groups at once"):
            bad()


def test_python_models_learn_from_bounded_groups(three):
    sizes = g.PandasEstimator("x", "y", lambda f: len(f), lambda m, f: [m] * len(f), most_rows=20)
    out = g.GroupedPredictor(sizes, "g").fit(three)
    seen = {r.prediction for r in out.predict(three).collect()} | {r.prediction for r in out.predict(three.withColumn("g", F.lit("new"))).collect()}
    assert all(5 <= n <= 45 for n in seen)
    whole = g.PandasEstimator("x", "y", lambda f: len(f), lambda m, f: [m] * len(f))
    assert {r.prediction for r in g.GroupedPredictor(whole, "g").fit(three).predict(three).collect()} == {50}


def test_states_leave_the_cache_with_their_model(spark, three):
    import gc

    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held()
    model = g.GroupedRegressor(g.MeanEstimator("y"), "g").fit(three)
    model.predict(three).count()
    assert held() > before
    del model
    gc.collect()
    assert held() == before


def joined_by_shuffle(spark, make) -> bool:
    """Whether a prediction brings its rows together by group, where Spark itself broadcasts nothing."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = make()._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    return plan.count("BroadcastHashJoin") == 0 or "SortMergeJoin" in plan


def two_groups(spark):
    return spark.range(200).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).cast("double").alias("x"), (3 * (F.col("id") % 7) + F.col("id") % 2).cast("double").alias("y"))


def test_small_states_of_regressors_are_broadcast(spark):
    df = two_groups(spark)
    inners = [g.LinearEstimator("x", "y"), g.MeanEstimator("y"), g.PandasEstimator("x", "y", lambda f: float(f["y"].mean()), lambda m, f: [m] * len(f))]
    for inner in inners:
        assert not joined_by_shuffle(spark, lambda: g.GroupedRegressor(inner, "g").fit(df).predict(df))  # noqa: B023


def test_pandas_models_of_hot_groups_know_their_rows(spark):
    df = spark.range(3_000).select(F.when(F.col("id") < 2_900, "hot").otherwise("cold").alias("g"), F.col("id").cast("double").alias("y"))
    for keys in (["g"], []):
        inner = g.PandasEstimator([], "y", lambda f: float(len(f)), lambda m, f: [m] * len(f), most_rows=500)
        found = {r["g"] if keys else None: (r["n"], len(r["params"]["model"])) for r in inner.state(df, keys, "params").collect()}
        assert {k: n for k, (n, _) in found.items()} == ({"hot": 2_900, "cold": 100} if keys else {None: 3_000})


def test_small_states_of_scalers_are_broadcast(spark):
    df = two_groups(spark)
    assert not joined_by_shuffle(spark, lambda: g.GroupedTransformer(g.GroupScaler("x"), "g").fit_transform(df))


def test_small_states_of_quantiles_are_broadcast(spark):
    df = two_groups(spark)
    assert not joined_by_shuffle(spark, lambda: g.GroupedRegressor(g.QuantileEstimator("y"), "g").fit(df).predict(df))


@pytest.mark.parametrize("quantile", [0.5, 0.3, 1.0])
def test_quantiles_of_groups_with_many_values_are_narrowed(spark, quantile, monkeypatch):
    values = np.random.default_rng(0).normal(size=3_000) * 1e3
    rows = [("hot" if i % 3 else "odd" if i % 2 else "few", float(v) if i % 3 else float(i % 7)) for i, v in enumerate(values)] + [("hot", None), ("hot", -np.inf), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, y double")
    made = lambda: {r["g"]: r["prediction"] for r in g.GroupedRegressor(g.QuantileEstimator("y", quantile), "g").fit(df).predict(df.select("g").distinct().union(spark.createDataFrame([("new",)], "g string"))).collect()}
    expected = made()
    hot = sorted(v for k, v in rows if k == "hot" and v is not None)
    assert expected["hot"] == pytest.approx(np.percentile(hot, 100 * quantile), rel=1e-9)
    monkeypatch.setattr(g, "HELD_VALUES", 500)
    held, whole = [], g.quantile_of
    monkeypatch.setattr(g, "quantile_of", lambda value, point, accuracy: held.append(value) or whole(value, point, accuracy))
    got = made()
    assert got.keys() == expected.keys() == {"hot", "odd", "few", "empty", "new"}
    assert all(got[k] == pytest.approx(expected[k], rel=1e-12) if expected[k] is not None else got[k] is None for k in got)
    assert held and all("CASE WHEN" in str(value) for value in held)  # no aggregation takes a large group's values
