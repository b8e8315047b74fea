import pickle
import zipfile
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import features, grouped, linear, select
from loomgrid.plans.model_selection import ClusterFoldValidation, GroupTimeSeriesSplit, TimeGapSplit
from loomgrid.plans.pipeline import DebugPipeline, log_step, log_step_extra, make_debug_pipeline
from loomgrid.sources import datasets
from loomgrid.streaming.apply import apply


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(i, datetime(2018, 1, 1) + timedelta(days=i)) for i in range(25)], "i int, date timestamp")


def folds(split, df):
    return [tuple([r.i for r in part.orderBy("i").collect()] for part in pair) for pair in split.split(df)]


def test_time_gap_folds(days):
    d = timedelta
    got = folds(TimeGapSplit("date", d(days=3), d(days=5), d(days=1), d(days=3)), days)
    assert got[0] == ([0, 1, 2, 3, 4], [6, 7, 8]) and got[1] == ([3, 4, 5, 6, 7], [9, 10, 11])
    assert all(max(t) < min(v) - 1 for t, v in got)
    wide = folds(TimeGapSplit("date", d(days=3), d(days=5), d(days=1), d(days=3), window="expanding"), days)
    assert [t[0] for t, _ in wide] == [0] * len(wide) and len(wide) == len(got)
    assert TimeGapSplit("date", d(days=3), gap_duration=d(days=1), n_splits=3, stride_duration=d(days=2)).get_n_splits(days) == 3
    rows = TimeGapSplit("date", d(days=3), d(days=5), d(days=1), d(days=3)).summary(days).collect()
    assert len(rows) == 2 * len(got) and (rows[0].n_rows, rows[0].unique_dates, rows[0].period) == (5, 5, 4) and rows[0].part == "train"


def test_time_gap_errors(days):
    d = timedelta
    for options in ({}, {"train_duration": d(days=1), "gap_duration": d(days=2)}, {"train_duration": d(days=5), "window": "zz"}, {"train_duration": d(days=5), "stride_duration": d(0)}):
        with pytest.raises(ValueError):
            TimeGapSplit("date", d(days=3), **options)
    with pytest.raises(ValueError):
        TimeGapSplit("date", d(days=3), d(days=5), n_splits=50).bounds(days)


def test_group_time_series(spark):
    sizes = [3, 1, 2, 1, 5, 2, 2, 1]
    df = spark.createDataFrame([(2000 + g,) for g, n in enumerate(sizes) for _ in range(n)], "year int")
    split = GroupTimeSeriesSplit("year", 3)
    assert [b[2] for b in split.blocks(df)] == [4, 3, 5, 5]
    parts = [(t.count(), v.count()) for t, v in split.split(df)]
    assert parts == [(4, 3), (3, 5), (5, 5)]
    assert {r.block: (r.n_rows, r.n_groups) for r in split.summary(df).collect()} == {0: (4, 2), 1: (3, 2), 2: (5, 1), 3: (5, 3)}
    with pytest.raises(ValueError):
        GroupTimeSeriesSplit("year", 9).blocks(df)


def test_group_cuts_are_optimal():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(200):
        sizes, parts = [rng.randint(1, 9) for _ in range(rng.randint(4, 9))], rng.randint(2, 4)
        ideal = sum(sizes) / parts
        cost = lambda cuts: sum(abs(sum(sizes[a:b]) - ideal) for a, b in zip([0, *cuts], [*cuts, len(sizes)]))  # noqa: B023, E731
        best = min(cost(c) for c in itertools.combinations(range(1, len(sizes)), parts - 1))
        got = GroupTimeSeriesSplit.cuts(sizes, parts)
        assert len(got) == parts - 1 and sorted(set(got)) == got and cost(got) <= 1.5 * best + ideal


def test_cluster_folds(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 0.1, (20, 2)), rng.normal(9, 0.1, (30, 2))]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    from pyspark.ml.clustering import KMeans

    got = [(t.count(), v.count()) for t, v in ClusterFoldValidation(["a", "b"], KMeans(k=2, seed=1)).split(df)]
    assert sorted(got) == [(20, 30), (30, 20)]
    with pytest.raises(ValueError):
        list(ClusterFoldValidation(["a"], KMeans(k=2, seed=1)).split(df.withColumn("a", F.lit(1.0))))


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(float(i), float(i % 3), 2.0 * i) for i in range(30)], "a double, b double, y double")


def test_debug_pipeline(numbers):
    heard = []
    pipe = make_debug_pipeline(select.ColumnSelector(["a", "y"]), features.ColumnCapper("a"), linear.LinearRegression("a", "y"), log_callback=lambda **k: heard.append(k))
    model = pipe.fit(numbers)
    assert [h["func"] for h in heard] == ["columnselector", "columncapper"]
    assert set(heard[0]) == {"func", "input_args", "input_kwargs", "output", "execution_time"}
    assert model.predict(numbers).columns == ["a", "y", "prediction"] and list(model.named_steps)[-1] == "linearregression"
    assert make_debug_pipeline(features.ColumnCapper("a"), features.ColumnCapper("b")).steps[1][0] == "columncapper-2"
    with pytest.raises(ValueError):
        DebugPipeline([("x", None), ("x", None)])
    cached = make_debug_pipeline(select.ColumnSelector(["a", "y"]), features.ColumnCapper("a"), memory=True, log_callback="default", verbose=True)
    assert cached.fit_transform(numbers).count() == 30
    pickle.dumps(make_debug_pipeline(features.ColumnCapper("a"), log_callback="default"))


def test_log_step(numbers):
    said = []

    @log_step(shape_delta=True, names=True, dtypes=True, print_fn=said.append)
    def keep(df, low=3):
        return df.where(F.col("a") > low).drop("b")

    @log_step(shape=False, print_fn=said.append)
    def broken(df):
        raise KeyError("no")

    assert keep(numbers, low=5).count() == 24
    assert all(x in said[0] for x in ("keep(df=df, low=5)", "n_obs=24, n_col=2", "delta=(-6, -1)", "time=", "names=['a', 'y']"))
    with pytest.raises(KeyError):
        broken(numbers)
    assert "FAILED" in said[1]

    @log_step_extra(lambda df: f"rows={df.count()}", print_fn=said.append)
    def again(df):
        return df

    again(numbers)
    assert said[2] == "[again] rows=30"
    with pytest.raises(ValueError):
        log_step_extra()


def test_sources(spark, tmp_path):
    text = "species,island,bill_length_mm,bill_depth_mm,flipper_length_mm,body_mass_g,sex\nAdelie,Dream,39.1,18.7,181,3750,male\nGentoo,Biscoe,40,17,190,4000,\n"
    with zipfile.ZipFile(tmp_path / "penguins.zip", "w") as z:
        z.writestr("penguins.csv", text)
    (tmp_path / "penguins.csv").write_text(text)
    for name in ("penguins.zip", "penguins.csv"):
        x, y = datasets.load_penguins(spark, str(tmp_path / name), return_X_y=True)
        assert y.columns == ["species"] and x.count() == 2 and dict(x.dtypes)["body_mass_g"] == "double"
    heroes = spark.createDataFrame([("a", "Melee", 1.0, 2.0)], "name string, attack_type string, health double, attack double")
    heroes.write.parquet(str(tmp_path / "heroes.parquet"))
    x, _ = datasets.load_heroes(spark, str(tmp_path / "heroes.parquet"), True)
    assert x.columns == ["health", "attack"]
    with pytest.raises(ImportError, match="pip install nothing"):
        datasets.NotInstalledPackage("nothing").anything


def test_simple_series(spark):
    a, b = (datasets.make_simpleseries(spark, 500, seed=3, start_date=date(2020, 1, 1)).orderBy("t").collect() for _ in range(2))
    assert a == b and len(a) == 500 and a[31].date == date(2020, 2, 1)
    stacked = datasets.make_simpleseries(spark, 500, seed=3, noise=1.0, stack_noise=True)
    assert stacked.count() == 500


def test_operators_on_a_stream(spark, numbers, tmp_path):
    numbers.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(numbers.schema).parquet(str(tmp_path / "in"))
    model = grouped.GroupedRegressor(grouped.MeanEstimator("y"), "b").fit(numbers)
    query = apply(model, stream, "predict").writeStream.format("memory").queryName("predicted").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("predicted").count() == 30 and spark.table("predicted").where("prediction is null").count() == 0
    with pytest.raises(ValueError):
        features.add_lags(stream, "a", 1, "a")
    with pytest.raises(ValueError):
        apply(linear.LowessRegression("a", "y").fit(numbers), stream, "predict")


def test_entry_imports_without_the_subpackage():
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as d:
        shutil.copy(f"{root}/__spark_entry__.py", d)
        shutil.copytree(f"{root}/loomgrid", f"{d}/loomgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q if k[:2] == 'op' and k[2:3].isdigit()); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=d, check=True, env={**os.environ, "PYTHONPATH": d})


def test_helpers_and_invariants(spark, numbers):
    from loomgrid import base, testing
    from loomgrid.operators import density

    assert base.flatten([1, [2, (3, [4])]]) == [1, 2, 3, 4]
    assert isinstance(linear.LogisticClassifier("a", "y"), base.ProbabilisticClassifier) and not isinstance(linear.LinearRegression("a", "y"), base.ProbabilisticClassifier)
    assert isinstance(density.GMMOutlierDetector("a"), base.OutlierModel) and isinstance(ClusterFoldValidation(["a"]), base.Clusterer)
    testing.check_shape_remains_same(features.ColumnCapper("a"), numbers)
    testing.check_shape_remains_same(linear.LinearRegression("a", "y"), numbers, "predict")
    testing.check_input_is_kept(grouped.GroupedRegressor(grouped.MeanEstimator("y"), "b"), numbers)
    with pytest.raises(AssertionError):
        testing.check_shape_remains_same(select.OutlierRemover(density.GMMOutlierDetector("a", 0.5)), numbers)


def test_lazy_log_counts_while_the_result_is_read(spark):
    import time

    from loomgrid.plans.pipeline import log_step

    lines = []

    @log_step(time_taken=False, lazy=True, print_fn=lines.append)
    def odd(df):
        return df.where("id % 2 = 1")

    out = odd(spark.range(1001))
    assert lines == ["[odd(df=df)] n_col=1"]
    assert len(out.collect()) == 500
    for _ in range(100):
        if len(lines) == 2:
            break
        time.sleep(0.05)
    assert lines[1:] == ["[odd] n_obs=500"]


def test_memory_is_released_after_fitting(spark):
    from loomgrid.operators import features
    from loomgrid.plans.pipeline import DebugPipeline

    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held()
    df = spark.range(50).selectExpr("cast(id as double) as a")
    DebugPipeline([("one", features.ColumnCapper("a")), ("two", features.ColumnCapper("a", (10, 90)))], memory=True).fit(df)
    assert held() == before


def test_too_many_time_groups_are_an_error(spark, monkeypatch):
    from loomgrid.plans.model_selection import GroupTimeSeriesSplit

    monkeypatch.setattr(GroupTimeSeriesSplit, "MOST_GROUPS", 10)
    with pytest.raises(ValueError, match="more than 10 groups"):
        GroupTimeSeriesSplit("id", 2).blocks(spark.range(20))
