"""Named example datasets from files, generated series, and tables by path."""

from __future__ import annotations

import os
import zipfile
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The label of each dataset, and its columns where they are few.
DATASETS = {
    "penguins": ("species", "species string, island string, bill_length_mm double, bill_depth_mm double, flipper_length_mm double, body_mass_g double, sex string"),
    "arrests": ("released", None),
    "chickweight": ("weight", None),
    "abalone": ("sex", None),
    "heroes": ("attack_type", None),
    "hearts": ("target", None),
    "creditcard": ("Class", None),
}


class NotInstalledPackage:
    """Stands for a package that isn't there; any use says how to get it."""

    def __init__(self, package_name: str, version: str | None = None) -> None:
        self.package_name = f"{package_name}{'==' + version if version else ''}"

    def __getattr__(self, name: str):
        raise ImportError(f"the package {self.package_name} is not installed: pip install {self.package_name}")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON, or CSV with a header (by the path's ending). A zip file holds one CSV and is not splittable: it
    is unpacked in Spark from its bytes, so any store will do; write it as Parquet once."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending == ".zip":
        import io

        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            lines = z.read(z.namelist()[0]).decode().splitlines()
        text = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
        return spark.read.csv(text.rdd.map(lambda r: r[0]), header=True, schema=schema, inferSchema=schema is None)
    if ending in (".csv", ".gz", ".txt"):
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None, nullValue="NA")
    if ending in (".json", ".orc"):
        return getattr(spark.read, ending[1:])(path)
    return spark.read.parquet(path)


def load(spark: SparkSession, name: str, path: str, return_X_y: bool = False):
    """A dataset of ``DATASETS`` from its file; with ``return_X_y`` the features and the label apart."""
    label, schema = DATASETS[name]
    df = read_table(spark, path, schema)
    return (df.drop(label), df.select(label)) if return_X_y else df


def load_penguins(spark: SparkSession, path: str, return_X_y: bool = False):
    return load(spark, "penguins", path, return_X_y)


def load_arrests(spark: SparkSession, path: str, return_X_y: bool = False):
    return load(spark, "arrests", path, return_X_y)


def load_chicken(spark: SparkSession, path: str, return_X_y: bool = False):
    return load(spark, "chickweight", path, return_X_y)


def load_abalone(spark: SparkSession, path: str, return_X_y: bool = False):
    return load(spark, "abalone", path, return_X_y)


def load_heroes(spark: SparkSession, path: str, return_X_y: bool = False):
    """With ``return_X_y`` the features are health and attack."""
    out = load(spark, "heroes", path, return_X_y)
    return (out[0].select("health", "attack"), out[1]) if return_X_y else out


def load_hearts(spark: SparkSession, path: str, return_X_y: bool = False):
    return load(spark, "hearts", path, return_X_y)


def fetch_creditcard(spark: SparkSession, path: str, return_X_y: bool = False):
    """The table has to be there already: nothing is downloaded."""
    return load(spark, "creditcard", path, return_X_y)


def make_simpleseries(spark: SparkSession, n_samples: int = 365 * 5, trend: float = 0.001, season_trend: float = 0.001, noise: float = 0.5, seed: int | None = None, stack_noise: bool = False, start_date: date | None = None) -> DataFrame:
    """(t, yt[, date]): a trend, a season of 365 rows that grows, and noise (summed up with ``stack_noise``)."""
    import math

    import numpy as np

    rng = np.random.default_rng(seed)
    r1, r2 = rng.normal(size=2)
    t = F.col("t").cast("double")
    season = r1 * F.sin(t * (2 * math.pi / 365)) + r2 * F.cos(t * (4 * math.pi / 365) + 1)
    # One partition where noise adds up, since the sum runs along the whole series.
    df = spark.range(0, n_samples, 1, 1 if stack_noise else None).toDF("t").withColumn("__noise", F.randn(int(rng.integers(1 << 31))) * noise)
    if stack_noise:
        df = df.withColumn("__noise", F.sum("__noise").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("yt", season + season_trend * season * t + trend * t + F.col("__noise")).drop("__noise")
    return df.withColumn("date", F.date_add(F.lit(start_date), F.col("t").cast("int"))) if start_date else df
