"""Scores as aggregates over a table of predictions; each returns a table of one row with the column ``score``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Null where a side is constant, instead of an error."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_score(df: DataFrame, column: str, prediction: str = "prediction") -> DataFrame:
    """Minus the size of the correlation of prediction and column: 0 is fairest."""
    return df.agg((-F.abs(pearson(F.col(prediction).cast("double"), F.col(column).cast("double")))).alias("score"))


def _ratio(df: DataFrame, sensitive_column: str, hit: Column, empty: float) -> DataFrame:
    z = F.col(sensitive_column)
    sides = df.agg(F.avg(F.when(z == 0, hit)).alias("p0"), F.avg(F.when(z == 1, hit)).alias("p1"), F.count(F.when(~z.isin(0, 1), 1)).alias("others"))
    p0, p1 = F.col("p0"), F.col("p1")
    wrong = F.raise_error(F.lit(f"{sensitive_column} has to hold only 0 and 1")).cast("double")
    score = F.when(F.col("others") > 0, wrong).when(p0.isNull() | p1.isNull(), F.lit(empty)).when((p0 == 0) & (p1 == 0), 1.0).when((p0 == 0) | (p1 == 0), 0.0)
    return sides.select(score.otherwise(F.least(F.try_divide(p1, p0), F.try_divide(p0, p1))).alias("score"))


def p_percent_score(df: DataFrame, sensitive_column: str, positive_target=1, prediction: str = "prediction") -> DataFrame:
    """Smaller over larger rate of positive predictions of the two sides; 1 if both or one of the sides have no rows or no positives at all."""
    return _ratio(df, sensitive_column, (F.col(prediction) == F.lit(positive_target)).cast("double"), 1.0)


def equal_opportunity_score(df: DataFrame, sensitive_column: str, label: str = "label", positive_target=1, prediction: str = "prediction") -> DataFrame:
    """The same among rows whose label is positive; 0 if a side has none."""
    return _ratio(df.where(F.col(label) == F.lit(positive_target)), sensitive_column, (F.col(prediction) == F.lit(positive_target)).cast("double"), 0.0)


def subset_score(df: DataFrame, subset: Column | Callable[[DataFrame], DataFrame], score: Callable[..., DataFrame], **options) -> DataFrame:
    """Any score over the rows of a subset; of no rows it is null."""
    return score(df.where(subset) if isinstance(subset, Column) else subset(df), **options)


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("score"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))
