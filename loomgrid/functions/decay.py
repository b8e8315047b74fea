"""Weights that fade with age, as expressions of a row's place (0-based, oldest first) and the number of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.base import as_list, refuse_stream, temp


def _range(low: float, high: float) -> None:
    if low > high:
        raise ValueError(f"min_value {low} has to be at most max_value {high}")


def linear_decay(i: Column, n: Column, min_value: float = 0.0, max_value: float = 1.0) -> Column:
    _range(min_value, max_value)
    return F.lit(min_value) + (max_value - min_value) * (i + 1) / n


def exponential_decay(i: Column, n: Column, decay_rate: float = 0.999) -> Column:
    if not 0 < decay_rate < 1:
        raise ValueError(f"decay_rate {decay_rate} has to be between 0 and 1")
    return F.pow(F.lit(float(decay_rate)), n - i)


def stepwise_decay(i: Column, n: Column, n_steps: int | None = None, step_size: int | None = None, min_value: float = 0.0, max_value: float = 1.0) -> Column:
    """Exactly one of ``n_steps`` and ``step_size``; if the size doesn't divide n, the oldest rows may fall below the minimum."""
    _range(min_value, max_value)
    if (n_steps is None) == (step_size is None):
        raise ValueError("give exactly one of n_steps and step_size")
    if (n_steps or step_size) <= 0:
        raise ValueError("n_steps and step_size have to be positive")
    steps = F.lit(n_steps) if n_steps else F.floor(n / F.lit(step_size))
    steps = F.greatest(steps, F.lit(1))
    size = F.greatest(F.floor(n / steps), F.lit(1)) if n_steps else F.greatest(F.floor(n / steps), F.lit(1))
    return F.lit(max_value) - F.floor((n - i) / size) * (max_value - min_value) / steps


def sigmoid_decay(i: Column, n: Column, growth_rate: float | None = None, min_value: float = 0.0, max_value: float = 1.0) -> Column:
    _range(min_value, max_value)
    if growth_rate is not None and not 0 < growth_rate < 1:
        raise ValueError(f"growth_rate {growth_rate} has to be between 0 and 1")
    growth = F.lit(growth_rate) if growth_rate is not None else F.lit(10.0) / n
    return F.lit(min_value) + (max_value - min_value) / (F.lit(1.0) + F.exp(-growth * (i - F.floor(n / F.lit(2)))))


DECAYS: dict[str, Callable[..., Column]] = {"linear": linear_decay, "exponential": exponential_decay, "stepwise": stepwise_decay, "sigmoid": sigmoid_decay}


def with_decay(df: DataFrame, order_by, decay: str | Callable[..., Column] = "exponential", output: str = "weight", partition_by=None, **options) -> DataFrame:
    """``df`` with the weight of each row, oldest first by ``order_by`` (ties have to be broken by the caller).

    Without ``partition_by`` one task numbers all rows; a large table should name keys.
    """
    refuse_stream(df, "decay")
    if isinstance(decay, str) and decay not in DECAYS:
        raise ValueError(f"decay has to be one of {sorted(DECAYS)} or a function")
    keys, i, n = as_list(partition_by), temp("i"), temp("n")
    numbered = df.withColumn(i, F.row_number().over(Window.partitionBy(*keys).orderBy(*as_list(order_by))) - 1)
    numbered = numbered.withColumn(n, F.count("*").over(Window.partitionBy(*keys)))
    weight = (DECAYS[decay] if isinstance(decay, str) else decay)(F.col(i), F.col(n), **options)
    return numbered.withColumn(output, weight.cast("double")).drop(i, n)
