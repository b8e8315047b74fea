"""Invariants that any operator can be held to."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomgrid.base import Operator


def check_shape_remains_same(model: Operator, df: DataFrame, method: str = "transform") -> None:
    """As many rows come out as went in, for the whole table, one row and none."""
    fitted = model.fit(df)
    for rows in (df, df.limit(1), df.limit(0)):
        assert getattr(fitted, method)(rows).count() == rows.count(), f"{type(model).__name__}.{method} changed the number of rows"


def check_input_is_kept(model: Operator, df: DataFrame, method: str = "predict") -> None:
    """Predicting adds columns and leaves those of the input."""
    out = getattr(model.fit(df), method)(df)
    assert out.columns[: len(df.columns)] == df.columns
