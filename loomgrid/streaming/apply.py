"""Fitted operators on streams: their state is numbers or a small table, so each micro-batch is a projection or a join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomgrid.base import Operator, refuse_stream

ROW_WISE = ("predict", "predict_proba", "transform", "decision_function", "score_samples")


def apply(model: Operator, stream: DataFrame, method: str = "transform") -> DataFrame:
    """A fitted operator on a streaming DataFrame; operators that compare rows with rows of the stream are refused."""
    if method not in ROW_WISE:
        raise ValueError(f"method has to be one of {ROW_WISE}")
    if type(model).__name__ in ("LowessRegression", "BayesianKernelDensityClassifier"):
        refuse_stream(stream, type(model).__name__)
    return getattr(model, method)(stream)
