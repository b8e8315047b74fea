"""Weights of the levels of a group hierarchy, from the root to the group, as expressions of the levels' row counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.base import total


def constant_shrinkage(sizes: list[Column], alpha: float) -> list[Column]:
    k = len(sizes)
    return [F.lit(alpha ** (k - 1 - i) * (1.0 if i == 0 else 1 - alpha)) for i in range(k)]


def relative_shrinkage(sizes: list[Column]) -> list[Column]:
    return [s.cast("double") for s in sizes]


def min_n_obs_shrinkage(sizes: list[Column], min_n_obs: int) -> list[Column]:
    """All weight on the deepest level with enough rows; none has them: an error when the row is computed."""
    enough = [s >= min_n_obs for s in sizes]
    chosen = F.coalesce(*[F.when(e, F.lit(i)) for i, e in reversed(list(enumerate(enough)))], F.raise_error(F.lit(f"no level has {min_n_obs} rows")).cast("int"))
    return [F.when(chosen == i, 1.0).otherwise(0.0) for i in range(len(sizes))]


def equal_shrinkage(sizes: list[Column]) -> list[Column]:
    return [F.lit(1.0) for _ in sizes]


def no_shrinkage(sizes: list[Column]) -> list[Column]:
    return [F.lit(float(i == len(sizes) - 1)) for i in range(len(sizes))]


SHRINKAGE: dict[str, Callable[..., list[Column]]] = {"constant": constant_shrinkage, "relative": relative_shrinkage, "min_n_obs": min_n_obs_shrinkage, "equal": equal_shrinkage}


def weights(sizes: list[Column], shrinkage: str | Callable | None, **options) -> list[Column]:
    """Weights that sum to one; a function gets the list of counts and returns as many numbers or Columns."""
    if isinstance(shrinkage, str) and shrinkage not in SHRINKAGE:
        raise ValueError(f"shrinkage has to be one of {sorted(SHRINKAGE)} or a function")
    function = no_shrinkage if shrinkage is None else SHRINKAGE[shrinkage] if isinstance(shrinkage, str) else shrinkage
    raw = [w if isinstance(w, Column) else F.lit(float(w)) for w in function(sizes, **options)]
    if len(raw) != len(sizes):
        raise ValueError(f"shrinkage gave {len(raw)} weights for {len(sizes)} levels")
    whole = total(raw)
    return [w / whole for w in raw]
