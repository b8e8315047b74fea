"""Pipelines that report on each step, and decorators that log functions from DataFrame to DataFrame."""

from __future__ import annotations

import functools
import inspect
import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgrid.base import Operator

log = logging.getLogger(__name__)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def default_log_callback(output, execution_time: float, **kwargs) -> None:
    """Logs step, columns and seconds; no job runs for it."""
    logger = logging.getLogger(__name__)
    logger.info(f"[{kwargs.get('func')}] columns={len(output[0].columns) if isinstance(output, tuple) else len(output.columns)} time={execution_time:.3f}s")


class DebugPipeline(Operator):
    """Steps (name, operator), each fitted on what the one before returns. ``log_callback`` (or "default") hears of every
    step but the last, with func, input_args, input_kwargs, output and execution_time. ``memory=True`` keeps each
    step's rows in Spark's cache until all later steps are fitted."""

    def __init__(self, steps: list[tuple[str, Operator]], memory: bool = False, verbose: bool = False, *, log_callback: Callable | str | None = None) -> None:
        names = [n for n, _ in steps]
        if len(set(names)) != len(names):
            raise ValueError(f"step names have to be unique: {names}")
        self.steps, self.memory, self.verbose, self.log_callback = steps, memory, verbose, log_callback

    def uses(self) -> list[str]:
        return []

    def _fit(self, df: DataFrame) -> None:
        self.steps_, held = [], []
        say = default_log_callback if self.log_callback == "default" else self.log_callback
        for i, (name, step) in enumerate(self.steps):
            began, given = time.time(), df
            model = step.fit(df)
            self.steps_.append((name, model))
            if i + 1 < len(self.steps):
                df = model.transform(df)
                if self.memory:
                    df = df.cache()
                    held.append(df)
                if say:
                    say(func=name, input_args=(given,), input_kwargs={}, output=(df, model), execution_time=time.time() - began)
            if self.verbose:
                print(f"[{name}] {time.time() - began:.3f}s")
        for cached in held:
            cached.unpersist()

    def _through(self, df: DataFrame) -> DataFrame:
        for _, model in self.steps_[:-1]:
            df = model.transform(df)
        return df

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.steps_[-1][1].transform(self._through(df))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.steps_[-1][1].predict(self._through(df))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.steps_[-1][1].predict_proba(self._through(df))

    @property
    def named_steps(self) -> dict[str, Operator]:
        return dict(getattr(self, "steps_", None) or self.steps)


def make_debug_pipeline(*steps: Operator, memory: bool = False, verbose: bool = False, log_callback: Callable | str | None = None) -> DebugPipeline:
    """A pipeline whose steps are named after their types; repeated types are numbered."""
    types = [type(s).__name__.lower() for s in steps]
    names = [t if types.count(t) == 1 else f"{t}-{types[: i + 1].count(t)}" for i, t in enumerate(types)]
    return DebugPipeline(list(zip(names, steps)), memory, verbose, log_callback=log_callback)


def counted_later(df: DataFrame, say: Callable[[int], None]) -> DataFrame:
    """The same rows; once an action has read them, ``say`` hears how many there were."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    threading.Thread(target=lambda: say(seen.get["rows"]), daemon=True).start()
    return out


def log_step(func: Callable | None = None, *, time_taken: bool = True, shape: bool = True, shape_delta: bool = False, names: bool = False, dtypes: bool = False, print_fn: Callable = print, display_args: bool = True, log_error: bool = True, lazy: bool = False):
    """Logs each call of a DataFrame function, also when it fails. ``shape`` counts rows, which runs a job; without it the
    log is free. With ``lazy`` no job runs for the log: the rows are counted by an Observation while the result is first
    read, and a second line, ``n_obs=``, says how many."""
    if func is None:
        return functools.partial(log_step, time_taken=time_taken, shape=shape, shape_delta=shape_delta, names=names, dtypes=dtypes, print_fn=print_fn, display_args=display_args, log_error=log_error, lazy=lazy)
    count = globals()["shape"]

    @functools.wraps(func)
    def wrapper(*args, **kwargs):
        before = count(args[0]) if shape_delta and not lazy and args and isinstance(args[0], DataFrame) else None
        began, said, failed = time.time(), [], None
        try:
            result = func(*args, **kwargs)
            if time_taken:
                said.append(f"time={time.time() - began:.3f}s")
            size = count(result) if (shape and not lazy) or before else None
            if shape and lazy:
                said.append(f"n_col={len(result.columns)}")
                result = counted_later(result, lambda n: print_fn(f"[{func.__name__}] n_obs={n}"))
            elif shape:
                said.append(f"n_obs={size[0]}, n_col={size[1]}")
            if before:
                said.append(f"delta=({size[0] - before[0]:+d}, {size[1] - before[1]:+d})")
            if names:
                said.append(f"names={result.columns}")
            if dtypes:
                said.append(f"dtypes={dict(result.dtypes)}")
            return result
        except Exception as e:
            failed = e
            raise
        finally:
            if failed is None or log_error:
                bound = inspect.signature(func).bind(*args, **kwargs).arguments if display_args else {}
                shown = ", ".join(f"{k}={'df' if isinstance(v, DataFrame) else v}" for k, v in bound.items())
                end = f" FAILED with error: {failed!r}" if failed else ""
                print_fn(f"[{func.__name__}({shown})] " + " ".join(said) + end)

    return wrapper


def log_step_extra(*log_functions: Callable, print_fn: Callable = print, **log_options):
    """Logs what the functions say of the result."""
    if not log_functions or not all(callable(f) for f in log_functions):
        raise ValueError("name at least one function that says what to log")

    def decorator(func):
        @functools.wraps(func)
        def wrapper(*args, **kwargs):
            result = func(*args, **kwargs)
            print_fn(f"[{func.__name__}] " + " ".join(str(f(result, **log_options)) for f in log_functions))
            return result

        return wrapper

    return decorator
