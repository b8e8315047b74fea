"""Projections by name, type, value map and formula, and operators for training data only."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.base import Detector, Operator, as_list, distinct_values, finite


class ColumnSelector(Operator):
    """Keeps the named columns, in the order named."""

    def __init__(self, columns) -> None:
        self.columns = as_list(columns)

    def _fit(self, df: DataFrame) -> None:
        if not self.columns:
            raise ValueError("name at least one column")
        if missing := [c for c in self.columns if c not in df.columns]:
            raise KeyError(f"no such columns: {missing}")

    def uses(self) -> list[str]:
        return self.columns

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)

    def get_feature_names(self) -> list[str]:
        return self.columns


class ColumnDropper(ColumnSelector):
    """Drops the named columns; unknown names and dropping everything are errors."""

    def _fit(self, df: DataFrame) -> None:
        super()._fit(df)
        self.feature_names_ = [c for c in df.columns if c not in self.columns]
        if not self.feature_names_:
            raise ValueError(f"dropping {self.columns} would drop every column")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.columns)

    def get_feature_names(self) -> list[str]:
        return self.feature_names_


#: Type classes; decimals count as numbers.
TYPE_CLASSES = {
    "number": lambda f: isinstance(f.dataType, T.NumericType),
    "bool": lambda f: isinstance(f.dataType, T.BooleanType),
    "string": lambda f: isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)) and "ml_attr" not in f.metadata,
    "category": lambda f: "ml_attr" in f.metadata,
}


def of_type(field: T.StructField, kind) -> bool:
    """A class name, a Spark type or its class, or a simple type name such as ``bigint``."""
    if isinstance(kind, str):
        if kind in TYPE_CLASSES:
            return TYPE_CLASSES[kind](field)
        if kind == field.dataType.simpleString():
            return True
        if not re.fullmatch(r"[a-z0-9_]+(\(.*\))?|(array|map|struct)<.*>", kind) or kind in ("category_", "object"):
            raise ValueError(f"{kind!r} is no type class: use {sorted(TYPE_CLASSES)} or a Spark type")
        return False
    return isinstance(field.dataType, kind) if isinstance(kind, type) else field.dataType == kind


class TypeSelector(Operator):
    """Keeps the columns of the included types that are not of an excluded type."""

    def __init__(self, include=None, exclude=None) -> None:
        self.include, self.exclude = include, exclude

    def _fit(self, df: DataFrame) -> None:
        if self.include is None and self.exclude is None:
            raise ValueError("say what to include, what to exclude, or both")
        inc, exc = as_list(self.include), as_list(self.exclude)
        self.feature_names_ = [f.name for f in df.schema if (not inc or any(of_type(f, k) for k in inc)) and not any(of_type(f, k) for k in exc)]
        if not self.feature_names_:
            raise ValueError("no column is of these types")
        self.dtypes_ = dict(df.dtypes)

    def uses(self) -> list[str]:
        return list(self.dtypes_)

    def _transform(self, df: DataFrame) -> DataFrame:
        now = dict(df.dtypes)
        if wrong := [c for c, t in self.dtypes_.items() if now[c] != t]:
            raise ValueError(f"column types differ from those at fit: {wrong}")
        return df.select(*self.feature_names_)

    def get_feature_names(self) -> list[str]:
        return self.feature_names_


class PandasTypeSelector(TypeSelector):
    """Other name of TypeSelector."""


class IdentityTransformer(Operator):
    """Returns its input; with ``check_X`` one aggregate makes sure that all numbers are finite."""

    def __init__(self, check_X: bool = False) -> None:
        self.check_X = check_X

    def _fit(self, df: DataFrame) -> None:
        self.n_features_in_ = len(df.columns)
        if self.check_X:
            numbers = [f.name for f in df.schema if TYPE_CLASSES["number"](f)]
            bad = df.agg(*[F.count(F.when(~finite(F.col(c).cast("double")), 1)).alias(c) for c in numbers]).first() if numbers else []
            if any(bad):
                raise ValueError("input holds null, NaN or infinity")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df


class DictMapper(Operator):
    """Replaces the values of columns by a dict; values not in it (and nulls) become ``default``. Results are longs."""

    inline = 200

    def __init__(self, mapper: dict, default: int, columns=None) -> None:
        self.mapper, self.default, self.columns = mapper, default, columns

    def _fit(self, df: DataFrame) -> None:
        self.columns_ = as_list(self.columns) or df.columns

    def uses(self) -> list[str]:
        return self.columns_

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = [(k, int(v)) for k, v in self.mapper.items() if k is not None and k == k]
        if len(pairs) > self.inline:  # too long for an expression: a lookup join, broadcast by size
            table = df.sparkSession.createDataFrame(pairs, ["__key", "__value"])
            for c in self.columns_:
                df = df.join(table, df[c] == table["__key"], "left").withColumn(c, F.coalesce("__value", F.lit(self.default)).cast("long")).drop("__key", "__value")
            return df
        found = F.create_map(*[F.lit(x) for pair in pairs for x in pair]) if pairs else None
        value = lambda c: F.lit(self.default).cast("long") if found is None else F.coalesce(F.when(F.col(c).isNotNull(), F.try_element_at(found, F.col(c))).cast("long"), F.lit(self.default).cast("long"))
        return df.withColumns({c: value(c) for c in self.columns_})


class FormulaicTransformer(Operator):
    """Columns of a right-sided formula: ``a + log(b) + c:d + e*f - 1``; strings become one column for each level.

    With an intercept the first level (in order) of a string term is dropped, without one the first string term keeps all.
    """

    FUNCTIONS = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "log10": F.log10, "log2": F.log2, "log1p": F.log1p, "sin": F.sin, "cos": F.cos}

    def __init__(self, formula: str) -> None:
        self.formula = formula

    def _terms(self) -> tuple[bool, list[list[str]]]:
        if "~" in self.formula:
            raise ValueError("only one-sided formulas are supported")
        intercept, terms = True, []
        for sign, term in re.findall(r"([+-]?)\s*((?:\([^()]*\)|[^+\-()])+)", self.formula):
            term = term.strip()
            if term in ("0", "1"):
                intercept = (term == "1") != (sign == "-")
                continue
            if sign == "-":
                terms = [t for t in terms if t != term.split(":")]
                continue
            parts = [p.strip() for p in term.split("*")]
            made = [[]]
            for p in parts:
                made += [m + p.split(":") for m in made]
            terms += [m for m in sorted(made[1:], key=len) if m not in terms]
        return intercept, terms

    def _fit(self, df: DataFrame) -> None:
        self.intercept_, self.terms_ = self._terms()
        self.levels_, strings = {}, {f.name for f in df.schema if TYPE_CLASSES["string"](f) or TYPE_CLASSES["bool"](f)}
        names = {n for t in self.terms_ for n in t}
        for n in names:
            base = self._name(n)
            if base not in df.columns:
                raise KeyError(f"column {base} is not in the DataFrame")
            if base in strings:
                self.levels_[n] = distinct_values(df, base)
        self.columns_, full = [], self.intercept_
        if self.intercept_:
            self.columns_.append(("Intercept", F.lit(1.0)))
        for term in sorted(self.terms_, key=len):
            made = [("", None)]
            for n in term:
                parts = self._factor(n, drop=full if len(term) == 1 else True)
                full = full or (n in self.levels_ and len(term) == 1)
                made = [(f"{a}:{b}" if a else b, x if y is None else y * x) for a, y in made for b, x in parts]
            self.columns_ += made
        self.names_ = [a for a, _ in self.columns_]

    def _name(self, factor: str) -> str:
        m = re.fullmatch(r"(\w+)\((\w+)\)", factor)
        if m and m[1] != "C" and m[1] not in self.FUNCTIONS:
            raise ValueError(f"{m[1]} is not a function of formulas: use {sorted(self.FUNCTIONS)}")
        return m[2] if m else factor

    def _factor(self, factor: str, drop: bool) -> list:
        c = F.col(self._name(factor))
        if factor in self.levels_:
            prefix = "T." if drop else ""
            return [(f"{factor}[{prefix}{v}]", F.when(c == v, 1.0).otherwise(0.0)) for v in self.levels_[factor][drop:]]
        m = re.fullmatch(r"(\w+)\((\w+)\)", factor)
        return [(factor, self.FUNCTIONS[m[1]](c.cast("double")) if m else c.cast("double"))]

    def uses(self) -> list[str]:
        return sorted({self._name(n) for t in self.terms_ for n in t})

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[x.alias(a) for a, x in self.columns_])


# ---------------------------------------------------------------- training data only


class TrainOnlyTransformer(Operator):
    """Acts on the DataFrame it was fitted on (the same plan) and returns any other as it is; ``training`` overrides."""

    def _fit(self, df: DataFrame) -> None:
        self.plan_ = df.semanticHash()

    def transform(self, df: DataFrame, training: bool | None = None) -> DataFrame:
        self.check(df)
        if training if training is not None else df.semanticHash() == self.plan_:
            return self.transform_train(df)
        return self.transform_test(df)

    def transform_train(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def transform_test(self, df: DataFrame) -> DataFrame:
        return df


class RandomAdder(TrainOnlyTransformer):
    """Adds normal noise to numeric columns of the training data."""

    def __init__(self, noise: float = 1, random_state: int | None = None, columns=None) -> None:
        self.noise, self.random_state, self.columns = noise, random_state, columns

    def transform_train(self, df: DataFrame) -> DataFrame:
        columns = as_list(self.columns) or [f.name for f in df.schema if TYPE_CLASSES["number"](f)]
        seed = np.random.default_rng(self.random_state).integers(1 << 31) if self.random_state is not None else None
        noise = lambda k: F.randn(int(seed) + k) if seed is not None else F.randn()
        return df.withColumns({c: F.col(c) + self.noise * noise(k) for k, c in enumerate(columns)})


class OutlierRemover(TrainOnlyTransformer):
    """Drops the rows of the training data that a detector calls outliers."""

    def __init__(self, outlier_detector: Detector, refit: bool = True) -> None:
        self.outlier_detector, self.refit = outlier_detector, refit

    def _fit(self, df: DataFrame) -> None:
        super()._fit(df)
        self.detector_ = self.outlier_detector.fit(df) if self.refit or self.outlier_detector.schema_ is None else self.outlier_detector

    def transform_train(self, df: DataFrame) -> DataFrame:
        return df.where(self.detector_.decision() >= 0)
