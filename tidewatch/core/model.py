"""Parameters, fitted state and the verbs that all operators share."""

from __future__ import annotations

import inspect
from copy import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spec import US, SeriesSpec

REGISTRY: dict[str, dict[str, type]] = {"transformer": {}, "detector": {}, "aggregator": {}}


def list_models(kind: str | None = None) -> list[str]:
    """Names of all operators, or of one kind."""
    kinds = REGISTRY if kind is None else {kind: REGISTRY[kind]}
    return sorted(name for own in kinds.values() for name in own)


class Model:
    """Named parameters; subclasses with a ``kind`` enter the registry."""

    kind = ""

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        if cls.kind and not cls.__name__.startswith("_"):
            REGISTRY[cls.kind][cls.__name__] = cls

    def _names(self) -> list[str]:
        return [p for p in inspect.signature(type(self).__init__).parameters if p != "self"]

    def get_params(self) -> dict:
        return {p: getattr(self, p) for p in self._names()}

    def set_params(self, **params) -> Model:
        for p, v in params.items():
            if p not in self._names():
                raise KeyError(f"{type(self).__name__} has no parameter {p!r}")
            setattr(self, p, v)
        return self

    def clone(self) -> Model:
        return type(self)(**{p: copy(v) for p, v in self.get_params().items()})


class Params:
    """Fitted numbers of each series and column.

    Of unkeyed data they are plain values and become literals.  Of keyed data
    they are a table with a row for each series, joined at use; its size is
    the number of series, so no side is broadcast unless Spark measures it as
    small.
    """

    def __init__(self, spec: SeriesSpec, table: DataFrame, fields: list[str]):
        self.keys, self.fields = spec.keys, fields
        self.table = table
        self.row = table.first() if not spec.keys else None

    def get(self, field: str):
        return None if self.row is None else self.row[field]

    def bind(self, df: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
        """df with access to the fields, each as a column."""
        if not self.keys:
            types = dict(self.table.dtypes)
            return df, {f: literal(self.row[f] if self.row else None, types[f]) for f in self.fields}
        own = self.table.select(
            *[F.col(k).alias(f"_k_{tag}_{k}") for k in self.keys], *[F.col(f).alias(f"_p_{tag}_{f}") for f in self.fields]
        )
        on = [F.col(k).eqNullSafe(F.col(f"_k_{tag}_{k}")) for k in self.keys]
        df = df.join(own, on, "left").drop(*[f"_k_{tag}_{k}" for k in self.keys])
        return df, {f: F.col(f"_p_{tag}_{f}") for f in self.fields}


def literal(v, kind: str) -> Column:
    if isinstance(v, (list, tuple)):
        return F.array(*[F.lit(x) for x in v]).cast(kind)
    return F.lit(v).cast(kind)


def aggregate(df: DataFrame, spec: SeriesSpec, *columns: Column) -> DataFrame:
    return df.groupBy(*spec.keys).agg(*columns) if spec.keys else df.agg(*columns)


class SeriesModel(Model):
    """An operator on series.

    ``attach`` adds output columns to a normalised DataFrame without a join;
    it returns the DataFrame and (public name, column name) pairs.
    """

    multivariate = False
    trainable = False

    def attach(self, df: DataFrame, spec: SeriesSpec, cols: list[str], tag: str) -> tuple[DataFrame, list[tuple[str, str]]]:
        raise NotImplementedError

    def prepare(self, df: DataFrame, spec: SeriesSpec, cols: list[str], tag: str) -> None:
        """Learn from a normalised DataFrame; nothing where there is nothing to learn."""

    # Verbs -----------------------------------------------------------------
    def fit(self, df: DataFrame, spec: SeriesSpec) -> SeriesModel:
        self.prepare(spec.normalise(df), spec, list(spec.values), "f")
        self.columns_ = list(spec.values)
        self.single_ = len(spec.values) == 1
        return self

    def _inputs(self, spec: SeriesSpec) -> list[str]:
        """The columns a fitted operator works on, with the errors of a mismatch."""
        if not self.trainable:
            return list(spec.values)
        if not hasattr(self, "columns_"):
            raise RuntimeError(f"{type(self).__name__} must be fitted first")
        if self.multivariate:
            if missing := [c for c in self.columns_ if c not in spec.values]:
                raise ValueError(f"columns {missing} of the training data are missing")
            return list(self.columns_)
        if not self.single_:
            if unknown := [c for c in spec.values if c not in self.columns_]:
                raise ValueError(f"columns {unknown} were not in the training data")
        return list(spec.values)

    def _run(self, df: DataFrame, spec: SeriesSpec) -> DataFrame:
        cols = self._inputs(spec)
        out, made = self.attach(spec.normalise(df), spec, cols, "o")
        return out.select(*spec.index, *[F.col(f"`{c}`").alias(name) for name, c in made])

    def _source(self, col: str) -> str:
        """The fitted column whose parameters serve a column."""
        return self.columns_[0] if getattr(self, "single_", False) and col not in self.columns_ else col


def temp(tag: str, *parts) -> str:
    return "_".join(["_t", tag, *map(str, parts)])


__all__ = ["Model", "Params", "SeriesModel", "US", "aggregate", "list_models", "literal", "temp"]
