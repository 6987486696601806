"""Chains and graphs of operators, compiled to one wide lazy plan.

Every operator keeps the rows of its input, so a step only adds columns named
``{step}__{column}`` and a step with several inputs selects from the same
rows; no step joins another's result.
"""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.model import SeriesModel
from ..core.spec import US, SeriesSpec
from ..operators.aggregators import _Aggregator
from ..operators.detectors import _Detector
from ..operators.transformers import _Transformer

ORIGINAL = "original"


class Pipenet:
    """A graph of steps {name: {"model": ..., "input": name or names, "subset": columns}}.

    ``subset`` picks columns: a list for one input, a list of lists (or "all")
    for several.
    """

    def __init__(self, steps: dict[str, dict]):
        self.steps = steps

    # Structure ---------------------------------------------------------------
    def validate(self) -> list[str]:
        """Step names in working order; raises on a malformed graph."""
        if not isinstance(self.steps, dict) or not self.steps:
            raise TypeError("steps must be a dict with at least one step")
        for name, step in self.steps.items():
            if not isinstance(name, str):
                raise TypeError("step names must be strings")
            if name == ORIGINAL or "__" in name:
                raise ValueError(f"{name!r} cannot name a step")
            if not isinstance(step, dict):
                raise TypeError(f"step {name!r} must be a dict")
            if unknown := set(step) - {"model", "input", "subset"}:
                raise KeyError(f"step {name!r} has unknown entries {sorted(unknown)}")
            if missing := {"model", "input"} - set(step):
                raise KeyError(f"step {name!r} lacks {sorted(missing)}")
            if not isinstance(step["model"], (_Transformer, _Detector, _Aggregator)):
                raise TypeError(f"the model of step {name!r} is no transformer, detector or aggregator")
            inputs = self._inputs(name)
            if not inputs or not all(isinstance(i, str) for i in inputs):
                raise TypeError(f"the input of step {name!r} must be a step name or a list of them")
            for i in inputs:
                if i != ORIGINAL and i not in self.steps:
                    raise ValueError(f"step {name!r} reads the unknown step {i!r}")
                source = None if i == ORIGINAL else self.steps[i]["model"] if isinstance(self.steps[i], dict) else None
                if isinstance(step["model"], _Aggregator):
                    if not isinstance(source, (_Detector, _Aggregator)):
                        raise TypeError(f"aggregator {name!r} must read detectors or aggregators")
                elif source is not None and not isinstance(source, _Transformer):
                    raise TypeError(f"step {name!r} must read transformers or the original series")
            self._subsets(name)
        try:
            order = list(TopologicalSorter({n: [i for i in self._inputs(n) if i != ORIGINAL] for n in self.steps}).static_order())
        except CycleError as e:
            raise ValueError(f"steps read each other in a circle: {e.args[1]}") from None
        sinks = set(self.steps) - {i for n in self.steps for i in self._inputs(n)}
        if len(sinks) != 1:
            raise ValueError(f"the final step is ambiguous: {sorted(sinks)}")
        self.final_step_ = sinks.pop()
        return order

    def _inputs(self, name: str) -> list[str]:
        i = self.steps[name]["input"]
        return [i] if isinstance(i, str) else list(i) if isinstance(i, (list, tuple)) else [None]

    def _subsets(self, name: str) -> list:
        subset, inputs = self.steps[name].get("subset", "all"), self._inputs(name)
        if subset is None or subset == "all":
            return ["all"] * len(inputs)
        if not isinstance(subset, (list, tuple)):
            raise TypeError(f"the subset of step {name!r} must be a list or 'all'")
        if len(inputs) == 1 and all(isinstance(c, str) for c in subset):
            return [list(subset)]
        if len(subset) != len(inputs):
            raise ValueError(f"the subset of step {name!r} must have one entry for each input")
        return list(subset)

    def _columns(self, name: str, made: dict[str, list[str]]) -> list[str]:
        out = []
        for i, subset in zip(self._inputs(name), self._subsets(name)):
            prefix = "" if i == ORIGINAL else f"{i}__"
            own = made[i]
            if subset != "all":
                own = [f"{prefix}{c}" for c in subset]
                if lost := [c for c in own if c not in made[i]]:
                    raise ValueError(f"step {name!r} selects missing columns {lost}")
            out += own
        return out

    # Work ----------------------------------------------------------------------
    def _needed(self, order: list[str], skip: set[str]) -> tuple[set[str], set[str]]:
        """Steps to fit, and steps whose output a later fit needs."""
        fit = {n for n in order if getattr(self.steps[n]["model"], "trainable", False) and n not in skip}
        output: set[str] = set()
        for n in reversed(order):
            if n in fit or n in output:
                output |= {i for i in self._inputs(n) if i != ORIGINAL}
        return fit, output

    def _compile(self, df: DataFrame, spec: SeriesSpec, fit: set[str], output: set[str]) -> tuple[DataFrame, dict[str, list[str]]]:
        df = spec.normalise(df)
        made: dict[str, list[str]] = {ORIGINAL: list(spec.values)}
        for name in self.order_:
            if name not in fit and name not in output:
                continue
            model, cols = self.steps[name]["model"], self._columns(name, made)
            if name in fit:
                model.columns_, model.single_ = cols, len(cols) == 1
                model.prepare(df, spec, cols, "fit")
            if name in output:
                if isinstance(model, SeriesModel) and model.trainable:
                    cols = model._inputs(spec.with_values(*cols))
                df, out = model.attach(df, spec, cols, name)
                short = {c: c.rsplit("__", 1)[-1] for c, _ in out}
                clash = len(set(short.values())) < len(short)
                names = {col: f"{name}__{c if clash else short[c]}" for c, col in out}
                df = df.withColumns({new: F.col(f"`{col}`") for col, new in names.items()})
                made[name] = list(names.values())
        return df, made

    def fit(self, df: DataFrame, spec: SeriesSpec, skip_fit: list[str] | None = None) -> Pipenet:
        """Fit the trainable steps, but those in skip_fit, which keep what they learned."""
        self.order_ = self.validate()
        skip = set(skip_fit or [])
        if unknown := skip - set(self.steps):
            raise ValueError(f"skip_fit names unknown steps {sorted(unknown)}")
        self._compile(df, spec, *self._needed(self.order_, skip))
        return self

    def _predict(self, df, spec, kind, events, intermediate):
        self.order_ = self.validate()
        final = self.steps[self.final_step_]["model"]
        detects = not isinstance(final, _Transformer)
        if detects != (kind == "detect"):
            raise RuntimeError(f"the final step {'detects' if detects else 'transforms'}: use {'detect' if detects else 'transform'}")
        wide, made = self._compile(df, spec, set(), set(self.steps))
        if intermediate and events:
            return self._event_lists(wide, spec, made)
        if intermediate:
            shown = [c for n in self.order_ for c in made[n]]
            return wide.select(*spec.index, *[f"`{c}`" for c in spec.values], *[f"`{c}`" for c in shown])
        out = made[self.final_step_]
        names = [c.split("__", 1)[1] for c in out]
        result = wide.select(*spec.index, *[F.col(f"`{c}`").alias(n) for c, n in zip(out, names)])
        if not events:
            return result
        from ..operators.labels import to_events

        return to_events(result, spec.with_values(*names))

    def _event_lists(self, wide: DataFrame, spec: SeriesSpec, made: dict[str, list[str]]) -> DataFrame:
        """(keys, step, type, start, end) of every step that labels."""
        from ..operators.labels import to_events

        out = None
        for n in self.order_:
            if isinstance(self.steps[n]["model"], _Transformer):
                continue
            names = [c.split("__", 1)[1] for c in made[n]]
            own = wide.select(*spec.index, *[F.col(f"`{c}`").alias(x) for c, x in zip(made[n], names)])
            own = to_events(own, spec.with_values(*names))
            own = own.select(*spec.keys, F.lit(n).alias("step"), "type", "start", "end")
            out = own if out is None else out.union(own)
        return out

    def detect(self, df: DataFrame, spec: SeriesSpec, events: bool = False, return_intermediate: bool = False) -> DataFrame:
        return self._predict(df, spec, "detect", events, return_intermediate)

    def transform(self, df: DataFrame, spec: SeriesSpec, return_intermediate: bool = False) -> DataFrame:
        return self._predict(df, spec, "transform", False, return_intermediate)

    def fit_detect(self, df, spec, events: bool = False, return_intermediate: bool = False, skip_fit=None) -> DataFrame:
        return self.fit(df, spec, skip_fit).detect(df, spec, events, return_intermediate)

    def fit_transform(self, df, spec, return_intermediate: bool = False, skip_fit=None) -> DataFrame:
        return self.fit(df, spec, skip_fit).transform(df, spec, return_intermediate)

    def score(self, df: DataFrame, spec: SeriesSpec, truth: DataFrame, scoring: str = "recall", **how) -> DataFrame:
        from ..operators import metrics

        func = {"recall": metrics.recall, "precision": metrics.precision, "f1": metrics.f1_score, "iou": metrics.iou}[scoring]
        if "start" in truth.columns:
            return func(truth, self.detect(df, spec, events=True), keys=[k for k in spec.keys if k in truth.columns], **how)
        found = self.detect(df, spec)
        names = [c for c in found.columns if c not in spec.index]
        return func(truth, found, spec=spec.with_values(*names), **how)

    # Description -----------------------------------------------------------------
    def get_params(self) -> dict[str, dict]:
        return {n: s["model"].get_params() for n, s in self.steps.items()}

    def summary(self, spark: SparkSession) -> DataFrame:
        """name, model, input and subset of each step, in working order."""
        rows = [
            (n, type(self.steps[n]["model"]).__name__, ", ".join(self._inputs(n)), str(self.steps[n].get("subset", "all")))
            for n in self.validate()
        ]
        return spark.createDataFrame(rows, "name string, model string, input string, subset string")

    def flowchart(self) -> str:
        """The graph in the DOT language."""
        lines = ["digraph steps {", f'  "{ORIGINAL}" [shape=box];']
        for n in self.validate():
            lines.append(f'  "{n}" [label="{n}\\n{type(self.steps[n]["model"]).__name__}"];')
            lines += [f'  "{i}" -> "{n}";' for i in self._inputs(n)]
        return "\n".join([*lines, "}"])


class Pipeline(Pipenet):
    """A chain of (name, model) steps, each reading the one before it."""

    def __init__(self, steps: list[tuple[str, object]]):
        names = [ORIGINAL, *[n for n, _ in steps]]
        if len(set(names)) < len(names):
            raise ValueError("step names must differ")
        super().__init__({n: {"model": m, "input": names[i]} for i, (n, m) in enumerate(steps)})


__all__ = ["ORIGINAL", "Pipeline", "Pipenet", "US"]
