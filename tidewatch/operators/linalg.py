"""Regression and principal axes from one aggregate of means and covariances."""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.model import Params, aggregate, temp
from ..core.spec import US, SeriesSpec, clean_double


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without a null in cols."""
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols]))


def moments(df: DataFrame, spec: SeriesSpec, cols: list[str]) -> DataFrame:
    """keys, n, mean array and covariance matrix of the complete rows."""
    c = [F.col(f"`{x}`") for x in cols]
    cov = [F.array(*[F.covar_samp(a, b) for b in c]) for a in c]
    return aggregate(complete(df, cols), spec, F.count("*").alias("n"), F.array(*map(F.avg, c)).alias("mean"), F.array(*cov).alias("cov"))


def solved(table: DataFrame, spec: SeriesSpec, func, schema: str) -> DataFrame:
    """One row per series through a numpy function of its moments."""
    keys, kinds = list(spec.keys), dict(table.dtypes)

    def run(frames):
        for pdf in frames:
            rows = [func(r) for r in pdf.itertuples(index=False)]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows, columns=[p.split()[0] for p in schema.split(", ")])], axis=1)

    return table.mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], schema]))


def _matrix(rows) -> np.ndarray:
    return np.array([[0.0 if v is None else v for v in r] for r in rows], float)


class Linear:
    """Ordinary least squares with the smallest coefficients among equals."""

    @staticmethod
    def of(regressor):
        if regressor is None:
            return Linear()
        return MlModel(regressor) if isinstance(regressor, Estimator) else PyModel(regressor)

    def fit(self, df: DataFrame, spec: SeriesSpec, features: list[str], target: str):
        def solve(r):
            cov, mean = _matrix(r.cov), np.array(r.mean, float)
            if not r.n:
                return None, None
            beta = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=1e-12)[0] if r.n > 1 else np.zeros(len(features))
            return list(beta), float(mean[-1] - beta @ mean[:-1])

        table = moments(df, spec, [*features, target])
        self.params = Params(spec, solved(table, spec, solve, "beta array<double>, base double"), ["beta", "base"])
        if not spec.keys and self.params.get("beta") is None:
            raise RuntimeError("no row without a missing value to learn from")
        return self

    def predict(self, df: DataFrame, spec: SeriesSpec, features: list[str], tag: str) -> tuple[DataFrame, Column]:
        df, p = self.params.bind(df, f"{tag}ols")
        return df, reduce(lambda a, b: a + b, [p["base"], *[p["beta"][i] * F.col(f"`{c}`") for i, c in enumerate(features)]])


class MlModel:
    """A pyspark.ml regressor over all rows together."""

    def __init__(self, estimator: Estimator):
        self.estimator = estimator

    def fit(self, df, spec, features, target):
        rows = VectorAssembler(inputCols=features, outputCol="_features").transform(complete(df, [*features, target]))
        if rows.isEmpty():
            raise RuntimeError("no row without a missing value to learn from")
        est = self.estimator.copy().setFeaturesCol("_features").setLabelCol(target)
        self.model = est.fit(rows)
        return self

    def predict(self, df, spec, features, tag):
        name = temp(tag, "guess")
        df = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(df)
        df = self.model.setPredictionCol(name).transform(df).drop("_features")
        return df, F.col(name)


class PyModel:
    """A Python object with fit and predict, fitted in one task for each series."""

    def __init__(self, model):
        self.model = model

    def fit(self, df, spec, features, target=None):
        keys, kinds, model = list(spec.keys), dict(df.dtypes), self.model

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(US)
            x = pdf[features].to_numpy(float)
            own = pickle.loads(pickle.dumps(model))
            own.fit(x) if target is None else own.fit(x, pdf[target].to_numpy(float))
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "state": [pickle.dumps(own)]})

        cols = features if target is None else [*features, target]
        rows = complete(df, cols).select(*keys, US, *[f"`{c}`" for c in cols])
        by = keys or [F.lit(1).alias("_one")]
        table = rows.groupBy(*by).applyInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "state binary"]))
        self.params = Params(spec, table, ["state"])
        if not keys and self.params.row is None:
            raise RuntimeError("no row without a missing value to learn from")
        return self

    def predict(self, df, spec, features, tag):
        df, p = self.params.bind(df, f"{tag}py")

        @F.pandas_udf("double")
        def guess(state: pd.Series, *x: pd.Series) -> pd.Series:
            data = np.column_stack([c.to_numpy(float) for c in x])
            out, full = np.full(len(data), np.nan), ~np.isnan(data).any(1)
            for s in state[full].unique():
                at = full & (state == s).to_numpy()
                out[at] = np.asarray(pickle.loads(s).predict(data[at]), float)
            return pd.Series(out)

        return df, clean_double(guess(p["state"], *[F.col(f"`{c}`") for c in features]))


class Pca:
    """Principal axes.  Of each axis' scores, the largest in size is positive, the earliest among equals."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, df: DataFrame, spec: SeriesSpec, cols: list[str]):
        k = self.k

        def solve(r):
            if not r.n:
                return None, None
            cov = _matrix(r.cov) if r.n > 1 else np.zeros((len(cols), len(cols)))
            axes = np.linalg.eigh(cov)[1][:, ::-1].T[:k]
            return list(np.array(r.mean, float)), [list(a) for a in axes]

        table = solved(moments(df, spec, cols), spec, solve, "mean array<double>, axes array<array<double>>")
        raw = Params(spec, table, ["mean", "axes"])
        if not spec.keys and raw.get("mean") is None:
            raise RuntimeError("no row without a missing value to learn from")
        self.params = raw
        rows, scores, _ = self.bind(complete(df, cols), cols, "fit")
        signs = [F.sign(F.max_by(s, F.struct(F.round(F.abs(s), 9), -F.col(US)))) for s in scores]
        sign = Params(spec, aggregate(rows, spec, F.array(*signs).alias("sign")), ["sign"])
        if spec.keys:
            both = table.join(sign.table, list(spec.keys))
        else:
            both = table.crossJoin(F.broadcast(sign.table))  # one row each
        turned = F.transform("axes", lambda a, i: F.transform(a, lambda x: x * F.when(F.get("sign", i) < 0, -1.0).otherwise(1.0)))
        self.params = Params(spec, both.select(*spec.keys, "mean", turned.alias("axes")), ["mean", "axes"])
        return self

    def bind(self, df: DataFrame, cols: list[str], tag: str) -> tuple[DataFrame, list[Column], list[Column]]:
        """df, the scores on the axes, and the columns given back from them."""
        df, p = self.params.bind(df, f"{tag}pca")
        add = lambda parts: reduce(lambda a, b: a + b, parts)
        away = [F.col(f"`{c}`") - p["mean"][j] for j, c in enumerate(cols)]
        scores = [add([p["axes"][i][j] * v for j, v in enumerate(away)]) for i in range(self.k)]
        back = [p["mean"][j] + add([p["axes"][i][j] * scores[i] for i in range(self.k)]) for j in range(len(cols))]
        return df, scores, back
