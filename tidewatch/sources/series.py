"""Reading, validating and writing series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.spec import US, Freq, SeriesSpec, micros, shift
from ..operators.labels import one_hot


def read_csv(spark: SparkSession, path: str, time: str, schema: str, pattern: str | None = None, **options) -> DataFrame:
    """A CSV file of one or more series; the schema is given, so the file is read once."""
    df = spark.read.options(header=True, **options).schema(schema).csv(path)
    stamp = F.to_timestamp(F.col(f"`{time}`"), *([pattern] if pattern else [])).cast("timestamp_ntz")
    return df.withColumn(time, stamp)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    df.write.format(format).mode(mode).partitionBy(*(partition_by or [])).save(path)


def dedupe(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row for each time: the first by the tie-break columns, else by all others."""
    order = list(spec.tiebreak) or [c for c in df.columns if c not in spec.index]
    rest = [c for c in df.columns if c not in spec.index]
    first = F.min_by(F.struct(*[f"`{c}`" for c in rest]), F.struct(*[f"`{c}`" for c in order])).alias("_row")
    got = df.groupBy(*spec.index).agg(first)
    return got.select(*[F.col(c) if c in spec.index else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def infer_freq(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """keys, n and freq_us: the step of each series, null if it is not the same throughout."""
    own = df.withColumn(US, micros(F.col(spec.ts))).select(*spec.keys, US)
    own = own.withColumn("_gap", F.col(US) - F.lag(US).over(spec.window()))
    same = F.when((F.min("_gap") == F.max("_gap")) & (F.count("*") >= 3), F.min("_gap")).alias("freq_us")
    return own.groupBy(*spec.keys).agg(F.count("*").alias("n"), same) if spec.keys else own.agg(F.count("*").alias("n"), same)


def to_grid(df: DataFrame, spec: SeriesSpec, freq: str | Freq | None = None) -> DataFrame:
    """All grid points between a series' first and last time; new rows have null values."""
    step = Freq.parse(freq) if freq else spec.freq
    ends = df.groupBy(*spec.keys) if spec.keys else df.groupBy()
    ends = ends.agg(F.min(spec.ts).alias("_a"), F.max(spec.ts).alias("_b"))
    width = F.make_ym_interval(F.lit(0), F.lit(step.months)) if step.months else F.make_dt_interval(secs=F.lit(step.us / 1e6))
    grid = ends.where("_a is not null").select(*spec.keys, F.explode(F.sequence("_a", "_b", width)).alias(spec.ts))
    return grid.join(df, spec.index, "left").select(df.columns)


def validate_series(df: DataFrame, spec: SeriesSpec, check_freq: bool = True, check_categorical: bool = False) -> tuple[DataFrame, SeriesSpec]:
    """A series without repeated times, its step if it has one, and one-hot columns on demand."""
    out = dedupe(df, spec)
    if check_freq and spec.freq is None:
        row = infer_freq(out, spec).agg(F.min("freq_us").alias("a"), F.max("freq_us").alias("b"), F.count_if(F.col("freq_us").isNull()).alias("none")).first()
        if row["a"] is not None and row["a"] == row["b"] and not row["none"]:
            spec = SeriesSpec(spec.keys, spec.ts, spec.values, Freq(us=row["a"]), spec.tiebreak)
    if check_categorical:
        text = [c for c, t in out.dtypes if c in spec.values and t == "string"]
        before = [c for c in out.columns if c not in spec.index]
        out = one_hot(out, text, prefix=len(before) > 1)
        spec = spec.with_values(*[c for c in out.columns if c not in spec.index])
    return out, spec


__all__ = ["W", "dedupe", "infer_freq", "read_csv", "read_parquet", "shift", "to_grid", "validate_series", "write"]
