"""Arithmetic of ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def scaled(v: Column | str, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def no_nan(v: Column | str) -> Column:
    """Whether an array has neither null nor NaN elements."""
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def mean_vector(df: DataFrame, by: list[str], v: str, out: str = "c", width: int | None = None) -> DataFrame:
    """The mean vector and number of rows per key: ``by, n, out``.

    With a known width each element is an aggregate of its own, summed before the exchange and in generated code; without it
    elements are exploded with their place.
    """
    if width:
        means = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(v)[k]).alias(f"_m{k}") for k in range(width)])
        return means.select(*by, "n", F.array(*[f"_m{k}" for k in range(width)]).alias(out))
    parts = df.select(*by, F.posexplode(v).alias("_k", "_x")).groupBy(*by, "_k").agg(F.avg("_x").alias("_m"), F.count("*").alias("n"))
    return parts.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda s: s["_m"]).alias(out))


def gaussian(d: Column, sigma: Column) -> Column:
    return F.exp(-F.pow(d / sigma, 2))
