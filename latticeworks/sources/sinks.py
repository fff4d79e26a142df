"""Sinks: record files, summaries, failure logs, Markdown tables."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_records(df: DataFrame, path: str, order: list[str] | None = None, partition_by: list[str] = (), fmt: str = "csv") -> None:
    """Writes records with a header, sorted if an order is given. An empty result is written with its schema."""
    out = df.orderBy(*order) if order else df
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinity made null in all floating columns, with ``<column>_infinite`` where infinity was."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            out = out.withColumn(f"{f.name}_infinite", F.coalesce(F.abs(c) == float("inf"), F.lit(False)))
            out = out.withColumn(f.name, F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c))
    return out


def to_json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))


def _plain(x):
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def summary_json(summary: dict, path: str) -> None:
    """A nested summary of a bounded number of figures, as standard JSON: what is not finite becomes null."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(_plain(summary), f, indent=2)


def failure_log(df: DataFrame, ok: str, error: str, key: str, n: int = 500, width: int = 200) -> DataFrame:
    """The first n failures in key order with their message cut."""
    return df.where(~F.col(ok)).select(key, F.substring(error, 1, width).alias(error)).orderBy(key).limit(n)


def markdown(df: DataFrame, n: int = 100) -> str:
    """The first n rows as a Markdown table; df must be ordered."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in df.limit(n).collect())])
