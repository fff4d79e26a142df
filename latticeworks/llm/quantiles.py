"""Exact percentiles per group over a distributed sort.

The rows are range-partitioned by group and value and sorted; each partition counts its rows per group; the running sums of
the counts give every partition its offset in each group, so the row at any position of a group is known without moving rows
again. Both neighbours of each wanted position are read in one pass and interpolated. A group of any size spreads over as
many partitions as it needs. The rank error is nil; runs of separate days are merged before the sort, so combining them is
exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

PERCENTS = (10, 25, 50, 75, 90, 95)


def counting(value: str) -> Column:
    """Whether a value counts: a number, finite and not negative."""
    v = F.col(value).cast("double")
    return F.coalesce((v >= 0) & (v < float("inf")), F.lit(False))


def one_per_key(df: DataFrame, group: str, value: str, key: str, when: str | None = None) -> DataFrame:
    """``g, x, k``: one counting value per group and key. Of several that differ the latest counts, then the smallest."""
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & counting(value))
    x = F.col(value).cast("double") + F.lit(0.0)
    rows = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), x.alias("x"), (F.unix_micros(when) if when else F.lit(0)).alias("w"))
    rows = rows.groupBy("g", "k").agg(F.max(F.struct(F.coalesce("w", F.lit(-(2**62))).alias("w"), (-F.col("x")).alias("y"))).alias("m"))
    return rows.select("g", (-F.col("m.y")).alias("x"), "k")


def day_runs(df: DataFrame, group: str, value: str, key: str, when: str) -> DataFrame:
    """``day, g, k, w, x``: what one day contributes, rows without a time as a null day that comes before all. Runs of any days can be
    kept and merged; see ``merge_runs``."""
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & counting(value))
    rows = rows.select(F.to_date(when).alias("day"), F.col(group).alias("g"), F.col(key).alias("k"), F.coalesce(F.unix_micros(when), F.lit(-(2**62))).alias("w"), (F.col(value).cast("double") + F.lit(0.0)).alias("x"))
    rows = rows.groupBy("day", "g", "k").agg(F.max(F.struct("w", (-F.col("x")).alias("y"))).alias("m"))
    return rows.select("day", "g", "k", "m.w", (-F.col("m.y")).alias("x"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """``g, x, k`` of the runs of several days: a key that occurs on several days counts once, with its latest value."""
    rows = runs.groupBy("g", "k").agg(F.max(F.struct("w", (-F.col("x")).alias("y"))).alias("m"))
    return rows.select("g", (-F.col("m.y")).alias("x"), "k")


def _place(batches: Iterator) -> Iterator:
    """Adds to each row of a sorted partition its 1-based place among the rows of its group there."""
    import numpy as np
    import pyarrow as pa

    group, held = None, 0
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        g = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        at = np.arange(1, size + 1) - np.repeat(starts, np.diff(np.append(starts, size)))
        if g[0] == group:
            at[: starts[1] if len(starts) > 1 else size] += held
        group, held = g[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=["g", "x", "part", "at"])


def order_statistics(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """``g, pos, x``: the value at the 1-based position ``pos`` of group ``g``, for each distinct row of ``wanted(g, pos)``.

    ``values`` has ``g`` and ``x``, neither null. Positions outside the group give no row. Equal values are equal in rank order
    whatever their place, so ties need no rule.
    """
    spread, counts = _sorted(values)
    return _pick(spread, counts, wanted.select("g", F.col("pos").cast("bigint").alias("pos")).distinct())


def _sorted(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sorted rows with their place in the partition, written once; a value that most rows share spreads over partitions by
    the key ``k``, where there is one. And ``g, part, before, n, total``: the offset, the number of rows and the group's size for
    each partition and group."""
    kind = dict(values.dtypes)["g"]
    order = ["g", "x", *(["k"] if "k" in values.columns else [])]
    ranged = values.select(*order).repartitionByRange(*order).sortWithinPartitions("g", "x").select("g", "x")
    placed = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_place, f"g {kind}, x double, part int, at bigint")
    spread = stage(placed, "sorted")
    counts = spread.groupBy("g", "part").agg(F.max("at").alias("n"))
    by = Window.partitionBy("g").orderBy("part")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "part", "n", before.alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    return spread, stage(counts, "offsets")


def _pick(spread: DataFrame, counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows at the wanted positions: each falls into one partition of its group and becomes a place there."""
    places = wanted.join(counts, "g").where((F.col("pos") > F.col("before")) & (F.col("pos") <= F.col("before") + F.col("n")))
    places = places.select("g", "part", (F.col("pos") - F.col("before")).alias("at"), "pos")
    return spread.join(places, ["g", "part", "at"]).select("g", "pos", "x")


def percentiles(values: DataFrame, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """``g, pct, n, value``: exact percentiles of ``x`` per ``g``, linear between the two neighbouring order statistics.

    A group of one value gives that value for every percentile; no rows give no rows. Percentiles outside 0 to 100 are refused.
    """
    if any(not 0 <= p <= 100 for p in percents):
        raise ValueError("a percentile lies between 0 and 100")
    spread, counts = _sorted(values)
    groups = counts.groupBy("g").agg(F.max("total").alias("n"))
    at = groups.select("g", "n", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("pct"))
    at = at.withColumn("h", (F.col("n") - 1) * F.col("pct") / 100.0 + 1).withColumn("lo", F.floor("h").cast("bigint"))
    at = at.withColumn("hi", F.least(F.col("lo") + 1, F.col("n")))
    picked = _pick(spread, counts, at.select("g", F.explode(F.array("lo", "hi")).alias("pos")).distinct())
    low, high = picked.select("g", F.col("pos").alias("lo"), F.col("x").alias("x0")), picked.select("g", F.col("pos").alias("hi"), F.col("x").alias("x1"))
    out = at.join(low, ["g", "lo"]).join(high, ["g", "hi"])
    return out.select("g", F.col("pct"), "n", (F.col("x0") + (F.col("h") - F.col("lo")) * (F.col("x1") - F.col("x0"))).alias("value"))


def wrong_thresholds(values: DataFrame, published: DataFrame, slack: float = 0.015) -> DataFrame:
    """``g, pct, threshold`` of the published rows whose share of values at most ``threshold`` is off by more than ``slack``.

    The share exceeds pct/100 + slack exactly if the order statistic behind that many values is still at most the threshold, and
    falls short exactly if the one that completes pct/100 - slack lies above it; so two positions of each row decide it. A
    published row with a null, a repeated one and one whose group has no values are left out or counted once; a NaN threshold
    stands above every value.
    """
    rows = published.where(F.col("g").isNotNull() & F.col("pct").isNotNull() & F.col("threshold").isNotNull()).select("g", "pct", "threshold").distinct()
    spread, counts = _sorted(values)
    rows = rows.join(counts.groupBy("g").agg(F.max("total").alias("n")), "g")
    # shares are counted in thousandths: a position that falls on a whole number stays there
    scale = 100000
    high = F.floor((F.col("pct") * (scale // 100) + round(slack * scale)) * F.col("n") / scale + F.lit(1e-9)).cast("bigint") + 1
    low = F.ceil((F.col("pct") * (scale // 100) - round(slack * scale)) * F.col("n") / scale - F.lit(1e-9)).cast("bigint")
    rows = stage(rows.withColumn("hi", high).withColumn("lo", low), "thresholds")
    picked = _pick(spread, counts, rows.select("g", F.explode(F.array("lo", "hi")).alias("pos")).distinct())
    picked = stage(picked, "picked")
    a = picked.select("g", F.col("pos").alias("lo"), F.col("x").alias("x_lo"))
    b = picked.select("g", F.col("pos").alias("hi"), F.col("x").alias("x_hi"))
    out = rows.join(a, ["g", "lo"], "left").join(b, ["g", "hi"], "left")
    return out.where((F.col("x_hi") <= F.col("threshold")) | (F.col("x_lo") > F.col("threshold"))).select("g", "pct", "threshold")
