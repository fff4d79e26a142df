"""Statistics as column expressions and small aggregations. Undefined results are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of k in n; null for n = 0."""
    size = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / size
    middle, spread = p + z * z / (2 * size), z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    return (middle - spread) / (1 + z * z / size), (middle + spread) / (1 + z * z / size)


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def stdev_floor(x: Column, population: bool = False) -> Column:
    """Standard deviation, 1 where it is 0 or undefined."""
    return F.coalesce(F.nullif(F.stddev_pop(x) if population else F.stddev_samp(x), F.lit(0.0)), F.lit(1.0))


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return F.coalesce((x - mean) / F.nullif(sd, F.lit(0.0)), F.lit(0.0))


def accessibility(distance: Column, threshold: Column, size: Column, age: Column, alpha: float | Column = 0.5, beta: float | Column = 0.5, floor: float = 1e-6) -> Column:
    """How far a record lies from what was known, less what a large and an old community make up for."""
    alpha, beta = (x if isinstance(x, Column) else F.lit(x) for x in (alpha, beta))
    return F.log1p(distance / F.greatest(threshold, F.lit(floor))) - alpha * F.log1p(size) - beta * F.log1p(F.greatest(age.cast("double"), F.lit(0.0)))


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns in a group; null for fewer than two rows or no spread."""
    return F.when((F.count(F.col(x) + F.col(y)) > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


#: Rows up to which an aggregation may hold all values of a group in its buffer.
BUFFER_ROWS = 4_000_000


def percentiles(df: DataFrame, value: str, ps: list[float], by: list[str] = (), out: str = "q") -> DataFrame:
    """``by..., out``: the exact percentiles ``ps`` of ``value``, an array in their order, linear between neighbours; nulls do not
    count. Rows are counted first: few go through one aggregation, of more the distinct values are sorted in range partitions and
    positions are found by offsets, so that a group of any size spreads over partitions."""
    if df.count() <= BUFFER_ROWS:
        return df.groupBy(*by).agg(F.percentile(value, ps).alias(out))
    return _sorted_percentiles(df, value, ps, list(by), out)


def _sorted_percentiles(df: DataFrame, value: str, ps: list[float], by: list[str], out: str) -> DataFrame:
    from ..session import stage

    names = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    keys = [F.col(b).alias(n) for b, n in zip(by, names, strict=True)] if by else [F.lit(0).alias("_k0")]
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    counts = rows.groupBy(*names, "_x").agg(F.count("*").alias("_n"))
    ranged = stage(counts.repartitionByRange(*names, "_x").withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(*names, "_part").agg(F.sum("_n").alias("_s"))
    along = Window.partitionBy(*names).orderBy("_part")
    parts = parts.withColumn("_before", F.sum("_s").over(along) - F.col("_s")).withColumn("_total", F.sum("_s").over(Window.partitionBy(*names)))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*names, "_part").orderBy("_x"))
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in [*names, "_part"]]
    condition = same[0]
    for c in same[1:]:
        condition &= c
    placed = ranged.alias("a").join(parts.alias("b"), condition).select(*[F.col(f"a.{n}").alias(n) for n in [*names, "_part"]], "_x", "_n", "_before", "_total").withColumn("_upto", upto)
    found = []
    for i, p in enumerate(ps):
        at = (F.col("_total") - 1) * F.lit(float(p)) + 1
        for name, pos in ((f"_l{i}", F.floor(at)), (f"_h{i}", F.least(F.floor(at) + 1, F.col("_total")))):
            found.append(F.max(F.when((F.col("_upto") - F.col("_n") < pos) & (pos <= F.col("_upto")), F.col("_x"))).alias(name))
    got = placed.groupBy(*names).agg(F.max("_total").alias("_total"), *found)
    rest = lambda p: (F.col("_total") - 1) * F.lit(float(p)) + 1 - F.floor((F.col("_total") - 1) * F.lit(float(p)) + 1)
    values = [F.col(f"_l{i}") + rest(p) * (F.col(f"_h{i}") - F.col(f"_l{i}")) for i, p in enumerate(ps)]
    return got.select(*[F.col(n).alias(b) for b, n in zip(by, names, strict=False)], F.array(*values).alias(out))


def average_rank(df: DataFrame, x: str, out: str, by: list[str] = ()) -> DataFrame:
    """Adds the rank of x, ties sharing the mean of their ranks.

    Without ``by`` the ranks run over all rows. They come from the counts of distinct values, whose running sum is the only
    thing that is ordered globally, so the rows themselves are never sorted in one task.
    """
    if by:
        w = Window.partitionBy(*by)
        rank = F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)
        return df.withColumn(out, rank.cast("double"))
    counts = df.groupBy(x).agg(F.count("*").alias("_n"))
    ranks = running_total(counts, x, "_n", "_upto").select(x, (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).cast("double").alias(out))
    return df.join(ranks.withColumnRenamed(x, "_x"), F.col(x).eqNullSafe(F.col("_x"))).drop("_x")


def running_total(df: DataFrame, order: str, value: str, out: str, buckets: int = 32) -> DataFrame:
    """Adds the running sum of ``value`` in the order of the distinct numeric column ``order``.

    Rows fall into buckets of about equal size between approximate quantiles; the sums of the buckets are added up first, then
    the rows within each, so no task orders all rows.
    """
    edges = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))))
    bucket = sum((F.when(F.col(order) > e, 1).otherwise(0) for e in edges), F.lit(0)) if edges else F.lit(0)
    rows = df.withColumn("_b", bucket)
    sums = rows.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # one row per bucket
    return rows.join(F.broadcast(before), "_b").withColumn(out, F.col("_before") + inner).drop("_b", "_before")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, rho``: Pearson correlation of the average ranks of rows in which neither is null."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_rank(average_rank(rows, x, "_rx"), y, "_ry")
    return ranked.agg(F.count("*").alias("n"), pearson("_rx", "_ry").alias("rho"))


def ks_distance(df: DataFrame, x: str, group: str) -> DataFrame:
    """One row ``n0, n1, ks``: the largest distance of the distribution functions of x in group 0 (false) and 1 (true)."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.sum(F.when(F.col(group), 0).otherwise(1)).alias("a"), F.sum(F.when(F.col(group), 1).otherwise(0)).alias("b"))
    upto = running_total(running_total(counts, x, "a", "ca"), x, "b", "cb")
    total = counts.agg(F.sum("a").alias("n0"), F.sum("b").alias("n1"))
    gap = F.abs(F.col("ca") / F.nullif(F.col("n0").cast("double"), F.lit(0.0)) - F.col("cb") / F.nullif(F.col("n1").cast("double"), F.lit(0.0)))
    return upto.crossJoin(F.broadcast(total)).groupBy("n0", "n1").agg(F.max(gap).alias("ks"))


def log2_enrichment(hits: Column, size: Column, other_hits: Column, other_size: Column) -> Column:
    """log2 of the ratio of two shares, one added to each count and two to each size."""
    return F.log2(((hits + 1) / (size + F.lit(2.0))) / ((other_hits + 1) / (other_size + F.lit(2.0))))


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Shannon entropy in nats of the counts of each key: ``by, total, entropy``."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*by))
    return counts.where(F.col(n) > 0).withColumn("_p", p).groupBy(*by).agg(F.sum(n).alias("total"), (-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"))


def bootstrap(df: DataFrame, by: list[str], flag: str, replicas: int = 1000, seed: int = 7) -> DataFrame:
    """Percentile interval of the share of ``flag`` per key, over binomial resamples of its count: ``by, n, k, low, high``.

    Resampling 0/1 rows with replacement only moves the number of ones, so each key draws that number ``replicas`` times; rows
    are counted once and never copied. One row gives the point, none no row.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("int")).alias("k"))
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*counts.schema.fields, StructField("low", DoubleType()), StructField("high", DoubleType())])

    def draw(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, k = batch.column(len(by)).to_numpy(), batch.column(len(by) + 1).to_numpy()
            keys = zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True)
            low, high = [], []
            for key, size, ones in zip(keys, n, k, strict=True):
                means = np.random.default_rng([seed, zlib.crc32(repr(key).encode())]).binomial(size, ones / size, replicas) / size
                a, b = np.percentile(means, [2.5, 97.5])
                low.append(a)
                high.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.float64()), pa.array(high, pa.float64())], names=schema.names)

    return counts.mapInArrow(draw, schema)


def permuted(df: DataFrame, key: str, value: str, replicas: int, seed: int = 0) -> DataFrame:
    """``replica, key, value``: in each replica the values dealt anew to the keys, which are distinct numbers.

    The i-th key in the order of the replica's hash gets the i-th value in key order. Rows of each replica are numbered in
    buckets of the hash, whose counts are added up first, so a replica is not ordered by one task.
    """
    from ..operators.tables import row_numbers

    buckets = 64
    ordered = row_numbers(df.select(key, value), [key], "_i")
    copies = ordered.select(key).crossJoin(F.broadcast(df.sparkSession.range(replicas).withColumnRenamed("id", "replica")))
    copies = copies.withColumn("_h", F.xxhash64(key, "replica", F.lit(seed))).withColumn("_b", F.floor(F.col("_h") / F.lit(2.0**63) * (buckets // 2)).cast("int"))
    counts = copies.groupBy("replica", "_b").agg(F.count("*").alias("_n"))
    before = counts.select("replica", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("replica").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    dealt = copies.join(before, ["replica", "_b"]).withColumn("_j", F.col("_before") + F.row_number().over(Window.partitionBy("replica", "_b").orderBy("_h", key)))
    values = ordered.select(F.col("_i").alias("_j"), F.col(value).alias("_v"))
    return dealt.join(values, "_j").select("replica", key, F.col("_v").alias(value))
