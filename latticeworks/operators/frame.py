"""The frozen frame: scaling, centroids, basins, and the projection of other records onto it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import percentiles
from ..functions.vectors import distance, mean_vector
from ..session import stage

#: What may be sent to every task as one matrix. Larger sides are taken in slices of this size.
MATRIX_BYTES = 64_000_000


def known(df: DataFrame, community: str = "community") -> DataFrame:
    """Without noise and without rows of no community."""
    return df.where(F.col(community) >= 0)


def split(df: DataFrame, cutoff: int, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Dated rows up to the cutoff, and those after it. Rows without a year are in neither."""
    return df.where(F.col(year) <= cutoff), df.where(F.col(year) > cutoff)


def centroids(df: DataFrame, v: str = "v", community: str = "community", width: int | None = None) -> DataFrame:
    """``community, n, c``: size and mean vector of each community but noise."""
    return mean_vector(known(df, community), [community], v, "c", width)


def member_distances(df: DataFrame, centres: DataFrame, v: str = "v", community: str = "community") -> DataFrame:
    """The rows of communities that have a centroid, with ``d``, their distance to it."""
    return df.join(centres.select(community, "c"), community).withColumn("d", distance(v, "c")).drop("c")


def thresholds(members: DataFrame, percentile: float = 95.0, mode: str = "per_community", community: str = "community") -> DataFrame:
    """``community, threshold``: the percentile of the members' distances, of each community or of all together, with linear
    interpolation. ``members`` comes from ``member_distances``."""
    if mode not in ("per_community", "pooled"):
        raise ValueError("mode is per_community or pooled")
    if mode == "per_community":
        return percentiles(members, "d", [percentile / 100], [community]).select(community, F.col("q")[0].alias("threshold"))
    pooled = percentiles(members, "d", [percentile / 100]).select(F.col("q")[0].alias("threshold"))
    return members.select(community).distinct().crossJoin(F.broadcast(pooled))  # one row


def classify(records: DataFrame, limits: DataFrame, unknown: str = "drop", community: str = "community", d: str = "distance") -> DataFrame:
    """Adds ``threshold`` and ``in_basin``: whether the distance is at most the threshold of the record's community.

    Records whose community has no threshold are dropped, or with ``unknown='frontier'`` kept as outside.
    """
    if unknown not in ("drop", "frontier"):
        raise ValueError("unknown is drop or frontier")
    joined = records.join(limits.select(community, "threshold"), community, "inner" if unknown == "drop" else "left")
    return joined.withColumn("in_basin", F.coalesce(F.col(d) <= F.col("threshold"), F.lit(False)))


def same_partition(a: DataFrame, b: DataFrame, column: str = "partition_id") -> None:
    """Refuses to join assignments of different partitions of the same entities: ids of one mean nothing in the other."""
    if column not in a.columns or column not in b.columns:
        raise ValueError(f"both sides need {column}")
    ids = {r[0] for r in a.select(column).distinct().union(b.select(column).distinct()).distinct().limit(2).collect()}
    if len(ids) > 1:
        raise ValueError(f"records and frame belong to different partitions: {sorted(map(str, ids))}")


def slices(df: DataFrame, v: str, rows_of: int | None = None) -> Iterator[DataFrame]:
    """Parts of df that fit ``MATRIX_BYTES`` as one matrix each; df itself if it fits. The size is counted, not assumed."""
    shape = df.agg(F.count("*").alias("n"), F.max(F.size(v)).alias("w")).first()
    most = rows_of or max(1, MATRIX_BYTES // (8 * max(shape["w"] or 1, 1)))
    parts = -(-shape["n"] // most)
    for k in range(parts):
        yield df if parts == 1 else df.where(F.pmod(F.xxhash64(v), parts) == k)


def _nearest(sent, v_index: int, width: int):
    """Adds the nearest row of a matrix to each record, or takes it instead of what an earlier matrix gave. ``width`` is the
    number of the record's own columns."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids, matrix = sent.value
        squares = (matrix * matrix).sum(1)
        few = min(4, len(ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(v_index).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best, dist = np.empty(len(x), ids.dtype), np.empty(len(x))
            for s in range(0, len(x), 512):
                part = x[s : s + 512]
                near = np.argpartition(squares - 2 * (part @ matrix.T), few - 1, axis=1)[:, :few]
                exact = np.sqrt(((part[:, None, :] - matrix[near]) ** 2).sum(2))
                # the smallest id of equals
                order = np.lexsort((ids[near], exact), axis=1)[:, 0]
                best[s : s + 512] = np.take_along_axis(ids[near], order[:, None], 1)[:, 0]
                dist[s : s + 512] = np.take_along_axis(exact, order[:, None], 1)[:, 0]
            if batch.num_columns > width:
                b, d = batch.column(width).to_numpy(zero_copy_only=False), batch.column(width + 1).to_numpy()
                old = (d < dist) | ((d == dist) & (b < best))
                best, dist = np.where(old, b, best), np.where(old, d, dist)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(best), pa.array(dist)], names=[*batch.schema.names[:width], "_community", "_distance"])

    return run


def nearest_centroid(records: DataFrame, centres: DataFrame, v: str = "v", community: str = "community", out: str = "assigned_community", d: str = "distance") -> DataFrame:
    """Adds to each record the nearest centroid and its distance, ties to the smaller community.

    Centroids travel as one matrix if ``MATRIX_BYTES`` holds them; else slice after slice is compared, each in a pass that keeps
    the better of its own and the earlier result, so that every row stays a row, equal ones too. Records with nulls or NaN in
    ``v`` must be left out before. Without centroids nothing comes out.
    """
    import numpy as np

    key_type = dict(centres.dtypes)[community]
    width, schema = len(records.columns), ", ".join(f"`{n}` {t}" for n, t in records.dtypes) + f", _community {key_type}, _distance double"
    v_index, found = records.columns.index(v), None
    for part in slices(centres, "c"):
        got = part.select(community, "c").orderBy(community).toArrow()
        if not got.num_rows:
            continue
        matrix = np.asarray(got.column(1).combine_chunks().flatten()).reshape(got.num_rows, -1)
        sent = records.sparkSession.sparkContext.broadcast((got.column(0).to_numpy(), matrix))
        # one matrix at a time in a task
        before = records if found is None else stage(found, "nearest")
        found = before.mapInArrow(_nearest(sent, v_index, width), schema)
    if found is None:
        return records.where("false").withColumn(out, F.lit(None).cast(key_type)).withColumn(d, F.lit(None).cast("double"))
    return found.withColumnRenamed("_community", out).withColumnRenamed("_distance", d)


def standard_scaler(df: DataFrame, v: str, width: int) -> DataFrame:
    """One row ``mean, sd``: elementwise mean and population deviation, 0 replaced by 1."""
    cols = [F.avg(F.col(v)[k]).alias(f"m{k}") for k in range(width)] + [F.coalesce(F.nullif(F.stddev_pop(F.col(v)[k]), F.lit(0.0)), F.lit(1.0)).alias(f"s{k}") for k in range(width)]
    return df.agg(*cols).select(F.array(*[f"m{k}" for k in range(width)]).alias("mean"), F.array(*[f"s{k}" for k in range(width)]).alias("sd"))


def scale(df: DataFrame, scaler: DataFrame, v: str) -> DataFrame:
    joined = df.crossJoin(F.broadcast(scaler))  # one row
    centred = F.zip_with(v, "mean", lambda x, m: x - m)
    return joined.withColumn(v, F.zip_with(centred, "sd", lambda x, s: x / s)).drop("mean", "sd")


def fit_pca(df: DataFrame, v: str, k: int):
    """A PCA model of centred vectors; ``apply_pca`` uses it. The covariance is summed in a distributed pass."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    return PCA(k=k, inputCol="_x", outputCol="_y").fit(df.select(array_to_vector(F.col(v)).alias("_x")))


def apply_pca(df: DataFrame, model, v: str, out: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    return model.transform(df.withColumn("_x", array_to_vector(F.col(v)))).withColumn(out, vector_to_array("_y")).drop("_x", "_y")


def frame_at(df: DataFrame, cutoff: int | None = None, percentile: float = 95.0, mode: str = "per_community", v: str = "v", year: str = "year", width: int | None = None) -> DataFrame:
    """``community, n, c, threshold, median, birth_year`` of the rows up to the cutoff: all that projection and scoring need."""
    rows = known(df if cutoff is None else split(df, cutoff, year)[0])
    centres = centroids(rows, v, width=width)
    members = member_distances(rows, centres, v)
    if mode == "per_community":
        both = percentiles(members, "d", [percentile / 100, 0.5], ["community"])
        out = centres.join(both.select("community", F.col("q")[0].alias("threshold"), F.col("q")[1].alias("median")), "community")
    else:
        median = percentiles(members, "d", [0.5], ["community"]).select("community", F.col("q")[0].alias("median"))
        out = centres.join(thresholds(members, percentile, mode), "community").join(median, "community")
    return out.join(rows.groupBy("community").agg(F.min(year).alias("birth_year")), "community")


def projection_summary(projected: DataFrame, by: list[str]) -> DataFrame:
    """Per key: records, how many lie outside every basin, their share and the mean distance."""
    return projected.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum((~F.col("in_basin")).cast("int")).cast("bigint").alias("n_frontier"), F.avg((~F.col("in_basin")).cast("double")).alias("frontier_ratio"), F.avg("distance").alias("mean_distance")
    )


def match_tier(d: Column, threshold: Column, near: float = 0.5) -> Column:
    """How well a record is matched: by an absolute distance, within the basin, within twice its radius, or not."""
    return F.when(d <= near, "VERY HIGH").when(d <= threshold, "HIGH").when(d <= 2 * threshold, "NEAR").otherwise("DISTANT")


def small_community(size: Column, threshold: Column) -> Column:
    """Whether a match deserves a caveat: fewer than 20 members, or a basin narrower than 0.1."""
    return (size < 20) | (threshold < 0.1)
