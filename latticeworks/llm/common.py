"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep_staged, shared_dir, stage, staging

__all__ = ["VECTOR_WIDTH", "as_lists", "distinct_vectors", "is_vector", "keep_staged", "matrix", "shared_dir", "stage", "staging", "table"]

VECTOR_WIDTH = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_vector(v: str, width: int = VECTOR_WIDTH):
    """Whether column ``v`` holds ``width`` finite elements; a null array, a null element, NaN and infinity do not count."""
    bound = F.lit(float("inf"))
    ok = F.forall(v, lambda x: F.coalesce((x < bound) & (x > -bound), F.lit(False)))
    return F.coalesce((F.size(v) == width) & ok, F.lit(False))


def matrix(column, width: int = VECTOR_WIDTH):
    """The rows of an Arrow column of equally long lists as a float32 matrix."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, width)


def as_lists(values, rows: int):
    """A matrix as an Arrow column of lists."""
    import numpy as np
    import pyarrow as pa

    values = np.ascontiguousarray(values)
    width = values.shape[1] if values.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def drawn(rows: DataFrame, key: str, vector: str, most: int, total: int, seed: int):
    """About ``most`` vectors (all of fewer) as a matrix, drawn by a hash of ``key``, so that the same rows give the same sample."""
    part = rows if total <= most else rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**31)) < int(2**31 * most / total))
    return matrix(part.sort(key).select(vector).toArrow().column(0))


def distinct_vectors(df: DataFrame, key: str, vector: str, order: str, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors, ``rep, copies, v``, and the keys of classes of several, ``id, rep``.

    A key with several vectors keeps the one with the smallest ``order`` (a null order last; of equal orders either). Of ``among``,
    a frame of one column, only keys in it take part. ``rep`` is the smallest key of a
    class and ``copies`` its size, so a later stage works on classes and a vector held by a third of all keys costs no more than
    any other. Vectors are told apart by 128 bits of hashes; counts and minima are made before anything is exchanged. Null keys
    and rows without a valid vector are left out, other columns are ignored, no rows give no classes.
    """
    rows = df.where(F.col(key).isNotNull() & is_vector(vector)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.coalesce(F.col(order).cast("bigint"), F.lit(2**62)).alias("o"))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float"))).withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))
    # the two take the same row: they compare the same orders in turn
    ids = rows.groupBy("id").agg(F.min_by("h", "o").alias("h"), F.min_by("g", "o").alias("g"))
    if among is not None:
        ids = ids.join(among.select(F.col(among.columns[0]).cast("bigint").alias("id")), "id", "left_semi")
    ids = stage(ids, "ids")
    sizes = ids.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").cast("int").alias("copies"))
    vectors = rows.select("h", "g", "v").dropDuplicates(["h", "g"])
    classes = stage(sizes.join(vectors, ["h", "g"]), "classes")
    shared = classes.where("copies > 1").select("h", "g", "rep")
    return classes.select("rep", "copies", "v"), stage(ids.join(shared, ["h", "g"]).select("id", "rep"), "several")
