"""Top N items of every group, by a secondary sort that never holds a group.

Each input partition sorts its rows by group, score and item and streams the first N of each group as Arrow batches; only
those rows are exchanged, hash-partitioned by group, sorted and streamed once more. A group that holds a third of all rows
therefore leaves N rows per input partition, and no task keeps more than the N items of the group that it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stream(n: int, width: int):
    """The first n distinct items of each group of batches sorted by group, score and item."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        group, rank, seen = None, 0, set()
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            g, i = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            ends = np.append(starts[1:], size)
            keep, ranks = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if g[s] != group:
                    group, rank, seen = g[s], 0, set()
                at = s
                while rank < n and at < e:
                    item = i[at]
                    if item not in seen:
                        seen.add(item)
                        rank += 1
                        keep.append(at)
                        ranks.append(rank)
                    at += 1
            if keep:
                out = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([out.column(k) for k in range(width)] + [pa.array(ranks, pa.int32())], names=[*out.schema.names[:width], "rk"])

    return run


def top_n(df: DataFrame, group: str, score: str, item: str, n: int = 10) -> DataFrame:
    """``group, score, item, rk``: the n items with the smallest score of each group, ties by the smaller item.

    Rows in which one of the three is null, and scores that are NaN, are left out; an item that occurs several times in a group
    counts once, with its smallest score. Columns besides the three are ignored. A group of fewer than n items gives them all;
    no rows give no rows. ``n`` below 1 is refused.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(item).alias("i"))
    rows = rows.where(F.col("g").isNotNull() & F.col("s").isNotNull() & F.col("i").isNotNull() & ~F.isnan("s"))
    # 0.0 and -0.0 tie
    rows = rows.withColumn("s", F.col("s") + F.lit(0.0))
    kinds = dict(rows.dtypes)
    schema = f"g {kinds['g']}, s double, i {kinds['i']}, rk int"
    order = ["g", "s", "i"]
    local = rows.sortWithinPartitions(*order).mapInArrow(_stream(n, 3), schema).drop("rk")
    best = local.repartition("g").sortWithinPartitions(*order).mapInArrow(_stream(n, 3), schema)
    names = {"g": group, "s": score, "i": item}
    return best.select(*[F.col(k).alias(v) for k, v in names.items()], "rk")


def nearest_members(events: DataFrame, n: int = 10) -> DataFrame:
    """The n records closest to the centroid of each community but noise; a distance counts if finite and not negative."""
    d = F.col("distance_to_centroid").cast("double")
    rows = events.where((F.col("community") >= 0) & (d >= 0) & (d < float("inf")))
    return top_n(rows, "community", "distance_to_centroid", "icsd_id", n)
