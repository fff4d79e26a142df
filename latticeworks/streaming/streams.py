"""Operators on streams of dated records. All take a streaming or a static DataFrame, so a batch run checks a stream.

Late data: each takes how late a record may come; what comes later is dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..session import place


def project(stream: DataFrame, frame: DataFrame, v: str = "v") -> DataFrame:
    """T-01: adds the nearest community of the frozen frame, the distance and whether the record lies in its basin.

    Stateless. The frame is of ``frame.frame_at``; it is sent to the tasks as one array after its size is checked.
    """
    from ..operators.frame import MATRIX_BYTES

    rows = frame.select("community", "c", "threshold")
    size = rows.agg(F.sum(F.size("c") * 8)).first()[0] or 0
    if size > MATRIX_BYTES:
        raise ValueError("the frame is too large for one array; project micro-batches with foreachBatch and nearest_centroid")
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("community", "c", "threshold"))).alias("_f"))
    near = F.array_min(F.transform("_f", lambda s: F.struct(distance(v, s["c"]).alias("distance"), s["community"].alias("community"), s["threshold"].alias("threshold"))))
    out = stream.crossJoin(F.broadcast(whole)).withColumn("_n", near)  # one row, checked above
    return out.withColumn("assigned_community", F.col("_n.community")).withColumn("distance", F.col("_n.distance")).withColumn("in_basin", F.col("_n.distance") <= F.col("_n.threshold")).drop("_f", "_n")


def windowed_rate(stream: DataFrame, time: str, flag: Column, size: str, slide: str | None = None, late: str = "1 hour", by: list[str] = ()) -> DataFrame:
    """T-02: ``start, end, by, n, k, rate`` of a flag in tumbling or sliding windows."""
    win = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(win.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(flag.cast("int")).cast("bigint").alias("k"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "k", (F.col("k") / F.col("n")).alias("rate"))


def births(stream: DataFrame, key: str, time: str, ident: str) -> DataFrame:
    """T-03: ``key, ts, id``: the first event of each key, by time, then id. In a stream, in update mode, a key is reported again
    if an earlier event comes late; the last report holds. The state is one event a key."""
    rows = stream.select(F.col(key).cast("bigint").alias("key"), F.col(time).alias("ts"), F.col(ident).cast("bigint").alias("id"))
    return rows.groupBy("key").agg(F.min(F.struct("ts", "id")).alias("s")).select("key", "s.ts", "s.id")


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first arrival of each key within the allowed delay, without other state than the keys."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def bursts(stream: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """T-04: ``key, start, end, n``: runs of events of one key with no pause longer than the gap."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available and gives the result as a table: all that was appended or updated, or in complete
    mode what the last batch held. Batches go to the shared folder, each under its number, so one that is repeated takes its own
    place again; nothing passes through the driver."""
    spark = df.sparkSession
    path, state = place(spark, name), place(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], df.schema)
    out = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, batch bigint").parquet(path)
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch")  # one row
    return out.select(*df.columns)
