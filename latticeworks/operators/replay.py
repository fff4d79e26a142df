"""Replaying history: records enter in order of their year and are classed by what they find.

The graph is that of all records. What a record finds are its neighbours that came before it, which an inequality of places in
the order says; there is no sequential scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import decade
from ..functions.stats import percentiles
from .frame import centroids, member_distances
from .graph import both_ways

COUNTS = ["outlier", "cluster_birth_point", "existing_cluster", "same_community_attachment", "cross_community_attachment", "bridge_attachment", "core_attachment", "periphery_attachment"]


def earlier(a: str, b: str, key: str = "key", year: str = "year"):
    """Whether the record of side a entered before that of side b: by year, those without one last, then by key."""
    ya, yb = F.col(f"{a}.{year}"), F.col(f"{b}.{year}")
    ka, kb = F.col(f"{a}.{key}"), F.col(f"{b}.{key}")
    return F.coalesce(ya < yb, F.lit(False)) | (ya.isNotNull() & yb.isNull()) | (ya.eqNullSafe(yb) & (ka < kb))


def replay(df: DataFrame, edges: DataFrame, key: str, v: str = "v", width: int | None = None) -> DataFrame:
    """The event of each record: ``key, year, decade, community, event_type, n_active_neighbors,
    n_active_same_community_neighbors, n_active_other_communities, is_bridge_attachment, distance_to_centroid, core_threshold,
    core_periphery``; the last three null for noise. The core threshold is the median distance of the community's members."""
    rows = df.select(F.col(key).alias("key"), "year", "community", v)
    short = rows.select("key", "year", "community")
    pairs = both_ways(edges.select("src", "dst")).alias("e").join(short.alias("n"), F.col("e.a") == F.col("n.key")).join(short.alias("m"), F.col("e.b") == F.col("m.key"))
    active = pairs.where(earlier("m", "n"))
    same = (F.col("n.community") >= 0) & (F.col("m.community") == F.col("n.community"))
    other = F.when((F.col("m.community") >= 0) & (F.col("m.community") != F.col("n.community")), F.col("m.community"))
    met = active.groupBy(F.col("n.key").alias("key")).agg(F.count("*").alias("na"), F.sum(same.cast("int")).alias("ns"), F.count_distinct(other).alias("no"))
    members = member_distances(rows, centroids(rows, v, width=width), v).select("key", "community", "d")
    medians = percentiles(members, "d", [0.5], ["community"]).select("community", F.col("q")[0].alias("core_threshold"))
    births = rows.where((F.col("community") >= 0) & F.col("year").isNotNull()).groupBy("community").agg(F.min("year").alias("birth"))
    out = short.join(met, "key", "left").join(members.select("key", "d"), "key", "left").join(medians, "community", "left").join(births, "community", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    event = F.when(F.col("community") < 0, "outlier").when(F.col("year") == F.col("birth"), "community_birth").otherwise("existing_community")
    return out.select(
        F.col("key").alias(key), "year", decade(F.col("year")).alias("decade"), "community", event.alias("event_type"), count("na").alias("n_active_neighbors"),
        count("ns").alias("n_active_same_community_neighbors"), count("no").alias("n_active_other_communities"), (count("no") >= 2).alias("is_bridge_attachment"),
        F.col("d").alias("distance_to_centroid"), F.when(F.col("d").isNotNull(), F.col("core_threshold")).alias("core_threshold"),
        F.when(F.col("d") <= F.col("core_threshold"), "core").when(F.col("d").isNotNull(), "periphery").alias("core_periphery"),
    )


def decades(events: DataFrame) -> DataFrame:
    """``decade, n_total``, the eight counts ``n_...`` and their shares ``..._ratio``. The counts overlap."""
    inside = F.col("community") >= 0
    flags = {
        "outlier": ~inside, "cluster_birth_point": F.col("event_type") == "community_birth", "existing_cluster": F.col("event_type") == "existing_community",
        "same_community_attachment": inside & (F.col("n_active_same_community_neighbors") > 0), "cross_community_attachment": inside & (F.col("n_active_other_communities") > 0),
        "bridge_attachment": inside & F.col("is_bridge_attachment"), "core_attachment": F.coalesce(F.col("core_periphery") == "core", F.lit(False)),
        "periphery_attachment": F.coalesce(F.col("core_periphery") == "periphery", F.lit(False)),
    }
    out = events.groupBy("decade").agg(F.count("*").alias("n_total"), *[F.sum(flags[n].cast("int")).cast("bigint").alias(f"n_{n}") for n in COUNTS])
    return out.select("*", *[(F.col(f"n_{n}") / F.col("n_total")).alias(f"{n}_ratio") for n in COUNTS])


def growth(df: DataFrame, top: int) -> DataFrame:
    """``community, decade, cumulative_size``: for the largest communities (ties by the smaller id) and every decade that any
    record has, how many members there are by then. Records without a year are not counted."""
    inside = df.where(F.col("community") >= 0)
    largest = inside.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(top)
    dated = df.where(F.col("year").isNotNull())
    all_decades = dated.select(decade(F.col("year")).alias("decade")).distinct()
    grid = largest.select("community").crossJoin(F.broadcast(all_decades))  # tens of decades
    counts = dated.join(F.broadcast(largest.select("community")), "community", "left_semi").groupBy("community", decade(F.col("year")).alias("decade")).agg(F.count("*").alias("n"))
    filled = grid.join(counts, ["community", "decade"], "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("community").orderBy("decade").rowsBetween(Window.unboundedPreceding, 0))
    return filled.select("community", "decade", running.cast("bigint").alias("cumulative_size"))


def shares(decade_table: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen counts of each decade as parts that sum to 1, one row per part: ``decade, part, share``."""
    parts = decade_table.select("decade", F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("double").alias("n")) for c in columns])).alias("s")).select("decade", "s.part", "s.n")
    total = F.sum("n").over(Window.partitionBy("decade"))
    return parts.select("decade", "part", F.coalesce(F.col("n") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("share"))
