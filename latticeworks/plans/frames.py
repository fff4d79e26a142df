"""Queries on basins, projection and held-out rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import frame, scoring, tables
from . import fixtures as fx
from .fixtures import r6

PERCENTS = [50.0, 55.0, 60.0, 65.0, 70.0, 75.0, 80.0, 85.0, 90.0, 95.0, 99.0]
CUTOFF = 2000


def heldout(spark, sf_dir, cutoff=CUTOFF):
    rows = fx.entity(spark, sf_dir)
    train, late = frame.split(rows, cutoff)
    at = frame.frame_at(train, width=fx.WIDTH)
    probe = late.select("vec_id", "year", F.col("w").alias("v"))
    placed = frame.nearest_centroid(probe, at, "v", "community", "community")
    return frame.classify(placed, at), at


def heldout_basin_rate_wilson(spark, sf_dir):
    """Share of held-out records within the basin of their nearest community, by community, with its interval."""
    placed, _ = heldout(spark, sf_dir)
    out = placed.groupBy("community").agg(F.count("*").alias("n"), F.sum(F.col("in_basin").cast("int")).cast("bigint").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return out.select("community", "n", "k", r6(F.col("k") / F.col("n")).alias("rate"), r6(low).alias("low"), r6(high).alias("high"))


def _members(spark, sf_dir):
    rows = fx.entity(spark, sf_dir)
    return frame.member_distances(frame.known(rows), frame.centroids(rows, width=fx.WIDTH))


def basin_thresholds_per_community(spark, sf_dir):
    return frame.thresholds(_members(spark, sf_dir)).select("community", r6("threshold").alias("threshold"))


def basin_thresholds_pooled(spark, sf_dir):
    return frame.thresholds(_members(spark, sf_dir), mode="pooled").select("community", r6("threshold").alias("threshold"))


def core_medians(spark, sf_dir):
    return _members(spark, sf_dir).groupBy("community").agg(F.count("*").alias("n"), r6(F.median("d")).alias("median"))


def community_centroids(spark, sf_dir):
    c = frame.centroids(fx.entity(spark, sf_dir), width=fx.WIDTH)
    return c.select("community", "n", F.posexplode("c").alias("k", "e")).select("community", "n", F.col("k").cast("bigint").alias("k"), r6("e").alias("e"))


def projected(spark, sf_dir):
    at = frame.frame_at(fx.frame_rows(spark, sf_dir), width=fx.WIDTH)
    probe = fx.external(spark, sf_dir).select("vec_id", "source", F.col("w").alias("v"))
    return frame.nearest_centroid(probe, at), at


def nearest_centroid_assign(spark, sf_dir):
    placed, _ = projected(spark, sf_dir)
    return placed.select("vec_id", "source", "assigned_community", r6("distance").alias("distance"))


def projection_summary(spark, sf_dir):
    placed, at = projected(spark, sf_dir)
    out = frame.projection_summary(frame.classify(placed.withColumnRenamed("assigned_community", "community"), at), ["source"])
    return out.select("source", "n", "n_frontier", r6("frontier_ratio").alias("frontier_ratio"), r6("mean_distance").alias("mean_distance"))


def _unknown(spark, sf_dir, policy):
    placed, at = projected(spark, sf_dir)
    limits = at.where(F.col("community") % 3 != 0)
    out = frame.classify(placed.withColumnRenamed("assigned_community", "community"), limits, policy)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.sum((~F.col("in_basin")).cast("int")).cast("bigint").alias("n_frontier"))


def unknown_community_dropped(spark, sf_dir):
    return _unknown(spark, sf_dir, "drop")


def unknown_community_frontier(spark, sf_dir):
    return _unknown(spark, sf_dir, "frontier")


def top_assigned_communities(spark, sf_dir):
    placed, _ = projected(spark, sf_dir)
    out = tables.top_values(placed, ["source"], "assigned_community", 3)
    return out.select("source", "assigned_community", "n", F.col("rk").cast("bigint").alias("rk"))


def match_tiers(spark, sf_dir):
    placed, at = projected(spark, sf_dir)
    out = placed.withColumnRenamed("assigned_community", "community").join(at.select("community", "threshold", F.col("n").alias("size")), "community")
    return out.groupBy(frame.match_tier(F.col("distance"), F.col("threshold")).alias("tier"), frame.small_community(F.col("size"), F.col("threshold")).alias("caveat")).agg(F.count("*").alias("n"))


def threshold_sweep(spark, sf_dir):
    rows = fx.entity(spark, sf_dir)
    train, late = frame.split(rows, CUTOFF)
    train = frame.known(train)
    centres = frame.centroids(train, width=fx.WIDTH)
    members = frame.member_distances(train, centres)
    placed = frame.nearest_centroid(late.select("vec_id", F.col("w").alias("v")), centres, out="community")
    return scoring.threshold_sweep(members, placed, PERCENTS).select("pct", "n", "k", r6("rate").alias("rate"))


def standard_scaled(spark, sf_dir):
    rows = fx.entity(spark, sf_dir).select("vec_id", "v")
    out = frame.scale(rows, frame.standard_scaler(rows, "v", fx.WIDTH), "v")
    return out.select("vec_id", r6(F.col("v")[0]).alias("first"), r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square"))


def pca_distances(spark, sf_dir):
    """Distances between consecutive records after a rotation onto all axes, which leaves them as they were."""
    rows = fx.entity(spark, sf_dir).select("vec_id", "v")
    model = frame.fit_pca(rows, "v", fx.WIDTH)
    y = frame.apply_pca(rows, model, "v", "y").select("vec_id", "y")
    other = y.select((F.col("vec_id") - 1).alias("vec_id"), F.col("y").alias("z"))
    from ..functions.vectors import distance

    return y.join(other, "vec_id").select("vec_id", F.round(distance("y", "z"), 5).alias("distance"))


def frame_by_cutoff(spark, sf_dir):
    """Birth year, size and threshold of the frame at three cutoffs, as one table keyed by cutoff."""
    rows, out = fx.entity(spark, sf_dir), None
    for cutoff in (1990, 2000, 2010):
        one = frame.frame_at(rows, cutoff, width=fx.WIDTH).select(F.lit(cutoff).cast("bigint").alias("cutoff"), "community", "n", "birth_year", r6("threshold").alias("threshold"), r6("median").alias("median"))
        out = one if out is None else out.unionByName(one)
    return out


def spatial_trim(spark, sf_dir):
    rows = fx.entity(spark, sf_dir).select("vec_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return tables.trim_window(rows, "x", "y", 0.05).select("vec_id")


_E = fx.ENTITY
_BASE = [_E, fx.centres("fx_entity"), fx.members("fx_entity")]
_TRAIN = [_E, f"train AS (SELECT * FROM fx_entity WHERE year <= {CUTOFF} AND community >= 0)", fx.centres("train"), fx.members("train"), f"late AS (SELECT vec_id, year, w FROM fx_entity WHERE year > {CUTOFF})"]
_PLACED = [_E, fx.EXTERNAL, fx.centres("fx_frame"), fx.members("fx_frame"), "lim AS (SELECT community, quantile_cont(d, 0.95) AS threshold, count(*) AS size FROM members GROUP BY community)", fx.nearest("fx_external", "centres", "w")]
_low, _high = fx.wilson("k", "n")

SQL = {
    "heldout_basin_rate_wilson": fx.sql(*_TRAIN, "lim AS (SELECT community, quantile_cont(d, 0.95) AS threshold FROM members GROUP BY community)", fx.nearest("late", "centres", "w"),
        "c AS (SELECT assigned_community AS community, count(*) AS n, sum((distance <= threshold)::INT)::BIGINT AS k FROM projected p JOIN lim l ON p.assigned_community = l.community GROUP BY 1)",
        select=f"SELECT community, n, k, round(k / n, 6) + 0 AS rate, round({_low}, 6) + 0 AS low, round({_high}, 6) + 0 AS high FROM c"),
    "basin_thresholds_per_community": fx.sql(*_BASE, select="SELECT community, round(quantile_cont(d, 0.95), 6) AS threshold FROM members GROUP BY community"),
    "basin_thresholds_pooled": fx.sql(*_BASE, select="SELECT DISTINCT community, round((SELECT quantile_cont(d, 0.95) FROM members), 6) AS threshold FROM members"),
    "core_medians": fx.sql(*_BASE, select="SELECT community, count(*) AS n, round(median(d), 6) AS median FROM members GROUP BY community"),
    "community_centroids": fx.sql(_E, fx.centres("fx_entity"), select="SELECT community, n, (generate_subscripts(c, 1) - 1)::BIGINT AS k, round(unnest(c), 6) + 0 AS e FROM centres"),
    "nearest_centroid_assign": fx.sql(*_PLACED, select="SELECT vec_id, source, assigned_community, round(distance, 6) AS distance FROM projected"),
    "projection_summary": fx.sql(*_PLACED, select="SELECT source, count(*) AS n, sum((distance > threshold)::INT)::BIGINT AS n_frontier, round(avg((distance > threshold)::INT::DOUBLE), 6) AS frontier_ratio, round(avg(distance), 6) AS mean_distance FROM projected p JOIN lim l ON p.assigned_community = l.community GROUP BY source"),
    "unknown_community_dropped": fx.sql(*_PLACED, select="SELECT source, count(*) AS n, sum((distance > threshold)::INT)::BIGINT AS n_frontier FROM projected p JOIN lim l ON p.assigned_community = l.community WHERE l.community % 3 <> 0 GROUP BY source"),
    "unknown_community_frontier": fx.sql(*_PLACED, select="SELECT source, count(*) AS n, sum((NOT coalesce(distance <= threshold, false))::INT)::BIGINT AS n_frontier FROM projected p LEFT JOIN (SELECT * FROM lim WHERE community % 3 <> 0) l ON p.assigned_community = l.community GROUP BY source"),
    "top_assigned_communities": fx.sql(*_PLACED, select="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, assigned_community) AS rk FROM (SELECT source, assigned_community, count(*) AS n FROM projected GROUP BY source, assigned_community)) WHERE rk <= 3"),
    "match_tiers": fx.sql(*_PLACED, select="SELECT CASE WHEN distance <= 0.5 THEN 'VERY HIGH' WHEN distance <= threshold THEN 'HIGH' WHEN distance <= 2 * threshold THEN 'NEAR' ELSE 'DISTANT' END AS tier, (size < 20 OR threshold < 0.1) AS caveat, count(*) AS n FROM projected p JOIN lim l ON p.assigned_community = l.community GROUP BY ALL"),
    "threshold_sweep": fx.sql(*_TRAIN, f"pc AS (SELECT unnest({PERCENTS}::DOUBLE[]) AS pct)", "cut AS (SELECT community, pct, s[floor(h)::INT + 1] + (h - floor(h)) * (s[least(floor(h)::INT + 2, len(s))] - s[floor(h)::INT + 1]) AS t FROM (SELECT community, pct, s, (len(s) - 1) * pct / 100 AS h FROM (SELECT community, list(d ORDER BY d) AS s FROM members GROUP BY community), pc))",
        fx.nearest("late", "centres", "w"), select="SELECT pct, count(*) AS n, sum((distance <= t)::INT)::BIGINT AS k, round(avg((distance <= t)::INT::DOUBLE), 6) AS rate FROM projected p JOIN cut c ON p.assigned_community = c.community GROUP BY pct"),
    "standard_scaled": fx.sql(_E, "x AS (SELECT vec_id, generate_subscripts(v, 1) AS k, unnest(v) AS e FROM fx_entity)", "m AS (SELECT k, avg(e) AS mean, CASE WHEN stddev_pop(e) > 0 THEN stddev_pop(e) ELSE 1 END AS sd FROM x GROUP BY k)",
        select="SELECT vec_id, round(sum(CASE WHEN k = 1 THEN (e - mean) / sd ELSE 0 END), 6) + 0 AS first, round(sum(power((e - mean) / sd, 2)), 6) AS square FROM x JOIN m USING (k) GROUP BY vec_id"),
    "pca_distances": fx.sql(_E, select="SELECT a.vec_id, round(list_distance(a.v, b.v), 5) AS distance FROM fx_entity a JOIN fx_entity b ON b.vec_id = a.vec_id + 1"),
    "spatial_trim": fx.sql(_E, "p AS (SELECT vec_id, v[1] AS x, v[2] AS y FROM fx_entity)", "b AS (SELECT quantile_cont(x, 0.05) AS xa, quantile_cont(x, 0.95) AS xb, quantile_cont(y, 0.05) AS ya, quantile_cont(y, 0.95) AS yb FROM p)", select="SELECT vec_id FROM p, b WHERE x BETWEEN xa AND xb AND y BETWEEN ya AND yb"),
    "frame_by_cutoff": fx.sql(_E, "cu AS (SELECT unnest([1990, 2000, 2010]::BIGINT[]) AS cutoff)", "tr AS (SELECT cutoff, f.* FROM cu, fx_entity f WHERE year <= cutoff AND community >= 0)",
        "me AS (SELECT cutoff, community, list(m ORDER BY k) AS c FROM (SELECT cutoff, community, k, avg(e) AS m FROM (SELECT cutoff, community, generate_subscripts(v, 1) AS k, unnest(v) AS e FROM tr) GROUP BY ALL) GROUP BY ALL)",
        "dd AS (SELECT tr.*, list_distance(tr.v, me.c) AS d FROM tr JOIN me USING (cutoff, community))",
        select="SELECT cutoff, community, count(*) AS n, min(year) AS birth_year, round(quantile_cont(d, 0.95), 6) AS threshold, round(median(d), 6) AS median FROM dd GROUP BY ALL"),
}

QUERIES = {f.__name__: f for f in (
    heldout_basin_rate_wilson, basin_thresholds_per_community, basin_thresholds_pooled, core_medians, community_centroids, nearest_centroid_assign, projection_summary, unknown_community_dropped,
    unknown_community_frontier, top_assigned_communities, match_tiers, threshold_sweep, standard_scaled, pca_distances, frame_by_cutoff, spatial_trim,
)}
