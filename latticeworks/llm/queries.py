"""The queries of this package, each over its whole tables with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, encode, entities, leakage, neighbours, quantiles, split, topn
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.one_per_key(table(spark, sf_dir, "node_events"), "community", "distance_to_centroid", "icsd_id", "ingest_ts")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_records(table(spark, sf_dir, "frozen_vectors"), among=table(spark, sf_dir, "community_assignments").select("icsd_id"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.member_distances(_clusters(spark, sf_dir), table(spark, sf_dir, "frozen_vectors"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.chain(_clusters(spark, sf_dir)).select(F.col("a").alias("icsd_id_a"), F.col("b").alias("icsd_id_b"))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select(F.col("id").alias("icsd_id"), F.col("cluster").alias("community"), F.round("distance", 5).alias("distance"))


def p1_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.describe(_placed(spark, sf_dir))
    return out.select(F.col("cluster").alias("community"), "size", F.round("radius", 5).alias("radius"), F.array_join("typical", ",").alias("typical"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = table(spark, sf_dir, "community_thresholds").select(F.col("community").alias("g"), "pct", "threshold")
    return quantiles.wrong_thresholds(_distances(spark, sf_dir), published).select(F.col("g").alias("community"), "pct")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quantiles.percentiles(_distances(spark, sf_dir))
    return out.select(F.col("g").alias("community"), F.col("pct").cast("int").alias("pct"), "n", F.round("value", 9).alias("value"))


def p2_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = quantiles.day_runs(table(spark, sf_dir, "node_events"), "community", "distance_to_centroid", "icsd_id", "ingest_ts")
    out = quantiles.percentiles(quantiles.merge_runs(runs))
    return out.select(F.col("g").alias("community"), F.col("pct").cast("int").alias("pct"), "n", F.round("value", 9).alias("value"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.close_pairs(table(spark, sf_dir, "frozen_vectors"))
    return pairs.select(F.col("a").alias("icsd_id_a"), F.col("b").alias("icsd_id_b"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest(table(spark, sf_dir, "frozen_vectors"))
    return near.select(F.col("id").alias("icsd_id"), "rk", F.col("near").alias("neighbour_id"), F.round("distance", 6).alias("distance"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.nearest_members(table(spark, sf_dir, "node_events")).select("community", "rk", "icsd_id")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [table(spark, sf_dir, t) for t in ("mp_records", "jarvis_records", "alex_records", "alab_targets")]
    return entities.match_materials(spark, *tables).select("id_a", "id_b", F.round("confidence", 6).alias("confidence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).where(F.col("confidence") >= 0.5).select("id_a", "id_b")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = p6_ids(spark, sf_dir)
    back = encode.decode_corpus(ids).withColumnRenamed("text", "back")
    same = table(spark, sf_dir, "documents").select("doc_id", "text").join(back, "doc_id")
    return same.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), (F.coalesce("text", F.lit("")) == F.col("back")).alias("round_trip"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(table(spark, sf_dir, "documents"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_texts(table(spark, sf_dir, "documents"), with_text=True)
    return pieces.select("doc_id", "piece", "first_token", "end_token", "cut", "piece_text")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_members, p1_communities, p2_found, p2_percentiles, p2_merged_days, p3_found, p3_neighbours, p4_found, p5_found, p5_matches, p6_ids, p6_lengths, p7_found, p8_found, p8_pieces)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return SQL
