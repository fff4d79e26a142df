"""SQL for DuckDB, over the same whole tables, of the queries that SQL can express there in reasonable time."""

_DISTANCES = """
SELECT community, icsd_id, arg_min(distance_to_centroid, (-epoch_us(ingest_ts), distance_to_centroid)) AS d
FROM node_events
WHERE community IS NOT NULL AND icsd_id IS NOT NULL AND distance_to_centroid >= 0 AND distance_to_centroid < 'infinity'::DOUBLE
GROUP BY community, icsd_id
"""

_PERCENTILES = f"""
WITH x AS ({_DISTANCES}), p AS (SELECT unnest([10, 25, 50, 75, 90, 95]) AS pct)
SELECT community, CAST(pct AS INTEGER) AS pct, CAST(n AS BIGINT) AS n, round(s[CAST(floor(h) AS INT) + 1] + (h - floor(h)) * (s[least(CAST(floor(h) AS INT) + 2, n)] - s[CAST(floor(h) AS INT) + 1]), 9) AS value
FROM (SELECT community, pct, len(s) AS n, s, (len(s) - 1) * pct / 100.0::DOUBLE AS h
      FROM (SELECT community, list(d ORDER BY d) AS s FROM x GROUP BY community), p)
"""

_VECTORS = """
SELECT icsd_id AS id, arg_min(pca32, row_ix)::DOUBLE[] AS v FROM frozen_vectors
WHERE len(pca32) = 32 AND icsd_id IS NOT NULL AND len(list_filter(pca32, lambda e: isfinite(e))) = 32 GROUP BY icsd_id
"""

SQL = {
    # every beginning of every record's order of distances that ends at a gap, and the sets that all their members propose
    "p1_found": f"""
WITH v AS MATERIALIZED (SELECT * FROM ({_VECTORS}) WHERE id IN (SELECT icsd_id FROM community_assignments)),
d AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM v a, v b),
r AS (SELECT a, d, row_number() OVER w AS n, lead(d) OVER w AS following, sum(hash(b) % 4294967296) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM d WINDOW w AS (PARTITION BY a ORDER BY d, b)),
g AS MATERIALIZED (SELECT a, n, s FROM r WHERE n >= 8 AND (following IS NULL OR (following > d AND following >= 1.3 * d))),
whole AS (SELECT n, s FROM g GROUP BY n, s HAVING count(*) = n),
least AS (SELECT a, min((n, s)) AS ns FROM g JOIN whole USING (n, s) GROUP BY a),
named AS (SELECT a, ns.n AS n, ns.s AS s FROM (SELECT a, struct_pack(n := struct_extract(ns, 1), s := struct_extract(ns, 2)) AS ns FROM least)),
kept AS (SELECT n, s FROM named GROUP BY n, s HAVING count(*) = n)
SELECT * FROM (SELECT a AS icsd_id_a, lead(a) OVER (PARTITION BY n, s ORDER BY a) AS icsd_id_b FROM named JOIN kept USING (n, s)) WHERE icsd_id_b IS NOT NULL
""",
    "p3_found": f"""
WITH v AS MATERIALIZED ({_VECTORS}),
d AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM v a, v b WHERE a.id <> b.id),
near AS (SELECT a, b, d FROM d WHERE d <= 0.25 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5)
SELECT DISTINCT least(a, b) AS icsd_id_a, greatest(a, b) AS icsd_id_b FROM near
""",
    "p2_found": f"""
WITH x AS ({_DISTANCES}), t AS (SELECT DISTINCT community, pct, threshold FROM community_thresholds)
SELECT community, pct FROM t JOIN x USING (community)
GROUP BY community, pct, threshold
HAVING abs(avg(CAST(d <= threshold AS INTEGER)) - pct / 100.0) > 0.015
""",
    "p2_percentiles": _PERCENTILES,
    "p2_merged_days": _PERCENTILES,
    "p4_found": """
SELECT community, CAST(rk AS INTEGER) AS rk, icsd_id FROM (
  SELECT community, icsd_id, row_number() OVER (PARTITION BY community ORDER BY d, icsd_id) AS rk
  FROM (SELECT community, icsd_id, min(distance_to_centroid) AS d FROM node_events
        WHERE community >= 0 AND distance_to_centroid >= 0 AND distance_to_centroid < 'infinity'::DOUBLE AND icsd_id IS NOT NULL
        GROUP BY community, icsd_id))
WHERE rk <= 10
""",
    "p6_lengths": """
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, true AS round_trip FROM documents
""",
}
