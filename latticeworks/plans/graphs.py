"""Queries on neighbour graphs, communities and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import graph, replay, tables
from ..session import stage
from . import fixtures as fx
from .fixtures import r6


def _nn(spark, sf_dir):
    return graph.knn(fx.entity(spark, sf_dir), fx.K, "vec_id", "v")


def _edges(spark, sf_dir):
    return stage(graph.gaussian_edges(graph.mutual(_nn(spark, sf_dir))), "edges")


def _nodes(spark, sf_dir):
    return fx.entity(spark, sf_dir).select(F.col("vec_id").alias("node"))


def knn_edges(spark, sf_dir):
    return _nn(spark, sf_dir).select("src", "dst", F.col("rk").cast("bigint").alias("rk"), r6("dist").alias("dist"))


def mutual_knn_edges(spark, sf_dir):
    return graph.mutual(_nn(spark, sf_dir)).where(F.col("src") < F.col("dst")).select("src", "dst")


def knn_gaussian_weights(spark, sf_dir):
    return graph.gaussian_edges(graph.mutual(_nn(spark, sf_dir))).select("src", "dst", r6("weight").alias("weight"))


def connected_component_sizes(spark, sf_dir):
    labels = graph.drop_small(graph.components(_nodes(spark, sf_dir), _edges(spark, sf_dir)), 4)
    return labels.groupBy("component").agg(F.count("*").alias("n"))


def node_degree(spark, sf_dir):
    return graph.degree(fx.network(spark, sf_dir))


def triangle_clustering(spark, sf_dir):
    return graph.clustering(fx.companions(spark, sf_dir)).select("node", "degree", "triangles", r6("clustering").alias("clustering"))


def weighted_clustering(spark, sf_dir):
    return graph.weighted_clustering(_edges(spark, sf_dir)).select("node", r6("clustering").alias("clustering"))


def k_core(spark, sf_dir):
    return graph.core_numbers(fx.network(spark, sf_dir))


def k_core_of_neighbours(spark, sf_dir):
    """Nodes of the 4-core of the neighbour graph."""
    return graph.core_numbers(_edges(spark, sf_dir)).where("core >= 4").select("node")


def _replayed(spark, sf_dir):
    return replay.replay(fx.entity(spark, sf_dir), _edges(spark, sf_dir), "vec_id", width=fx.WIDTH)


def temporal_replay_events(spark, sf_dir):
    e = _replayed(spark, sf_dir)
    return e.withColumn("distance_to_centroid", r6("distance_to_centroid")).withColumn("core_threshold", r6("core_threshold"))


def temporal_replay_decades(spark, sf_dir):
    d = replay.decades(_replayed(spark, sf_dir))
    return d.select("decade", "n_total", *[f"n_{c}" for c in replay.COUNTS], *[r6(f"{c}_ratio").alias(f"{c}_ratio") for c in replay.COUNTS])


def stack_shares(spark, sf_dir):
    d = replay.decades(_replayed(spark, sf_dir))
    out = replay.shares(d, ["n_cluster_birth_point", "n_bridge_attachment", "n_core_attachment", "n_periphery_attachment"])
    return out.select("decade", "part", r6("share").alias("share"))


def community_growth(spark, sf_dir):
    return replay.growth(fx.entity(spark, sf_dir), 5)


def community_birth_year(spark, sf_dir):
    return fx.entity(spark, sf_dir).where("community >= 0 and year is not null").groupBy("community").agg(F.min("year").alias("birth_year"), F.count("*").alias("n"))


def decade_densification(spark, sf_dir):
    """Noise, births and joins per decade, without a graph."""
    from ..functions.parse import decade

    rows = fx.entity(spark, sf_dir).select("year", "community")
    births = rows.where("community >= 0 and year is not null").groupBy("community").agg(F.min("year").alias("birth"))
    rows = rows.join(F.broadcast(births), "community", "left")
    inside, birth = F.col("community") >= 0, F.coalesce(F.col("year") == F.col("birth"), F.lit(False))
    count = lambda c: F.sum(c.cast("int")).cast("bigint")
    out = rows.groupBy(decade(F.col("year")).alias("decade")).agg(F.count("*").alias("n"), count(~inside).alias("n_outlier"), count(inside & birth).alias("n_birth"), count(inside & ~birth).alias("n_existing"))
    return out.withColumn("outlier_ratio", r6(F.col("n_outlier") / F.col("n")))


def intercommunity_edges(spark, sf_dir):
    labels = fx.entity(spark, sf_dir).where("community >= 0").select(F.col("vec_id").alias("node"), "community")
    return graph.contract(_nn(spark, sf_dir), labels, "community")


def top_neighbour_communities(spark, sf_dir):
    labels = fx.entity(spark, sf_dir).where("community >= 0").select(F.col("vec_id").alias("node"), "community")
    return graph.top_neighbours(graph.contract(_nn(spark, sf_dir), labels, "community"))


def _formula_nodes(spark, sf_dir):
    return fx.with_formula(fx.entity(spark, sf_dir), "vec_id", fx.FORMULAS, "formula").where("formula <> ''").select(F.col("vec_id").alias("node"), "formula", "community")


def formula_graph_edges(spark, sf_dir):
    """Formulas joined by any edge between their records, unweighted."""
    return graph.contract(_edges(spark, sf_dir), _formula_nodes(spark, sf_dir), "formula")


def formula_centroid_graph(spark, sf_dir):
    """Formulas of at least three records joined to the three whose mean vectors are nearest."""
    from ..functions.vectors import mean_vector

    rows = fx.with_formula(fx.entity(spark, sf_dir), "vec_id", fx.FORMULAS, "formula").where("formula <> ''")
    means = mean_vector(rows, ["formula"], "v", "c", fx.WIDTH).where("n >= 3")
    named = means.select(F.col("formula"), "c").withColumn("id", F.array_position(F.array(*map(F.lit, fx.FORMULAS)), F.col("formula")).cast("bigint"))
    return graph.knn(named, 3, "id", "c").select("src", "dst", F.col("rk").cast("bigint").alias("rk"), r6("dist").alias("dist"))


def bridge_rates(spark, sf_dir):
    """Per formula the share of records whose neighbours reach one, and two, other communities."""
    rows = _formula_nodes(spark, sf_dir)
    e = graph.both_ways(_edges(spark, sf_dir).select("src", "dst")).join(rows.select(F.col("node").alias("a"), "formula", F.col("community").alias("ca")), "a").join(fx.entity(spark, sf_dir).select(F.col("vec_id").alias("b"), F.col("community").alias("cb")), "b")
    other = F.count_distinct(F.when((F.col("cb") >= 0) & (F.col("cb") != F.col("ca")), F.col("cb")))
    met = e.groupBy(F.col("a").alias("node")).agg(other.alias("others"))
    out = rows.join(met, "node", "left").withColumn("others", F.coalesce("others", F.lit(0)))
    return out.groupBy("formula").agg(F.count("*").alias("n"), r6(F.avg((F.col("others") >= 1).cast("double"))).alias("cross_rate"), r6(F.avg((F.col("others") >= 2).cast("double"))).alias("bridge_rate"))


def louvain_communities(spark, sf_dir):
    return graph.louvain(_nodes(spark, sf_dir), _edges(spark, sf_dir), least=4)


def eigenvector_centrality(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.eigenvector(edges, graph.components(_nodes(spark, sf_dir), edges)).select("node", r6("centrality").alias("centrality"))


def betweenness_of_formulas(spark, sf_dir):
    """On the contracted graph of communities."""
    labels = fx.entity(spark, sf_dir).where("community >= 0").select(F.col("vec_id").alias("node"), "community")
    pairs = graph.contract(_edges(spark, sf_dir), labels, "community").withColumn("weight", F.col("n").cast("double"))
    return graph.betweenness(pairs).select("node", r6("betweenness").alias("betweenness"))


def community_layout(spark, sf_dir):
    labels = fx.entity(spark, sf_dir).where("community >= 0").select(F.col("vec_id").alias("node"), "community")
    return graph.layout(graph.contract(_nn(spark, sf_dir), labels, "community"))


def hulls(spark, sf_dir):
    pts = fx.entity(spark, sf_dir).select("community", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return graph.convex_hull(pts, "community", "x", "y")


def kernel_density(spark, sf_dir):
    pts = fx.entity(spark, sf_dir).select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return graph.density(pts, "x", "y", 24).select("i", "j", r6("density").alias("density"))


def fragmentation_entropy(spark, sf_dir):
    rows = fx.with_formula(fx.entity(spark, sf_dir), "vec_id", fx.FORMULAS, "formula").where("formula <> '' and community >= 0")
    counts = rows.groupBy("formula", "community").agg(F.count("*").alias("n"))
    return stats.entropy(counts, ["formula"]).select("formula", F.col("total").cast("bigint").alias("total"), r6("entropy").alias("entropy"))


def role_groups(spark, sf_dir):
    e = _replayed(spark, sf_dir).where("community >= 0")
    return e.groupBy(tables.role(F.col("event_type"), F.col("is_bridge_attachment"), F.col("core_periphery")).alias("role")).agg(F.count("*").alias("n"), r6(F.avg("distance_to_centroid")).alias("mean_distance"))


def role_groups_overlapping(spark, sf_dir):
    e = _replayed(spark, sf_dir).where("community >= 0")
    each = e.select(F.explode(tables.roles(F.col("event_type"), F.col("is_bridge_attachment"), F.col("core_periphery"))).alias("role"), "distance_to_centroid")
    return each.groupBy("role").agg(F.count("*").alias("n"), r6(F.avg("distance_to_centroid")).alias("mean_distance"))


def closest_members(spark, sf_dir):
    """The member nearest to each centroid, ties by the smaller id."""
    from ..operators import frame

    rows = fx.entity(spark, sf_dir)
    m = frame.member_distances(frame.known(rows), frame.centroids(rows, width=fx.WIDTH))
    return m.groupBy("community").agg(F.min(F.struct("d", "vec_id")).alias("s")).select("community", F.col("s.vec_id").alias("vec_id"), r6("s.d").alias("d"))


def stepping_stones(spark, sf_dir):
    """First year of each formula against the first birth among its communities."""
    rows = fx.with_formula(fx.entity(spark, sf_dir), "vec_id", fx.FORMULAS, "formula").where("formula <> ''").withColumn("year", F.when(F.col("vec_id") % 3 == 0, F.col("year")))
    births = fx.entity(spark, sf_dir).where("community >= 0 and year is not null").groupBy("community").agg(F.min("year").alias("birth"))
    first = rows.groupBy("formula").agg(F.min("year").alias("first_year"))
    born = rows.where("community >= 0").select("formula", "community").distinct().join(births, "community").groupBy("formula").agg(F.min("birth").alias("birth"))
    return first.join(born, "formula", "left").select("formula", "first_year", "birth", tables.stepping_stone(F.col("birth"), F.col("first_year")).alias("stepping_stone_class"))


_E, _N, _M, _D = fx.ENTITY, fx.knn(), fx.MUTUAL, fx.EDGES
_BOTH = "bo AS (SELECT src AS a, dst AS b FROM ed UNION ALL SELECT dst, src FROM ed)"
_NET = "nb AS (SELECT src AS a, dst AS b FROM fx_network UNION ALL SELECT dst, src FROM fx_network)"
_LABEL = "la AS (SELECT vec_id AS node, community FROM fx_entity WHERE community >= 0)"
_BEFORE = "((m.year < n.year) OR (m.year IS NOT NULL AND n.year IS NULL) OR (m.year IS NOT DISTINCT FROM n.year AND m.vec_id < n.vec_id))"
_REPLAY = [_E, _N, _M, _D, _BOTH, fx.centres("fx_entity"), fx.members("fx_entity"), "med AS (SELECT community, median(d) AS t FROM members GROUP BY community)",
    "bi AS (SELECT community, min(year) AS birth FROM fx_entity WHERE community >= 0 GROUP BY community)",
    f"""me AS (SELECT n.vec_id, count(*) AS na, sum((n.community >= 0 AND m.community = n.community)::INT) AS ns, count(DISTINCT CASE WHEN m.community >= 0 AND m.community <> n.community THEN m.community END) AS no
  FROM bo JOIN fx_entity n ON bo.a = n.vec_id JOIN fx_entity m ON bo.b = m.vec_id WHERE {_BEFORE} GROUP BY n.vec_id)""",
    """ev AS (SELECT f.vec_id, f.year, CASE WHEN f.year IS NULL THEN 'unknown' ELSE (f.year // 10 * 10)::VARCHAR || 's' END AS decade, f.community,
  CASE WHEN f.community < 0 THEN 'outlier' WHEN f.year = birth THEN 'community_birth' ELSE 'existing_community' END AS event_type, coalesce(na, 0)::BIGINT AS n_active_neighbors,
  coalesce(ns, 0)::BIGINT AS n_active_same_community_neighbors, coalesce(no, 0)::BIGINT AS n_active_other_communities, coalesce(no, 0) >= 2 AS is_bridge_attachment, d AS distance_to_centroid,
  CASE WHEN d IS NOT NULL THEN t END AS core_threshold, CASE WHEN d <= t THEN 'core' WHEN d IS NOT NULL THEN 'periphery' END AS core_periphery
  FROM fx_entity f LEFT JOIN me USING (vec_id) LEFT JOIN (SELECT vec_id, d FROM members) USING (vec_id) LEFT JOIN med ON f.community = med.community LEFT JOIN bi ON f.community = bi.community)"""]  # fmt: skip
_FLAGS = {"outlier": "community < 0", "cluster_birth_point": "event_type = 'community_birth'", "existing_cluster": "event_type = 'existing_community'", "same_community_attachment": "community >= 0 AND n_active_same_community_neighbors > 0", "cross_community_attachment": "community >= 0 AND n_active_other_communities > 0", "bridge_attachment": "community >= 0 AND is_bridge_attachment", "core_attachment": "coalesce(core_periphery = 'core', false)", "periphery_attachment": "coalesce(core_periphery = 'periphery', false)"}
_DEC = "de AS (SELECT decade, count(*) AS n_total, " + ", ".join(f"sum(({c})::INT)::BIGINT AS n_{n}" for n, c in _FLAGS.items()) + " FROM ev GROUP BY decade)"
#: Of each k the nodes that still have k neighbours left, round after round.
_PEELED = """al AS (SELECT 0 AS it, k.k AS k, dg.node AS node FROM dg, ({ks}) k WHERE dg.k >= k.k
  UNION ALL SELECT x.it + 1, x.k, x.node FROM al x JOIN {edges} e ON e.a = x.node JOIN al y ON y.node = e.b AND y.k = x.k WHERE x.it < 60 GROUP BY x.it, x.k, x.node HAVING count(*) >= x.k)"""
_FORM = [_E, fx.FORMULA]
_FN = "fn AS (SELECT vec_id AS node, formula, community FROM fx_formula WHERE formula <> '')"
_ROLE = "CASE WHEN event_type = 'community_birth' THEN 'birth' WHEN is_bridge_attachment THEN 'bridge' WHEN core_periphery = 'core' THEN 'core' ELSE 'periphery' END"

SQL = {
    "knn_edges": fx.sql(_E, _N, select="SELECT src, dst, rk, round(dist, 6) AS dist FROM nn"),
    "mutual_knn_edges": fx.sql(_E, _N, _M, select="SELECT src, dst FROM mu WHERE src < dst"),
    "knn_gaussian_weights": fx.sql(_E, _N, _M, _D, select="SELECT src, dst, round(weight, 6) AS weight FROM ed"),
    "connected_component_sizes": fx.sql(_E, _N, _M, _D, _BOTH, "re AS (SELECT vec_id AS node, vec_id AS root FROM fx_entity UNION SELECT bo.b, re.root FROM re JOIN bo ON re.node = bo.a)", "co AS (SELECT node, min(root) AS component FROM re GROUP BY node)", "sz AS (SELECT component, count(*) AS n FROM co GROUP BY component)",
        select="SELECT CASE WHEN n >= 4 THEN component ELSE -1 END AS component, sum(n)::BIGINT AS n FROM sz GROUP BY 1"),
    "node_degree": fx.sql(fx.NETWORK, _NET, select="SELECT a AS node, count(*) AS degree FROM nb GROUP BY a"),
    "triangle_clustering": fx.sql(fx.COMPANIONS, "fx_network AS (SELECT * FROM fx_companions)", _NET, "dg AS (SELECT a AS node, count(*) AS degree FROM nb GROUP BY a)", "tr AS (SELECT x.src AS p, x.dst AS q, y.dst AS r FROM fx_network x JOIN fx_network y ON x.dst = y.src JOIN fx_network z ON z.src = x.src AND z.dst = y.dst)", "tn AS (SELECT node, count(*) AS t FROM (SELECT p AS node FROM tr UNION ALL SELECT q FROM tr UNION ALL SELECT r FROM tr) GROUP BY node)",
        select="SELECT node, degree, coalesce(t, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN coalesce(t, 0) / (degree * (degree - 1) / 2) ELSE 0 END, 6) AS clustering FROM dg LEFT JOIN tn USING (node)"),
    "k_core": fx.sql(fx.NETWORK, _NET, "dg AS (SELECT a AS node, count(*) AS k FROM nb GROUP BY a)", _PEELED.format(ks="SELECT unnest(range(1, (SELECT max(k) + 1 FROM dg))) AS k", edges="nb"), select="SELECT node, max(k)::INTEGER AS core FROM al WHERE it = 60 GROUP BY node"),
    "k_core_of_neighbours": fx.sql(_E, _N, _M, _D, _BOTH, "dg AS (SELECT a AS node, count(*) AS k FROM bo GROUP BY a)", _PEELED.format(ks="SELECT 4 AS k", edges="bo"), select="SELECT node FROM al WHERE it = 60"),
    "weighted_clustering": fx.sql(_E, _N, _M, _D, "ww AS (SELECT src, dst, weight / (SELECT max(weight) FROM ed) AS w FROM ed)", "dg AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed) GROUP BY node)", "tr AS (SELECT x.src AS p, x.dst AS q, y.dst AS r, cbrt(x.w * y.w * z.w) AS g FROM ww x JOIN ww y ON x.dst = y.src JOIN ww z ON z.src = x.src AND z.dst = y.dst)", "tn AS (SELECT node, sum(g) AS g FROM (SELECT p AS node, g FROM tr UNION ALL SELECT q, g FROM tr UNION ALL SELECT r, g FROM tr) GROUP BY node)",
        select="SELECT node, round(CASE WHEN k > 1 THEN 2 * coalesce(g, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM dg LEFT JOIN tn USING (node)"),
    "temporal_replay_events": fx.sql(*_REPLAY, select="SELECT * REPLACE (round(distance_to_centroid, 6) AS distance_to_centroid, round(core_threshold, 6) AS core_threshold) FROM ev"),
    "temporal_replay_decades": fx.sql(*_REPLAY, _DEC, select="SELECT decade, n_total, " + ", ".join(f"n_{n}" for n in _FLAGS) + ", " + ", ".join(f"round(n_{n} / n_total, 6) AS {n}_ratio" for n in _FLAGS) + " FROM de"),
    "stack_shares": fx.sql(*_REPLAY, _DEC, "pa AS (UNPIVOT (SELECT decade, n_cluster_birth_point, n_bridge_attachment, n_core_attachment, n_periphery_attachment FROM de) ON COLUMNS(* EXCLUDE decade) INTO NAME part VALUE n)", select="SELECT decade, part, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY decade), 0), 0), 6)::DOUBLE AS share FROM pa"),
    "community_growth": fx.sql(_E, "lg AS (SELECT community FROM fx_entity WHERE community >= 0 GROUP BY community ORDER BY count(*) DESC, community LIMIT 5)", "dc AS (SELECT *, (year // 10 * 10)::VARCHAR || 's' AS decade FROM fx_entity WHERE year IS NOT NULL)", "gr AS (SELECT community, decade FROM lg, (SELECT DISTINCT decade FROM dc))",
        select="SELECT community, decade, (sum(n) OVER (PARTITION BY community ORDER BY decade))::BIGINT AS cumulative_size FROM (SELECT gr.community, gr.decade, count(dc.vec_id) AS n FROM gr LEFT JOIN dc USING (community, decade) GROUP BY ALL)"),
    "community_birth_year": fx.sql(_E, select="SELECT community, min(year) AS birth_year, count(*) AS n FROM fx_entity WHERE community >= 0 AND year IS NOT NULL GROUP BY community"),
    "decade_densification": fx.sql(_E, "bi AS (SELECT community, min(year) AS birth FROM fx_entity WHERE community >= 0 GROUP BY community)", "x AS (SELECT CASE WHEN year IS NULL THEN 'unknown' ELSE (year // 10 * 10)::VARCHAR || 's' END AS decade, f.community >= 0 AS inside, coalesce(year = birth, false) AS birth FROM fx_entity f LEFT JOIN bi USING (community))",
        select="SELECT decade, count(*) AS n, sum((NOT inside)::INT)::BIGINT AS n_outlier, sum((inside AND birth)::INT)::BIGINT AS n_birth, sum((inside AND NOT birth)::INT)::BIGINT AS n_existing, round(avg((NOT inside)::INT::DOUBLE), 6) AS outlier_ratio FROM x GROUP BY decade"),
    "intercommunity_edges": fx.sql(_E, _N, _LABEL, select="SELECT least(a.community, b.community) AS src, greatest(a.community, b.community) AS dst, count(*) AS n FROM nn JOIN la a ON nn.src = a.node JOIN la b ON nn.dst = b.node WHERE a.community <> b.community GROUP BY 1, 2"),
    "top_neighbour_communities": fx.sql(_E, _N, _LABEL, "pr AS (SELECT a.community AS node, b.community AS other FROM nn JOIN la a ON nn.src = a.node JOIN la b ON nn.dst = b.node WHERE a.community <> b.community)", "bt AS (SELECT node, other FROM pr UNION ALL SELECT other, node FROM pr)", "ct AS (SELECT node, other, count(*) AS n FROM bt GROUP BY ALL)",
        select="SELECT node, sum(n)::BIGINT AS total, first(other ORDER BY n DESC, other) AS top FROM ct GROUP BY node"),
    "formula_graph_edges": fx.sql(*_FORM, _N, _M, _D, _FN, select="SELECT least(a.formula, b.formula) AS src, greatest(a.formula, b.formula) AS dst, count(*) AS n FROM ed JOIN fn a ON ed.src = a.node JOIN fn b ON ed.dst = b.node WHERE a.formula <> b.formula GROUP BY 1, 2"),
    "formula_centroid_graph": fx.sql(*_FORM, "ce AS (SELECT formula, list(m ORDER BY k) AS v, max(n) AS n FROM (SELECT formula, k, avg(e) AS m, count(*) AS n FROM (SELECT formula, generate_subscripts(v, 1) AS k, unnest(v) AS e FROM fx_formula WHERE formula <> '') GROUP BY ALL) GROUP BY formula)", f"nm AS (SELECT list_position({fx._values(fx.FORMULAS)}, formula)::BIGINT AS vec_id, v FROM ce WHERE n >= 3)", fx.knn("nm", 3), select="SELECT src, dst, rk, round(dist, 6) AS dist FROM nn"),
    "bridge_rates": fx.sql(*_FORM, _N, _M, _D, _BOTH, _FN, "mt AS (SELECT fn.node, count(DISTINCT CASE WHEN m.community >= 0 AND m.community <> fn.community THEN m.community END) AS o FROM fn JOIN bo ON bo.a = fn.node JOIN fx_entity m ON bo.b = m.vec_id GROUP BY fn.node)",
        select="SELECT formula, count(*) AS n, round(avg((coalesce(o, 0) >= 1)::INT::DOUBLE), 6) AS cross_rate, round(avg((coalesce(o, 0) >= 2)::INT::DOUBLE), 6) AS bridge_rate FROM fn LEFT JOIN mt USING (node) GROUP BY formula"),
    "kernel_density": fx.sql(_E, "p AS (SELECT v[1] AS x, v[2] AS y FROM fx_entity)", "s AS (SELECT count(*)::DOUBLE AS n, min(x) AS x0, min(y) AS y0, (max(x) - min(x)) / 96 AS dx, (max(y) - min(y)) / 96 AS dy, stddev_samp(x) * power(count(*), -1.0::DOUBLE / 6) AS hx, stddev_samp(y) * power(count(*), -1.0::DOUBLE / 6) AS hy FROM p)",
        "m AS (SELECT least(floor((x - x0) / dx), 95) AS a, least(floor((y - y0) / dy), 95) AS b, count(*) AS k FROM p, s GROUP BY 1, 2)", "g AS (SELECT unnest(range(24))::INTEGER AS i)",
        select="SELECT g.i AS i, h.i AS j, round(sum(k * exp(-power(((a + 0.5::DOUBLE) - 4 * (g.i + 0.5::DOUBLE)) * dx / hx, 2) / 2) * exp(-power(((b + 0.5::DOUBLE) - 4 * (h.i + 0.5::DOUBLE)) * dy / hy, 2) / 2) / (hx * hy * 2 * pi())) / max(n), 6) + 0 AS density FROM m, s, g, g h GROUP BY g.i, h.i"),
    "fragmentation_entropy": fx.sql(*_FORM, "ct AS (SELECT formula, community, count(*) AS n FROM fx_formula WHERE formula <> '' AND community >= 0 GROUP BY ALL)", "pp AS (SELECT *, n / sum(n) OVER (PARTITION BY formula) AS p FROM ct)", select="SELECT formula, sum(n)::BIGINT AS total, round(-sum(p * ln(p)), 6) + 0 AS entropy FROM pp GROUP BY formula"),
    "role_groups": fx.sql(*_REPLAY, select=f"SELECT {_ROLE} AS role, count(*) AS n, round(avg(distance_to_centroid), 6) AS mean_distance FROM ev WHERE community >= 0 GROUP BY 1"),
    "role_groups_overlapping": fx.sql(*_REPLAY, "rl AS (SELECT 'birth' AS role, distance_to_centroid FROM ev WHERE community >= 0 AND event_type = 'community_birth' UNION ALL SELECT CASE WHEN is_bridge_attachment THEN 'bridge' WHEN core_periphery = 'core' THEN 'core' ELSE 'periphery' END, distance_to_centroid FROM ev WHERE community >= 0)", select="SELECT role, count(*) AS n, round(avg(distance_to_centroid), 6) AS mean_distance FROM rl GROUP BY role"),
    "closest_members": fx.sql(_E, fx.centres("fx_entity"), fx.members("fx_entity"), select="SELECT community, vec_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY d, vec_id) AS rn FROM members) WHERE rn = 1"),
    "stepping_stones": fx.sql(*_FORM, "bi AS (SELECT community, min(year) AS birth FROM fx_entity WHERE community >= 0 GROUP BY community)", "fy AS (SELECT formula, min(CASE WHEN vec_id % 3 = 0 THEN year END) AS first_year FROM fx_formula WHERE formula <> '' GROUP BY formula)", "fb AS (SELECT formula, min(birth) AS birth FROM fx_formula JOIN bi USING (community) WHERE formula <> '' GROUP BY formula)",
        select="SELECT formula, first_year, birth, CASE WHEN birth < first_year THEN 'joins_existing' WHEN birth = first_year THEN 'co_birth' WHEN birth > first_year THEN 'community_after_formula' END AS stepping_stone_class FROM fy LEFT JOIN fb USING (formula)"),
}

QUERIES = {f.__name__: f for f in (
    knn_edges, mutual_knn_edges, knn_gaussian_weights, connected_component_sizes, node_degree, triangle_clustering, weighted_clustering, k_core, k_core_of_neighbours, temporal_replay_events, temporal_replay_decades,
    stack_shares, community_growth, community_birth_year, decade_densification, intercommunity_edges, top_neighbour_communities, formula_graph_edges, formula_centroid_graph, bridge_rates, louvain_communities,
    eigenvector_centrality, betweenness_of_formulas, community_layout, hulls, kernel_density, fragmentation_entropy, role_groups, role_groups_overlapping, closest_members, stepping_stones,
)}
