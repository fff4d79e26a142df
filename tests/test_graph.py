import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.operators import embedding, graph, replay


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src bigint, dst bigint, weight double")


def brute_core(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        low = [n for n, x in near.items() if len(x) <= k]
        if not low:
            k += 1
            continue
        for n in low:
            core[n] = k
            for m in near.pop(n):
                if m in near:
                    near[m].discard(n)
    return core


def test_triangle_with_a_tail_and_an_island(spark):
    e = edges(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1)])
    nodes = spark.range(1, 6).withColumnRenamed("id", "node")
    assert {r["node"]: r["component"] for r in graph.components(nodes, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    c = {r["node"]: (r["degree"], r["triangles"], r["clustering"]) for r in graph.clustering(e).collect()}
    assert c[1] == (2, 1, 1.0)
    assert c[3] == (3, 1, 1 / 3)
    assert c[4] == (1, 0, 0.0)
    small = graph.drop_small(graph.components(nodes, e), 2)
    assert small.where("component = -1").count() == 1


def test_long_chain_is_one_component(spark):
    e = edges(spark, [(i, i + 1, 1) for i in range(200)])
    nodes = spark.range(201).withColumnRenamed("id", "node")
    assert graph.components(nodes, e).select("component").distinct().collect()[0][0] == 0


def test_core_numbers_equal_peeling(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(140)})
    got = {r["node"]: r["core"] for r in graph.core_numbers(edges(spark, [(a, b, 1) for a, b in pairs])).collect()}
    assert got == brute_core(pairs)


def test_core_numbers_run_until_none_changes(spark):
    path = edges(spark, [(k, k + 1, 1) for k in range(15)])
    assert {r["core"] for r in graph.core_numbers(path).collect()} == {1}
    with pytest.raises(ValueError, match="still change"):
        graph.core_numbers(path, most_rounds=3)


def test_knn_keeps_equal_vectors_and_not_itself(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [9.0, 9.0])], "id bigint, v array<double>")
    got = [(r["src"], r["dst"], r["rk"]) for r in graph.knn(df, 2, "id", "v").orderBy("src", "rk").collect()]
    assert got[:4] == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2)]
    back = {(a, b) for a, b, _ in got}
    assert all((b, a) in back for a, b in [(r["src"], r["dst"]) for r in graph.mutual(graph.knn(df, 2, "id", "v")).collect()])


def test_louvain_parts_two_cliques(spark):
    two = [(a, b, 1) for part in (range(5), range(10, 15)) for a, b in itertools.combinations(part, 2)] + [(4, 10, 0.1)]
    e = edges(spark, two)
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15), 99]], "node bigint")
    got = {r["node"]: r["community"] for r in graph.louvain(nodes, e, least=2).collect()}
    assert {got[i] for i in range(5)} == {0}
    assert {got[i] for i in range(10, 15)} == {1}
    assert got[99] == -1
    found = spark.createDataFrame(list(got.items()), "node bigint, community bigint")
    whole = nodes.select("node", F.lit(0).alias("community"))
    assert graph.modularity(e, found).first()[0] > graph.modularity(e, whole).first()[0]


def test_centralities_of_a_path(spark):
    e = edges(spark, [(1, 2, 1), (2, 3, 1)])
    nodes = spark.range(1, 5).withColumnRenamed("id", "node")
    b = {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert b == {1: 0.0, 2: 1.0, 3: 0.0}
    c = {r["node"]: r["centrality"] for r in graph.eigenvector(e, graph.components(nodes, e)).collect()}
    assert abs(c[2] - 0.5**0.5) < 1e-9
    assert c[4] == 1.0


def test_hull_and_density(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 2.0, 2.0), (1, 0.0, 2.0), (1, 1.0, 1.0), (2, 0.0, 0.0), (2, 1.0, 1.0)], "g int, x double, y double")
    got = graph.convex_hull(pts, "g", "x", "y").orderBy("at").collect()
    assert [(r["g"], r["x"], r["y"]) for r in got] == [(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 2.0, 2.0), (1, 0.0, 2.0)]
    d = graph.density(pts, "x", "y", 10).toPandas()
    assert len(d) == 100
    assert (d.density > 0).all()
    assert graph.density(pts.where("false"), "x", "y").count() == 0


def test_replay_of_six(spark):
    rows = [(1, 1990, 0, [0.0]), (2, 1991, 0, [1.0]), (3, 1991, 1, [5.0]), (4, None, 1, [6.0]), (5, 1992, -1, [9.0]), (6, 1993, 2, [3.0])]
    df = spark.createDataFrame(rows, "id bigint, year bigint, community bigint, v array<double>")
    e = edges(spark, [(1, 2, 1), (2, 6, 1), (3, 6, 1), (4, 6, 1), (5, 6, 1)]).select("src", "dst")
    ev = {r["id"]: r for r in replay.replay(df, e, "id").collect()}
    assert ev[1]["event_type"] == "community_birth"
    assert ev[2]["n_active_same_community_neighbors"] == 1
    assert ev[5]["event_type"] == "outlier"
    assert ev[5]["core_periphery"] is None
    assert (ev[6]["n_active_neighbors"], ev[6]["n_active_other_communities"], ev[6]["is_bridge_attachment"]) == (3, 2, True)
    assert ev[4]["decade"] == "unknown"
    assert ev[4]["n_active_neighbors"] == 1  # enters last
    dec = replay.decades(replay.replay(df, e, "id")).collect()
    assert sum(r["n_total"] for r in dec) == 6


def test_embedding_of_sites(spark):
    rows = [(1, [[1.0], [3.0]], [(0, 1, 2.0), (1, 0, 2.0)], [7.0]), (2, [], [], [0.0]), (3, [[1.0]], None, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, sites array<array<double>>, edges array<struct<i:int,j:int,w:double>>, extra array<double>")
    got = {r["id"]: r for r in embedding.embed(df, "id", "sites", "edges", "extra", rounds=1).collect()}
    assert got[1]["v"] == [4.0, 4.0, 0.0, 7.0]
    assert not got[2]["ok"]
    assert got[2]["error"] == "no sites"
    assert got[3]["v"] == [1.0, 1.0, 0.0, 1.0]
    assert embedding.failures(embedding.embed(df, "id", "sites", "edges", "extra")).count() == 1


def test_neighbours_over_blocks_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    monkeypatch.setattr(graph, "BLOCK_ROWS", 40)
    got = graph.knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>"), 4, "id", "v").collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(i, rk, int(j)) for i in range(300) for rk, j in enumerate(np.argsort(d[i])[:4], 1)}
    assert {(r["src"], r["rk"], r["dst"]) for r in got} == want
    assert graph.knn(spark.createDataFrame([], "id bigint, v array<double>"), 4, "id", "v").count() == 0
