import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.llm import clusters, common, entities, materials, neighbours, quantiles, topn
from latticeworks.llm.cells import Profiles, isolated, proposals


def test_top_n_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), rng.choice([0.0, -0.0, 0.5, 1.5, float("nan"), None, rng.random()]), rng.randrange(60), i) for i in range(900)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, "g bigint, s double, i bigint, rk int").repartition(7)
    got = sorted((r["g"], r["rk"], r["i"]) for r in topn.top_n(df, "g", "s", "i", 10).collect())
    best = {}
    for g, s, i, _ in rows:
        if g is not None and s is not None and s == s:
            best[g, i] = min(best.get((g, i), s), s)
    want = []
    for g in {g for g, _ in best}:
        for k, (_, i) in enumerate(sorted((s + 0.0, i) for (h, i), s in best.items() if h == g)[:10], 1):
            want.append((g, k, i))
    assert got == sorted(want)


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1.0, "x")], "g string, s double, i string")
    assert [tuple(r) for r in topn.top_n(df, "g", "s", "i", 3).collect()] == [("a", 1.0, "x", 1)]
    assert topn.top_n(df.where("false"), "g", "s", "i", 3).collect() == []
    with pytest.raises(ValueError, match="at least"):
        topn.top_n(df, "g", "s", "i", 0)


def test_no_group_is_shuffled_whole(spark):
    df = spark.range(20000).select(F.lit(1).alias("g"), F.rand(3).alias("s"), "id")
    plan = topn.top_n(df, "g", "s", "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(g") < plan.rindex("MapInArrow")  # the first map stands below the exchange


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_percentiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.random(n), 2)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("h", 1.0)], "g string, x double")
    got = {r["pct"]: r["value"] for r in quantiles.percentiles(df, (0, 10, 50, 95, 100)).where("g = 'g'").collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.percentile(x, p), abs=1e-12)


def events(spark, rows):
    return spark.createDataFrame(rows, "community bigint, icsd_id bigint, d double, ts timestamp, pct int").withColumn("ts", F.col("ts"))


def test_days_put_together_equal_the_whole(spark):
    import datetime

    rng = random.Random(2)
    t = lambda k: datetime.datetime(2024, 1, 1 + k)
    rows = [(rng.randrange(3), i, rng.choice([rng.random(), None, float("nan"), float("inf"), -1.0]), rng.choice([None, t(rng.randrange(5))]), 1) for i in range(300)]
    rows += [(g, i, d, t((w.day + 1) % 9) if w else t(3), p) for g, i, d, w, p in rows[:80]]
    df = events(spark, rows)
    whole = quantiles.percentiles(quantiles.one_per_key(df, "community", "d", "icsd_id", "ts"))
    days = quantiles.percentiles(quantiles.merge_runs(quantiles.day_runs(df, "community", "d", "icsd_id", "ts")))
    key = lambda r: (r["g"], r["pct"], r["n"], round(r["value"], 12))
    assert sorted(map(key, whole.collect())) == sorted(map(key, days.collect()))


def test_a_value_of_most_rows_spreads_over_partitions(spark):
    df = spark.range(40000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id") / 7.0).alias("x"), F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in quantiles._sorted(df)[1].collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40000
    assert max(sizes) < 20000
    assert {r["pct"]: r["value"] for r in quantiles.percentiles(df, (10, 50)).collect()} == {10: 0.0, 50: 0.0}


def test_wrong_thresholds_equal_shares(spark):
    rng = np.random.default_rng(5)
    x = {g: np.round(rng.random(n), 3) for g, n in ((1, 200), (2, 37), (3, 1), (4, 1000))}
    values = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs], "g bigint, x double")
    rows = [(g, p, float(np.round(rng.random(), 3))) for g in x for p in (10, 25, 50, 75, 90, 95) for _ in range(4)]
    published = spark.createDataFrame([*rows, *rows[:5], (9, 50, 0.5), (1, None, 0.5), (1, 50, None)], "g bigint, pct int, threshold double")
    got = {tuple(r) for r in quantiles.wrong_thresholds(values, published).collect()}
    want = {(g, p, t) for g, p, t in rows if abs((x[g] <= t).mean() - p / 100) > 0.015 + 1e-12}
    assert got == want
    assert quantiles.wrong_thresholds(values.where("false"), published).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, k, v, "x", 1) for k, (i, v) in enumerate(rows)], "icsd_id bigint, row_ix bigint, pca32 array<float>, rep string, near int")


def grid(n, seed=0, scale=1.0, centre=None):
    rng = np.random.default_rng(seed)
    c = np.zeros(32) if centre is None else centre
    return (c + scale * rng.normal(size=(n, 32))).astype(np.float32)


def test_odd_vectors_take_no_part(spark):
    ok = [0.5] * 32
    rows = [(1, ok), (2, None), (3, []), (4, ok[:31]), (5, [float("nan"), *ok[1:]]), (6, [float("inf"), *ok[1:]]), (7, [None, *ok[1:]]), (None, ok), (1, ok), (8, ok), (9, [0.0, *ok[1:]]), (9, [-0.0, *ok[1:]])]
    classes, several = common.distinct_vectors(vectors(spark, rows), "icsd_id", "pca32", "row_ix")
    assert {r["rep"]: r["copies"] for r in classes.collect()} == {1: 2, 9: 1}
    assert {tuple(r) for r in several.collect()} == {(1, 1), (8, 1)}


def test_key_with_several_vectors_keeps_the_first(spark):
    rows = [(1, [1.0] * 32), (1, [2.0] * 32), (2, [2.0] * 32)]
    classes, several = common.distinct_vectors(vectors(spark, rows), "icsd_id", "pca32", "row_ix")
    assert {r["rep"]: r["v"][0] for r in classes.collect()} == {1: 1.0, 2: 2.0}
    assert several.collect() == []


def test_a_vector_held_by_most_keys_is_no_burden(spark):
    df = spark.range(6000).select(F.col("id").alias("icsd_id"), F.col("id").alias("row_ix"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda k: F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.rand(4) + k).cast("float")).alias("pca32"))
    classes, several = common.distinct_vectors(df, "icsd_id", "pca32", "row_ix")
    assert classes.count() == 2001
    assert several.count() == 4000
    plan = df.select(F.xxhash64("pca32").alias("h"), "pca32").dropDuplicates(["h"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Exchange") < plan.rindex("Aggregate")  # copies end before the exchange


def test_equal_distances_go_by_key_across_classes(spark):
    at = lambda v: [float(v)] + [0.0] * 31
    df = vectors(spark, [(1, at(1)), (10, at(1)), (11, at(1)), (2, at(-1)), (100, at(0))])
    got = {r["rk"]: r["near"] for r in neighbours.nearest(df, 2).where("id = 100").collect()}
    assert got == {1: 1, 2: 2}


@pytest.mark.parametrize("options", [neighbours.Permutations(per_pivot=4, asked=1, far_asked=1, places=1, far_places=1), neighbours.Permutations(per_pivot=4, direct=8, group=4, task_pairs=50.0, asked=2, far_asked=3)])
def test_no_close_pair_is_lost(spark, options):
    rng = np.random.default_rng(3)
    x = np.concatenate([grid(150, k, 0.06, rng.normal(size=32)) for k in range(6)] + [grid(100, 77, 3.0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:5] if d[i, j] <= 0.5}
    assert len(want) > 500
    assert {tuple(r) for r in neighbours.close_pairs(vectors(spark, rows), 0.5, options=options).collect()} == want


@pytest.mark.parametrize("direct", [10_000, 8])
def test_few_files_are_asked_within_a_radius(direct):
    # of one hot cluster, of which a fixed ring about the nearest pivot would take in most files; looked up for many rows at once
    x = np.concatenate([grid(3000, 1, 0.5), grid(600, 2, 4.0)])
    x[1500:3000] = x[:1500] + grid(1500, 3, 0.03)
    pivots = neighbours.Pivots(np.concatenate([grid(200, 4, 0.5), grid(50, 5, 4.0)]), neighbours.Permutations(direct=direct, group=8, far_asked=2))
    row, pivot, d, rank = pivots.around(x, 0.25)
    asked = np.zeros((len(x), 250), bool)
    asked[row, pivot] = True
    whole = np.sqrt(((x[:, None].astype(float) - (pivots.x + pivots.middle)[None]) ** 2).sum(-1))
    assert (pivot[rank == 0] == whole.argmin(1)[row[rank == 0]]).all() and (rank == 0).sum() == len(x)
    near = np.sqrt(((x[:1500].astype(float) - x[1500:3000]) ** 2).sum(-1)) <= 0.25
    assert near.sum() > 1000
    one, other = np.arange(1500)[near], np.arange(1500, 3000)[near]
    assert asked[one, whole.argmin(1)[other]].all() and asked[other, whole.argmin(1)[one]].all()
    assert asked.sum() < 0.5 * (whole <= whole.min(1)[:, None] + 0.5).sum()
    assert len(list(pivots._looks(x, 0.5))) < len(x) / 10


def test_neighbours_of_few_are_exact(spark):
    x = grid(60, 3)
    x[10:18] = x[9]  # copies
    rows = [(100 + i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows), 5).orderBy("id", "rk").collect():
        got.setdefault(r["id"], []).append((r["near"], r["distance"]))
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    for i in range(60):
        want = sorted((round(float(d[i, j]), 5), 100 + j) for j in range(60) if j != i)[:5]
        assert [n for n, _ in got[100 + i]] == [j for _, j in want]
        assert [round(x, 4) for _, x in got[100 + i]] == pytest.approx([w for w, _ in want], abs=2e-4)
    one = vectors(spark, rows[:1])
    assert neighbours.nearest(one).collect() == []
    assert neighbours.nearest(one.where("false")).collect() == []
    pairs = {tuple(r) for r in neighbours.close_pairs(vectors(spark, rows), 0.01).collect()}
    assert (109, 110) in pairs
    assert all(a < b and 109 <= a and b <= 117 for a, b in pairs)


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([grid(400, k, 0.3, rng.normal(size=32) * 5) for k in range(12)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = ((x[:, None, :8] - x[None, :, :8]) ** 2).sum(-1)
    for s in range(8, 32, 8):
        d += ((x[:, None, s : s + 8] - x[None, :, s : s + 8]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    fifth = np.sqrt(np.sort(d, 1)[:, 4])
    options = neighbours.Permutations(per_pivot=32, direct=64, group=16, task_pairs=2e5)
    got = neighbours.nearest(vectors(spark, rows), 5, options=options).toPandas()
    assert (got.groupby("id").size() == 5).all()
    assert (got.distance.to_numpy() <= fifth[got.id.to_numpy()] + 1e-4).mean() >= 0.9


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_on_a_hot_cluster_and_on_isolated_records(spark, n):
    rng = np.random.default_rng(9)
    parts = {"hot": grid(n // 3, 1), "rest": np.concatenate([grid(40, 10 + k, 0.3, rng.normal(size=32) * 20) for k in range(n // 65)]), "isolated": rng.normal(size=(n // 20, 32)).astype(np.float32) * 20}
    x = np.concatenate(list(parts.values()))
    kind = np.repeat(list(parts), [len(p) for p in parts.values()])
    squares = (x.astype(float) ** 2).sum(1)
    d = squares[:, None] + squares[None] - 2 * x.astype(float) @ x.astype(float).T
    np.fill_diagonal(d, np.inf)
    fifth = np.sqrt(np.maximum(np.partition(d, 4, axis=1)[:, 4], 0))
    # as many files as a large collection has
    got = neighbours.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), 5, options=neighbours.Permutations(per_pivot=8, task_pairs=1e6)).toPandas()
    found = got.distance.to_numpy() <= fifth[got.id.to_numpy()] + 1e-4
    for k in parts:
        assert found[kind[got.id.to_numpy()] == k].mean() >= 0.9, k


def brute_clusters(x, least=8, apart=1.3):
    """Straight from the definition: every beginning of every row's order of distances is tried."""
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    sets = set()
    for i in range(len(x)):
        order = np.argsort(d[i], kind="stable")
        for n in range(least, len(x) + 1):
            s = np.sort(order[:n])
            rest = np.setdiff1d(np.arange(len(x)), s)
            inside = d[np.ix_(s, s)].max(1)
            if not len(rest) or (d[np.ix_(s, rest)].min(1) >= apart * inside).all():
                sets.add(frozenset(s.tolist()))
    return {s for s in sets if not any(t < s for t in sets)}


def sample_of_clusters(seed):
    rng = np.random.default_rng(seed)
    parts = [grid(n, seed * 10 + k, s, rng.normal(size=32) * 6) for k, (n, s) in enumerate([(9, 0.2), (15, 0.1), (40, 0.3), (7, 0.1), (22, 0.6)])]
    parts.append(rng.normal(size=(12, 32)).astype(np.float32) * 6)
    parts.append(parts[1][:9] * 0 + grid(9, seed + 99, 0.1, parts[1].mean(0) + 0.35))
    return np.concatenate(parts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_isolated_sets_equal_the_definition(seed):
    x = sample_of_clusters(seed)
    label = isolated(x, np.ones(len(x), np.int64), len(x), 8, 1.3)
    got = {frozenset(np.flatnonzero(label == k).tolist()) for k in range(label.max() + 1)}
    assert got == brute_clusters(x)


def test_copies_count_as_records():
    x = np.concatenate([grid(4, 1, 0.1), grid(5, 2, 0.1, np.full(32, 9.0))])
    assert isolated(x, np.array([5, 1, 1, 1, 1, 1, 1, 1, 1]), 9, 8, 1.3).tolist() == [0, 0, 0, 0, -1, -1, -1, -1, -1]


@pytest.mark.parametrize(("seed", "limits"), [(1, clusters.Limits()), (2, clusters.Limits(cell_rows=16, unit_rows=16, view_units=20, sample=64)), (3, clusters.Limits(cell_rows=32, unit_rows=12, view_units=30, sample=128))])
def test_clusters_equal_the_definition(spark, seed, limits):
    x = sample_of_clusters(seed)
    rows = [(1000 + i, v.tolist()) for i, v in enumerate(x)] + [(1003, x[3].tolist()), (5, None)]
    got = {}
    for r in clusters.cluster_records(vectors(spark, rows), limits=limits).collect():
        got.setdefault(r["cluster"], set()).add(r["id"] - 1000)
    want = brute_clusters(x)
    assert {frozenset(s) for s in got.values()} == want
    chained = {tuple(r) for r in clusters.chain(clusters.cluster_records(vectors(spark, rows), limits=limits)).collect()}
    ordered = [sorted(s) for s in want]
    assert chained == {(1000 + a, 1000 + b) for s in ordered for a, b in zip(s, s[1:], strict=False)}


@pytest.mark.parametrize("exact_rows", [4, 20])
def test_large_groups_equal_the_definition(spark, exact_rows):
    x = sample_of_clusters(2)
    # two clusters so near that they are linked, one of them spoilt by a record in between, and one with a record far enough off
    at = np.zeros(32)
    at[0] = 60
    off = np.eye(32)[1] * 2.2
    blobs = [grid(40, 71, 0.1, at), grid(40, 72, 0.1, at + off), grid(30, 73, 0.1, at * 2), (at * 2 + off * 0.45)[None], grid(30, 74, 0.1, at * 3), (at * 3 + off)[None]]
    x = np.concatenate([x, *blobs]).astype(np.float32)
    rows = [(1000 + i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in clusters.cluster_records(vectors(spark, rows), limits=clusters.Limits(exact_rows=exact_rows, block_rows=8)).collect():
        got.setdefault(r["cluster"], set()).add(r["id"] - 1000)
    assert {frozenset(s) for s in got.values()} == brute_clusters(x)


@pytest.mark.parametrize("limits", [clusters.Limits(exact_rows=300, block_rows=200, cell_rows=256, view_units=200), clusters.Limits()])
def test_a_set_within_a_large_group(spark, limits):
    # spread rows that hold a tight ten, and far rows; with the limits of 300 the group is judged in blocks
    x = np.concatenate([grid(900, 61, 1.0), grid(10, 62, 0.01, np.full(32, 0.3)), grid(200, 63, 1.0, np.full(32, 40.0))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in clusters.cluster_records(vectors(spark, rows), limits=limits).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(s) for s in got.values()} == {frozenset(range(900, 910)), frozenset(range(910, 1110))}


@pytest.mark.parametrize("seeds", [0, 4])
def test_large_groups_of_which_few_rows_are_judged(spark, seeds):
    at, off = np.eye(32)[0] * 60, np.eye(32)[1]
    hot = grid(90, 81, 1.0)
    blobs = [grid(40, 71, 0.1, at), grid(40, 72, 0.1, at + off * 2.2), grid(30, 73, 0.1, at * 2), (at * 2 + off)[None], grid(12, 75, 0.01, hot[0] * 0.2)]
    # a record outside for which the way by the centre is too long and the true width is not
    blobs += [grid(30, 74, 0.1, at * 3), (at * 3 + off * 2.0)[None]]
    x = np.concatenate([hot, *blobs]).astype(np.float32)
    limits = clusters.Limits(exact_rows=20, block_rows=16, seeds=seeds)
    got = {}
    for r in clusters.cluster_records(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), limits=limits).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(s) for s in got.values()} == brute_clusters(x)


def test_few_rows_of_a_hot_cluster_are_judged(spark):
    # all of them were once sent to every block of the group
    x = grid(5000, 83)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    own = spark.createDataFrame([(1, i, 1, v, i, 5000, 0, i < 400) for i, v in rows], "grp bigint, id bigint, copies int, v array<float>, name bigint, held bigint, block int, seed boolean")
    judged = {r["id"] for r in clusters._to_judge(own, clusters.Limits(block_rows=128)).collect()}
    assert set(range(400)) <= judged and len(judged) < 1500


def test_profiles_propose_as_whole_orders_do():
    rng = np.random.default_rng(0)
    for trial in range(40):
        parts = [rng.normal(size=(rng.integers(3, 60), 32)) * rng.choice([0.01, 0.1, 0.5, 1]) + rng.normal(size=32) * rng.choice([0.5, 2, 6]) for _ in range(rng.integers(1, 8))]
        x = np.concatenate(parts).astype(np.float32)
        n, name = len(x), rng.integers(-(2**62), 2**62, len(x))
        w = rng.integers(1, 4, n) if trial % 2 else np.ones(n, np.int64)
        want = sorted((i, t, c) for i, t, c, _ in proposals(x, w, name, np.arange(n), n, 8, 1.3))
        block, got = rng.integers(0, 4, n), []
        for b in range(4):
            own, rest = np.flatnonzero(block == b), np.flatnonzero(block != b)
            if len(own):
                p = Profiles(own, w[own], name[own], x[own], n, 8, 1.3)
                for part in np.array_split(rest, 3):
                    p.add(part, w[part], name[part], x[part])
                got += [(int(own[r]), int(t), int(c)) for r, t, c, _ in zip(*(np.concatenate(a) for a in zip(*p.proposals(), strict=True)), strict=True)] if (held := list(p.proposals())) and held else []
        assert sorted(got) == want


def test_staged_tables_are_deleted(spark, tmp_path):
    from latticeworks import session

    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(sample_of_clusters(1))])
    folder = session.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with session.staging():
        assert clusters.cluster_records(df).count()
        assert len(set(os.listdir(folder)) - before) == 1  # what the result reads
        assert neighbours.nearest(df).count()
    assert set(os.listdir(folder)) == before


@pytest.mark.parametrize("kind", ["one", "third"])
def test_wide_clusters_of_single_rows(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "one":
        x = rng.normal(size=(1000, 32)).astype(np.float32)
    else:
        # rows of uneven density, which stay single, and compact clusters far off
        blob = rng.normal(size=(200, 32)) * np.exp(rng.normal(size=(200, 1)) * 0.7)
        x = np.concatenate([blob, *[grid(40, 80 + k, 0.1, rng.normal(size=32) * 60) for k in range(10)]]).astype(np.float32)
    label = isolated(x, np.ones(len(x), np.int64), len(x), 8, 1.3)
    assert max(np.bincount(label[label >= 0])) >= 200
    got = {}
    for r in clusters.cluster_records(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(s) for s in got.values()} == {frozenset(np.flatnonzero(label == k).tolist()) for k in range(label.max() + 1)}


def test_descriptions(spark):
    x = sample_of_clusters(1)
    df = vectors(spark, [(1000 + i, v.tolist()) for i, v in enumerate(x)])
    found = clusters.member_distances(clusters.cluster_records(df), df)
    for r in clusters.describe(found, 3).collect():
        assert r["size"] >= 8
        assert len(r["typical"]) == 3
    assert clusters.cluster_records(df.where("false")).collect() == []


def test_chain_across_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("cluster"), "id")
    assert clusters.chain(df).count() == 4997


@pytest.mark.parametrize(
    ("text", "want"),
    [("Sc₃Nd₅MnFe₅S₆", "Fe5Mn1Nd5S6Sc3"), ("Yb<sub>14</sub>GeO<sub>2</sub>", "Ge1O2Yb14"), (" Mg8 Sr Al7 P O10 ", "Al7Mg8O10P1Sr1"), ("Ca0.667Nb1Sn1F0.667", "Ca2F2Nb3Sn3"), ("Na12.81La1.01P1As4O5.94", "As4La1Na13O6P1"), ("Zr3(MoNi)2", "Mo2Ni2Zr3"), ("Mo8Cl4", "Cl1Mo2"), ("n/a", None), ("", None), ("((A)", None), ("2", None)],
)
def test_formula_notations(text, want):
    whole = materials.reduce_amounts(materials.parse_formula(text))
    assert (materials.composition_key(whole) if whole else None) == want


@pytest.mark.parametrize(("text", "want"), [("P2_1/c", 14), ("P 1 21/c 1", 14), ("P21/n", 14), ("Pmcn", 62), ("pbca", 61), ("P4/nmm (129)", 129), ("225", 225), (12, 12), ("Cmca", 64), ("231", None), ("nonsense", None), (None, None)])
def test_space_groups(text, want):
    assert materials.space_group(text) == want


def test_reports_and_structures():
    g, v, n = materials.read_report("P6_3mc, N=68, cell lengths in pm: 775, 775, 2120; angles 90.0 90.0 120.0")
    assert (g, n) == (186, 68)
    assert v == pytest.approx(7.75 * 7.75 * 21.2 * 3**0.5 / 2)
    assert materials.read_report("phase confirmed, space group Pna2_1; a=1.0 b=2.0 c=3.0 A, angles 90.00/90.00/90.00, 24 sites in cell") == (33, pytest.approx(6.0), 24)
    assert materials.read_report(None) == (None, None, None)
    assert materials.read_structure('{"lattice_mat": [[1,0,0],[0,2,0],[0,0,3]], "elements": ["Na","Cl"]}') == ({"Na": 1, "Cl": 1}, 6.0)
    for bad in (None, "", "[]", "{}", '{"elements": 3}', "not json"):
        assert materials.read_structure(bad) == (None, None)


def test_readings_of_doubtful_records():
    assert materials.readings("NaCl", {"Na": 4, "Cl": 4}, 80.0) == [("Cl1Na1", 10.0, 1.0)]
    assert materials.readings("Y7Sn15Bi4", {"Y": 14, "Sn": 28, "Bi": 8}, 500.0)[0][0] == "Bi4Sn14Y7"  # whole units: the formula is off
    assert materials.readings("Mg12O9Sr4", {"Mg": 34, "O": 27, "Sr": 12}, 750.0)[0] == ("Mg12O9Sr4", 10.0, 0.95)  # atoms are missing
    assert len(materials.readings("Pr10CrNi4O3", {"Pr": 10, "Cr": 1, "Ni": 4, "O": 2}, 100.0)) == 2
    assert materials.readings(None, None, 5.0) == []


def material_tables(spark):
    js = '{{"lattice_mat": [[{a},0,0],[0,2,0],[0,0,4]], "elements": [{e}]}}'
    nacl = ", ".join(['"Na"'] * 2 + ['"Cl"'] * 2)
    mp = spark.createDataFrame(
        [("mp-1", "NaCl", "Fm-3m", '{"lattice": {"a": 4, "b": 2, "c": 10, "alpha": 90, "beta": 90, "gamma": 90, "volume": 80}, "species": [["Na", 4], ["Cl", 4]]}', 1), ("mp-2", "ClNa", None, '{"lattice": {"a": 4, "b": 4, "c": 10, "alpha": 90, "beta": 90, "gamma": 90, "volume": 160}, "species": [["Na", 4], ["Cl", 4]]}', 1), (None, "NaCl", "1", None, 2), ("mp-3", None, None, None, 3)],
        "material_id string, reduced_formula string, spg string, structure string, id int",
    )
    jarvis = spark.createDataFrame([("J-1", "Na₂Cl₂", 225, js.format(a=4.9, e=nacl)), ("J-1", "Na₂Cl₂", 225, js.format(a=4.9, e=nacl)), ("J-2", "NaCl", 221, js.format(a=9.8, e=nacl))], "material_id string, reduced_formula string, spg int, atoms string")
    alex = spark.createDataFrame([("a-1", "NaCl", None, '{"lattice": {"matrix": [[5,0,0],[0,2,0],[0,0,4]]}, "sites": [{"species": "Na", "count": 2}, {"species": "Cl", "count": 2}]}')], "material_id string, reduced_formula string, spg int, structure string")
    lab = spark.createDataFrame([("lab-1", "Na0.99Cl1.01", "Refined cell 5.0 x 4.0 x 2.0 (90.0, 90.0, 90.0), SG 225, 4 atoms per cell"), ("lab-2", "NaCl", None)], "target_id string, formula string, conclusion string")
    return mp, jarvis, alex, lab


def test_materials_are_matched(spark):
    got = {(r["id_a"], r["id_b"]): r["confidence"] for r in entities.match_materials(spark, *material_tables(spark)).collect()}
    sure = {p for p, c in got.items() if c >= 0.5}
    assert sure == {("J-1", "mp-1"), ("J-1", "a-1"), ("a-1", "mp-1"), ("J-1", "lab-1"), ("lab-1", "mp-1"), ("a-1", "lab-1"), ("J-2", "mp-2")}
    assert all(0 <= c <= 1 for c in got.values())
    empty = [t.where("false") for t in material_tables(spark)]
    assert entities.match_materials(spark, *empty).collect() == []
