import math

import pytest
from pyspark.sql import functions as F

from latticeworks.functions import formula, parse, stats, text
from latticeworks.operators import frame, scoring, tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, [kind(v) for v in values.values()], strict=True)))
    return df.select(column.alias("x")).first()["x"]


def kind(v):
    return "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"


@pytest.mark.parametrize(("raw", "want"), [("17.0", 17), (" 17.9 ", 17), ("-3.5", -3), ("", None), ("1d", None), ("abc", None), ("1e3", 1000), ("nan", None), ("1e300", None)])
def test_to_int(spark, raw, want):
    assert one(spark, parse.to_int(F.col("s")), s=raw) == want


def test_numbers_that_are_none(spark):
    assert math.isnan(one(spark, parse.to_float(F.col("s"), finite=False), s="nan"))
    assert one(spark, parse.to_float(F.col("s"), finite=False), s="-inf") == -math.inf
    assert one(spark, parse.to_int_digits(F.col("s")), s="ICSD 00123") == 123


@pytest.mark.parametrize(("f", "want"), [("MgAl2O4", {"Mg": 1, "Al": 2, "O": 4}), ("Ca(OH)2", None), ("1A", None), ("", None), ("MgAl2O4Mg", {"Mg": 2, "Al": 2, "O": 4})])
def test_strict_formula(spark, f, want):
    got = one(spark, formula.parse_strict(F.col("s")), s=f)
    assert (got and {r["e"]: r["n"] for r in got}) == want


@pytest.mark.parametrize(("f", "reduced", "ascending", "stratum"), [("MgAl2O4", "A4B2C1", "A1B2C4", "oxide|n3|r15"), ("LaMnO3", "A3B1C1", "A1B1C3", "oxide|n3|r15"), ("Ni3Al", "A3B1", "A1B3", "intermetallic|n2|rno-anion"), ("OS", "A1B1", "A1B1", "mixed-anion|n2|rall-anion")])
def test_anonymous_forms(spark, f, reduced, ascending, stratum):
    s = F.col("s")
    assert one(spark, formula.anonymous_reduced(s), s=f) == reduced
    assert one(spark, formula.anonymous_ascending(s), s=f) == ascending
    assert one(spark, formula.composition_class(s), s=f) == stratum


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (0, 0)], "k bigint, n bigint")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = df.select("n", low.alias("low"), high.alias("high")).collect()
    assert abs(rows[0]["low"]) < 1e-12
    assert abs(rows[1]["high"] - 1) < 1e-12
    assert 0 < rows[2]["low"] < 0.3 < rows[2]["high"] < 1
    assert rows[3]["low"] is None
    assert rows[3]["high"] is None


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "x double")
    assert sorted(r["r"] for r in stats.average_rank(df, "x", "r").collect()) == [1.5, 1.5, 3.0]
    rows = spark.range(500).select((F.col("id") % 37).cast("double").alias("x"))
    assert rows.count() * (rows.count() + 1) / 2 == stats.average_rank(rows, "x", "r").agg(F.sum("r")).first()[0]


def test_correlation_without_spread_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(stats.pearson("x", "y").alias("r")).first()["r"] is None


def test_stdev_floor_and_quantile(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    assert df.agg(stats.stdev_floor(F.col("x")).alias("s")).first()["s"] == 1.0
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert df.agg(F.percentile("x", 0.95).alias("p")).first()["p"] == pytest.approx(8.95)


def test_ks_of_known_samples(spark):
    df = spark.createDataFrame([(1.0, False), (2.0, False), (3.0, True), (4.0, True), (2.0, True)], "x double, g boolean")
    row = stats.ks_distance(df, "x", "g").first()
    assert (row["n0"], row["n1"]) == (2, 3)
    assert row["ks"] == pytest.approx(2 / 3)


def test_permutation_keeps_values(spark):
    df = spark.range(20).select("id", (F.col("id") * 3).alias("v"))
    out = stats.permuted(df, "id", "v", 4, seed=1).toPandas()
    for _, part in out.groupby("replica"):
        assert sorted(part.v) == [3 * i for i in range(20)]
    assert len({tuple(p.sort_values("id").v) for _, p in out.groupby("replica")}) == 4


def test_bootstrap_is_around_the_share(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("g"), (F.col("id") % 5 == 0).alias("f"))
    for r in stats.bootstrap(df, ["g"], "f", 300).collect():
        assert r["low"] <= r["k"] / r["n"] <= r["high"]


@pytest.mark.parametrize(("s", "want"), [(" n/a ", None), (";;", None), ("spinel", "spinel"), ("", None), ("UNKNOWN", None)])
def test_clean_label(spark, s, want):
    assert one(spark, text.clean_label(F.col("s")), s=s) == want


def test_fold_text(spark):
    df = spark.createDataFrame([(0, 0), (0, 3), (2, 5)], "a bigint, b bigint")
    assert [r[0] for r in df.select(text.fold_text(F.col("a"), F.col("b"))).collect()] == ["n/a", "inf", "2.5x"]


def test_mode_of_equals_takes_the_first(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "b", 4), ("k", "a", 3), ("k", None, 0)], "g string, v string, i int")
    assert tables.mode_of(df, ["g"], "v", "i").first()["v"] == "b"
    assert tables.mode_of(df, ["g"], "v").first()["v"] == "a"


def test_quartiles_leave_the_rest_to_the_last(spark):
    q = [r["quartile"] for r in tables.quartiles(spark.range(10), ["id"]).orderBy("id").collect()]
    assert q == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3]


def test_anti_join_on_null_keys(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "f string, s int")
    assert [r["f"] for r in tables.drop_known(a, a, ["f", "s"]).collect()] == ["y"]


def test_unknown_communities(spark):
    records = spark.createDataFrame([(1, 5.0), (9, 1.0)], "community bigint, distance double")
    limits = spark.createDataFrame([(1, 6.0)], "community bigint, threshold double")
    assert frame.classify(records, limits).count() == 1
    assert [r["in_basin"] for r in frame.classify(records, limits, "frontier").orderBy("community").collect()] == [True, False]
    with pytest.raises(ValueError, match="unknown"):
        frame.classify(records, limits, "other")


def test_partitions_are_not_mixed(spark):
    a = spark.createDataFrame([("p1", 1)], "partition_id string, community int")
    frame.same_partition(a, a)
    with pytest.raises(ValueError, match="different partitions"):
        frame.same_partition(a, a.withColumn("partition_id", F.lit("p2")))


def test_nearest_centroid_ties_and_slices(spark, monkeypatch):
    c = spark.createDataFrame([(3, [0.0, 1.0]), (1, [0.0, -1.0]), (2, [5.0, 5.0])], "community bigint, c array<double>")
    r = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "id bigint, v array<double>")
    whole = [tuple(x) for x in frame.nearest_centroid(r, c).orderBy("id").select("assigned_community", "distance").collect()]
    assert whole == [(1, 1.0), (2, 0.0)]
    monkeypatch.setattr(frame, "MATRIX_BYTES", 16)
    assert [tuple(x) for x in frame.nearest_centroid(r, c).orderBy("id").select("assigned_community", "distance").collect()] == whole
    assert frame.nearest_centroid(r, c.where("false")).count() == 0


def test_nearest_centroid_keeps_equal_records(spark, monkeypatch):
    c = spark.createDataFrame([(k, [float(k), float(k % 3)]) for k in range(9)], "community bigint, c array<double>")
    rows = [(1, [0.2, 0.0], {"a": 1})] * 3 + [(2, [7.9, 1.0], {}), (None, [4.4, 1.0], None)]
    r = spark.createDataFrame(rows, "id bigint, v array<double>, extras map<string,int>")
    key = lambda df: sorted((str(x["id"]), x["assigned_community"], x["distance"], str(x["extras"])) for x in df.collect())
    whole = key(frame.nearest_centroid(r, c))
    assert len(whole) == 5
    monkeypatch.setattr(frame, "MATRIX_BYTES", 48)
    assert key(frame.nearest_centroid(r, c)) == whole


def test_strict_races(spark):
    rows = spark.createDataFrame([("f", 1990, 1, 2.0), ("f", 1999, 2, 4.0), ("f", 1999, 1, 9.0), ("g", 1990, 1, 1.0), ("g", 1991, 2, 1.0)], "f string, y int, c int, x double")
    got = scoring.strict_races(rows, "f", "y", "c", "x").collect()
    assert [(r["f"], r["later_min_year"], r["first_mean"], r["later_mean"], r["first_lower"]) for r in got] == [("f", 1999, 2.0, 4.0, True)]


def test_step_change_takes_the_earliest_of_equals(spark):
    rows = spark.createDataFrame([(1, y) for y in [1990, 1995, 1995, 1996]], "community int, year int")
    r = scoring.step_changes(rows, [1992, 1993, 1994], 5, 2).first()
    assert (r["event_year"], r["n_pre"], r["n_post"], r["score"]) == (1992, 1, 3, 9.0)


def test_weight_grid_equals_direct_scores(spark):
    rows = spark.createDataFrame([("a", 0.5, 10, 4), ("b", 1.5, 3, 20), ("a", 0.1, 7, -2), ("b", 2.5, 90, 1)], "role string, stretch double, size bigint, age int")
    got = {(r["alpha"], r["beta"], r["role"]): r["mean_a"] for r in scoring.weight_grid(rows, [0.0, 1.0]).collect()}
    raw = [s - math.log1p(z) - math.log1p(max(g, 0)) for _, s, z, g in rows.collect()]
    m = sum(raw) / 4
    sd = (sum((x - m) ** 2 for x in raw) / 4) ** 0.5
    assert got[(1.0, 1.0, "a")] == pytest.approx(((raw[0] + raw[2]) / 2 - m) / sd)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_percentiles_of_many_rows_equal_those_of_few(spark, monkeypatch, by):
    df = spark.range(3000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, 1.5).otherwise(F.rand(3)).alias("x"))
    key = lambda d: sorted((str(r["g"]) if by else "", *(round(v, 9) for v in r["q"])) for r in d.collect())
    few = key(stats.percentiles(df, "x", [0.0, 0.1, 0.5, 0.95, 1.0], by))
    monkeypatch.setattr(stats, "BUFFER_ROWS", 0)
    assert key(stats.percentiles(df, "x", [0.0, 0.1, 0.5, 0.95, 1.0], by)) == few
