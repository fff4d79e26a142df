"""Queries on dated reports, scores, surveys and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.vectors import distance
from ..operators import frame, scoring, tables
from . import fixtures as fx
from .fixtures import r6

YEARS = [1997, 1998, 1999, 2000]


def first_reports(spark, sf_dir):
    out = tables.first_row(fx.report(spark, sf_dir), ["formula"], ["year", "row_ix"])
    return out.select("formula", "row_ix", "year", "community", r6("score").alias("score"))


def spearman_first_report(spark, sf_dir):
    first = tables.first_row(fx.report(spark, sf_dir), ["formula"], ["year", "row_ix"])
    a = stats.spearman(first.withColumn("x", F.round("score", 6)), "x", "row_ix")
    return a.select("n", r6("rho").alias("rho"))


def spearman_all_reports(spark, sf_dir):
    rows = fx.report(spark, sf_dir).withColumn("x", F.round("score", 6))
    return stats.spearman(rows, "x", "year").select("n", r6("rho").alias("rho"))


def polymorph_races(spark, sf_dir):
    out = scoring.races(fx.report(spark, sf_dir), "formula", "year", "score")
    return out.select("formula", "first_year", F.round("first_mean", 8).alias("first_mean"), F.round("later_mean", 8).alias("later_mean"))


def race_tally(spark, sf_dir):
    out = scoring.races(fx.report(spark, sf_dir).withColumn("score", F.col("row_ix") % 1000), "formula", "year", "score")
    return out.agg(F.count("*").alias("n"), F.sum(F.col("first_lower").cast("int")).cast("bigint").alias("n_lower"))


def strict_polymorph(spark, sf_dir):
    out = scoring.strict_races(fx.report(spark, sf_dir), "formula", "year", "community", "score", gap=3)
    return out.select("formula", "first_year", "later_min_year", F.round("first_mean", 8).alias("first_mean"), F.round("later_mean", 8).alias("later_mean"))


def class_centered(spark, sf_dir):
    out = tables.centre(fx.report(spark, sf_dir).withColumn("k", F.concat("class", F.lit("|"), (F.col("community") % 30).cast("string"))), "k", "score", 20, "centred")
    return out.select("row_ix", "k", r6("centred").alias("centred"))


def class_min_rank(spark, sf_dir):
    """Smallest rank of the year within a class, counted over distinct years."""
    rows = fx.report(spark, sf_dir).groupBy("formula", "year").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return rows.withColumn("rank", F.rank().over(Window.partitionBy("formula").orderBy("year")).cast("bigint"))


def ks_two_sample(spark, sf_dir):
    rows = fx.report(spark, sf_dir).withColumn("x", F.round("score", 6)).withColumn("g", F.col("class") == "R")
    return stats.ks_distance(rows, "x", "g").select("n0", "n1", r6("ks").alias("ks"))


def decile_contrast(spark, sf_dir):
    rows = fx.report(spark, sf_dir).withColumn("x", F.round("score", 6))
    out = scoring.decile_contrast(rows, "x", "in_basin")
    return out.select(*[r6(c).alias(c) for c in ("lo", "hi", "bottom_rate", "top_rate", "ratio")])


def matched_strata_rates(spark, sf_dir):
    rows = fx.report(spark, sf_dir).withColumn("stratum", F.concat((F.col("formula") % 200).cast("string"), F.lit("|"), (F.col("community") % 7).cast("string")))
    out = scoring.matched_rates(rows.where("class = 'A'"), rows.where("class = 'R' and year >= 1998"), "stratum", "in_basin")
    return out.select("side", "matched", "n", "k", *[r6(c).alias(c) for c in ("rate", "low", "high")])


def prior_quadrants(spark, sf_dir):
    rows = fx.report(spark, sf_dir)
    seen = rows.where("year < 1996").select("formula")
    return scoring.quadrants(tables.member_flag(rows.where("year >= 1998"), seen, "formula", "seen"), ["class"], "in_basin", "seen")


def formula_first_years(spark, sf_dir):
    rows = fx.report(spark, sf_dir)
    return tables.earliest([rows.where("class = 'A'"), rows.where("class = 'R'")], "formula", "year")


def last_wins_lookup(spark, sf_dir):
    rows = fx.report(spark, sf_dir).withColumn("label", F.concat("class", F.col("community").cast("string")))
    return tables.last_wins([rows.where("class <> 'N'"), rows.where("class = 'N' and year < 1999")], "formula", "label", "row_ix")


def dedup_anti_join(spark, sf_dir):
    rows = fx.report(spark, sf_dir)
    known = rows.where("year < 1998").select("formula", "community").distinct()
    return tables.drop_known(rows.where("year >= 1998"), known, ["formula", "community"]).groupBy("year").agg(F.count("*").alias("n"))


def left_default_lookup(spark, sf_dir):
    rows = fx.report(spark, sf_dir)
    side = fx.table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("community"), F.col("s_nationkey").cast("bigint").alias("nation"))
    return tables.lookup(rows, side, "community", "nation", -1).groupBy("nation").agg(F.count("*").alias("n"))


def formulas_in_both(spark, sf_dir):
    rows = fx.report(spark, sf_dir)
    a, b = rows.where("class = 'A' and year = 1996").select("formula"), rows.where("class = 'N'").select("formula")
    return a.intersect(b)


def communities_only_later(spark, sf_dir):
    rows = fx.report(spark, sf_dir)
    late, early = rows.where("year > 1999").select("formula", "community").distinct(), rows.where("year <= 1999").select("formula", "community").distinct()
    return late.join(early, ["formula", "community"], "left_anti").groupBy("formula").agg(F.count("*").alias("n"))


def labelled_union(spark, sf_dir):
    rows = fx.report(spark, sf_dir)
    return rows.where("class = 'A'").select("community").union(rows.where("year = 2000").select("community")).distinct()


def accessibility_scores(spark, sf_dir):
    rows = fx.entity(spark, sf_dir)
    at = frame.frame_at(rows, 2000, width=fx.WIDTH)
    train, late = frame.split(frame.known(rows), 2000)
    own = train.join(at.select("community", "c"), "community").withColumn("distance", distance("v", "c"))
    base = scoring.raw_scores(own, at, F.lit(2000))
    probe = frame.nearest_centroid(late.select("vec_id", "year", F.col("w").alias("v")), at, out="community")
    out = scoring.standardise(scoring.raw_scores(probe, at, F.col("year")), base)
    return out.select("vec_id", "community", r6("raw").alias("raw"), r6("a_i").alias("a_i"))


def _role_rows(spark, sf_dir):
    rows = frame.known(fx.entity(spark, sf_dir)).where("year is not null")
    at = frame.frame_at(rows, width=fx.WIDTH)
    m = rows.join(at, "community").withColumn("d", distance("v", "c"))
    role = F.when(F.col("year") == F.col("birth_year"), "birth").when(F.col("d") <= F.col("median"), "core").otherwise("periphery")
    return m.select("vec_id", role.alias("role"), F.log1p(F.col("d") / F.greatest("threshold", F.lit(1e-8))).alias("stretch"), F.col("n").alias("size"), (F.lit(2019) - F.col("birth_year")).alias("age"))


def accessibility_groups(spark, sf_dir):
    """Mean score of each role and its share above the ninetieth percentile of all."""
    rows = _role_rows(spark, sf_dir)
    raw = rows.withColumn("raw", F.col("stretch") - 0.5 * F.log1p("size") - 0.5 * F.log1p(F.greatest(F.col("age").cast("double"), F.lit(0.0))))
    a = scoring.standardise(raw, raw)
    cut = stats.percentiles(a, "a_i", [0.9]).select(F.col("q")[0].alias("p90"))
    out = a.crossJoin(F.broadcast(cut)).groupBy("role").agg(F.count("*").alias("n"), F.avg("a_i").alias("mean_a"), F.avg((F.col("a_i") > F.col("p90")).cast("double")).alias("above_p90"))
    return out.select("role", "n", r6("mean_a").alias("mean_a"), r6("above_p90").alias("above_p90"))


def accessibility_grid(spark, sf_dir):
    out = scoring.weight_grid(_role_rows(spark, sf_dir), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    return out.select("alpha", "beta", "role", "n", r6("mean_a").alias("mean_a"))


def step_change_survey(spark, sf_dir):
    out = scoring.step_changes(fx.event_year(spark, sf_dir), YEARS, 3, 50)
    return out.select("community", "size", "event_year", "n_pre", "n_post", r6("score").alias("score"), r6("fold").alias("fold"))


def event_probe(spark, sf_dir):
    return scoring.event_counts(fx.event_year(spark, sf_dir), 1998, 3)


def dense_year_histogram(spark, sf_dir):
    rows = fx.report(spark, sf_dir).where("formula % 3 = 0 and class = 'R'").select("formula", F.col("year").cast("int").alias("year"))
    return tables.dense_years(rows, "formula")


def functional_rollup(spark, sf_dir):
    out = tables.two_levels(fx.population(spark, sf_dir), "population", "class", F.col("flag"))
    return out.select("population", F.coalesce("class", F.lit("all")).alias("class"), "n", "k", r6(F.col("k") / F.col("n")).alias("rate"))


def functional_bootstrap(spark, sf_dir):
    return stats.bootstrap(fx.population(spark, sf_dir), ["population", "class"], "flag").select("population", "class", "n", "k", r6("low").alias("low"), r6("high").alias("high"))


def wilson_by_class(spark, sf_dir):
    out = fx.population(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("int")).cast("bigint").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return out.select("class", "n", "k", r6(low).alias("low"), r6(high).alias("high"))


def space_group_diversity(spark, sf_dir):
    """Distinct suppliers per part, and the share of the most frequent."""
    rows = fx.report(spark, sf_dir)
    n = rows.groupBy("formula").agg(F.count("*").alias("size"), F.count_distinct("community").alias("distinct")).where("size >= 5")
    top = tables.mode_of(rows, ["formula"], "community", "row_ix").withColumnRenamed("n", "top_n")
    return n.join(top, "formula").select("formula", "size", "distinct", F.col("community").alias("dominant"), r6(F.col("top_n") / F.col("size")).alias("dominant_share"))


def top_formulas_per_community(spark, sf_dir):
    out = tables.top_values(fx.report(spark, sf_dir), ["community"], "formula", 8)
    return out.select("community", "formula", "n", F.col("rk").cast("bigint").alias("rk"))


def first_examples(spark, sf_dir):
    out = tables.first_rows(fx.report(spark, sf_dir), ["community"], ["row_ix"], 5)
    return out.select("community", "row_ix", F.col("at").cast("bigint").alias("at"))


def largest_and_rest(spark, sf_dir):
    sizes = fx.report(spark, sf_dir).groupBy("class", "community").agg(F.count("*").alias("size"))
    out = tables.top_and_other(sizes, "class", "community", "size", 25)
    return out.select("class", "community", F.col("size").cast("bigint").alias("size"), "n_items")


def large_or_ten(spark, sf_dir):
    sizes = fx.report(spark, sf_dir).groupBy("formula").agg(F.count("*").alias("size"))
    return tables.at_least_some(sizes, "size", 48, 10, ["formula"])


def family_roll_up(spark, sf_dir):
    """Size-weighted mean birth year per class and community, per class, and over all."""
    rows = fx.report(spark, sf_dir).groupBy("class", "community").agg(F.count("*").alias("size"), F.min("year").alias("birth"))
    out = rows.rollup("class", "community").agg(F.sum("size").cast("bigint").alias("size"), (F.sum(F.col("birth") * F.col("size")) / F.sum("size")).alias("mean_birth"))
    return out.select("class", "community", "size", r6("mean_birth").alias("mean_birth"))


def degree_quartiles(spark, sf_dir):
    from ..operators import graph

    deg = graph.degree(fx.network(spark, sf_dir))
    return tables.quartiles(deg, ["degree", "node"]).groupBy("quartile").agg(F.count("*").alias("n"), F.min("degree").alias("least"), F.max("degree").alias("most"))


def average_ranks(spark, sf_dir):
    rows = fx.report(spark, sf_dir).groupBy("formula").agg(F.count("*").alias("n"))
    return stats.average_rank(rows, "n", "rank").select("formula", "n", "rank")


def kth_largest(spark, sf_dir):
    """Parts at least as frequent as the 25th most frequent."""
    sizes = fx.report(spark, sf_dir).groupBy("formula").agg(F.count("*").alias("size"))
    cut = sizes.orderBy(F.desc("size"), "formula").limit(25).agg(F.min("size").alias("cut"))
    return sizes.join(F.broadcast(cut), F.col("size") >= F.col("cut")).select("formula", "size")


def forward_fill(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("g"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).alias("p"))
    return tables.forward_fill(rows, "o_orderkey", ["p"], ["g"])


def permutation_band_fixed(spark, sf_dir):
    """Per replica the years are dealt anew by a fixed arithmetic rule; the share of late reports per class, and its band."""
    counts = fx.report(spark, sf_dir).groupBy("class", "formula").agg(F.min("year").alias("year"))
    from pyspark.sql import Window

    n = counts.count()
    rows = counts.withColumn("i", F.row_number().over(Window.orderBy("class", "formula")).cast("bigint") - 1)
    dealt = rows.crossJoin(F.broadcast(spark.range(20).withColumnRenamed("id", "replica"))).withColumn("j", ((F.col("replica") * 2 + 1) * 1000003 * F.col("i") + F.col("replica") * 7919) % n)
    years = rows.select(F.col("i").alias("j"), F.col("year").alias("dealt"))
    per = dealt.join(years, "j").groupBy("replica", "class").agg(F.avg((F.col("dealt") > 1995).cast("double")).alias("x"))
    out = scoring.null_band(per, ["class"], "x")
    return out.select("class", *[r6(c).alias(c) for c in ("mean", "p05", "p50", "p95")])


def permutation_band(spark, sf_dir):
    """The same with a seeded hash order."""
    rows = fx.event_year(spark, sf_dir).groupBy("community").agg(F.min("year").alias("year"), F.count("*").alias("n"))
    per = stats.permuted(rows, "community", "year", 100).groupBy("replica", (F.col("community") % 4).alias("g")).agg(F.avg("year").alias("x"))
    out = scoring.null_band(per, ["g"], "x")
    return out.select("g", *[r6(c).alias(c) for c in ("mean", "p05", "p50", "p95")])


def null_band_flags(spark, sf_dir):
    band = permutation_band_fixed(spark, sf_dir)
    seen = fx.report(spark, sf_dir).groupBy("class", "formula").agg(F.min("year").alias("year")).groupBy("class").agg(F.avg((F.col("year") > 1995).cast("double")).alias("x"))
    return scoring.band_flags(seen, band, ["class"], "x").select("class", r6("x").alias("x"), "below", "above")


def outcomes(spark, sf_dir):
    t = fx.table(spark, sf_dir, "alab_targets")
    return t.groupBy(tables.outcome(F.col("raw_result"), F.col("conclusion")).alias("outcome")).agg(F.count_distinct("target_id").alias("n"))


def stdev_with_floor(spark, sf_dir):
    rows = fx.report(spark, sf_dir)
    out = rows.groupBy("formula").agg(F.count("*").alias("n"), stats.stdev_floor(F.col("community")).alias("sample"), stats.stdev_floor(F.col("community"), True).alias("population"), stats.mean_or_zero(F.when(F.col("in_basin"), F.col("score"))).alias("mean"))
    return out.select("formula", "n", *[r6(c).alias(c) for c in ("sample", "population", "mean")])


def pearson_by_class(spark, sf_dir):
    rows = fx.report(spark, sf_dir).withColumn("c", F.col("community").cast("double")).withColumn("y", F.col("year").cast("double"))
    return rows.groupBy("class").agg(F.count("*").alias("n"), r6(stats.pearson("c", "y")).alias("r"))


_R, _Y, _P, _E = fx.REPORT, fx.EVENT_YEAR, fx.POPULATION, fx.ENTITY
_FIRST = "fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY year, row_ix) AS rn FROM fx_report) WHERE rn = 1)"
_RHO = """rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM xy)"""
_RACE = """fy AS (SELECT formula, min(year) AS first_year FROM fx_report GROUP BY formula),
ra AS (SELECT formula, first_year, avg(CASE WHEN year = first_year THEN s END) AS a, avg(CASE WHEN year > first_year THEN s END) AS b FROM (SELECT *, {} AS s FROM fx_report) JOIN fy USING (formula) GROUP BY ALL)"""
_low, _high = fx.wilson("k", "n")
_AT = [_E, "train AS (SELECT * FROM fx_entity WHERE year <= 2000 AND community >= 0)", fx.centres("train"), fx.members("train"), "lim AS (SELECT community, quantile_cont(d, 0.95) AS t, count(*) AS n, min(year) AS b FROM members GROUP BY community)"]
_RAW = "ln(1 + {d} / greatest(t, 1e-6)) - 0.5 * ln(1 + n) - 0.5 * ln(1 + greatest({y} - b, 0))"
_ALL = [_E, "dated AS (SELECT * FROM fx_entity WHERE year IS NOT NULL AND community >= 0)", fx.centres("dated"), fx.members("dated"), "lim AS (SELECT community, quantile_cont(d, 0.95) AS t, median(d) AS med, count(*) AS n, min(year) AS b FROM members GROUP BY community)",
    "ro AS (SELECT vec_id, CASE WHEN year = b THEN 'birth' WHEN d <= med THEN 'core' ELSE 'periphery' END AS role, ln(1 + d / greatest(t, 1e-8)) AS s, ln(1 + n) AS z, ln(1 + greatest(2019 - b, 0)) AS g FROM members JOIN lim USING (community))"]
_PERM = """c AS (SELECT class, formula, min(year) AS year FROM fx_report GROUP BY ALL), n AS (SELECT count(*) AS n FROM c), rw AS (SELECT *, row_number() OVER (ORDER BY class, formula) - 1 AS i FROM c),
de AS (SELECT replica, class, ((replica * 2 + 1) * 1000003 * i + replica * 7919) % n AS j FROM rw, n, (SELECT unnest(range(20)) AS replica)),
pr AS (SELECT replica, de.class, avg((rw.year > 1995)::INT::DOUBLE) AS x FROM de JOIN rw ON de.j = rw.i GROUP BY ALL),
band AS (SELECT class, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95 FROM pr GROUP BY class)"""

SQL = {
    "first_reports": fx.sql(_R, _FIRST, select="SELECT formula, row_ix, year, community, round(score, 6) AS score FROM fr"),
    "spearman_first_report": fx.sql(_R, _FIRST, "xy AS (SELECT round(score, 6) AS x, row_ix AS y FROM fr)", _RHO, select="SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk"),
    "spearman_all_reports": fx.sql(_R, "xy AS (SELECT round(score, 6) AS x, year AS y FROM fx_report)", _RHO, select="SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk"),
    "polymorph_races": fx.sql(_R, _RACE.format("score"), select="SELECT formula, first_year, round(a, 8) AS first_mean, round(b, 8) AS later_mean FROM ra WHERE b IS NOT NULL"),
    "race_tally": fx.sql(_R, _RACE.format("row_ix % 1000"), select="SELECT count(*) AS n, sum((a < b)::INT)::BIGINT AS n_lower FROM ra WHERE b IS NOT NULL"),
    "strict_polymorph": fx.sql(_R, "fy AS (SELECT formula, min(year) AS first_year FROM fx_report GROUP BY formula HAVING count(DISTINCT community) >= 2 AND count(DISTINCT year) > 1)", "al AS (SELECT r.*, first_year FROM fx_report r JOIN fy USING (formula))", "lt AS (SELECT * FROM al a WHERE year >= first_year + 3 AND NOT EXISTS (SELECT 1 FROM al b WHERE b.formula = a.formula AND b.community = a.community AND b.year = b.first_year))", "x AS (SELECT formula, first_year, avg(score) AS a FROM al WHERE year = first_year GROUP BY ALL)", "y AS (SELECT formula, min(year) AS m, avg(score) AS b FROM lt GROUP BY formula)",
        select="SELECT formula, first_year, m AS later_min_year, round(a, 8) AS first_mean, round(b, 8) AS later_mean FROM x JOIN y USING (formula)"),
    "class_centered": fx.sql(_R, "k AS (SELECT *, class || '|' || CAST(community % 30 AS VARCHAR) AS k FROM fx_report)", select="SELECT row_ix, k, round(score - avg(score) OVER (PARTITION BY k), 6) + 0 AS centred FROM k QUALIFY count(*) OVER (PARTITION BY k) >= 20"),
    "class_min_rank": fx.sql(_R, select="SELECT formula, year, count(*) AS n, rank() OVER (PARTITION BY formula ORDER BY year) AS rank FROM fx_report GROUP BY formula, year"),
    "ks_two_sample": fx.sql(_R, "x AS (SELECT round(score, 6) AS x, class = 'R' AS g FROM fx_report)", "c AS (SELECT x, sum((NOT g)::INT) AS a, sum(g::INT) AS b FROM x GROUP BY x)", "u AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb FROM c)", "t AS (SELECT sum(a) AS n0, sum(b) AS n1 FROM c)",
        select="SELECT n0::BIGINT AS n0, n1::BIGINT AS n1, round(max(abs(ca::DOUBLE / n0 - cb::DOUBLE / n1)), 6) AS ks FROM u, t GROUP BY n0, n1"),
    "decile_contrast": fx.sql(_R, "x AS (SELECT round(score, 6) AS x, in_basin::INT::DOUBLE AS f FROM fx_report)", "q AS (SELECT quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM x)", "r AS (SELECT lo, hi, avg(CASE WHEN x <= lo THEN f END) AS a, avg(CASE WHEN x >= hi THEN f END) AS b FROM x, q GROUP BY ALL)", select="SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, round(a, 6) AS bottom_rate, round(b, 6) AS top_rate, round(a / greatest(b, 1e-9), 6) AS ratio FROM r"),
    "matched_strata_rates": fx.sql(_R, "s AS (SELECT *, CAST(formula % 200 AS VARCHAR) || '|' || CAST(community % 7 AS VARCHAR) AS st FROM fx_report)", "a AS (SELECT * FROM s WHERE class = 'A')", "b AS (SELECT * FROM s WHERE class = 'R' AND year >= 1998)", "sh AS (SELECT st FROM a INTERSECT SELECT st FROM b)",
        "c AS (SELECT 'known' AS side, false AS matched, count(*) AS n, coalesce(sum(in_basin::INT), 0)::BIGINT AS k FROM a UNION ALL SELECT 'source', false, count(*), coalesce(sum(in_basin::INT), 0)::BIGINT FROM b UNION ALL SELECT 'known', true, count(*), coalesce(sum(in_basin::INT), 0)::BIGINT FROM a WHERE st IN (FROM sh) UNION ALL SELECT 'source', true, count(*), coalesce(sum(in_basin::INT), 0)::BIGINT FROM b WHERE st IN (FROM sh))",
        select=f"SELECT side, matched, n, k, round(k / n, 6) AS rate, round({_low}, 6) + 0 AS low, round({_high}, 6) + 0 AS high FROM c"),
    "prior_quadrants": fx.sql(_R, "x AS (SELECT *, formula IN (SELECT formula FROM fx_report WHERE year < 1996) AS seen FROM fx_report WHERE year >= 1998)", select="SELECT class, count(*) AS n, sum((in_basin AND seen)::INT)::BIGINT AS in_seen, sum((in_basin AND NOT seen)::INT)::BIGINT AS in_new, sum((NOT in_basin AND seen)::INT)::BIGINT AS out_seen, sum((NOT in_basin AND NOT seen)::INT)::BIGINT AS out_new FROM x GROUP BY class"),
    "formula_first_years": fx.sql(_R, select="SELECT formula, min(year) AS year FROM fx_report WHERE class IN ('A', 'R') GROUP BY formula"),
    "last_wins_lookup": fx.sql(_R, "x AS (SELECT 0 AS t, * FROM fx_report WHERE class <> 'N' UNION ALL SELECT 1, * FROM fx_report WHERE class = 'N' AND year < 1999)", select="SELECT formula, class || CAST(community AS VARCHAR) AS label FROM x QUALIFY row_number() OVER (PARTITION BY formula ORDER BY t DESC, row_ix DESC) = 1"),
    "dedup_anti_join": fx.sql(_R, select="SELECT year, count(*) AS n FROM fx_report a WHERE year >= 1998 AND NOT EXISTS (SELECT 1 FROM fx_report b WHERE b.year < 1998 AND a.formula = b.formula AND a.community = b.community) GROUP BY year"),
    "left_default_lookup": fx.sql(_R, select="SELECT coalesce(s_nationkey, -1)::BIGINT AS nation, count(*) AS n FROM fx_report LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 3000) ON community = s_suppkey GROUP BY 1"),
    "formulas_in_both": fx.sql(_R, select="SELECT formula FROM fx_report WHERE class = 'A' AND year = 1996 INTERSECT SELECT formula FROM fx_report WHERE class = 'N'"),
    "communities_only_later": fx.sql(_R, "x AS (SELECT formula, community FROM fx_report WHERE year > 1999 EXCEPT SELECT formula, community FROM fx_report WHERE year <= 1999)", select="SELECT formula, count(*) AS n FROM x GROUP BY formula"),
    "labelled_union": fx.sql(_R, select="SELECT community FROM fx_report WHERE class = 'A' UNION SELECT community FROM fx_report WHERE year = 2000"),
    "accessibility_scores": fx.sql(*_AT, f"ba AS (SELECT {_RAW.format(d='d', y='2000')} AS raw FROM members JOIN lim USING (community))", "mo AS (SELECT avg(raw) AS m, coalesce(nullif(stddev_samp(raw), 0), 1) AS s FROM ba)", "late AS (SELECT vec_id, year, w FROM fx_entity WHERE year > 2000 AND community >= 0)", fx.nearest("late", "centres", "w"),
        f"sc AS (SELECT vec_id, assigned_community, {_RAW.format(d='distance', y='year')} AS raw FROM projected p JOIN lim l ON p.assigned_community = l.community)", select="SELECT vec_id, assigned_community AS community, round(raw, 6) + 0 AS raw, round((raw - m) / s, 6) + 0 AS a_i FROM sc, mo"),
    "accessibility_groups": fx.sql(*_ALL, "ra AS (SELECT role, s - 0.5 * z - 0.5 * g AS raw FROM ro)", "a AS (SELECT role, (raw - avg(raw) OVER ()) / coalesce(nullif(stddev_samp(raw) OVER (), 0), 1) AS a FROM ra)", "c AS (SELECT quantile_cont(a, 0.9) AS p FROM a)", select="SELECT role, count(*) AS n, round(avg(a), 6) + 0 AS mean_a, round(avg((a > p)::INT::DOUBLE), 6) AS above_p90 FROM a, c GROUP BY role"),
    "accessibility_grid": fx.sql(*_ALL, "st AS (SELECT unnest([0, 0.2, 0.4, 0.6, 0.8, 1]::DOUBLE[]) AS x)", "ra AS (SELECT a.x AS alpha, b.x AS beta, role, s - a.x * z - b.x * g AS raw FROM ro, st a, st b)", "zs AS (SELECT alpha, beta, role, (raw - avg(raw) OVER (PARTITION BY alpha, beta)) / nullif(stddev_pop(raw) OVER (PARTITION BY alpha, beta), 0) AS a FROM ra)", select="SELECT alpha, beta, role, count(*) AS n, round(avg(coalesce(a, 0)), 6) + 0 AS mean_a FROM zs GROUP BY ALL"),
    "step_change_survey": fx.sql(_Y, "sz AS (SELECT community, count(*) AS size FROM fx_event_year GROUP BY community HAVING count(*) >= 50)", f"ev AS (SELECT unnest({YEARS}::INTEGER[]) AS event_year)", "ct AS (SELECT community, size, event_year, sum((year > event_year - 3 AND year <= event_year)::INT)::BIGINT AS n_pre, sum((year > event_year AND year <= event_year + 3)::INT)::BIGINT AS n_post FROM fx_event_year JOIN sz USING (community), ev GROUP BY ALL)", "sc AS (SELECT *, CASE WHEN n_pre > 0 THEN n_post / n_pre END AS fold, coalesce(n_post / nullif(n_pre, 0) * n_post, n_post) AS score FROM ct)",
        select="SELECT community, size, event_year, n_pre, n_post, round(score, 6)::DOUBLE AS score, round(fold, 6)::DOUBLE AS fold FROM sc QUALIFY row_number() OVER (PARTITION BY community ORDER BY score DESC, event_year) = 1"),
    "event_probe": fx.sql(_Y, "c AS (SELECT community, sum((year > 1995 AND year <= 1998)::INT)::BIGINT AS n_pre, sum((year > 1998 AND year <= 2001)::INT)::BIGINT AS n_post FROM fx_event_year GROUP BY community)", select="SELECT community, n_pre, n_post, CASE WHEN n_pre = 0 AND n_post = 0 THEN 'n/a' WHEN n_pre = 0 THEN 'inf' ELSE printf('%.1fx', n_post::DOUBLE / n_pre) END AS fold_text FROM c"),
    "dense_year_histogram": fx.sql(_R, "x AS (SELECT formula, year FROM fx_report WHERE formula % 3 = 0 AND class = 'R')", "sp AS (SELECT formula, unnest(generate_series(min(year), max(year))) AS year FROM x GROUP BY formula)", select="SELECT formula, sp.year::INTEGER AS year, count(x.year) AS n FROM sp LEFT JOIN x USING (formula, year) GROUP BY ALL"),
    "functional_rollup": fx.sql(_P, select="SELECT population, coalesce(class, 'all') AS class, count(*) AS n, sum(flag::INT)::BIGINT AS k, round(avg(flag::INT::DOUBLE), 6) AS rate FROM fx_population WHERE class IS NOT NULL GROUP BY GROUPING SETS ((population, class), (population))"),
    "wilson_by_class": fx.sql(_P, "c AS (SELECT class, count(*) AS n, sum(flag::INT)::BIGINT AS k FROM fx_population GROUP BY class)", select=f"SELECT class, n, k, round({_low}, 6) + 0 AS low, round({_high}, 6) + 0 AS high FROM c"),
    "space_group_diversity": fx.sql(_R, "s AS (SELECT formula, count(*) AS size, count(DISTINCT community) AS dis FROM fx_report GROUP BY formula HAVING count(*) >= 5)", "m AS (SELECT formula, community, count(*) AS n, min(row_ix) AS f FROM fx_report GROUP BY ALL)", "t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY formula ORDER BY n DESC, f) = 1)", select="SELECT formula, size, dis AS \"distinct\", community AS dominant, round(n / size, 6) AS dominant_share FROM s JOIN t USING (formula)"),
    "top_formulas_per_community": fx.sql(_R, select="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, formula) AS rk FROM (SELECT community, formula, count(*) AS n FROM fx_report GROUP BY community, formula)) WHERE rk <= 8"),
    "first_examples": fx.sql(_R, select="SELECT * FROM (SELECT community, row_ix, row_number() OVER (PARTITION BY community ORDER BY row_ix) AS \"at\" FROM fx_report) WHERE \"at\" <= 5"),
    "largest_and_rest": fx.sql(_R, "s AS (SELECT class, community, count(*) AS size, row_number() OVER (PARTITION BY class ORDER BY count(*) DESC, community) AS rn FROM fx_report GROUP BY class, community)", select="SELECT class, CASE WHEN rn <= 25 THEN CAST(community AS VARCHAR) ELSE 'other' END AS community, sum(size)::BIGINT AS size, count(*) AS n_items FROM s GROUP BY 1, 2"),
    "large_or_ten": fx.sql(_R, "s AS (SELECT formula, count(*) AS size FROM fx_report GROUP BY formula)", select="SELECT formula, size FROM s QUALIFY size >= 48 OR row_number() OVER (ORDER BY size DESC, formula) <= 10"),
    "family_roll_up": fx.sql(_R, "s AS (SELECT class, community, count(*) AS size, min(year) AS birth FROM fx_report GROUP BY ALL)", select="SELECT class, community, sum(size)::BIGINT AS size, round(sum(birth * size)::DOUBLE / sum(size), 6) AS mean_birth FROM s GROUP BY ROLLUP (class, community)"),
    "degree_quartiles": fx.sql(fx.NETWORK, "nb AS (SELECT src AS a FROM fx_network UNION ALL SELECT dst FROM fx_network)", "d AS (SELECT a AS node, count(*) AS degree FROM nb GROUP BY a)", "q AS (SELECT degree, least((row_number() OVER (ORDER BY degree, node) - 1) // greatest(1, (count(*) OVER ()) // 4), 3)::INTEGER AS quartile FROM d)", select="SELECT quartile, count(*) AS n, min(degree) AS least, max(degree) AS most FROM q GROUP BY quartile"),
    "average_ranks": fx.sql(_R, "c AS (SELECT formula, count(*) AS n FROM fx_report GROUP BY formula)", select="SELECT formula, n, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0)::DOUBLE AS rank FROM c"),
    "kth_largest": fx.sql(_R, "s AS (SELECT formula, count(*) AS size FROM fx_report GROUP BY formula)", select="SELECT formula, size FROM s WHERE size >= (SELECT min(size) FROM (SELECT size FROM s ORDER BY size DESC, formula LIMIT 25))"),
    "forward_fill": "SELECT o_orderkey, o_custkey % 20 AS g, last_value(CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS p FROM orders",
    "permutation_band_fixed": fx.sql(_R, _PERM, select="SELECT * FROM band"),
    "null_band_flags": fx.sql(_R, _PERM, "ob AS (SELECT class, avg((year > 1995)::INT::DOUBLE) AS x FROM c GROUP BY class)", select="SELECT class, round(x, 6) AS x, x < p05 AS below, x > p95 AS above FROM ob JOIN band USING (class)"),
    "outcomes": "SELECT CASE WHEN trim(raw_result) = 'Success (offline)' THEN 'offline_recovery' WHEN contains(lower(coalesce(conclusion, '')), 'inconclusive') THEN 'inconclusive' WHEN trim(coalesce(conclusion, '')) <> '' THEN 'made' ELSE 'not_obtained' END AS outcome, count(DISTINCT target_id) AS n FROM alab_targets GROUP BY 1",
    "stdev_with_floor": fx.sql(_R, select="SELECT formula, count(*) AS n, round(coalesce(nullif(stddev_samp(community), 0), 1), 6) AS sample, round(coalesce(nullif(stddev_pop(community), 0), 1), 6) AS population, round(coalesce(avg(CASE WHEN in_basin THEN score END), 0), 6) AS mean FROM fx_report GROUP BY formula"),
    "pearson_by_class": fx.sql(_R, select="SELECT class, count(*) AS n, round(corr(community, year), 6) + 0 AS r FROM fx_report GROUP BY class"),
}

QUERIES = {f.__name__: f for f in (
    first_reports, spearman_first_report, spearman_all_reports, polymorph_races, race_tally, strict_polymorph, class_centered, class_min_rank, ks_two_sample, decile_contrast, matched_strata_rates, prior_quadrants,
    formula_first_years, last_wins_lookup, dedup_anti_join, left_default_lookup, formulas_in_both, communities_only_later, labelled_union, accessibility_scores, accessibility_groups, accessibility_grid, step_change_survey,
    event_probe, dense_year_histogram, functional_rollup, functional_bootstrap, wilson_by_class, space_group_diversity, top_formulas_per_community, first_examples, largest_and_rest, large_or_ten, family_roll_up,
    degree_quartiles, average_ranks, kth_largest, forward_fill, permutation_band_fixed, permutation_band, null_band_flags, outcomes, stdev_with_floor, pearson_by_class,
)}
