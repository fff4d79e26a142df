"""Accessibility scores and what is tested with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import tables


def raw_scores(records: DataFrame, frame: DataFrame, observed: Column, alpha: float = 0.5, beta: float = 0.5, floor: float = 1e-6, missing_birth: int = 2010) -> DataFrame:
    """Adds ``raw`` to records with ``community`` and ``distance``; ``frame`` is of ``frame.frame_at``. ``observed`` is the year
    from which the age of a community counts; one without a birth year counts as born in ``missing_birth``."""
    side = frame.select("community", F.col("n").alias("_n"), F.col("threshold").alias("_t"), F.coalesce("birth_year", F.lit(missing_birth)).alias("_b"))
    joined = records.join(side, "community")
    return joined.withColumn("raw", stats.accessibility(F.col("distance"), F.col("_t"), F.col("_n"), observed - F.col("_b"), alpha, beta, floor)).drop("_n", "_t", "_b")


def standardise(df: DataFrame, reference: DataFrame, x: str = "raw", out: str = "a_i", population: bool = False) -> DataFrame:
    """Adds x in deviations from the mean of the reference rows."""
    moments = reference.agg(F.avg(x).alias("_m"), stats.stdev_floor(F.col(x), population).alias("_s"))
    return df.crossJoin(F.broadcast(moments)).withColumn(out, stats.z_score(F.col(x), F.col("_m"), F.col("_s"))).drop("_m", "_s")  # one row


def races(df: DataFrame, key: str, year: str, x: str) -> DataFrame:
    """``key, first_year, first_mean, later_mean, first_lower``: keys with several years, the mean of x in the first against
    that of all later ones."""
    rows = df.where(F.col(key).isNotNull() & F.col(year).isNotNull())
    births = rows.groupBy(key).agg(F.min(year).alias("first_year"))
    at = rows.join(births, key)
    out = at.groupBy(key, "first_year").agg(F.avg(F.when(F.col(year) == F.col("first_year"), F.col(x))).alias("first_mean"), F.avg(F.when(F.col(year) > F.col("first_year"), F.col(x))).alias("later_mean"))
    return out.where(F.col("later_mean").isNotNull()).withColumn("first_lower", F.col("first_mean") < F.col("later_mean"))


def strict_races(df: DataFrame, key: str, year: str, community: str, x: str, gap: int = 5, changes: int = 2) -> DataFrame:
    """``key, first_year, later_min_year, first_mean, later_mean, first_lower``: only rows at least ``gap`` years later and in
    communities that the first year does not have count as later; keys need ``changes`` communities."""
    rows = df.where(F.col(key).isNotNull() & F.col(year).isNotNull() & F.col(community).isNotNull())
    births = rows.groupBy(key).agg(F.min(year).alias("first_year"), F.count_distinct(community).alias("_c"), F.count_distinct(year).alias("_y")).where((F.col("_c") >= changes) & (F.col("_y") > 1)).drop("_c", "_y")
    at = rows.join(births, key)
    first = at.where(F.col(year) == F.col("first_year"))
    later = at.where(F.col(year) >= F.col("first_year") + gap).join(first.select(key, community).distinct(), [key, community], "left_anti")
    a = first.groupBy(key, "first_year").agg(F.avg(x).alias("first_mean"))
    b = later.groupBy(key).agg(F.min(year).alias("later_min_year"), F.avg(x).alias("later_mean"))
    return a.join(b, key).withColumn("first_lower", F.col("first_mean") < F.col("later_mean"))


def decile_contrast(df: DataFrame, x: str, flag: str) -> DataFrame:
    """One row ``lo, hi, bottom_rate, top_rate, ratio``: the share of the flag at or below the tenth percentile and at or above
    the ninetieth, and their ratio over at least 1e-9."""
    cuts = stats.percentiles(df, x, [0.1, 0.9], out="_q")
    rows = df.crossJoin(F.broadcast(cuts)).select(F.col(x).alias("x"), F.col(flag).cast("double").alias("f"), F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))  # one row
    out = rows.groupBy("lo", "hi").agg(F.avg(F.when(F.col("x") <= F.col("lo"), F.col("f"))).alias("bottom_rate"), F.avg(F.when(F.col("x") >= F.col("hi"), F.col("f"))).alias("top_rate"))
    return out.withColumn("ratio", F.col("bottom_rate") / F.greatest("top_rate", F.lit(1e-9)))


def threshold_sweep(members: DataFrame, projected: DataFrame, percents: list[float]) -> DataFrame:
    """``pct, n, k, rate``: how many projected records lie in their basin as its percentile varies. All percentiles of a
    community come from one pass."""
    cuts = stats.percentiles(members, "d", [p / 100 for p in percents], ["community"], "_q")
    at = projected.join(cuts, "community").select("distance", F.posexplode("_q").alias("_k", "_t"))
    pct = F.element_at(F.array(*[F.lit(float(p)) for p in percents]), F.col("_k") + 1)
    return at.groupBy(pct.alias("pct")).agg(F.count("*").alias("n"), F.sum((F.col("distance") <= F.col("_t")).cast("int")).cast("bigint").alias("k")).withColumn("rate", F.col("k") / F.col("n"))


def weight_grid(rows: DataFrame, steps: list[float], by: str = "role") -> DataFrame:
    """``alpha, beta, by, n, mean_a``: mean standardised score of each role over a grid of both weights. The rows need
    ``stretch``, ``size`` and ``age``; the score is standardised anew, with the population deviation, in every cell.

    A score is linear in the weights, so its moments in a cell follow from sums over the rows: the rows are read once and the
    grid only meets the sums.
    """
    r = rows.select(by, F.col("stretch").alias("s"), F.log1p("size").alias("z"), F.log1p(F.greatest(F.col("age").cast("double"), F.lit(0.0))).alias("g"))
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in ("s", "z", "g")], *[F.sum(F.col(a) * F.col(b)).alias(f"q_{a}{b}") for a, b in ("ss", "zz", "gg", "sz", "sg", "zg")]]
    per = r.groupBy(by).agg(*sums)
    total = per.agg(*[F.sum(c).alias(f"t_{c}") for c in per.columns if c != by])
    spark = rows.sparkSession
    grid = spark.createDataFrame([(float(a), float(b)) for a in steps for b in steps], "alpha double, beta double")
    cell = per.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(grid))  # roles, one row, a few dozen
    a, b, n = F.col("alpha"), F.col("beta"), F.col("t_n")
    mean = (F.col("t_s_s") - a * F.col("t_s_z") - b * F.col("t_s_g")) / n
    square = (F.col("t_q_ss") + a * a * F.col("t_q_zz") + b * b * F.col("t_q_gg") - 2 * a * F.col("t_q_sz") - 2 * b * F.col("t_q_sg") + 2 * a * b * F.col("t_q_zg")) / n
    sd = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    own = (F.col("s_s") - a * F.col("s_z") - b * F.col("s_g")) / F.col("n")
    return cell.select("alpha", "beta", by, "n", stats.z_score(own, mean, sd).alias("mean_a"))


def matched_rates(known: DataFrame, source: DataFrame, stratum: str, flag: str) -> DataFrame:
    """One row of both sides' counts and shares of the flag, over all rows and over the strata that both have, with intervals:
    ``side, matched, n, k, rate, low, high``."""
    a, b = tables.common_strata(known, source, stratum)
    parts = None
    for side, matched, rows in (("known", False, known), ("source", False, source), ("known", True, a), ("source", True, b)):
        one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0)).cast("bigint").alias("k")).select(F.lit(side).alias("side"), F.lit(matched).alias("matched"), "n", "k")
        parts = one if parts is None else parts.unionByName(one)
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return parts.select("side", "matched", "n", "k", (F.col("k") / F.nullif(F.col("n"), F.lit(0))).alias("rate"), low.alias("low"), high.alias("high"))


def quadrants(df: DataFrame, by: list[str], basin: str, seen: str) -> DataFrame:
    """Counts of the four combinations of two flags per key."""
    b, s = F.col(basin), F.col(seen)
    count = lambda c: F.sum(c.cast("int")).cast("bigint")
    return df.groupBy(*by).agg(F.count("*").alias("n"), count(b & s).alias("in_seen"), count(b & ~s).alias("in_new"), count(~b & s).alias("out_seen"), count(~b & ~s).alias("out_new"))


def step_changes(df: DataFrame, years: list[int], window: int, least: int, key: str = "community", year: str = "year") -> DataFrame:
    """``key, size, event_year, n_pre, n_post, score, fold``: for each key of at least ``least`` dated rows the event year after
    which the most came in ``window`` years, measured against as many years up to it; of equals the earliest. The fold is null
    where nothing came before, and the score then the number that came after.

    Rows are counted per key and year first; the counts, not the rows, meet the candidate years.
    """
    counts = df.where(F.col(year).isNotNull()).groupBy(key, year).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(key).agg(F.sum("c").alias("size")).where(F.col("size") >= least)
    events = df.sparkSession.createDataFrame([(int(y),) for y in years], "event_year int")
    y, e = F.col(year), F.col("event_year")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0))
    # every eligible key is scored in every year, also where nothing came
    seen = counts.join(sizes, key).crossJoin(F.broadcast(events)).groupBy(key, "size", "event_year").agg(n((y > e - window) & (y <= e)).alias("n_pre"), n((y > e) & (y <= e + window)).alias("n_post"))
    fold = F.when(F.col("n_pre") > 0, F.col("n_post") / F.nullif(F.col("n_pre").cast("double"), F.lit(0.0)))
    seen = seen.withColumn("fold", fold).withColumn("score", F.coalesce(F.col("fold") * F.col("n_post"), F.col("n_post").cast("double")))
    best = seen.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "event_year"))).where("_at = 1")
    return best.select(key, "size", "event_year", "n_pre", "n_post", "score", "fold")


def event_counts(df: DataFrame, event_year: int, window: int, key: str = "community", year: str = "year") -> DataFrame:
    """``key, n_pre, n_post, fold_text`` around one event year."""
    from ..functions.text import fold_text

    y = F.col(year)
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    out = df.where(y.isNotNull()).groupBy(key).agg(n((y > event_year - window) & (y <= event_year)).alias("n_pre"), n((y > event_year) & (y <= event_year + window)).alias("n_post"))
    return out.withColumn("fold_text", fold_text(F.col("n_pre"), F.col("n_post")))


def family_enrichment(members: DataFrame, tags: DataFrame, key: str, community: str = "community") -> DataFrame:
    """``community, family, hits, size, total, fold``: share of a family among a community's members over its share among all.
    ``tags`` has one row per record and family."""
    size = members.groupBy(community).agg(F.count("*").alias("size"))
    everyone = members.agg(F.count("*").alias("all"))
    tagged = members.select(key, community).join(tags.select(key, "family").distinct(), key)
    hits = tagged.groupBy(community, "family").agg(F.count("*").alias("hits"))
    total = tagged.groupBy("family").agg(F.count("*").alias("total"))
    out = hits.join(size, community).join(F.broadcast(total), "family").crossJoin(F.broadcast(everyone))  # one row per family, one row
    return out.select(community, "family", "hits", "size", "total", ((F.col("hits") / F.col("size")) / (F.col("total") / F.col("all"))).alias("fold"))


def element_enrichment(df: DataFrame, elements: str, bridge: str) -> DataFrame:
    """``element, n_bridge, n_core, bridge_fraction, core_fraction, log2_enrichment`` of records that are bridges against those
    that are not."""
    sizes = df.agg(F.sum(F.col(bridge).cast("int")).alias("nb"), F.sum((~F.col(bridge)).cast("int")).alias("nc"))
    each = df.select(F.explode(elements).alias("element"), bridge).groupBy("element").agg(F.sum(F.col(bridge).cast("int")).cast("bigint").alias("n_bridge"), F.sum((~F.col(bridge)).cast("int")).cast("bigint").alias("n_core"))
    out = each.crossJoin(F.broadcast(sizes))  # one row
    pb, pc = (F.col("n_bridge") + 1) / (F.col("nb") + F.lit(2.0)), (F.col("n_core") + 1) / (F.col("nc") + F.lit(2.0))
    return out.select("element", "n_bridge", "n_core", pb.alias("bridge_fraction"), pc.alias("core_fraction"), F.log2(pb / pc).alias("log2_enrichment"))


def null_band(replicas: DataFrame, by: list[str], x: str) -> DataFrame:
    """``by, mean, p05, p50, p95`` of a statistic over replicas."""
    return replicas.groupBy(*by).agg(F.avg(x).alias("mean"), F.percentile(x, 0.05).alias("p05"), F.percentile(x, 0.5).alias("p50"), F.percentile(x, 0.95).alias("p95"))


def band_flags(observed: DataFrame, band: DataFrame, by: list[str], x: str) -> DataFrame:
    return observed.join(band, by).withColumn("below", F.col(x) < F.col("p05")).withColumn("above", F.col(x) > F.col("p95"))


def auto_labels(members: DataFrame, prototypes: DataFrame, least: int = 10) -> DataFrame:
    """Proposed labels of communities from the most frequent (stoichiometry, space group) of their members.

    ``members`` has ``community, formula, sg``; ``prototypes`` has ``stoich, sg, label, needs`` with ``needs`` null, ``O`` or
    ``chalc``. A prototype whose chemistry the community's usual anion does not meet is not proposed.
    """
    from ..functions.formula import anonymous_ascending, dominant_anion

    rows = members.where(F.col("community") >= 0)
    sizes = rows.groupBy("community").agg(F.count("*").alias("size"), F.count("formula").alias("covered")).where(F.col("size") >= least)
    keyed = rows.where((F.col("formula") != "") & F.col("sg").isNotNull()).select("community", F.struct(anonymous_ascending(F.col("formula")).alias("stoich"), F.col("sg")).alias("key"))
    top = tables.mode_of(keyed, ["community"], "key").select("community", F.col("key.stoich").alias("stoich"), F.col("key.sg").alias("sg"), "n")
    anion = tables.mode_of(rows.select("community", dominant_anion(F.col("formula")).alias("anion")), ["community"], "anion").select("community", "anion")
    out = sizes.join(top, "community").join(anion, "community", "left").join(F.broadcast(prototypes), ["stoich", "sg"], "left")
    met = F.col("needs").isNull() | ((F.col("needs") == "O") & (F.col("anion") == "O")) | ((F.col("needs") == "chalc") & F.col("anion").isin("S", "Se", "Te"))
    plain = F.concat("stoich", F.lit(" stoichiometry, SG "), F.col("sg").cast("string"), F.lit(" (auto)"))
    label = F.when(F.col("label").isNotNull() & F.coalesce(met, F.lit(False)), F.col("label")).otherwise(plain)
    share = F.col("n") / F.col("covered")
    return out.select("community", "size", "covered", "stoich", "sg", "anion", share.alias("dominant_share"), tables.confidence(share).alias("confidence"), label.alias("proposed_label"))
