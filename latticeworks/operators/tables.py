"""Relational patterns: lookups, set logic, ranking, counting, filling. Every tie has a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percentiles

# --- joins ---------------------------------------------------------------------------------------------------------


def lookup(df: DataFrame, side: DataFrame, on: str, column: str, default=None) -> DataFrame:
    """Adds ``column`` of the side by key; the default where the key is unknown."""
    out = df.join(side.select(on, column), on, "left")
    return out if default is None else out.withColumn(column, F.coalesce(column, F.lit(default)))


def member_flag(df: DataFrame, keys: DataFrame, on: str, out: str) -> DataFrame:
    """Adds whether the key stands in ``keys``; each row stays one row."""
    marked = keys.select(on).where(F.col(on).isNotNull()).distinct().withColumn("_there", F.lit(True))
    return df.join(marked, on, "left").withColumn(out, F.coalesce("_there", F.lit(False))).drop("_there")


def drop_known(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not known. A key with a null part is never known."""
    return df.join(known.select(*on), on, "left_anti")


def last_wins(tables: list[DataFrame], key: str, value: str, order: str) -> DataFrame:
    """``key, value``: of all tables the value of the last row, later tables before earlier, then by ``order``; blanks do not
    count."""
    rows = None
    for k, t in enumerate(tables):
        part = t.where(F.col(key).isNotNull() & (F.trim(F.col(value)) != "")).select(key, value, F.lit(k).alias("_t"), F.col(order).alias("_o"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.max_by(value, F.struct("_t", "_o")).alias(value))


def earliest(tables: list[DataFrame], key: str, year: str) -> DataFrame:
    """``key, year``: the smallest year of a key in all tables; blank keys and null years do not count."""
    rows = None
    for t in tables:
        part = t.where((F.trim(F.col(key).cast("string")) != "") & F.col(year).isNotNull()).select(key, year)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min(year).alias(year))


def universe(a: DataFrame, b: DataFrame, key: str, na: str, nb: str) -> DataFrame:
    """All keys of both sides with their counts, 0 where a side lacks one."""
    return a.select(key, na).join(b.select(key, nb), key, "full_outer").select(key, F.coalesce(na, F.lit(0)).alias(na), F.coalesce(nb, F.lit(0)).alias(nb))


def common_strata(a: DataFrame, b: DataFrame, stratum: str) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to the strata that both have."""
    shared = a.select(stratum).intersect(b.select(stratum))
    return a.join(shared, stratum, "left_semi"), b.join(shared, stratum, "left_semi")


# --- counts and choices --------------------------------------------------------------------------------------------


def mode_of(df: DataFrame, by: list[str], value: str, first: str | None = None) -> DataFrame:
    """``by, value, n``: the most frequent value per key; of equals the one met first in the order of ``first``, then the
    smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), (F.min(first) if first else F.lit(0)).alias("_f"))
    top = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("_f"), F.col(value).alias("v"))).alias("s"))
    return top.select(*by, F.col("s.v").alias(value), (-F.col("s.m")).alias("n"))


def top_values(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """``by, value, n, rk``: the k most frequent values per key, ties by the value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))).where(F.col("rk") <= k)


def first_row(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given, which must be total."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_at = 1").drop("_at")


def first_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("at") <= n)


def top_and_other(df: DataFrame, by: str, item: str, size: str, k: int, other: str = "other") -> DataFrame:
    """``by, item, size, n_items``: the k largest items of each key, ties by name, and the rest together as one."""
    ranked = df.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(size), item)))
    named = ranked.withColumn("_item", F.when(F.col("_at") <= k, F.col(item).cast("string")).otherwise(other))
    return named.groupBy(by, F.col("_item").alias(item)).agg(F.sum(size).alias(size), F.count("*").alias("n_items"))


def at_least_some(df: DataFrame, size: str, least: int, some: int, order: list[str]) -> DataFrame:
    """Rows of at least ``least``, but no fewer than the ``some`` largest. The largest are found by a limited sort."""
    best = df.orderBy(F.desc(size), *order).limit(some)
    return df.where(F.col(size) >= least).unionByName(best.where(F.col(size) < least))


def row_numbers(df: DataFrame, order: list[str], out: str, buckets: int = 32) -> DataFrame:
    """Adds each row's place, from 1, in the order given, whose first column is numeric and not null.

    Rows fall into buckets between approximate quantiles of the first column; buckets are counted, and rows are numbered within
    theirs, so no task orders all rows.
    """
    edges = sorted(set(df.approxQuantile(order[0], [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))))
    bucket = sum((F.when(F.col(order[0]) > e, 1).otherwise(0) for e in edges), F.lit(0)) if edges else F.lit(0)
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row per bucket
    return rows.join(F.broadcast(before), "_b").withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(*order))).drop("_b", "_before")


def quartiles(df: DataFrame, order: list[str], out: str = "quartile", by: list[str] = ()) -> DataFrame:
    """Adds 0 to 3: quarters of n // 4 rows (at least one), what is left over in the last. Without ``by`` the first column of
    the order must be numeric; see ``row_numbers``."""
    if by:
        w = Window.partitionBy(*by)
        q = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 4))
        return df.withColumn(out, F.least(F.floor((F.row_number().over(w.orderBy(*order)) - 1) / q), F.lit(3)).cast("int"))
    total = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 4)).alias("_q"))
    placed = row_numbers(df, order, "_at").crossJoin(F.broadcast(total))  # one row
    return placed.withColumn(out, F.least(F.floor((F.col("_at") - 1) / F.col("_q")), F.lit(3)).cast("int")).drop("_at", "_q")


def centre(df: DataFrame, by: str, x: str, least: int, out: str) -> DataFrame:
    """Adds x less its mean in the class, for classes of at least ``least`` rows; others are dropped. Sizes and means are
    aggregated first and joined back, so a large class is not held by one task."""
    means = df.groupBy(by).agg(F.count("*").alias("_n"), F.avg(x).alias("_m")).where(F.col("_n") >= least)
    return df.join(means, by).withColumn(out, F.col(x) - F.col("_m")).drop("_n", "_m")


def forward_fill(df: DataFrame, order: str, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Replaces nulls by the last value before them."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def dense_years(df: DataFrame, by: str, year: str = "year", n: str = "n") -> DataFrame:
    """``by, year, n``: counts for every year between a key's first and last, 0 where there are none."""
    counts = df.where(F.col(year).isNotNull()).groupBy(by, year).agg(F.count("*").alias(n))
    span = counts.groupBy(by).agg(F.explode(F.sequence(F.min(year), F.max(year))).alias(year))
    return span.join(counts, [by, year], "left").select(by, year, F.coalesce(n, F.lit(0)).cast("bigint").alias(n))


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first condition that holds, null if none does: why a row is dropped."""
    out = None
    for name, condition in reasons.items():
        bad = F.coalesce(condition, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def two_levels(df: DataFrame, outer: str, inner: str, flag: Column) -> DataFrame:
    """``outer, inner, n, k``: rows and rows with the flag per pair, and per outer key with inner null."""
    rows = df.where(F.col(inner).isNotNull()).withColumn("_k", flag.cast("int"))
    out = rows.groupingSets([[outer, inner], [outer]], outer, inner).agg(F.count("*").alias("n"), F.sum("_k").cast("bigint").alias("k"))
    return out


def trim_window(df: DataFrame, x: str, y: str, q: float = 0.01) -> DataFrame:
    """Rows between the q and 1 - q quantiles of both columns."""
    bounds = percentiles(df, x, [q, 1 - q], out="_bx").crossJoin(percentiles(df, y, [q, 1 - q], out="_by"))  # one row each
    kept = df.crossJoin(F.broadcast(bounds)).where(F.col(x).between(F.col("_bx")[0], F.col("_bx")[1]) & F.col(y).between(F.col("_by")[0], F.col("_by")[1]))  # one row
    return kept.drop("_bx", "_by")


# --- cases ---------------------------------------------------------------------------------------------------------


def role(event_type: Column, bridge: Column, core: Column) -> Column:
    """One role per record: birth before bridge before core before periphery."""
    return F.when(event_type == "community_birth", "birth").when(bridge, "bridge").when(core == "core", "core").otherwise("periphery")


def roles(event_type: Column, bridge: Column, core: Column) -> Column:
    """All roles of a record: birth comes on top of the one of the others that holds."""
    return F.filter(F.array(F.when(event_type == "community_birth", "birth"), F.when(bridge, "bridge").when(core == "core", "core").otherwise("periphery")), lambda r: r.isNotNull())


def stepping_stone(birth: Column, first: Column) -> Column:
    """How a formula's first year stands to the first birth among its communities; null if either is unknown."""
    return F.when(birth < first, "joins_existing").when(birth == first, "co_birth").when(birth > first, "community_after_formula")


def confidence(share: Column) -> Column:
    return F.when(share > 0.7, "HIGH").when(share > 0.5, "MED").otherwise("LOW")


def outcome(result: Column, conclusion: Column) -> Column:
    """Outcome of an attempt: recovered offline, inconclusive, made, not obtained."""
    text = F.lower(F.coalesce(conclusion, F.lit("")))
    return F.when(F.trim(result) == "Success (offline)", "offline_recovery").when(text.contains("inconclusive"), "inconclusive").when(F.trim(text) != "", "made").otherwise("not_obtained")


def label_of(community: Column, canonical: Column, inferred: Column, prototype: Column) -> tuple[Column, Column]:
    """The label of a community and where it comes from: curated before inferred before prototype before its number."""
    use = lambda c: F.nullif(F.trim(c), F.lit(""))
    label = F.coalesce(use(canonical), use(inferred), use(prototype), F.concat(F.lit("community "), community.cast("string")))
    source = F.when(use(canonical).isNotNull(), "canonical").when(use(inferred).isNotNull(), "inferred").when(use(prototype).isNotNull(), "prototype").otherwise("fallback")
    return label, source
