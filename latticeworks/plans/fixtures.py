"""Views over the driver's tables that stand for the tables of an analysis, in Spark and, as text, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64
K = 16
#: Inline rows.
FORMULAS = ["MgAl2O4", "LaMnO3", "CaF2", "ZnS", "NaCl", "Fe2O3", "SrTiO3", "CdTe", "PbSe", "BaCl2", "Y0.844Cu1.5Se2", "Ni3Al", "CuZn", "LiCoO2", "BiOCl", "GaN", "TiB2", "Ca(OH)2", "", "1A", "CsPbBr3", "KI", "Nb3Sn", "MgAl2O4Mg"]
NAMES = ["Spinel", "ordered perovskite phase", "Garnet (YAG type)", ";;", "unknown", "sodalite zeolite", "augite", "elpasolite", " n/a ", "metal-organic frame", "half Heusler", "Tremolite amphibole", "plain oxide", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, year, community, v, w``: dated vectors with communities; w is v stretched, as a probe."""
    e = table(spark, sf_dir, "embeddings")
    i, v = F.col("vec_id"), F.col("embedding").cast("array<double>")
    by = F.lit(0.7) + (i % 7).cast("double") * F.lit(0.1)
    return e.select(
        "vec_id", F.when(i % 50 == 0, None).otherwise(F.lit(1900) + (i * 37) % 120).alias("year"), F.when(i % 17 == 0, -1).otherwise(F.col("label")).cast("bigint").alias("community"), v.alias("v"), F.transform(v, lambda x: x * by).alias("w")
    )


def with_formula(df: DataFrame, key: str, values: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int")))


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of five sources: every fifth vector."""
    return entity(spark, sf_dir).where(F.col("vec_id") % 5 == 0).withColumn("source", F.concat(F.lit("src"), ((F.col("vec_id") % 25) / 5).cast("int").cast("string")))


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).where(F.col("vec_id") % 5 != 0)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_ix, formula, year, community, score, class, in_basin``: dated reports of formulas."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_ix"), F.col("l_partkey").alias("formula"), F.year("l_shipdate").cast("bigint").alias("year"), F.col("l_suppkey").alias("community"),
        (F.col("l_discount") + F.col("l_tax") * 3).alias("score"), F.col("l_returnflag").alias("class"), (F.col("l_quantity") <= 20).alias("in_basin"),
    )


def event_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("community"), F.year("o_orderdate").cast("int").alias("year"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), (F.col("c_nationkey") % 3).cast("string")).alias("population"), F.col("c_mktsegment").alias("class"), (F.col("c_acctbal") < 0).alias("flag"), F.col("c_custkey").alias("key"))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts joined to the suppliers they come from, as edges ``src, dst``: an undirected graph without weights. Suppliers have
    negative numbers."""
    return table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey")).cast("bigint").alias("src"), F.col("l_partkey").cast("bigint").alias("dst")).distinct()


def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share a supplier and a day of delivery, as edges ``src, dst``: a graph with triangles."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.to_date("l_shipdate").alias("d")).distinct()
    a, b = t.select(F.col("p").alias("src"), "s", "d"), t.select(F.col("p").alias("dst"), "s", "d")
    return a.join(b, ["s", "d"]).where(F.col("src") < F.col("dst")).select("src", "dst").distinct()


def _values(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ENTITY = """fx_entity AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN NULL ELSE 1900 + (vec_id * 37) % 120 END AS year,
  CAST(CASE WHEN vec_id % 17 = 0 THEN -1 ELSE label END AS BIGINT) AS community, embedding::DOUBLE[] AS v,
  list_transform(embedding::DOUBLE[], lambda x: x * (0.7::DOUBLE + (vec_id % 7)::DOUBLE * 0.1::DOUBLE)) AS w FROM embeddings)"""
EXTERNAL = "fx_external AS (SELECT *, 'src' || CAST((vec_id % 25) // 5 AS VARCHAR) AS source FROM fx_entity WHERE vec_id % 5 = 0), fx_frame AS (SELECT * FROM fx_entity WHERE vec_id % 5 <> 0)"
FORMULA = f"fx_formula AS (SELECT *, {_values(FORMULAS)}[vec_id % {len(FORMULAS)} + 1] AS formula FROM fx_entity)"
NAME = f"fx_name AS (SELECT *, {_values(NAMES)}[vec_id % {len(NAMES)} + 1] AS name FROM fx_entity)"
REPORT = """fx_report AS (SELECT l_orderkey * 8 + l_linenumber AS row_ix, l_partkey AS formula, year(l_shipdate)::BIGINT AS year, l_suppkey AS community,
  l_discount + l_tax * 3 AS score, l_returnflag AS class, l_quantity <= 20 AS in_basin FROM lineitem)"""
EVENT_YEAR = "fx_event_year AS (SELECT o_custkey % 40 AS community, year(o_orderdate)::INTEGER AS year FROM orders)"
POPULATION = "fx_population AS (SELECT 'p' || CAST(c_nationkey % 3 AS VARCHAR) AS population, c_mktsegment AS class, c_acctbal < 0 AS flag, c_custkey AS key FROM customer)"
NETWORK = "fx_network AS (SELECT DISTINCT (-l_suppkey)::BIGINT AS src, l_partkey::BIGINT AS dst FROM lineitem)"
COMPANIONS = """t AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, CAST(l_shipdate AS DATE) AS d FROM lineitem),
fx_companions AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM t a JOIN t b ON a.s = b.s AND a.d = b.d AND a.p < b.p)"""


def centres(rows: str, out: str = "centres", v: str = "v") -> str:
    """SQL of ``community, n, c`` over the members in ``rows``."""
    return f"""{out}_e AS (SELECT community, generate_subscripts({v}, 1) AS k, unnest({v}) AS e FROM {rows} WHERE community >= 0),
{out} AS (SELECT community, list(m ORDER BY k) AS c, max(n) AS n FROM (SELECT community, k, avg(e) AS m, count(*) AS n FROM {out}_e GROUP BY ALL) GROUP BY community)"""


def members(rows: str, centre: str = "centres", out: str = "members") -> str:
    return f"{out} AS (SELECT r.*, list_distance(r.v, c.c) AS d FROM {rows} r JOIN {centre} c USING (community))"


def nearest(rows: str, centre: str, v: str, out: str = "projected") -> str:
    return f"""{out} AS (SELECT * EXCLUDE (rn) FROM (SELECT r.*, c.community AS assigned_community, list_distance(r.{v}, c.c) AS distance,
  row_number() OVER (PARTITION BY r.vec_id ORDER BY list_distance(r.{v}, c.c), c.community) AS rn FROM {rows} r, {centre} c) WHERE rn = 1)"""


def wilson(k: str, n: str) -> tuple[str, str]:
    p = f"({k}::DOUBLE / {n})"
    mid, spread, base = f"({p} + 3.8416::DOUBLE / (2 * {n}))", f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + 3.8416::DOUBLE / (4 * {n} * {n})))", f"(1 + 3.8416::DOUBLE / {n})"
    return f"({mid} - {spread}) / {base}", f"({mid} + {spread}) / {base}"


def knn(rows: str = "fx_entity", k: int = K, out: str = "nn") -> str:
    return f"""{out} AS MATERIALIZED (SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS dist,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rk FROM {rows} a, {rows} b WHERE a.vec_id <> b.vec_id) WHERE rk <= {k})"""


MUTUAL = "mu AS (SELECT a.* FROM nn a JOIN nn b ON a.src = b.dst AND a.dst = b.src)"
EDGES = """sig AS (SELECT greatest(coalesce(median(CASE WHEN dist > 0 THEN dist END), 1.0), 1e-8) AS s FROM mu),
ed AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(exp(-power(dist / s, 2))) AS weight FROM mu, sig GROUP BY 1, 2)"""


def sql(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def r6(c):
    """Six places, zero without a sign."""
    return F.round(c, 6) + F.lit(0.0)
