"""Queries on formulas, names, labels, structures and text parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula as fm
from ..functions import parse, text
from ..operators import scoring, tables
from . import fixtures as fx
from .fixtures import r6

#: Prototypes by stoichiometry and space group, with the chemistry that they need.
PROTOTYPES = [
    ("A1B1", 225, "Rocksalt (NaCl-type)", None), ("A1B1", 221, "Cesium chloride (CsCl-type)", None), ("A1B1", 216, "Zincblende (ZnS-type)", None), ("A1B1", 186, "Wurtzite (ZnS hex)", None),
    ("A1B2", 225, "Fluorite (CaF2-type) / antifluorite", None), ("A1B2", 194, "Laves C14 (MgZn2-prototype)", None), ("A1B2", 227, "Laves C15 (Cu2Mg-prototype)", None), ("A1B5", 191, "CaCu5-prototype (LaNi5 hydrogen-storage family)", None),
    ("A1B1C3", 221, "Cubic perovskite ABO3", "O"), ("A1B1C3", 62, "Orthorhombic Pnma perovskite ABO3", "O"), ("A1B2C4", 227, "Spinel (AB2O4, Fd-3m)", "O"), ("A2B2C7", 227, "Pyrochlore (A2B2O7)", "O"), ("A1B1C2", 166, "CdI2-prototype (1T-MX2 dichalcogenide)", "chalc"),
]


def _formulas(spark, sf_dir):
    return fx.with_formula(fx.entity(spark, sf_dir), "vec_id", fx.FORMULAS, "formula")


def _named(spark, sf_dir):
    return fx.with_formula(fx.entity(spark, sf_dir), "vec_id", fx.NAMES, "name")


def formula_parse(spark, sf_dir):
    rows = _formulas(spark, sf_dir).select("vec_id", F.explode(fm.parse_strict(F.col("formula"))).alias("p"))
    return rows.select("vec_id", F.col("p.e").alias("element"), r6("p.n").alias("amount"))


def formula_refused(spark, sf_dir):
    return _formulas(spark, sf_dir).where(fm.parse_strict(F.col("formula")).isNull()).groupBy("formula").agg(F.count("*").alias("n"))


def composition_class(spark, sf_dir):
    return _formulas(spark, sf_dir).select("vec_id", fm.composition_class(F.col("formula")).alias("stratum"))


def anonymized_formula(spark, sf_dir):
    f = F.col("formula")
    return _formulas(spark, sf_dir).select("formula").distinct().select("formula", fm.anonymous_reduced(f).alias("reduced"))


def anonymized_ascending(spark, sf_dir):
    f = F.col("formula")
    return _formulas(spark, sf_dir).select("formula").distinct().select("formula", fm.anonymous_ascending(f).alias("ascending"), fm.class_key(f).alias("class_key"))


def formula_elements(spark, sf_dir):
    e = fm.elements(F.col("formula"))
    return _formulas(spark, sf_dir).select("formula").distinct().select("formula", F.array_join(e, ",").alias("elements"), F.size(e).cast("bigint").alias("n"))


def element_predicate(spark, sf_dir):
    e = fm.elements(F.col("formula"))
    return _formulas(spark, sf_dir).where(fm.has_elements(e, ["O"], ["Mg", "Ti", "Co"], 4)).select("vec_id")


def dominant_anions(spark, sf_dir):
    rows = _formulas(spark, sf_dir).where("community >= 0").select("community", "vec_id", fm.dominant_anion(F.col("formula")).alias("anion"))
    return tables.mode_of(rows, ["community"], "anion").select("community", "anion", "n")


def canonical_formulas(spark, sf_dir):
    return _formulas(spark, sf_dir).select("formula").distinct().select("formula", fm.formula_canonical(F.col("formula")).alias("canonical"))


def reduced_formulas(spark, sf_dir):
    return _formulas(spark, sf_dir).select("formula").distinct().select("formula", fm.formula_reduced(F.col("formula")).alias("reduced"))


def family_tags(spark, sf_dir):
    return _named(spark, sf_dir).select("vec_id", F.explode(text.family_tags(F.col("name"))).alias("family"))


def family_enrichment(spark, sf_dir):
    rows = _named(spark, sf_dir).where("community >= 0")
    tags = rows.select("vec_id", F.explode(text.family_tags(F.col("name"))).alias("family"))
    out = scoring.family_enrichment(rows, tags, "vec_id")
    return out.select("community", "family", "hits", "size", "total", r6("fold").alias("fold"))


def element_enrichment(spark, sf_dir):
    rows = _formulas(spark, sf_dir).select(fm.elements(F.col("formula")).alias("elems"), (F.col("vec_id") % 3 == 0).alias("bridge"))
    out = scoring.element_enrichment(rows, "elems", "bridge")
    return out.select("element", "n_bridge", "n_core", *[r6(c).alias(c) for c in ("bridge_fraction", "core_fraction", "log2_enrichment")])


def clean_labels(spark, sf_dir):
    return _named(spark, sf_dir).select("name").distinct().select("name", text.clean_label(F.col("name")).alias("label"))


def tag_precedence(spark, sf_dir):
    i = F.col("vec_id")
    rows = _named(spark, sf_dir)
    tags = F.map_filter(F.create_map(F.lit("aflow"), F.when(i % 2 == 0, F.col("name")), F.lit("mineral"), F.when(i % 3 == 0, F.lit(" n/a ")).when(i % 5 == 0, F.lit("galena")), F.lit("other"), F.lit("x")), lambda k, v: v.isNotNull())
    return rows.select("vec_id", text.preferred_tag(tags).alias("label"))


def label_precedence(spark, sf_dir):
    i = F.col("vec_id")
    label, source = tables.label_of(i, F.when(i % 4 == 0, F.lit("curated")), F.when(i % 3 == 0, F.lit("inferred one")).when(i % 5 == 0, F.lit(" ")), F.when(i % 2 == 0, F.lit("prototype")))
    return fx.entity(spark, sf_dir).select("vec_id", label.alias("label"), source.alias("label_source"))


def auto_labels(spark, sf_dir):
    groups = [225, 62, 166, 186, 227]
    rows = _formulas(spark, sf_dir).select(F.col("community"), "formula", F.element_at(F.array(*map(F.lit, groups)), (F.col("vec_id") % 5 + 1).cast("int")).alias("sg"))
    proto = spark.createDataFrame(PROTOTYPES, "stoich string, sg int, label string, needs string")
    out = scoring.auto_labels(rows, proto)
    return out.select("community", "size", "covered", "stoich", "sg", "anion", r6("dominant_share").alias("dominant_share"), "confidence", "proposed_label")


def tolerant_parsing(spark, sf_dir):
    i = F.col("vec_id")
    raw = F.when(i % 6 == 0, F.concat(F.lit(" "), i.cast("string"), F.lit(".7 "))).when(i % 6 == 1, F.lit("")).when(i % 6 == 2, F.lit("n/a")).when(i % 6 == 3, F.concat(F.lit("id-"), i.cast("string"))).when(i % 6 == 4, F.lit("1e3")).otherwise(i.cast("string"))
    rows = fx.entity(spark, sf_dir).select("vec_id", raw.alias("raw"))
    return rows.select("vec_id", parse.to_int(F.col("raw")).alias("whole"), parse.to_float(F.col("raw")).alias("number"), parse.to_int_digits(F.col("raw")).alias("digits"))


def tolerant_bools(spark, sf_dir):
    words = ["True", "0", " yes ", "f", "maybe", "", "T", "no"]
    rows = fx.with_formula(fx.entity(spark, sf_dir), "vec_id", words, "raw")
    return rows.select("vec_id", parse.to_bool(F.col("raw")).alias("flag"))


def decade_buckets(spark, sf_dir):
    return fx.entity(spark, sf_dir).groupBy(parse.decade(F.col("year")).alias("decade")).agg(F.count("*").alias("n"))


def path_parts(spark, sf_dir):
    i = F.col("vec_id").cast("string")
    path = F.concat(F.lit("set/fam"), (F.col("vec_id") % 4).cast("string"), F.lit("/my file+"), i, F.lit(".v1.cif"))
    return fx.entity(spark, sf_dir).select("vec_id", text.path_family(path).alias("family"), text.path_stem(path).alias("stem"), text.slug(path).alias("slug"), text.padded_key(F.col("vec_id")).alias("padded"), text.shorten(path, 15).alias("short"))


def marker_sizes(spark, sf_dir):
    sizes = fx.report(spark, sf_dir).groupBy("formula").agg(F.count("*").alias("n"))
    span = sizes.agg(F.log1p(F.min("n")).alias("lo"), F.log1p(F.max("n")).alias("hi"))
    return sizes.crossJoin(F.broadcast(span)).select("formula", r6(parse.rescale(F.log1p("n"), F.col("lo"), F.col("hi"), 4.0, 20.0)).alias("marker"))  # one row


def drop_reasons(spark, sf_dir):
    """Why records of a structure list are left out: the first reason of several."""
    j = fx.table(spark, sf_dir, "jarvis_records").dropDuplicates(["material_id"])
    n = F.size(F.from_json("atoms", "struct<elements: array<string>>")["elements"])
    why = tables.first_reason({"other": F.coalesce(n, F.lit(0)) <= 0, "icsd": F.trim(F.coalesce("icsd_field", F.lit(""))) != "", "ehull": F.col("ehull").isNull() | ~F.col("ehull").between(0.0, 0.05), "size": n > 60})
    return j.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_E, _F, _N = fx.ENTITY, fx.FORMULA, fx.NAME
_STRICT = "'^([A-Z][a-z]?([0-9]*[.]?[0-9]+)?)+$'"
_PARTS = f"""pt AS (SELECT formula, i, regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]+)?', 1)[i] AS e, coalesce(try_cast(nullif(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]+)?', 2)[i], '') AS DOUBLE), 1) AS n
  FROM (SELECT formula, unnest(generate_series(1, len(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]+)?', 1)))) AS i FROM (SELECT DISTINCT formula FROM fx_formula WHERE regexp_matches(formula, {_STRICT}))))"""
_SUM = "sm AS (SELECT formula, e, sum(n) AS n, min(i) AS i FROM pt GROUP BY ALL)"
_LAX = """lx AS (SELECT formula, i, regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 1)[i] AS e, coalesce(try_cast(nullif(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 2)[i], '') AS DOUBLE), 1) AS n
  FROM (SELECT formula, unnest(generate_series(1, len(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 1)))) AS i FROM (SELECT DISTINCT formula FROM fx_formula)))"""
_ASC = "asc_ AS (SELECT formula, string_agg(chr(64 + rn::INT) || CASE WHEN n = floor(n) THEN CAST(n::BIGINT AS VARCHAR) ELSE CAST(n AS VARCHAR) END, '' ORDER BY rn) AS a FROM (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY n, e) AS rn FROM lx) WHERE rn <= 26 GROUP BY formula)"
_ANIONS = ", ".join(f"'{e}'" for e in fm.ANION_CLASSES)
_KIND = "CASE " + " ".join(f"WHEN a = '{e}' THEN '{k}'" for e, k in fm.ANION_CLASSES.items()) + " END"
_BUCKET = "CASE WHEN na = 0 THEN 'no-anion' WHEN nc = 0 THEN 'all-anion' " + " ".join(f"WHEN ta / tc < {b} THEN '{k}'" for b, k in fm.RATIO_BUCKETS) + " ELSE 'hi' END"
_TAGS = " UNION ALL ".join(f"SELECT vec_id, community, '{f}' AS family FROM fx_name WHERE regexp_matches(lower(name), '" + "|".join(rf"\b{w}\b" for w in words) + "')" for f, words in text.FAMILIES.items())
_CLEAN = "CASE WHEN trim(name) = '' OR lower(trim(name)) IN (" + ", ".join(f"'{w}'" for w in text.NO_LABEL) + r") OR regexp_full_match(trim(name), '[\s;:.,_\-+/\\]+') THEN NULL ELSE trim(name) END"
_ELEMS = "el AS (SELECT formula, list_sort(list_distinct(regexp_extract_all(formula, '([A-Z][a-z]?)', 1))) AS els FROM (SELECT DISTINCT formula FROM fx_formula))"
_DOM = "da AS (SELECT formula, e AS anion FROM lx WHERE e IN (" + ", ".join(f"'{e}'" for e in fm.ANION_PRIORITY) + ") QUALIFY row_number() OVER (PARTITION BY formula ORDER BY n DESC, i) = 1)"
_GCD = "gc AS (SELECT formula, list_reduce(list(CAST(round_even(n * 100, 0) AS BIGINT)), lambda a, b: gcd(a, b)) AS g FROM sm GROUP BY formula)"

SQL = {
    "formula_parse": fx.sql(_E, _F, _PARTS, _SUM, select="SELECT vec_id, e AS element, round(n, 6) AS amount FROM fx_formula JOIN sm USING (formula)"),
    "formula_refused": fx.sql(_E, _F, select=f"SELECT formula, count(*) AS n FROM fx_formula WHERE NOT regexp_matches(formula, {_STRICT}) GROUP BY formula"),
    "composition_class": fx.sql(_E, _F, _PARTS, _SUM, f"ag AS (SELECT formula, count(*) AS ne, count(*) FILTER (e IN ({_ANIONS})) AS na, count(*) FILTER (e NOT IN ({_ANIONS})) AS nc, sum(n) FILTER (e IN ({_ANIONS})) AS ta, sum(n) FILTER (e NOT IN ({_ANIONS})) AS tc, min(e) FILTER (e IN ({_ANIONS})) AS a FROM sm GROUP BY formula)",
        select=f"SELECT vec_id, CASE WHEN na = 0 THEN 'intermetallic' WHEN na > 1 THEN 'mixed-anion' ELSE {_KIND} END || '|n' || CASE WHEN ne <= 4 THEN CAST(ne AS VARCHAR) ELSE '5+' END || '|r' || {_BUCKET} AS stratum FROM fx_formula LEFT JOIN ag USING (formula)"),
    "anonymized_formula": fx.sql(_E, _F, _PARTS, _SUM, _GCD, "an AS (SELECT formula, string_agg(chr(64 + rn::INT) || CAST(CAST(round_even(n * 100, 0) AS BIGINT) // g AS VARCHAR), '' ORDER BY rn) AS reduced FROM (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY n DESC) AS rn FROM sm JOIN gc USING (formula)) GROUP BY formula)",
        select="SELECT f.formula, reduced FROM (SELECT DISTINCT formula FROM fx_formula) f LEFT JOIN an USING (formula)"),
    "anonymized_ascending": fx.sql(_E, _F, _LAX, _ASC, _ELEMS, select=f"SELECT f.formula, coalesce(a, '') AS ascending, CASE WHEN regexp_matches(f.formula, {_STRICT}) THEN a || '|' || CAST(len(els) AS VARCHAR) END AS class_key FROM (SELECT DISTINCT formula FROM fx_formula) f LEFT JOIN asc_ USING (formula) LEFT JOIN el USING (formula)"),
    "formula_elements": fx.sql(_E, _F, _ELEMS, select="SELECT formula, array_to_string(els, ',') AS elements, len(els)::BIGINT AS n FROM el"),
    "element_predicate": fx.sql(_E, _F, _ELEMS, select="SELECT vec_id FROM fx_formula JOIN el USING (formula) WHERE list_contains(els, 'O') AND list_has_any(els, ['Mg', 'Ti', 'Co']) AND len(els) <= 4"),
    "dominant_anions": fx.sql(_E, _F, _LAX, _DOM, "ct AS (SELECT community, anion, count(*) AS n FROM fx_formula JOIN da USING (formula) WHERE community >= 0 GROUP BY ALL)", select="SELECT community, anion, n FROM ct QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, anion) = 1"),
    "canonical_formulas": fx.sql(_E, _F, _PARTS, _SUM, _GCD, "cf AS (SELECT formula, string_agg(e || CASE WHEN CAST(round_even(n * 100, 0) AS BIGINT) = g THEN '' ELSE CAST(CAST(round_even(n * 100, 0) AS BIGINT) // g AS VARCHAR) END, '' ORDER BY e) AS canonical FROM sm JOIN gc USING (formula) GROUP BY formula)", select="SELECT f.formula, canonical FROM (SELECT DISTINCT formula FROM fx_formula) f LEFT JOIN cf USING (formula)"),
    "reduced_formulas": fx.sql(_E, _F, _PARTS, _SUM, _GCD, "ex AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', {x})" for e, x in fm.ELECTRONEGATIVITY.items()) + ") AS v(e, x))", "cf AS (SELECT formula, string_agg(e || CASE WHEN CAST(round_even(n * 100, 0) AS BIGINT) = g THEN '' ELSE CAST(CAST(round_even(n * 100, 0) AS BIGINT) // g AS VARCHAR) END, '' ORDER BY coalesce(x, 9), e) AS reduced FROM sm JOIN gc USING (formula) LEFT JOIN ex USING (e) GROUP BY formula)", select="SELECT f.formula, reduced FROM (SELECT DISTINCT formula FROM fx_formula) f LEFT JOIN cf USING (formula)"),
    "family_tags": fx.sql(_E, _N, f"tg AS ({_TAGS})", select="SELECT vec_id, family FROM tg"),
    "family_enrichment": fx.sql(_E, _N, f"tg AS ({_TAGS})", "tt AS (SELECT * FROM tg WHERE community >= 0)", "sz AS (SELECT community, count(*) AS size FROM fx_name WHERE community >= 0 GROUP BY community)", "ht AS (SELECT community, family, count(*) AS hits FROM tt GROUP BY ALL)", "tl AS (SELECT family, count(*) AS total FROM tt GROUP BY family)",
        select="SELECT community, family, hits, size, total, round((hits / size) / (total / (SELECT sum(size) FROM sz)::DOUBLE), 6) AS fold FROM ht JOIN sz USING (community) JOIN tl USING (family)"),
    "element_enrichment": fx.sql(_E, _F, _ELEMS, "x AS (SELECT vec_id % 3 = 0 AS b, els FROM fx_formula JOIN el USING (formula))", "s AS (SELECT sum(b::INT) AS nb, sum((NOT b)::INT) AS nc FROM x)", "c AS (SELECT element, sum(b::INT)::BIGINT AS n_bridge, sum((NOT b)::INT)::BIGINT AS n_core FROM (SELECT b, unnest(els) AS element FROM x) GROUP BY element)",
        select="SELECT element, n_bridge, n_core, round((n_bridge + 1) / (nb + 2)::DOUBLE, 6) AS bridge_fraction, round((n_core + 1) / (nc + 2)::DOUBLE, 6) AS core_fraction, round(log2(((n_bridge + 1) / (nb + 2)::DOUBLE) / ((n_core + 1) / (nc + 2)::DOUBLE)), 6) + 0 AS log2_enrichment FROM c, s"),
    "clean_labels": fx.sql(_E, _N, select=f"SELECT DISTINCT name, {_CLEAN} AS label FROM fx_name"),
    "tag_precedence": fx.sql(_E, _N, select=f"SELECT vec_id, CASE WHEN vec_id % 3 <> 0 AND vec_id % 5 = 0 THEN 'galena' WHEN vec_id % 2 = 0 AND ({_CLEAN}) IS NOT NULL THEN {_CLEAN} ELSE 'x' END AS label FROM fx_name"),
    "label_precedence": "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'curated' WHEN vec_id % 3 = 0 THEN 'inferred one' WHEN vec_id % 2 = 0 THEN 'prototype' ELSE 'community ' || CAST(vec_id AS VARCHAR) END AS label, CASE WHEN vec_id % 4 = 0 THEN 'canonical' WHEN vec_id % 3 = 0 THEN 'inferred' WHEN vec_id % 2 = 0 THEN 'prototype' ELSE 'fallback' END AS label_source FROM embeddings",
    "auto_labels": fx.sql(_E, _F, _LAX, _ASC, _DOM, "m AS (SELECT community, formula, [225, 62, 166, 186, 227][vec_id % 5 + 1] AS sg FROM fx_formula WHERE community >= 0)", "sz AS (SELECT community, count(*) AS size, count(formula) AS covered FROM m GROUP BY community HAVING count(*) >= 10)",
        "ky AS (SELECT * FROM (SELECT community, a AS stoich, sg, count(*) AS n FROM m JOIN asc_ USING (formula) WHERE formula <> '' GROUP BY community, a, sg) QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, stoich, sg) = 1)", "an AS (SELECT * FROM (SELECT community, anion, count(*) AS na FROM m JOIN da USING (formula) GROUP BY community, anion) QUALIFY row_number() OVER (PARTITION BY community ORDER BY na DESC, anion) = 1)",
        "pr AS (SELECT * FROM (VALUES " + ", ".join("('{}', {}, '{}', {})".format(a, b, c.replace("'", "''"), f"'{d}'" if d else "NULL") for a, b, c, d in PROTOTYPES) + ") AS v(stoich, sg, label, needs))",
        select="SELECT community, size, covered, k.stoich, k.sg::INTEGER AS sg, anion, round(n / covered, 6) AS dominant_share, CASE WHEN n / covered > 0.7 THEN 'HIGH' WHEN n / covered > 0.5 THEN 'MED' ELSE 'LOW' END AS confidence, CASE WHEN label IS NOT NULL AND (needs IS NULL OR (needs = 'O' AND anion = 'O') OR (needs = 'chalc' AND anion IN ('S', 'Se', 'Te'))) THEN label ELSE k.stoich || ' stoichiometry, SG ' || CAST(k.sg AS VARCHAR) || ' (auto)' END AS proposed_label FROM sz JOIN ky k USING (community) LEFT JOIN an USING (community) LEFT JOIN pr ON pr.stoich = k.stoich AND pr.sg = k.sg"),
    "tolerant_parsing": "SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN vec_id WHEN 4 THEN 1000 WHEN 5 THEN vec_id END AS whole, CASE vec_id % 6 WHEN 0 THEN CAST(CAST(vec_id AS VARCHAR) || '.7' AS DOUBLE) WHEN 4 THEN 1000 WHEN 5 THEN vec_id END::DOUBLE AS number, CASE vec_id % 6 WHEN 0 THEN vec_id WHEN 3 THEN vec_id WHEN 4 THEN 1000 WHEN 5 THEN vec_id END AS digits FROM embeddings",
    "tolerant_bools": "SELECT vec_id, [true, false, true, false, NULL, NULL, true, false][vec_id % 8 + 1] AS flag FROM embeddings",
    "decade_buckets": fx.sql(_E, select="SELECT CASE WHEN year IS NULL THEN 'unknown' ELSE (year // 10 * 10)::VARCHAR || 's' END AS decade, count(*) AS n FROM fx_entity GROUP BY 1"),
    "path_parts": "SELECT vec_id, 'fam' || CAST(vec_id % 4 AS VARCHAR) AS family, 'my_file_' || CAST(vec_id AS VARCHAR) || '_v1' AS stem, 'set_fam' || CAST(vec_id % 4 AS VARCHAR) || '_my_file_' || CAST(vec_id AS VARCHAR) || '_v1_cif' AS slug, 'icsd_' || printf('%06d', vec_id) AS padded, left('set/fam' || CAST(vec_id % 4 AS VARCHAR) || '/my file+' || CAST(vec_id AS VARCHAR) || '.v1.cif', 14) || '…' AS short FROM embeddings",
    "marker_sizes": fx.sql(fx.REPORT, "s AS (SELECT formula, count(*) AS n FROM fx_report GROUP BY formula)", "b AS (SELECT ln(1 + min(n)) AS lo, ln(1 + max(n)) AS hi FROM s)", select="SELECT formula, round(CASE WHEN lo = hi THEN 12 ELSE 4 + (ln(1 + n) - lo) / (hi - lo) * 16 END, 6) AS marker FROM s, b"),
    "drop_reasons": "WITH j AS (SELECT DISTINCT ON (material_id) *, len(from_json(json_extract(atoms, '$.elements'), '[\"VARCHAR\"]')) AS sites FROM jarvis_records WHERE material_id IS NOT NULL), r AS (SELECT CASE WHEN coalesce(sites, 0) <= 0 THEN 'other' WHEN trim(coalesce(icsd_field, '')) <> '' THEN 'icsd' WHEN ehull IS NULL OR ehull NOT BETWEEN 0 AND 0.05 THEN 'ehull' WHEN sites > 60 THEN 'size' ELSE 'kept' END AS reason FROM j) SELECT reason, count(*) AS n FROM r GROUP BY reason",
}

QUERIES = {f.__name__: f for f in (
    formula_parse, formula_refused, composition_class, anonymized_formula, anonymized_ascending, formula_elements, element_predicate, dominant_anions, canonical_formulas, reduced_formulas, family_tags, family_enrichment, element_enrichment,
    clean_labels, tag_precedence, label_precedence, auto_labels, tolerant_parsing, tolerant_bools, decade_buckets, path_parts, marker_sizes, drop_reasons,
)}
