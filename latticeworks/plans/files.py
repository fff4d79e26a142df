"""Queries over the readers and writers: tables are written in a format, read back by the library and summed up."""

from __future__ import annotations

import base64
import json
import lzma
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import NUMBER
from ..functions.formula import ELECTRONEGATIVITY
from ..operators import frame, tables
from ..session import place
from ..sources import datasources, readers, sinks
from . import fixtures as fx
from .fixtures import r6


def _local(spark: SparkSession, name: str) -> str:
    """The same for formats that the driver writes; the shared folder must be mounted."""
    path = place(spark, name)
    if not path.startswith(("file:", "/")):
        raise ValueError("the shared folder is not mounted")
    path = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def _csv(df: DataFrame, name: str) -> str:
    path = place(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments as text, every 97th community and every 89th year unreadable."""
    t = fx.table(spark, sf_dir, "community_assignments")
    i = F.col("icsd_id")
    return t.select(i.cast("string").alias("icsd_id"), F.when(i % 89 == 0, "n.d.").otherwise(F.col("year").cast("string")).alias("year"), F.when(i % 97 == 0, "?").otherwise(F.col("community").cast("string")).alias("community"))


def read_communities_coerced(spark, sf_dir):
    rows = readers.communities(spark, _csv(_assignments(spark, sf_dir), "communities"))
    return rows.groupBy("community").agg(F.count("*").alias("n"), F.count("year").alias("dated"), F.sum("entity_id").alias("ids"))


def read_communities_skipped(spark, sf_dir):
    rows = readers.communities(spark, _csv(_assignments(spark, sf_dir), "communities"), "skip", years=(1900, 2025), noise=False)
    return rows.groupBy("community").agg(F.count("*").alias("n"), F.min("year").cast("bigint").alias("first"), F.max("year").cast("bigint").alias("last"))


def read_communities_strictly(spark, sf_dir):
    rows = readers.communities(spark, _csv(_assignments(spark, sf_dir).where("community is not null and community <> '?'"), "communities"), "strict")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"), F.sum("community").alias("total"))


def read_entry_index(spark, sf_dir):
    """Parts under alias names; every third comes again later with another name, which counts."""
    p = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("ICSD "), F.col("p_partkey").cast("string")).alias("cif_names"), F.col("p_name").alias("Name"), (F.lit(1900) + F.col("p_size")).cast("string").alias("publication_year"), F.lit(None).cast("string").alias("sym_group"), F.col("p_partkey").alias("k"))
    again = p.where("k % 3 = 0").withColumn("Name", F.lit("later"))
    rows = p.withColumn("o", F.lit(0)).unionByName(again.withColumn("o", F.lit(1))).coalesce(1).sortWithinPartitions("o", "k").drop("o", "k")
    return readers.entry_index(spark, _csv(rows, "index")).select("entity_id", "formula", F.col("year").cast("bigint").alias("year"), F.col("space_group").cast("bigint").alias("space_group"))


def read_records(spark, sf_dir):
    """Customers as records of a source: typed columns, the rest in a map, rows without a needed value dropped."""
    c = fx.table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("material_id"), F.when(F.col("c_custkey") % 11 > 0, F.col("c_nationkey")).alias("assigned_community"), F.col("c_acctbal").alias("nearest_centroid_distance"), F.when(F.col("c_acctbal") < 0, "True").otherwise("false").alias("outlier_like"), F.col("c_mktsegment").alias("segment"))
    got = readers.records(spark, _csv(rows, "records"))
    return got.groupBy(F.col("extras")["segment"].alias("segment"), F.col("assigned_community").cast("bigint").alias("community")).agg(F.count("*").alias("n"), F.sum(F.col("outlier_like").cast("int")).cast("bigint").alias("outliers"), r6(F.sum("nearest_centroid_distance")).alias("distance"))


def read_candidates(spark, sf_dir):
    """Records of at most 40 sites, of which the number is unknown for some."""
    p = fx.table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 13 > 0, F.col("p_name")).alias("id"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_size")).alias("n_sites"), "p_partkey")
    return readers.source_candidates(p, "id", "n_sites", 40, None).select("p_partkey")


def _documents(spark, sf_dir):
    """Structure records as files of one JSON list each."""
    j = fx.table(spark, sf_dir, "jarvis_records")
    atoms = F.from_json("atoms", "struct<lattice_mat: array<array<double>>, elements: array<string>>")
    rows = j.select(F.col("material_id").alias("jid"), F.col("icsd_field").alias("icsd"), F.col("ehull").cast("string").alias("ehull"), F.col("formation_energy").alias("formation_energy_peratom"), "reference", atoms.alias("atoms"))
    lists = rows.groupBy(F.pmod(F.xxhash64("jid"), F.lit(8)).alias("s")).agg(F.collect_list(F.struct(*rows.columns)).alias("l")).select(F.to_json("l").alias("value"))
    path = place(spark, "documents")
    lists.repartition(8, "value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.jarvis_documents(spark, path, most_sites=40)


def read_documents(spark, sf_dir):
    kept = _documents(spark, sf_dir)[0]
    return kept.groupBy("material_id").agg(F.count("*").alias("n"), F.max(F.size("atoms.elements")).cast("bigint").alias("sites"))


def read_document_drops(spark, sf_dir):
    return _documents(spark, sf_dir)[1]


def read_shards(spark, sf_dir):
    """Compressed shards of entries; those of a known formula and group are left out."""
    a = fx.table(spark, sf_dir, "alex_records")
    data = F.struct(F.col("material_id").alias("mat_id"), F.col("reduced_formula").alias("formula"), "spg", F.col("energy_above_hull").alias("e_above_hull"))
    sites = F.transform(F.sequence(F.lit(1), (F.col("spg") % 5 + 1).cast("int")), lambda k: F.struct(F.lit("A").alias("label")))
    entry = F.struct(data.alias("data"), F.struct(sites.alias("sites")).alias("structure"))
    shards = a.where("spg is not null").groupBy(F.pmod(F.xxhash64("material_id"), F.lit(8)).alias("s")).agg(F.collect_list(entry).alias("entries")).select(F.to_json(F.struct("entries"), {"ignoreNullFields": "false"}).alias("value"))
    path = place(spark, "shards")
    shards.write.option("compression", "bzip2").option("maxRecordsPerFile", 1).text(path)
    known = a.where("spg < 40 and reduced_formula is not null").select(F.col("reduced_formula").alias("formula"), "spg").distinct()
    got = readers.shards(spark, path, (0.0, 0.05), 4, known)
    return got.groupBy(F.col("spg").cast("bigint").alias("spg")).agg(F.count("*").alias("n"), F.sum("n_sites").cast("bigint").alias("sites"))


def read_cached_lines(spark, sf_dir):
    """Fetched entries kept as lines; those with provenance are left out."""
    m = fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("mp-"), F.col("s_suppkey").cast("string")).alias("material_id"), F.col("s_acctbal").alias("energy"), F.when(F.col("s_suppkey") % 4 == 0, F.array(F.col("s_nationkey"))).otherwise(F.array().cast("array<int>")).alias("icsd_ids"))
    path = place(spark, "lines")
    m.write.json(path)
    return readers.cached_lines(spark, path, "material_id string, energy double, icsd_ids array<int>").select("material_id", "energy")


def read_attribute_map(spark, sf_dir):
    """One object keyed by name, values numbers or lists whose last counts."""
    n = {r["n_name"]: {"degree": [r["n_regionkey"], r["n_nationkey"]], "core": r["n_regionkey"]} if r["n_nationkey"] % 2 else {"degree": r["n_nationkey"]} for r in fx.table(spark, sf_dir, "nation").collect()}
    path = _local(spark, "attributes") + ".json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(n, f)
    return readers.attribute_map(spark, "file://" + path, ["degree", "core"])


def _cif_texts(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "nation").collect()
    return {r["n_nationkey"]: (r["n_regionkey"], f"data_{r['n_nationkey']}\n_chemical_name_mineral '{r['n_name']}'\n_chemical_name_common {'?' if r['n_nationkey'] % 2 else 'x y'}\n{'THEORETICAL' if r['n_nationkey'] % 3 == 0 else 'measured'} structure\n") for r in rows}


def read_cif_headers(spark, sf_dir):
    """A folder of files: whether the head holds a word, and the tags that are given."""
    folder = _local(spark, "cif")
    os.makedirs(folder)
    for k, (_, text) in _cif_texts(spark, sf_dir).items():
        with open(f"{folder}/{k}.cif", "w", encoding="utf-8") as f:
            f.write(text)
    number = F.regexp_extract("path", r"(\d+)\.cif$", 1).cast("bigint")
    flags = readers.cif_flags(spark, "file://" + folder).select(number.alias("id"), "flagged")
    tags = spark.read.format("binaryFile").load("file://" + folder).select(number.alias("id"), readers.cif_tags(F.decode("content", "UTF-8")).alias("t"))
    return flags.join(tags, "id").select("id", "flagged", F.col("t")["_chemical_name_mineral"].alias("mineral"), F.col("t")["_chemical_name_common"].alias("common"))


def read_zip_members(spark, sf_dir):
    """An archive: members of a suffix without the excluded folder, their family and stem."""
    path = _local(spark, "archive") + ".zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (region, text) in _cif_texts(spark, sf_dir).items():
            z.writestr(f"top/region{region}/entry {k}.cif", text)
        z.writestr("readme.txt", "no")
    datasources.register(spark)
    got = spark.read.format("cifzip").option("exclude", "region3").option("blockfiles", 7).load(path)
    return got.select("id", "family", F.length("text").cast("bigint").alias("n_chars"), F.col("error").isNull().alias("ok"))


def read_npy(spark, sf_dir):
    """The matrix of the embeddings as a file: row numbers stand for the order of keys."""
    import numpy as np

    rows = fx.table(spark, sf_dir, "embeddings").orderBy("vec_id").select(F.col("embedding").cast("array<double>").alias("v")).toArrow().column(0).combine_chunks()
    path = _local(spark, "matrix") + ".npy"
    np.save(path, np.asarray(rows.flatten()).reshape(len(rows), -1))
    datasources.register(spark)
    got = spark.read.format("npy").option("blockrows", 500).load(path)
    return got.select("row_ix", r6(F.aggregate("v", F.lit(0.0), lambda s, e: s + e)).alias("total"), F.size("v").cast("bigint").alias("width"))


def read_xz_reactions(spark, sf_dir):
    """A compressed corpus of reactions: the formula of a target, else its text, else the first listed."""
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type").collect()
    shape = lambda r: ({"target": {"material_formula": r["p_brand"]}}, {"target": {"material_formula": " ", "material_string": r["p_type"]}}, {"targets_string": [r["p_brand"] + "!"]})[r["p_partkey"] % 3]
    path = _local(spark, "reactions") + ".json.xz"
    with lzma.open(path, "wt", encoding="utf-8") as f:
        json.dump({"reactions": [shape(r) for r in parts]}, f)
    datasources.register(spark)
    schema = "struct<reactions: array<struct<target: struct<material_formula: string, material_string: string>, targets_string: array<string>>>>"
    docs = spark.read.format("xzjson").load(path).select(F.from_json("value", schema).alias("d")).select("d.*")
    return readers.reaction_targets(docs)


def read_sheet(spark, sf_dir):
    """A sheet whose merged cells leave blanks: a blank region continues the one above."""
    rows = fx.table(spark, sf_dir, "nation").orderBy("n_regionkey", "n_nationkey").collect()
    ns, cells, before = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', [], None
    for k, r in enumerate(rows, 1):
        first = "" if r["n_regionkey"] == before else f'<c r="A{k}" t="inlineStr"><is><t>region {r["n_regionkey"]}</t></is></c>'
        cells.append(f'<row r="{k}">{first}<c r="B{k}" t="inlineStr"><is><t>{r["n_name"]}</t></is></c></row>')
        before = r["n_regionkey"]
    path = _local(spark, "sheet") + ".xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    datasources.register(spark)
    got = spark.read.format("xlsxrows").load(path).select("row", F.get("cells", F.lit(0)).alias("region"), F.get("cells", F.lit(1)).alias("name"))
    return tables.forward_fill(got, "row", ["region"]).select("name", "region")


def structure_descriptors(spark, sf_dir):
    """Structures from JSON, described by their elements: mean and largest atomic number, mean electronegativity, volume, sites."""
    from ..operators import embedding

    rows = fx.table(spark, sf_dir, "jarvis_records").select("material_id", "atoms").distinct()
    v = embedding.featurize(rows, "material_id", "atoms", "chem_only").where("ok")
    return v.select("material_id", r6(F.col("v")[0]).alias("mean_number"), F.col("v")[19].cast("bigint").alias("largest_number"), r6(F.col("v")[5]).alias("mean_x"), F.round(F.col("v")[63], 4).alias("volume"), F.col("v")[65].cast("bigint").alias("sites"))


def read_data_uri(spark, sf_dir):
    """Uploads as data URIs."""
    rows = [(r["n_nationkey"], "data:text/plain;base64," + base64.b64encode(r["n_name"].encode()).decode()) for r in fx.table(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame(rows, "id bigint, uri string").select("id", F.decode(readers.data_uri(F.col("uri")), "UTF-8").alias("text"))


def read_union_of_files(spark, sf_dir):
    """Two files of one schema read together, rows with a required column missing left out."""
    o = fx.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("assigned_community"), F.col("o_orderkey").alias("material_id"))
    o = o.withColumn("assigned_community", F.ascii("assigned_community")).withColumn("nearest_centroid_distance", F.lit(1.0))
    got = readers.records(spark, [_csv(o.where("material_id % 2 = 0"), "even"), _csv(o.where("material_id % 2 = 1"), "odd")])
    return got.groupBy(F.col("assigned_community").cast("bigint").alias("status")).agg(F.count("*").alias("n"))


def written_records(spark, sf_dir):
    """A record file in key order, partitioned by a column, read back."""
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    path = place(spark, "written")
    sinks.write_records(s, path, ["s_suppkey"], ["s_nationkey"])
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.groupBy(F.col("s_nationkey").cast("bigint").alias("nation")).agg(F.count("*").alias("n"), r6(F.sum("s_acctbal")).alias("balance"))


def written_nothing(spark, sf_dir):
    """An empty result keeps its columns."""
    path = place(spark, "nothing")
    sinks.write_records(fx.table(spark, sf_dir, "supplier").where("false"), path, fmt="parquet")
    back = spark.read.parquet(path)
    return back.agg(F.count("*").alias("n")).withColumn("width", F.lit(len(back.columns)).cast("bigint"))


def written_summary(spark, sf_dir):
    """A nested summary as JSON, what is not finite as null."""
    s = fx.table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("most")).first()
    path = _local(spark, "summary") + ".json"
    sinks.summary_json({"n": s["n"], "figures": {"most": s["most"], "ratio": float("nan")}}, path)
    return spark.read.option("multiLine", True).schema("n bigint, figures struct<most: double, ratio: double>").json("file://" + path).select("n", F.col("figures.most").alias("most"), F.col("figures.ratio").alias("ratio"))


def finite_columns(spark, sf_dir):
    """Infinite values as null with a flag."""
    s = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 9 == 0, float("inf")).when(F.col("s_suppkey") % 10 == 0, float("nan")).otherwise(F.col("s_acctbal").cast("double")).alias("x"))
    return sinks.finite(s)


def failures(spark, sf_dir):
    """The first 500 failures in key order with their message cut."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 25).alias("ok"), F.concat(F.lit("failed: "), F.col("p_type")).alias("error"))
    return sinks.failure_log(p, "ok", "error", "p_partkey", width=16)


def markdown_table(spark, sf_dir):
    """A table as Markdown lines."""
    text = sinks.markdown(fx.table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line bigint, text string")


def without_noise(spark, sf_dir):
    return frame.known(fx.entity(spark, sf_dir)).groupBy("community").agg(F.count("*").alias("n"))


def train_and_holdout(spark, sf_dir):
    train, held = frame.split(fx.entity(spark, sf_dir), 2000)
    return train.agg(F.count("*").alias("n")).withColumn("part", F.lit("train")).unionByName(held.agg(F.count("*").alias("n")).withColumn("part", F.lit("holdout")))


def array_operations(spark, sf_dir):
    """Norm, sum and largest place of vectors."""
    v = F.col("v")
    rows = fx.entity(spark, sf_dir)
    return rows.select("vec_id", r6(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))).alias("norm"), r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"), F.array_position(v, F.array_max(v)).alias("largest"))


QUERIES = {f.__name__: f for f in (
    read_communities_coerced, read_communities_skipped, read_communities_strictly, read_entry_index, read_records, read_candidates, read_documents, read_document_drops, read_shards, read_cached_lines, read_attribute_map,
    read_cif_headers, read_zip_members, read_npy, read_xz_reactions, read_sheet, structure_descriptors, read_data_uri, read_union_of_files, written_records, written_nothing, written_summary, finite_columns, failures, markdown_table, without_noise,
    train_and_holdout, array_operations,
)}

_A = "a AS (SELECT icsd_id, CASE WHEN icsd_id % 89 <> 0 THEN year END AS year, CASE WHEN icsd_id % 97 <> 0 THEN community END AS community FROM community_assignments)"
_J = "j AS (SELECT *, coalesce(json_array_length(atoms, '$.elements'), 0) AS sites FROM jarvis_records), w AS (SELECT *, CASE WHEN sites = 0 THEN 'other' WHEN trim(coalesce(icsd_field, '')) <> '' THEN 'icsd' WHEN ehull IS NULL OR isnan(ehull) OR ehull NOT BETWEEN 0 AND 0.1 THEN 'ehull' WHEN sites > 40 THEN 'size' END AS reason FROM j)"

SQL = {
    "read_communities_coerced": f"WITH {_A} SELECT coalesce(community, -1) AS community, count(*) AS n, count(year) AS dated, sum(icsd_id)::BIGINT AS ids FROM a GROUP BY 1",
    "read_communities_skipped": f"WITH {_A} SELECT community, count(*) AS n, min(year)::BIGINT AS first, max(year)::BIGINT AS last FROM a WHERE community >= 0 AND year BETWEEN 1900 AND 2025 GROUP BY community",
    "read_communities_strictly": f"WITH {_A} SELECT count(*) AS n, count(DISTINCT icsd_id) AS entities, sum(community)::BIGINT AS total FROM a WHERE community IS NOT NULL",
    "read_entry_index": "SELECT p_partkey::BIGINT AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN 'later' ELSE trim(p_name) END AS formula, (1900 + p_size)::BIGINT AS year, NULL::BIGINT AS space_group FROM part",
    "read_records": "SELECT c_mktsegment AS segment, c_nationkey::BIGINT AS community, count(*) AS n, sum((c_acctbal < 0)::INT)::BIGINT AS outliers, round(sum(c_acctbal), 6)::DOUBLE AS distance FROM customer WHERE c_custkey % 11 > 0 GROUP BY 1, 2",
    "read_candidates": "SELECT p_partkey FROM part WHERE p_partkey % 13 > 0 AND trim(p_name) <> '' AND (p_partkey % 7 = 0 OR p_size <= 40)",
    "read_documents": f"WITH {_J} SELECT material_id, count(*) AS n, max(sites)::BIGINT AS sites FROM w WHERE reason IS NULL GROUP BY material_id",
    "read_document_drops": f"WITH {_J} SELECT reason, count(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY reason",
    "read_shards": """WITH k AS (SELECT DISTINCT reduced_formula AS f, spg AS s FROM alex_records WHERE spg < 40 AND reduced_formula IS NOT NULL)
SELECT spg::BIGINT AS spg, count(*) AS n, sum(spg % 5 + 1)::BIGINT AS sites FROM alex_records WHERE energy_above_hull BETWEEN 0 AND 0.05 AND spg % 5 + 1 <= 4 AND NOT EXISTS (SELECT 1 FROM k WHERE f = reduced_formula AND s = spg) GROUP BY 1""",
    "read_cached_lines": "SELECT 'mp-' || s_suppkey AS material_id, s_acctbal::DOUBLE AS energy FROM supplier WHERE s_suppkey % 4 <> 0",
    "read_attribute_map": "SELECT n_name AS formula, n_nationkey::DOUBLE AS degree, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey ELSE 0 END::DOUBLE AS core FROM nation",
    "read_cif_headers": "SELECT n_nationkey::BIGINT AS id, n_nationkey % 3 = 0 AS flagged, n_name AS mineral, CASE WHEN n_nationkey % 2 = 0 THEN 'x y' END AS common FROM nation",
    "read_zip_members": "SELECT 'entry_' || n_nationkey AS id, 'region' || n_regionkey AS family, length('data_' || n_nationkey || chr(10) || '_chemical_name_mineral ''' || n_name || '''' || chr(10) || '_chemical_name_common ' || CASE WHEN n_nationkey % 2 = 1 THEN '?' ELSE 'x y' END || chr(10) || CASE WHEN n_nationkey % 3 = 0 THEN 'THEORETICAL' ELSE 'measured' END || ' structure' || chr(10)) AS n_chars, true AS ok FROM nation WHERE n_regionkey <> 3",
    "read_npy": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_ix, round(list_sum(embedding::DOUBLE[]), 6) + 0 AS total, len(embedding)::BIGINT AS width FROM embeddings",
    "read_xz_reactions": "SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN trim(p_brand) WHEN 1 THEN trim(p_type) ELSE p_brand || '!' END AS formula FROM part",
    "read_sheet": "SELECT n_name AS name, 'region ' || n_regionkey AS region FROM nation",
    "structure_descriptors": f"""WITH t AS (SELECT DISTINCT material_id, atoms FROM jarvis_records), z AS (SELECT * FROM (VALUES {", ".join(f"('{e}', {n}, {ELECTRONEGATIVITY.get(e, 0.0)})" for e, n in NUMBER.items())}) AS v(e, z, x)),
e AS (SELECT material_id, atoms, unnest(json_extract_string(atoms, '$.elements[*]')) AS e FROM t),
s AS (SELECT material_id, atoms, avg(z) AS mz, max(z) AS lz, avg(x::DOUBLE) AS mx, count(*) AS n FROM e JOIN z USING (e) GROUP BY 1, 2),
m AS (SELECT *, json_extract(atoms, '$.lattice_mat')::DOUBLE[][] AS l FROM s WHERE n <= 256)
SELECT material_id, round(mz, 6) AS mean_number, lz::BIGINT AS largest_number, round(mx, 6) AS mean_x, n AS sites, round(abs(l[1][1] * (l[2][2] * l[3][3] - l[2][3] * l[3][2]) - l[1][2] * (l[2][1] * l[3][3] - l[2][3] * l[3][1]) + l[1][3] * (l[2][1] * l[3][2] - l[2][2] * l[3][1])), 4) AS volume FROM m""",
    "read_data_uri": "SELECT n_nationkey::BIGINT AS id, n_name AS text FROM nation",
    "read_union_of_files": "SELECT ascii(o_orderstatus)::BIGINT AS status, count(*) AS n FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1",
    "written_records": "SELECT s_nationkey::BIGINT AS nation, count(*) AS n, round(sum(s_acctbal), 6)::DOUBLE AS balance FROM supplier GROUP BY 1",
    "written_nothing": "SELECT 0::BIGINT AS n, (SELECT count(*) FROM (DESCRIBE supplier)) AS width",
    "written_summary": "SELECT count(*) AS n, max(s_acctbal)::DOUBLE AS most, NULL::DOUBLE AS ratio FROM supplier",
    "finite_columns": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 10 <> 0 THEN s_acctbal::DOUBLE END AS x, s_suppkey % 9 = 0 AS x_infinite FROM supplier",
    "failures": "SELECT p_partkey, substr('failed: ' || p_type, 1, 16) AS error FROM part WHERE p_size <= 25 ORDER BY p_partkey LIMIT 500",
    "markdown_table": "SELECT 0::BIGINT AS line, '| r_regionkey | r_name |' AS text UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region",
    "without_noise": f"WITH {fx.ENTITY} SELECT community, count(*) AS n FROM fx_entity WHERE community >= 0 GROUP BY community",
    "train_and_holdout": f"WITH {fx.ENTITY} SELECT CASE WHEN year <= 2000 THEN 'train' ELSE 'holdout' END AS part, count(*) AS n FROM fx_entity WHERE year IS NOT NULL GROUP BY 1",
    "array_operations": f"WITH {fx.ENTITY} SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_sum(v), 6) + 0 AS total, list_position(v, list_max(v))::BIGINT AS largest FROM fx_entity",
}
