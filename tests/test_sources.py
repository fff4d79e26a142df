import bz2
import json
import lzma
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.sources import datasources, readers, sinks


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    datasources.register(spark)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_community_policies(spark, tmp_path):
    path = write(tmp_path / "c.csv", "icsd_id,year,community\n1,1990,0\n2,,x\nbad,1991,1\n3,1850,-1\n")
    rows = readers.communities(spark, path).collect()
    assert [(r["entity_id"], r["year"], r["community"]) for r in rows] == [(1, 1990, 0), (2, None, -1), (None, 1991, 1), (3, 1850, -1)]
    assert readers.communities(spark, path, "skip").count() == 2
    assert readers.communities(spark, path, "skip", years=(1900, 2025), noise=False).count() == 1
    with pytest.raises(Exception, match="no readable"):
        readers.communities(spark, path, "strict").collect()
    with pytest.raises(ValueError, match="policy"):
        readers.communities(spark, path, "other")


def test_aliases_and_guard(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "ID int, Name string")
    out = readers.resolve_columns(df, {"id": ["x", "id"], "name": ["name"], "none": ["z"]})
    assert out.first().asDict() == {"id": 1, "name": "a", "none": None}
    with pytest.raises(ValueError, match="no column for id"):
        readers.resolve_columns(df, {"id": ["q"]}, ("id",))
    with pytest.raises(FileNotFoundError, match="the table"):
        readers.require(spark, str(tmp_path / "none"), "the table")


def test_index_keeps_the_last_row(spark, tmp_path):
    path = write(tmp_path / "i.csv", "cif_names,name,publication_year,sym_group\n7,NaCl,1950,225\nICSD 8,,x,\n7,KCl,1960,221\n")
    got = {r["entity_id"]: (r["formula"], r["year"], r["space_group"]) for r in readers.entry_index(spark, path).collect()}
    assert got == {7: ("KCl", 1960, 221), 8: (None, None, None)}


def test_records_keep_extras(spark, tmp_path):
    path = write(tmp_path / "r.csv", "material_id,assigned_community,nearest_centroid_distance,outlier_like,hull\nm1,3,0.5,True,0.1\nm2,,0.5,False,\n")
    rows = readers.records(spark, path).collect()
    assert len(rows) == 1
    assert rows[0]["outlier_like"] is True
    assert rows[0]["extras"] == {"hull": "0.1"}


def test_candidates(spark):
    df = spark.createDataFrame([("a", 3), ("", 3), ("b", 999), ("c", None)], "id string, n int")
    assert {r["id"] for r in readers.source_candidates(df, "id", "n", 256, None).collect()} == {"a", "c"}
    assert readers.source_candidates(df, "id", None, 256, 1).count() == 1


def test_structure_documents(spark, tmp_path):
    docs = [
        {"jid": "J1", "icsd": "", "ehull": 0.01, "atoms": {"elements": ["Na", "Cl"], "lattice_mat": [], "coords": [], "cartesian": False}},
        {"jid": "J2", "icsd": "123", "ehull": 0.01, "atoms": {"elements": ["Na"]}},
        {"jid": "J3", "icsd": "", "ehull": "na", "atoms": {"elements": ["Na"]}},
        {"jid": "J4", "icsd": "", "ehull": 0.0, "atoms": {"elements": ["Na"] * 300}},
        {"jid": "J5", "icsd": "9", "ehull": 0.0, "atoms": {"elements": []}},
    ]
    kept, why = readers.jarvis_documents(spark, write(tmp_path / "j.json", json.dumps(docs)))
    assert [(r["material_id"], r["formula"]) for r in kept.collect()] == [("J1", "Cl1Na1")]
    assert {r["reason"]: r["n"] for r in why.collect()} == {"icsd": 1, "ehull": 1, "size": 1, "other": 1}


def test_compressed_shards(spark, tmp_path):
    entry = lambda i, f, sg, e: {"data": {"mat_id": i, "formula": f, "spg": sg, "e_above_hull": e}, "structure": {"sites": [{"label": "A"}]}}
    (tmp_path / "a.json.bz2").write_bytes(bz2.compress(json.dumps({"entries": [entry("m1", "NaCl", 225, 0.0), entry("m2", "KCl", None, 0.05)]}).encode()))
    (tmp_path / "b.json.bz2").write_bytes(bz2.compress(json.dumps([entry("m3", "LiF", 225, 0.9)]).encode()))
    known = spark.createDataFrame([("NaCl", 225), ("KCl", None)], "formula string, spg int")
    assert {r["material_id"] for r in readers.shards(spark, str(tmp_path)).collect()} == {"m1", "m2"}
    assert {r["material_id"] for r in readers.shards(spark, str(tmp_path), known=known).collect()} == {"m2"}


def test_attribute_map(spark, tmp_path):
    path = write(tmp_path / "n.json", json.dumps({"NaCl": {"deg": [1, 2, 5], "core": 3}, "KCl": {"deg": 4}}))
    got = {r["formula"]: (r["deg"], r["core"]) for r in readers.attribute_map(spark, path, ["deg", "core"]).collect()}
    assert got == {"NaCl": (5.0, 3.0), "KCl": (4.0, 0.0)}


def test_cif_texts(spark, tmp_path):
    write(tmp_path / "x.cif", "data_1\n_chemical_name_mineral 'Spinel'\n_chemical_name_common ?\nTHEORETICAL structure\n")
    assert readers.cif_flags(spark, str(tmp_path)).first()["flagged"]
    tags = spark.read.text(str(tmp_path), wholetext=True).select(readers.cif_tags(F.col("value")).alias("t")).first()["t"]
    assert tags == {"_chemical_name_mineral": "Spinel"}
    assert spark.createDataFrame([("data:text/plain;base64,aGk=",)], "u string").select(readers.data_uri(F.col("u")).alias("b")).first()["b"] == b"hi"


def test_npy(spark, tmp_path):
    x = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "f.npy", x)
    df = spark.read.format("npy").option("blockrows", 4).load(str(tmp_path / "f.npy"))
    assert df.rdd.getNumPartitions() == 3
    assert [r["v"] for r in df.orderBy("row_ix").collect()] == x.astype(float).tolist()


def test_zip_of_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("top/spinels/a b.cif", "data_a")
        z.writestr("top/other/c.cif", "data_c")
        z.writestr("__MACOSX/x.cif", "no")
        z.writestr("readme.txt", "no")
    df = spark.read.format("cifzip").option("exclude", "other").load(str(tmp_path / "z.zip"))
    assert [tuple(r) for r in df.collect()] == [("top/spinels/a b.cif", "a_b", "spinels", "data_a", None)]
    assert datasources.archive_member(["b", "c"], ["a", "c", "b"]) == "c"


def test_xz_reactions(spark, tmp_path):
    data = {"reactions": [{"target": {"material_formula": "NaCl"}}, {"target": {"material_formula": "", "material_string": "KCl"}}, {"targets_string": ["LiF"]}, {}]}
    with lzma.open(tmp_path / "r.json.xz", "wt") as f:
        json.dump(data, f)
    raw = spark.read.format("xzjson").load(str(tmp_path / "r.json.xz"))
    schema = "struct<reactions: array<struct<target: struct<material_formula: string, material_string: string>, targets_string: array<string>>>>"
    docs = raw.select(F.from_json("value", schema).alias("d")).select("d.*")
    assert {r["formula"] for r in readers.reaction_targets(docs).collect()} == {"NaCl", "KCl", "LiF"}


def sheet(path, rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return str(path)


def test_lab_targets(spark, tmp_path):
    path = sheet(tmp_path / "t.xlsx", [["A2B", "made phase"], [None, "inconclusive fit"], ["CD", None]])
    cells = spark.read.format("xlsxrows").load(path).select("row", F.get("cells", F.lit(0)).alias("formula"), F.get("cells", F.lit(1)).alias("conclusion"))
    results = spark.createDataFrame([("A2B", "Success", "mp-1"), ("CD", "Success (offline)", ""), ("E", "Failure", None)], "formula string, raw_result string, mp_id string")
    members = spark.createDataFrame([("auto/A2B/1.cif",), ("Manual_Refinement_Results/A2B/9.cif",), ("__MACOSX/A2B/2.cif",)], "member string")
    got = {r["formula"]: (r["corrected_outcome"], r["cif_member"]) for r in readers.lab_targets(results, cells, members).collect()}
    assert got == {"A2B": ("inconclusive", "Manual_Refinement_Results/A2B/9.cif"), "CD": ("offline_recovery", None), "E": ("not_obtained", None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, float("inf")), (1, 0.5)], "id int, fold double")
    sinks.write_records(df, str(tmp_path / "out"), ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    sinks.write_records(df.where("false"), str(tmp_path / "none"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "none")).columns == ["id", "fold"]
    got = {r["id"]: (r["fold"], r["fold_infinite"]) for r in sinks.finite(df).collect()}
    assert got == {2: (None, True), 1: (0.5, False)}
    sinks.summary_json({"a": float("nan"), "b": [1, {"c": float("inf")}]}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": None, "b": [1, {"c": None}]}
    assert sinks.markdown(df.orderBy("id")).splitlines()[2] == "| 1 | 0.5 |"
    log = sinks.failure_log(spark.createDataFrame([("a", False, "x" * 300), ("b", True, "")], "k string, ok boolean, e string"), "ok", "e", "k")
    assert [len(r["e"]) for r in log.collect()] == [200]


def test_options(monkeypatch):
    monkeypatch.setenv("LATTICEWORKS_K", "8")
    monkeypatch.setenv("LATTICEWORKS_CUTOFFS", "1980,1990")
    o = readers.Options.from_env()
    assert (o.k, o.cutoffs, o.alpha) == (8, (1980, 1990), 0.5)
