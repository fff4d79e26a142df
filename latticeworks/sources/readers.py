"""Readers of tables and documents, with stated policies for what cannot be read."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import to_bool, to_float, to_int, to_int_digits
from ..operators.tables import first_reason

#: Names under which columns of an entry index may come, in order of preference.
INDEX_ALIASES = {"entry_id": ["cif_names", "ICSDid", "ICSD ID", "Collection Code"], "name": ["name", "formula", "Name", "Formula"], "space_group": ["sym_group", "space_group", "sg"], "year": ["publication_year", "year"]}


@dataclass(frozen=True)
class Options:
    """Settings of a run, from the environment where a variable is set."""

    cutoffs: tuple[int, ...] = (1990, 2000, 2010)
    percentile: float = 95.0
    alpha: float = 0.5
    beta: float = 0.5
    k: int = 16
    resolution: float = 1.0

    @classmethod
    def from_env(cls, prefix: str = "LATTICEWORKS_") -> Options:
        plain = {f: type(getattr(cls, f))(os.environ[prefix + f.upper()]) for f in ("percentile", "alpha", "beta", "k", "resolution") if prefix + f.upper() in os.environ}
        cut = os.environ.get(prefix + "CUTOFFS")
        return cls(**plain, **({"cutoffs": tuple(map(int, cut.split(",")))} if cut else {}))


def require(spark: SparkSession, path: str, what: str) -> str:
    """The path, if something is there; else an error that says what is missing and where it was looked for."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"{what} not found at {path}; pass its path or put it there")
    return path


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """One column per canonical name: the first alias that is there, exactly or else in another letter case; null if none is."""
    low = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name, candidates in aliases.items():
        found = next((c for c in candidates if c in df.columns), None) or next((low[c.lower()] for c in candidates if c.lower() in low), None)
        if found is None and name in required:
            raise ValueError(f"no column for {name}: looked for {', '.join(candidates)}")
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def _text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def communities(spark: SparkSession, path: str, policy: str = "coerce", years: tuple[int, int] | None = None, noise: bool = True) -> DataFrame:
    """``entity_id, year, community`` of a CSV file.

    ``coerce`` makes what cannot be read null (a community -1), ``skip`` drops rows without a readable id or community,
    ``strict`` fails on them. A year that cannot be read is null in all three. With ``years`` only rows dated in that range stay.
    """
    raw = resolve_columns(_text(spark, path), {"entity_id": ["icsd_id", "entity_id", "id"], "year": ["year"], "community": ["community", "cluster"]}, ("entity_id", "community"))
    rows = raw.select(to_int(F.col("entity_id")).alias("entity_id"), to_int(F.col("year")).alias("year"), to_int(F.col("community")).alias("community"))
    bad = F.col("entity_id").isNull() | F.col("community").isNull()
    if policy == "strict":
        rows = rows.withColumn("entity_id", F.when(bad, F.raise_error(F.lit("a row has no readable id or community")).cast("bigint")).otherwise(F.col("entity_id")))
    elif policy == "skip":
        rows = rows.where(~bad)
    elif policy == "coerce":
        rows = rows.withColumn("community", F.coalesce("community", F.lit(-1).cast("bigint")))
    else:
        raise ValueError("policy is coerce, skip or strict")
    if years:
        rows = rows.where(F.col("year").between(*years))
    return rows if noise else rows.where(F.col("community") >= 0)


def entry_index(spark: SparkSession, path: str, aliases: dict[str, list[str]] = INDEX_ALIASES) -> DataFrame:
    """``entity_id, formula, year, space_group``: of rows with one id the last counts."""
    raw = _text(spark, path)
    rows = resolve_columns(raw, aliases, ("entry_id", "name")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select(to_int_digits(F.col("entry_id")).alias("entity_id"), F.nullif(F.trim("name"), F.lit("")).alias("formula"), to_int(F.col("year")).alias("year"), to_int(F.col("space_group")).alias("space_group"), "_row")
    last = rows.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.max_by(F.struct("formula", "year", "space_group"), "_row").alias("s"))
    return last.select("entity_id", "s.formula", "s.year", "s.space_group")


#: The shared columns of record files and how each is read; a source may have more, which are kept as text.
RECORD_TYPES = {"material_id": "string", "cif_id": "string", "reduced_formula": "string", "year": "int", "assigned_community": "int", "nearest_centroid_distance": "float", "outlier_like": "bool", "is_in_basin": "bool", "A_i": "float", "pca1": "float", "pca2": "float"}


def records(spark: SparkSession, path: str | list[str], needed: tuple[str, ...] = ("assigned_community", "nearest_centroid_distance")) -> DataFrame:
    """Records of an external source: known columns typed, all others in a map ``extras``; rows that lack a needed value are
    dropped."""
    raw = _text(spark, path)
    read = {"int": to_int, "float": to_float, "bool": to_bool, "string": lambda c: F.nullif(F.trim(c), F.lit(""))}
    typed = [read[t](F.col(f"`{c}`")).alias(c) for c, t in RECORD_TYPES.items() if c in raw.columns]
    rest = [x for c in raw.columns if c not in RECORD_TYPES for x in (F.lit(c), F.col(f"`{c}`"))]
    extras = (F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")).alias("extras")
    return raw.select(*typed, extras).dropna(subset=[c for c in needed if c in raw.columns])


def source_candidates(df: DataFrame, key: str, n_sites: str | None, most_sites: int, n: int | None, seed: int = 0) -> DataFrame:
    """Candidates with an id and no more sites than allowed (unknown counts pass). With ``n`` that many in the order of a
    seeded hash; a limited sort, so the rest is never ordered."""
    out = df.where(F.col(key).isNotNull() & (F.trim(F.col(key)) != ""))
    if n_sites:
        out = out.where(F.col(n_sites).isNull() | (F.col(n_sites) <= most_sites))
    return out if n is None else out.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


JARVIS_SCHEMA = "jid string, icsd string, ehull string, formation_energy_peratom double, reference string, atoms struct<lattice_mat: array<array<double>>, elements: array<string>, coords: array<array<double>>, cartesian: boolean>"


def jarvis_documents(spark: SparkSession, path: str, require_empty_icsd: bool = True, ehull: tuple[float, float] = (0.0, 0.1), most_sites: int = 256) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON list of structures, and how many were dropped for which reason: ``reason, n``.

    The first reason that holds counts, in the order other, icsd, ehull, size.
    """
    raw = spark.read.schema(JARVIS_SCHEMA).option("multiLine", True).json(path).withColumn("hull", to_float(F.col("ehull")))
    none = F.coalesce(F.size("atoms.elements"), F.lit(0)) <= 0
    reasons = {
        "other": none,
        "icsd": F.lit(require_empty_icsd) & (F.trim(F.coalesce("icsd", F.lit(""))) != ""),
        "ehull": F.col("hull").isNull() | ~F.col("hull").between(*ehull),
        "size": F.size("atoms.elements") > most_sites,
    }
    marked = raw.withColumn("reason", first_reason(reasons))
    count = F.transform(F.array_sort(F.array_distinct("atoms.elements")), lambda e: F.concat(e, F.size(F.filter("atoms.elements", lambda x: x == e)).cast("string")))
    kept = marked.where(F.col("reason").isNull()).select(F.col("jid").alias("material_id"), F.array_join(count, "").alias("formula"), F.col("hull").alias("ehull"), F.col("formation_energy_peratom").alias("formation_energy"), F.col("icsd").alias("icsd_field"), "reference", "atoms")
    return kept, marked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


SHARD_ENTRY = "struct<data: struct<mat_id: string, formula: string, spg: int, e_above_hull: double>, entry_id: string, structure: struct<sites: array<struct<label: string>>>>"


def shards(spark: SparkSession, path: str | list[str], ehull: tuple[float, float] = (0.0, 0.1), most_sites: int = 256, known: DataFrame | None = None) -> DataFrame:
    """``material_id, formula, spg, ehull, n_sites`` of JSON shards, compressed or not, whose entries stand under ``entries`` or
    in a bare list. ``known(formula, spg)`` is left out; an entry without a space group is never known."""
    files = spark.read.text(path, wholetext=True)
    entries = F.coalesce(F.from_json("value", f"struct<entries: array<{SHARD_ENTRY}>>")["entries"], F.from_json("value", f"array<{SHARD_ENTRY}>"))
    e = files.select(F.explode(entries).alias("e"))
    out = e.select(F.coalesce("e.data.mat_id", "e.entry_id").alias("material_id"), F.col("e.data.formula").alias("formula"), F.col("e.data.spg").alias("spg"), F.col("e.data.e_above_hull").alias("ehull"), F.size("e.structure.sites").alias("n_sites"))
    out = out.where(F.col("ehull").between(*ehull) & (F.col("n_sites") <= most_sites))
    return out if known is None else out.join(known.select("formula", "spg"), ["formula", "spg"], "left_anti")


def attribute_map(spark: SparkSession, path: str, attributes: list[str], formula: Column | None = None) -> DataFrame:
    """``formula`` and one column per attribute of a JSON object keyed by formula, whose values are numbers or lists of which
    the last counts. Keys that become equal keep the later one."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.posexplode(F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))))).select("pos", F.col("key").alias("formula"), F.col("value").alias("a"))
    number = lambda name: to_float(F.regexp_extract(F.col("a")[name], r"(-?[0-9][0-9.eE+-]*)[\s\]]*$", 1))
    cols = [F.coalesce(number(a), F.when(F.lower(F.col("a")[a]) == "true", 1.0), F.lit(0.0)).alias(a) for a in attributes]
    rows = parsed.select("pos", (formula if formula is not None else F.col("formula")).alias("formula"), F.struct(*cols).alias("s"))
    return rows.where(F.col("formula").isNotNull()).groupBy("formula").agg(F.max_by("s", "pos").alias("s")).select("formula", "s.*")


def cached_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries fetched earlier and kept as JSON lines; those with provenance in ``icsd_ids`` are left out."""
    rows = spark.read.schema(schema).json(path)
    return rows.where(F.coalesce(F.size("icsd_ids"), F.lit(0)) <= 0) if "icsd_ids" in rows.columns else rows


def cif_flags(spark: SparkSession, path: str, word: str = "theoretical", head: int = 8192) -> DataFrame:
    """``path, flagged``: whether the first bytes of each file hold a word, in any letter case."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode(F.substring("content", 1, head), "ISO-8859-1")
    return files.select("path", F.lower(text).contains(word.lower()).alias("flagged"))


#: Tags that are read from a CIF text.
CIF_TAGS = ["_chemical_name_mineral", "_chemical_name_common", "_chemical_name_systematic", "_chemical_name_structure_type", "_chemical_formula_sum"]


def cif_tags(text: Column, tags: list[str] = CIF_TAGS) -> Column:
    """MAP<STRING, STRING> of the tags that a CIF text gives; quotes are stripped, ``?`` and ``.`` are no values."""
    value = lambda t: F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?im)^{t}[ \t]+(.+?)[ \t]*$", 1), r"^['\"]|['\"]$", ""))
    pairs = F.array(*[F.struct(F.lit(t).alias("k"), value(t).alias("v")) for t in tags])
    return F.map_from_entries(F.filter(pairs, lambda p: ~p["v"].isin("", "?", ".")))


def data_uri(uri: Column) -> Column:
    """The bytes of a base64 data URI."""
    return F.unbase64(F.regexp_replace(uri, r"^data:[^,]*,", ""))


def reaction_targets(documents: DataFrame) -> DataFrame:
    """Distinct ``formula`` of the targets of reactions: the formula, else its text, else the first of the listed targets."""
    r = documents.select(F.explode("reactions").alias("r"))
    use = lambda c: F.nullif(F.trim(c), F.lit(""))
    return r.select(F.coalesce(use(F.col("r.target.material_formula")), use(F.col("r.target.material_string")), use(F.get(F.col("r.targets_string"), F.lit(0)))).alias("formula")).where(F.col("formula").isNotNull()).distinct()


def lab_targets(results: DataFrame, table: DataFrame, members: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``formula, raw_result, mp_id, corrected_outcome, conclusion, cif_member`` from a result list, a refinement table whose
    merged cells leave blanks (``row, formula, conclusion``), and the names of files (``member``).

    A blank formula continues the one above. Of several files of a formula those refined by hand come first, then by name.
    """
    from ..operators.tables import forward_fill, outcome

    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    canonical = lambda c: F.coalesce(F.element_at(names, c), c) if aliases else c
    filled = forward_fill(table.withColumn("formula", F.nullif(F.trim("formula"), F.lit(""))), "row", ["formula"])
    said = filled.where(F.trim("conclusion") != "").groupBy(canonical(F.col("formula")).alias("formula")).agg(F.max_by("conclusion", "row").alias("conclusion"))
    files = members.where(F.lower("member").endswith(".cif") & ~F.col("member").startswith("__MACOSX/") & (F.size(F.split("member", "/")) > 1))
    files = files.select(canonical(F.split("member", "/")[1]).alias("formula"), "member").groupBy("formula").agg(F.min(F.struct((~F.col("member").startswith("Manual_Refinement_Results/")).alias("auto"), "member")).alias("s")).select("formula", F.col("s.member").alias("cif_member"))
    out = results.join(said, "formula", "left").join(files, "formula", "left")
    return out.select("formula", "raw_result", "mp_id", outcome(F.col("raw_result"), F.col("conclusion")).alias("corrected_outcome"), F.coalesce("conclusion", F.lit("")).alias("conclusion"), "cif_member")
