"""Matching records of several sources that describe one material and share no key: collective graph linkage.

Each record is read into one or more (composition, volume per atom) with a trust. Records of different sources that share a
composition and lie in neighbouring volume classes are linked; the blocks are narrow, and a link weighs what it shares by how
rare that is: a doubtful reading that meets a rare composition in another source is borne out by it. A record that names another
is evidence for the link. Meta-blocking drops links that are light beside the best of both their ends. What is left open, above all a
space group that one end does not give, is settled by the neighbours: records take on the groups of what they are linked to,
links gain from common neighbours, and both are repeated until nothing moves.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_staged, stage, staging

#: Volumes per atom of one material differ by less than this.
TENTH = 0.1
#: Rounds of propagation after which links that still move are an error.
MOST_ROUNDS = 60
_ROW = "id string, src string, sg int, comp string, vpa double, trust double, ref string"


def _read(src: str, kind: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .materials import read_report, read_structure, readings, space_group

        for batch in batches:
            out: list[tuple] = []
            for key, formula, group, body, ref in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == "report":
                    sg, volume, n = read_report(body)
                    found = readings(formula, None, volume, n)
                else:
                    sg = space_group(group)
                    atoms, volume = read_structure(body)
                    found = readings(formula, atoms, volume) if atoms else []
                out += [(key, src, sg, *r, ref) for r in found]
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "src", "sg", "comp", "vpa", "trust", "ref"])

    return run


def read_records(df: DataFrame, src: str, key: str, formula: str, group: str | None, body: str, ref: str | None = None) -> DataFrame:
    """The readings of one source. Of rows with one key the latest loaded counts; rows with a null key, and those from which
    neither composition nor volume can be read, describe nothing. ``ref`` names a record of another source, often wrongly, and is
    evidence only. Other columns are ignored."""
    cols = [F.col(key).cast("string").alias("k"), F.col(formula).cast("string").alias("f"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"), F.col(body).cast("string").alias("b")]
    cols.append((F.nullif(F.trim(F.col(ref).cast("string")), F.lit("")) if ref and ref in df.columns else F.lit(None).cast("string")).alias("r"))
    late = F.col("loaded_at") if "loaded_at" in df.columns else F.lit(None).cast("timestamp")
    one = df.where(F.col(key).isNotNull()).select(*cols, late.alias("w")).groupBy("k").agg(F.max(F.struct("w", "f", "g", "b", "r")).alias("s"))
    return one.select("k", "s.f", "s.g", "s.b", "s.r").mapInArrow(_read(src, "report" if group is None else "structure"), _ROW)


def candidate_links(rows: DataFrame, closest: float = TENTH) -> DataFrame:
    """``a, b, ga, gb, own``: pairs of records of different sources that agree in composition, in volume per atom up to
    ``closest`` and in space group as far as both give one, with what the pair by itself is worth. a < b."""
    import math

    width = math.log1p(closest)
    rows = rows.withColumn("bin", F.floor(F.log("vpa") / width).cast("int"))
    count = rows.groupBy("comp").agg(F.count_distinct("id").alias("df"))
    # how much likelier a shared composition is for one material than by chance: by the rarity of the composition
    total = rows.select("id").distinct().count()
    rows = rows.join(count, "comp").withColumn("rare", F.greatest(F.lit(float(total)) / F.col("df"), F.lit(1.0)))
    left = rows.select("comp", F.explode(F.array(F.col("bin") - 1, "bin", F.col("bin") + 1)).alias("bin"), *[F.col(c).alias(f"{c}_a") for c in ("id", "src", "sg", "vpa", "trust", "ref")])
    right = rows.select("comp", "bin", "rare", *[F.col(c).alias(f"{c}_b") for c in ("id", "src", "sg", "vpa", "trust", "ref")])
    off = F.abs(F.log(F.col("vpa_a") / F.col("vpa_b")))
    pairs = left.join(right, ["comp", "bin"]).where(
        (F.col("id_a") < F.col("id_b")) & (F.col("src_a") != F.col("src_b")) & (off < width) & F.coalesce(F.col("sg_a") == F.col("sg_b"), F.lit(True))
    )
    # a doubtful reading that meets its like in another source is borne out by it, the more the rarer the composition
    trust = F.col("trust_a") * F.col("trust_b")
    borne = trust * F.col("rare") / (trust * F.col("rare") + 1 - trust)
    named = F.coalesce(F.col("ref_a") == F.col("id_b"), F.lit(False)) | F.coalesce(F.col("ref_b") == F.col("id_a"), F.lit(False))
    own = borne * F.exp(-F.pow(off / width, 2) * 0.25)
    own = F.when(named, 1 - (1 - own) * 0.5).otherwise(own)
    # two readings of one record give one link, the better
    return pairs.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("sg_a").alias("ga"), F.col("sg_b").alias("gb")).agg(F.max(own).alias("own"))


def prune(links: DataFrame, share: float = 0.5) -> DataFrame:
    """Meta-blocking: drops the links that weigh less than ``share`` of the heaviest link of both their ends."""
    ends = links.select(F.col("a").alias("n"), "own").unionByName(links.select(F.col("b").alias("n"), "own"))
    best = ends.groupBy("n").agg(F.max("own").alias("most"))
    kept = links.join(best.withColumnRenamed("n", "a").withColumnRenamed("most", "ma"), "a").join(best.withColumnRenamed("n", "b").withColumnRenamed("most", "mb"), "b")
    return kept.where(F.col("own") >= share * F.least("ma", "mb")).drop("ma", "mb")


def _both(links: DataFrame, *more: str) -> DataFrame:
    one = links.select(F.col("a").alias("n"), F.col("b").alias("m"), F.col("ga").alias("gn"), F.col("gb").alias("gm"), *more)
    return one.unionByName(links.select(F.col("b").alias("n"), F.col("a").alias("m"), F.col("gb").alias("gn"), F.col("ga").alias("gm"), *more))


def propagate(links: DataFrame, still: float = 0.01) -> DataFrame:
    """``a, b, confidence``: the links with what their neighbours say, repeated until no link moves by more than ``still``.

    Only links with an end of unknown space group, or of doubtful reading, can move; the others are evidence. An end without a
    group believes in the groups of its neighbours in proportion to their links; a link to a group it does not believe in loses.
    """
    start = F.when(F.col("ga").isNull() | F.col("gb").isNull(), 0.8).otherwise(1.0)
    links = stage(links.withColumn("s", F.col("own") * start), "links")
    open_ = (F.col("ga").isNull() | F.col("gb").isNull()) | (F.col("own") < 0.8)
    for _ in range(MOST_ROUNDS):
        both = _both(links, "s")
        votes = both.where(F.col("gn").isNull() & F.col("gm").isNotNull()).groupBy("n", F.col("gm").alias("g")).agg(F.sum("s").alias("v"))
        belief = votes.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("n"))).select("n", "g", "p")
        moving = links.where(open_)
        # the belief of an unknown end in the group of the known one
        m = moving.join(belief.select(F.col("n").alias("a"), F.col("g").alias("gb"), F.col("p").alias("pa")), ["a", "gb"], "left")
        m = m.join(belief.select(F.col("n").alias("b"), F.col("g").alias("ga"), F.col("p").alias("pb")), ["b", "ga"], "left")
        # two unknown ends: what they believe in common
        unknown = moving.where(F.col("ga").isNull() & F.col("gb").isNull()).select("a", "b")
        common = unknown.join(belief.select(F.col("n").alias("a"), "g", F.col("p").alias("qa")), "a").join(belief.select(F.col("n").alias("b"), F.col("g").alias("h"), F.col("p").alias("qb")), "b")
        common = common.groupBy("a", "b").agg(F.sum(F.when(F.col("g") == F.col("h"), F.col("qa") * F.col("qb")).otherwise(0.0)).alias("pc"))
        # common neighbours that agree with both ends
        arms = both.where(F.col("s") >= 0.5).select("n", "m", "s")
        paths = moving.select("a", "b").join(arms.select(F.col("n").alias("a"), F.col("m").alias("c"), F.col("s").alias("sa")), "a")
        paths = paths.join(arms.select(F.col("n").alias("b"), F.col("m").alias("c"), F.col("s").alias("sb")), ["b", "c"])
        support = paths.groupBy("a", "b").agg(F.max(F.least("sa", "sb")).alias("sup"))
        m = m.join(common, ["a", "b"], "left").join(support, ["a", "b"], "left")
        one = F.when(F.col("ga").isNull() & F.col("gb").isNotNull(), F.coalesce("pa", F.lit(0.5))).when(F.col("gb").isNull() & F.col("ga").isNotNull(), F.coalesce("pb", F.lit(0.5)))
        sure = one.when(F.col("ga").isNull() & F.col("gb").isNull(), F.coalesce("pc", F.lit(0.6))).otherwise(1.0)
        value = F.col("own") * (0.3 + 0.7 * sure)
        value = value + (1 - value) * 0.25 * F.coalesce("sup", F.lit(0.0)) * sure
        moved = m.select("a", "b", "ga", "gb", "own", value.alias("s2"), F.abs(value - F.col("s")).alias("by"))
        moved = stage(moved, "moved")
        most = moved.agg(F.max("by")).first()[0] or 0.0
        links = stage(links.where(~open_).unionByName(moved.select("a", "b", "ga", "gb", "own", F.col("s2").alias("s"))), "links")
        if most <= still:
            return links.select("a", "b", F.col("s").alias("confidence"))
    raise ValueError(f"links still move after {MOST_ROUNDS} rounds")


def match_materials(spark: SparkSession, mp: DataFrame, jarvis: DataFrame, alex: DataFrame, targets: DataFrame) -> DataFrame:
    """``id_a, id_b, confidence``: rows of different sources that may describe one material, smaller id first, byte by byte.

    Rows that repeat count once. Two ids of one source are not compared with each other, both are with the other sources. Rows
    without readable composition or volume match nothing; a missing space group is left to the neighbours.
    """
    parts = [
        read_records(mp, "mp", "material_id", "reduced_formula", "spg", "structure"),
        read_records(jarvis, "jarvis", "material_id", "reduced_formula", "spg", "atoms"),
        read_records(alex, "alex", "material_id", "reduced_formula", "spg", "structure"),
        read_records(targets, "alab", "target_id", "formula", None, "conclusion", "mp_id"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    with staging():
        links = propagate(prune(candidate_links(stage(rows, "readings"))))
        return keep_staged(stage(links.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "confidence"), "matches"))
