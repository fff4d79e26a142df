"""Clusters of mutually similar records, by bisecting k-means across the cluster.

1. Nodes are split by two-means, largest dispersion first, in rounds across the cluster, until none holds more rows than a task
   should; the splits of a round are fitted on bounded samples and every row is routed.
2. Within a node the splits go on over all its rows until compactness limits hold. The leaves are units: compact pieces of at
   most 64 rows, and single rows.
3. A cluster that a split has cut lies in several leaves. Leaves meet again in views: cells of two other bisecting trees, fitted
   on the leaves, each leaf in the three nearest of both. There parts of one cluster are linked; links make groups.
4. In every group the smallest isolated sets are found exactly, and what is near a set is held against it. What lies within a
   group is first taken into it. In a group of more than ``exact_rows`` rows only those are judged, in blocks, each against all
   rows of the group as they stream by, that may be in a set smaller than the group; to find them, each row is held against a
   seventh of the group, see ``_to_judge``. This is quadratic in the group, at some two nanoseconds a pair of a fourteenth.

Equal vectors are one row with its copies throughout, so repeated records cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import VECTOR_WIDTH, as_lists, distinct_vectors, drawn, keep_staged, matrix, stage, staging

#: Sets of large groups whose shapes are sent to the tasks at once.
SETS_SENT = 20_000


@dataclass(frozen=True)
class Limits:
    least: int = 8  #: records of a cluster
    apart: float = 1.3  #: how many times as far as any member whatever is outside lies
    sample: int = 32768  #: rows on which the splits of one level are fitted
    cell_rows: int = 4096  #: aimed at; a cell of three times as many is split once more
    unit_rows: int = 64
    view_units: int = 3000  #: units aimed at per view
    views: int = 3  #: views of each tree that a unit is in
    exact_rows: int = 4096  #: distinct vectors; larger groups are judged in blocks
    block_rows: int = 8192
    seeds: int = 4096  #: rows of a large group that are judged in any case
    widest: float = 0.5  #: largest rms radius of a unit, as a part of that of all rows


def _route(centres, at: str = "v"):
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        top, below = centres.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(batch.schema.get_field_index(at)))
            cell = np.argmin((top * top).sum(1) - 2 * (x @ top.T), axis=1)
            for level in below:
                for c in np.unique(cell):
                    if int(c) in level:
                        first, own = level[int(c)]
                        rows = cell == c
                        cell[rows] = first + np.argmin((own * own).sum(1) - 2 * (x[rows] @ own.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def route(rows: DataFrame, total: int, limits: Limits) -> tuple[DataFrame, float]:
    """Adds the cell of each row, so that no cell holds many more than ``cell_rows``; and the rms radius of the sample."""
    from .cells import bisect

    spark = rows.sparkSession
    x = drawn(rows, "id", "v", limits.sample, total, 5)
    spread = float(x.astype(float).var(0).sum() ** 0.5) if len(x) else 0.0
    top, below = bisect(x, min(max(1, -(-total // limits.cell_rows)), max(1, len(x) // 16))), []
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", cell int"
    next_cell, whole = len(top), set()
    while True:
        routed = rows.mapInArrow(_route(spark.sparkContext.broadcast((top, below))), schema)
        if total <= 3 * limits.cell_rows:
            return routed, spread
        counts = routed.groupBy("cell").count().where(F.col("count") > 3 * limits.cell_rows).toArrow()
        large = {c: n for c, n in zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True) if c not in whole}
        # the largest first, as many as a sample serves
        large = dict(sorted(large.items(), key=lambda p: (-p[1], p[0]))[: max(1, limits.sample // 256)])
        if not large:
            return routed, spread
        each = limits.sample // len(large)
        share = F.create_map(*[F.lit(v) for c, n in large.items() for v in (c, int(2**31 * min(1, each / n)))])[F.col("cell")]
        part = routed.where(F.pmod(F.xxhash64("id", F.lit(7 + len(below))), F.lit(2**31)) < share).sort("id").select("cell", "v").toArrow()
        cells, x, level = part.column("cell").to_numpy(), matrix(part.column("v")), {}
        for c, n in large.items():
            own = x[cells == c]
            own = bisect(own, min(-(-n // limits.cell_rows) + 1, max(2, len(own) // 8))) if len(own) > 1 else own
            if len(own) > 1:
                level[c] = next_cell, own
                next_cell += len(own)
            else:
                whole.add(c)
        if level:
            below = [*below, level]


def _make_units(limits: Limits, widest: float):
    def run(got):
        import numpy as np

        from .cells import summaries, units

        got = got.combine_chunks()
        order = np.argsort(got.column("id").to_numpy(), kind="stable")
        ids, copies, x = got.column("id").to_numpy()[order], got.column("copies").to_numpy()[order].astype(np.int64), matrix(got.column("v"))[order]
        unit = units(x, copies, limits.unit_rows, limits.least, widest)
        first, n, centre, rms, radius = summaries(x, copies, unit)
        names = ids[first]
        lead = np.full(len(ids), -1)
        lead[first] = np.arange(len(first))
        led = lead >= 0
        mask = ~led
        at = np.maximum(lead, 0)
        values = as_lists(centre[at], len(ids)) if len(ids) else pa.array([], pa.list_(pa.float32()))
        ends = values.offsets
        centre_col = pa.ListArray.from_arrays(ends, values.values, mask=pa.array(mask))
        return pa.table(
            {
                "id": ids,
                "copies": copies.astype(np.int32),
                "v": as_lists(x, len(ids)),
                "unit": names[unit],
                "n": pa.array(n[at], mask=mask),
                "c": centre_col,
                "rms": pa.array(rms[at], mask=mask),
                "radius": pa.array(radius[at], mask=mask),
            }
        )

    return run


_MEMBER = "id bigint, copies int, v array<float>, unit bigint, n bigint, c array<float>, rms double, radius double"
_UNIT = "unit bigint, n bigint, c array<float>, rms double, radius double"


def view_trees(units: DataFrame, limits: Limits):
    """The leaves of two bisecting trees fitted on bounded samples of the units, sent to the tasks."""
    from .cells import bisect

    total, trees = units.count(), []
    for seed in (17, 29):
        x = drawn(units, "unit", "c", limits.sample, total, seed)
        trees.append(bisect(x, min(max(1, -(-total * limits.views // limits.view_units)), max(1, len(x) // 8))))
    return units.sparkSession.sparkContext.broadcast(trees)


def view(units: DataFrame, sent, limits: Limits, columns: list[str]) -> DataFrame:
    """Each unit in the nearest cells of the two trees."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            x, base = matrix(batch.column(batch.schema.get_field_index("c"))), 0
            for tree in sent.value:
                k = min(limits.views, len(tree))
                d = (tree * tree).sum(1) - 2 * (x @ tree.T)
                near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(tree) else np.tile(np.arange(k), (len(x), 1))
                at = np.repeat(np.arange(len(x)), k)
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array((base + near.ravel()).astype(np.int32))], names=[*batch.schema.names, "cell"])
                base += len(tree)

    kinds = dict(units.dtypes)
    return units.select(*columns).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", cell int")


def _link(limits: Limits):
    def run(got):
        import numpy as np

        from .cells import links

        got = got.combine_chunks()
        ids, n, c, r = got.column("unit").to_numpy(), got.column("n").to_numpy(), matrix(got.column("c")), got.column("rms").to_numpy()
        order = np.argsort(ids, kind="stable")
        src, dst, dist, reach = links(ids[order], n[order], c[order], r[order], limits.least)
        return pa.table({"a": pa.array(src, pa.int64()), "b": pa.array(dst, pa.int64()), "d": pa.array(dist, pa.float64()), "reach": pa.array(reach, pa.float64()), "cell": pa.array([got.column("cell")[0].as_py()] * len(src), pa.int32())})

    return run


def link_units(units: DataFrame, trees, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """``a, b``: units that belong together; and ``unit, cell``: small units that see no gap in a view.

    Each small unit is heard in the view in which its reach, the distance that its links span, is the shortest. Its link to
    another holds if it is no longer than the other's own neighbourhood allows: 1.6 times its reach, or 2.5 times the rms radius
    of a unit of many rows.
    """
    said = view(units, trees, limits, ["unit", "n", "c", "rms"]).groupBy("cell").applyInArrow(_link(limits), "a bigint, b bigint, d double, reach double, cell int")
    said = stage(said, "links")
    lost, said = said.where("a = b").select(F.col("a").alias("unit"), "cell"), said.where("a <> b")
    best = said.groupBy("a").agg(F.min("reach").alias("best"))
    heard = said.join(best, "a").where(F.col("reach") <= F.col("best")).select("a", "b", "d").distinct()
    other = units.select(F.col("unit").alias("b"), "n", "rms").join(best.withColumnRenamed("a", "b"), "b", "left")
    held = heard.join(other, "b").where((F.col("d") == 0) | F.when(F.col("n") >= limits.least, F.col("d") <= 2.5 * F.col("rms")).otherwise(F.col("d") <= 1.6 * F.col("best")))
    return held.select("a", "b"), lost


def grouped(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """``unit, grp``: the smallest unit that links lead to. Labels travel along links and then to the label's own label, so
    rounds grow with the logarithm of the longest chain."""
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = stage(units.select("unit", F.col("unit").alias("grp")), "labels")
    while True:
        around = both.join(labels.select(F.col("unit").alias("b"), "grp"), "b").groupBy("a").agg(F.min("grp").alias("low"))
        step = labels.join(around.withColumnRenamed("a", "unit"), "unit", "left").select("unit", "grp", F.least("grp", F.coalesce("low", "grp")).alias("new"))
        jump = step.select(F.col("unit").alias("new"), F.col("new").alias("further"))
        after = stage(step.join(jump, "new", "left").select("unit", "grp", F.least("new", F.coalesce("further", "new")).alias("new")), "labels")
        moved = after.where("new < grp").limit(1).count()
        labels = after.select("unit", F.col("new").alias("grp"))
        if not moved:
            return labels


def _surroundings(limits: Limits):
    """In a view, units of other groups: near a group (kind 0) or within it (kind 2).

    Members of a set whose largest distance is w lie within 0.75 w of its centre, and what is 1.3 w from all of them lies beyond
    1.1 w of it; 1.9 rms radii part the two. A unit within was cut off from its group by a split, or the group is not isolated
    without it; either way it belongs in the same look.
    """

    def run(got):
        import numpy as np

        from .cells import squared

        got = got.combine_chunks()
        unit, c = got.column("unit").to_numpy(), matrix(got.column("c"))
        grp, gn = got.column("grp").to_numpy(), got.column("gn").to_numpy()
        gc, gr, grms, radius = matrix(got.column("gc")), got.column("gradius").to_numpy(), got.column("grms").to_numpy(), got.column("radius").to_numpy()
        _, one = np.unique(grp, return_index=True)
        one = one[gn[one] >= limits.least]
        out_g, out_u, out_k = [], [], []
        step = max(1, 2_000_000 // max(len(unit), 1))
        for s in range(0, len(one), step):
            g = one[s : s + step]
            d = np.sqrt(squared(gc[g], c))
            foreign = grp[g][:, None] != grp[None, :]
            within = foreign & (d <= 1.9 * grms[g][:, None])
            # no member lies further from the centre than the radius, no two further apart than twice that
            near = foreign & ~within & (d - radius[None, :] - gr[g][:, None] < 2 * limits.apart * gr[g][:, None])
            for kind, mask in ((0, near), (2, within)):
                a, b = np.nonzero(mask)
                out_g.append(grp[g][a])
                out_u.append(unit[b])
                out_k.append(np.full(len(a), kind, np.int32))
        cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        return pa.table({"grp": cat(out_g, pa.int64()), "unit": cat(out_u, pa.int64()), "kind": cat(out_k, pa.int32())})

    return run


def _isolate(limits: Limits):
    """The smallest isolated sets of a group, for each row the largest distance within. The row that names a set also has the
    set's centre and how far from it anything outside must be to be surely far enough: the radius plus ``apart`` times the
    largest distance within."""

    def run(got):
        import numpy as np

        from .cells import isolated, squared

        got = got.combine_chunks()
        ids = got.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, copies, x = ids[order], got.column("copies").to_numpy()[order], matrix(got.column("v"))[order]
        label = isolated(x, copies, len(x), limits.least, limits.apart)
        keep = np.flatnonzero(label >= 0)
        width, centre, clear, cluster = np.zeros(len(x)), [None] * len(x), [None] * len(x), np.zeros(len(x), np.int64)
        for k in range(int(label.max(initial=-1)) + 1):
            rows = np.flatnonzero(label == k)
            part = x[rows].astype(np.float64)
            for s in range(0, len(part), 1024):
                width[rows[s : s + 1024]] = np.sqrt(squared(part[s : s + 1024], part).max(1))
            middle = part.mean(0)
            cluster[rows] = ids[rows[0]]
            centre[rows[0]] = middle.astype(np.float32).tolist()
            clear[rows[0]] = float(np.sqrt(((part - middle) ** 2).sum(1).max()) + limits.apart * width[rows].max()) * (1 + 1e-6)
        grp = got.column("grp")[0].as_py() if len(x) else 0
        return pa.table({"rep": ids[keep], "cluster": cluster[keep], "width": width[keep], "grp": pa.array([grp] * len(keep), pa.int64()), "block": pa.array([0] * len(keep), pa.int32()), "centre": pa.array([centre[i] for i in keep], pa.list_(pa.float32())), "clear": pa.array([clear[i] for i in keep], pa.float64()), "rough": pa.array([False] * len(keep), pa.bool_())})

    return run


_SETS = "rep bigint, cluster bigint, width double, grp bigint, block int, centre array<float>, clear double, rough boolean"


def _off(v: str, centre: str):
    return F.sqrt(F.aggregate(F.zip_with(v, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e.cast("double")))


def _propose(limits: Limits):
    """Of a block of a large group's rows, which come first, beside all rows of the group, batch by batch: the sets that each
    row proposes. What is held is the block and what of the group falls into gaps of its profiles, see ``cells.Profiles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .cells import Profiles

        profiles, own, grp = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, held = batch.column("grp")[0].as_py(), batch.column("held")[0].as_py()
            part = [batch.column(c).to_numpy() for c in ("id", "copies", "name")] + [matrix(batch.column("v"))]
            late = batch.column("late").to_numpy(zero_copy_only=False)
            for mask in (~late, late):
                if not mask.any():
                    continue
                some = [c[mask] for c in part]
                if mask is late and profiles is None:
                    profiles = Profiles(*(np.concatenate(c) for c in zip(*own, strict=True)), held, limits.least, limits.apart)
                if mask is late:
                    profiles.add(*some)
                elif profiles is None:
                    own.append(some)
                else:
                    raise RuntimeError("the rows of a block must come first")
        if profiles is None and own:
            profiles = Profiles(*(np.concatenate(c) for c in zip(*own, strict=True)), held, limits.least, limits.apart)
        for s, total, count, width in profiles.proposals() if profiles else ():
            n = len(s)
            yield pa.RecordBatch.from_arrays([pa.array([grp] * n, pa.int64()), pa.array(profiles.ids[s]), pa.array(total), pa.array(count), pa.array(width)], names=["grp", "id", "total", "count", "width"])

    return run


def _reached(sent):
    """Which sets the units come so near that rows of theirs may undo them."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        from .cells import squared

        names, centres, clear = sent.value
        for batch in batches:
            unit, c, radius = batch.column(0).to_numpy(), matrix(batch.column(1)).astype(np.float64), batch.column(2).to_numpy()
            step = max(1, 2_000_000 // max(len(names), 1))
            for s in range(0, len(unit), step):
                a, b = np.nonzero(np.sqrt(squared(c[s : s + step], centres)) - radius[s : s + step, None] < clear[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(unit[s : s + step][a]), pa.array(names[b])], names=["unit", "cluster"])

    return run


def _undone(limits: Limits):
    """Of a block of a set's rows, which come first, beside what is near the set, batch by batch: its name if a row outside is too
    near one within. Of rows whose width is rough, no less than the true one, also those that are in doubt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .cells import squared

        own, width, rep, rough, hit, doubt, name = [], [], [], [], False, [], None
        for batch in batches:
            foreign, x, w = batch.column("foreign").to_numpy(zero_copy_only=False), matrix(batch.column("v")).astype(np.float64), batch.column("width").to_numpy()
            name = batch.column("cluster")[:1] if batch.num_rows else name
            own.append(x[~foreign])
            width.append(w[~foreign] ** 2)
            rep.append(batch.column("rep").to_numpy()[~foreign])
            rough.append(batch.column("rough").to_numpy(zero_copy_only=False)[~foreign])
            other = x[foreign]
            if hit or not len(other):
                continue
            own, width, rep, rough = [np.concatenate(own)], [np.concatenate(width)], [np.concatenate(rep)], [np.concatenate(rough)]
            step = max(1, 4_000_000 // max(len(other), 1))
            for s in range(0, len(own[0]), step):
                nearest, w = squared(own[0][s : s + step], other).min(1), width[0][s : s + step]
                close = (nearest < limits.apart**2 * w * (1 - 1e-12)) | (nearest <= w)
                hit = hit or bool((close & ~rough[0][s : s + step]).any())
                doubt.append(rep[0][s : s + step][close & rough[0][s : s + step]])
        if hit:
            yield pa.RecordBatch.from_arrays([name, pa.array([None], pa.int64())], names=["cluster", "rep"])
        elif doubt and len(some := np.unique(np.concatenate(doubt))):
            yield pa.RecordBatch.from_arrays([pa.array([name[0].as_py()] * len(some), pa.int64()), pa.array(some)], names=["cluster", "rep"])

    return run


def _widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some rows of a set, which come first, beside all of it, batch by batch: the largest distance of each within the set."""
    import numpy as np

    from .cells import squared

    cluster, rep, own, most = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        late, x = batch.column("late").to_numpy(zero_copy_only=False), matrix(batch.column("v")).astype(np.float64)
        cluster = batch.column("cluster")[0].as_py()
        rep.append(batch.column("rep").to_numpy()[~late])
        own.append(x[~late])
        if late.any():
            own = [np.concatenate(own)]
            most = np.zeros(len(own[0])) if most is None else most
            step = max(1, 4_000_000 // int(late.sum()))
            for s in range(0, len(most), step):
                most[s : s + step] = np.maximum(most[s : s + step], squared(own[0][s : s + step], x[late]).max(1))
    if most is not None and len(most):
        yield pa.RecordBatch.from_arrays([pa.array([cluster] * len(most), pa.int64()), pa.array(np.concatenate(rep)), pa.array(np.sqrt(most))], names=["cluster", "rep", "width"])


def _bounded(limits: Limits):
    """Of rows of a large group behind its seeds, batch by batch: the rows with their bounds, see ``cells.bounds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .cells import bounds

        seeds = [np.zeros((0, VECTOR_WIDTH), np.float32)]
        for batch in batches:
            late = batch.column("late").to_numpy(zero_copy_only=False)
            seeds = [np.concatenate([*seeds, matrix(batch.column("v"))[~late]])]
            some = batch.filter(pa.array(late))
            if some.num_rows:
                bound = bounds(matrix(some.column("v")), seeds[0], limits.apart)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("grp", "id", "held", "v")), pa.array(bound)], names=["grp", "id", "held", "v", "bound"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some rows, which come first, and others, batch by batch: those that have another within the bounds of both."""
    import numpy as np

    from .cells import mates

    own, hit, grp = [], None, 0

    def among():
        nonlocal own, hit
        own = [np.concatenate(c) for c in zip(*own, strict=True)]
        hit = mates(own[2], own[1], own[2], own[1], True)[0]

    def out(ids):
        return pa.RecordBatch.from_arrays([pa.array([grp] * len(ids), pa.int64()), pa.array(ids)], names=["grp", "id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        grp, late = batch.column("grp")[0].as_py(), batch.column("late").to_numpy(zero_copy_only=False)
        part = [batch.column("id").to_numpy(), batch.column("bound").to_numpy(), matrix(batch.column("v"))]
        if not late.all():
            if hit is not None:
                raise RuntimeError("the rows of a block must come first")
            own.append([c[~late] for c in part])
        if late.any():
            if not own:
                continue
            if hit is None:
                among()
            ids, bound, x = (c[late] for c in part)
            mine, theirs = mates(own[2], own[1], x, bound)
            hit |= mine
            yield out(ids[theirs])
    if own and hit is None:
        among()
    if own:
        yield out(own[0][hit])


def _inside(count: bool):
    """Of proposed sets, which come first, each with the row that proposed it, and rows of the group, batch by batch: how many of
    them each set holds, or which are in any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .cells import squared

        sets, seen, grp = [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, late = batch.column("grp")[0].as_py(), batch.column("late").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("v")).astype(np.float64)
            sets.append((batch.column("total").to_numpy()[~late], batch.column("count").to_numpy()[~late], batch.column("width").to_numpy()[~late] ** 2, x[~late]))
            if not late.any():
                continue
            sets = [tuple(np.concatenate(c) for c in zip(*sets, strict=True))]
            total, _, width, by = sets[0]
            seen = np.zeros(len(total), np.int64) if seen is None else seen
            x, ids, hit = x[late], batch.column("id").to_numpy()[late], np.zeros(int(late.sum()), bool)
            step = max(1, 4_000_000 // len(x))
            for s in range(0, len(total), step):
                d = squared(by[s : s + step], x)
                # nothing lies between the width and ``apart`` times it
                r, c = np.nonzero(d <= 1.2 * width[s : s + step, None] + 1e-8 * (1 + d.max()))
                e = by[s + r] - x[c]
                keep = np.einsum("ij,ij->i", e, e) <= 1.2 * width[s + r]
                seen[s : s + step] += np.bincount(r[keep], minlength=len(d))
                hit[c[keep]] = True
            if not count and hit.any():
                yield pa.RecordBatch.from_arrays([pa.array([grp] * int(hit.sum()), pa.int64()), pa.array(ids[hit])], names=["grp", "id"])
        if count and seen is not None:
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(seen), pa.int64()), pa.array(sets[0][0]), pa.array(sets[0][1]), pa.array(seen)], names=["grp", "total", "count", "inside"])

    return run


def _proposed(own: DataFrame, judged: DataFrame, limits: Limits) -> DataFrame:
    """What the rows ``judged`` propose, block by block; each block goes through all rows of its group."""
    blocks = judged.groupBy("grp").agg(F.ceil(F.count("*") / limits.block_rows).cast("int").alias("n"))
    first = judged.join(F.broadcast(blocks), "grp").select("id", F.pmod(F.xxhash64("id", F.lit(3)), F.col("n")).cast("int").alias("first"))
    sent = own.join(F.broadcast(blocks), "grp").join(first, "id", "left").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    sent = sent.select("grp", "id", "copies", "v", "name", "held", "to", F.coalesce(F.col("to") != F.col("first"), F.lit(True)).alias("late"))
    sent = sent.repartition("grp", "to").sortWithinPartitions("grp", "to", "late")
    return stage(sent.groupBy("grp", "to").applyInArrow(_propose(limits), "grp bigint, id bigint, total bigint, count bigint, width double"), "proposals")


def _to_judge(own: DataFrame, limits: Limits) -> DataFrame:
    """``grp, id``: seeds, rows with copies, and rows that may be in an isolated set without any of these.

    Such a set has ``least`` rows or more, so if the group is dealt out into one part less, two of them are in one part, within
    the bounds of both. Pairs are looked for within parts only, in pieces, each pair once.
    """
    parts = limits.least - 1
    if parts < 1:
        return own.select("grp", "id")
    n = F.ceil(F.col("held") / (16 * limits.block_rows)).cast("int")
    columns = ["grp", "to", "id", "held", "v", "late"]
    seeds = own.where("seed").withColumn("to", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("late", F.lit(False)).select(columns)
    rest = own.where("not seed and copies = 1").withColumn("to", F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int")).withColumn("late", F.lit(True)).select(columns)
    sent = seeds.unionByName(rest).repartition("grp", "to").sortWithinPartitions("grp", "to", "late")
    bounded = stage(sent.groupBy("grp", "to").applyInArrow(_bounded(limits), "grp bigint, id bigint, held bigint, v array<float>, bound float"), "large_bounds")
    pieces = F.ceil(F.col("held") / (parts * 8 * limits.block_rows)).cast("int")
    dealt = bounded.withColumn("part", F.pmod(F.xxhash64("id", F.lit(19)), F.lit(parts)).cast("int")).withColumn("piece", F.pmod(F.xxhash64("id", F.lit(23)), pieces).cast("int"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("piece")))).select("grp", "part", "to", "id", "bound", "v", (F.col("to") != F.col("piece")).alias("late"))
    dealt = dealt.repartition("grp", "part", "to").sortWithinPartitions("grp", "part", "to", "late")
    met = dealt.groupBy("grp", "part", "to").applyInArrow(_met, "grp bigint, id bigint").distinct()
    return stage(own.where("seed or copies > 1").select("grp", "id").unionByName(met), "judged")


def _sets_of_large(rows: DataFrame, large: DataFrame, limits: Limits) -> DataFrame:
    """The smallest isolated sets of groups of any size, as of ``_isolate``, before rows of other groups are looked at.

    As in ``cells.isolated``, a set stands if all its rows propose it. A set that is not the whole group is proposed by a row of
    ``_to_judge``: it holds a seed, or two of its rows lie within the bounds of both. So these propose first; of what all of them
    agree on the other members are judged as well. The whole group is isolated within itself, and is found if no other set is;
    then widths of its rows are rough, the way by the centre, and are measured where they matter.
    """
    key = ["grp", "total", "count"]
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("held") / limits.block_rows)).cast("int")
    seed = F.pmod(F.xxhash64("id", F.lit(11)), F.col("held")) < limits.seeds
    own = rows.join(F.broadcast(large), "grp")
    own = stage(own.select("grp", "id", "copies", "v", F.xxhash64("id").alias("name"), "held", block.alias("block"), seed.alias("seed")), "large_rows")
    judged = _to_judge(own, limits)
    said = _proposed(own, judged, limits)
    of_parts = said.join(F.broadcast(large), "grp").where(F.col("count") < F.col("held")).drop("held")
    votes = of_parts.groupBy(key).agg(F.count("*").alias("votes"), F.min(F.struct("id", "width")).alias("by"))
    open_ = stage(votes.where("votes < count").select(*key, "votes", "by.*"), "open")
    if open_.limit(1).count():
        n = F.ceil(F.col("held") / (8 * limits.block_rows)).cast("int")
        columns = ["grp", "to", "id", "total", "count", "width", "v", "late"]

        def inside(sets, some, count, schema):
            to_all = sets.join(own.select("id", "v", "held"), "id").withColumn("to", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("late", F.lit(False)).select(columns)
            each = some.withColumn("to", F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int")).select("grp", "to", "id", F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("width"), "v", F.lit(True).alias("late"))
            both = to_all.unionByName(each.join(sets.select("grp").distinct(), "grp", "left_semi")).repartition("grp", "to").sortWithinPartitions("grp", "to", "late")
            return both.groupBy("grp", "to").applyInArrow(_inside(count), schema)

        agreed = inside(open_, own.join(judged.select("id"), "id", "left_semi"), True, "grp bigint, total bigint, count bigint, inside bigint").groupBy(key).agg(F.sum("inside").alias("inside"))
        left = stage(open_.join(agreed, key).where("inside = votes").select(*key, "id", "width"), "agreed")
        if left.limit(1).count():
            more = stage(inside(left, own, False, "grp bigint, id bigint").distinct().join(judged.select("id"), "id", "left_anti").select("grp", "id"), "judged")
            of_parts = of_parts.unionByName(_proposed(own, more, limits).join(F.broadcast(large), "grp").where(F.col("count") < F.col("held")).drop("held"))
    # isolated sets are nested or disjoint; one that holds a smaller one has a row of which it is not the smallest
    whole = stage(of_parts.groupBy(key).agg(F.count("*").alias("votes")).where("votes = count").select(key), "whole")
    first = of_parts.join(whole, key).groupBy("grp", "id").agg(F.min(F.struct("count", "total", "width")).alias("s")).select("grp", "id", "s.*")
    first = stage(first, "large_first")
    names = first.groupBy(key).agg(F.count("*").alias("held"), F.min("id").alias("cluster")).where(F.col("held") == F.col("count")).select(*key, "cluster")
    found = first.join(names, key).select("grp", F.col("id").alias("rep"), "width", "cluster", F.lit(False).alias("rough")).join(own.select(F.col("id").alias("rep"), "v", "block"), "rep")
    undivided = own.join(F.broadcast(large.select("grp").join(whole.select("grp").distinct(), "grp", "left_anti")), "grp")
    named = undivided.groupBy("grp").agg(F.min("id").alias("cluster"))
    undivided = undivided.join(F.broadcast(named), "grp").select("grp", F.col("id").alias("rep"), F.lit(None).cast("double").alias("width"), "cluster", F.lit(True).alias("rough"), "v", "block")
    found = stage(found.unionByName(undivided), "large_sets")
    mean = found.groupBy("cluster").agg(*[F.avg(F.col("v")[k].cast("double")).cast("float").alias(f"m{k}") for k in range(VECTOR_WIDTH)])
    centre = stage(mean.select("cluster", F.array(*[f"m{k}" for k in range(VECTOR_WIDTH)]).alias("centre")), "large_centres")
    found = found.join(centre, "cluster").withColumn("off", _off("v", "centre")).drop("v", "centre")
    found = stage(found, "large_off")
    shape = found.groupBy("cluster").agg(F.max("off").alias("most"), F.max("width").alias("wide")).join(centre, "cluster")
    shape = stage(shape.select("cluster", "centre", "most", ((F.col("most") + limits.apart * F.coalesce("wide", 2 * F.col("most"))) * (1 + 1e-6)).alias("clear")), "large_shapes")
    first_row = F.col("rep") == F.col("cluster")
    width = F.when(F.col("rough"), (F.col("off") + F.col("most")) * (1 + 1e-9)).otherwise(F.col("width"))
    with_shape = found.join(shape, "cluster").select("rep", "cluster", width.alias("width"), "grp", "block", F.when(first_row, F.col("centre")).alias("centre"), F.when(first_row, F.col("clear")).alias("clear"), "rough")
    return stage(with_shape, "large_found")


def _near_large(found: DataFrame, units: DataFrame) -> DataFrame:
    """``unit, cluster, centre, clear, home``: units so near a set of a large group that rows of theirs may undo it. There
    are at most as many such sets as large groups have blocks of ``least`` rows; they are sent to the tasks in parts."""
    import numpy as np

    spark = found.sparkSession
    shapes = found.where(F.col("centre").isNotNull()).select("cluster", "grp", "centre", "clear")
    parts = []
    held = shapes.select("cluster", "centre", "clear").toArrow()
    for s in range(0, max(held.num_rows, 1), SETS_SENT):
        some = held.slice(s, SETS_SENT)
        sent = spark.sparkContext.broadcast((some.column("cluster").to_numpy(), matrix(some.column("centre")).astype(np.float64) if len(some) else np.zeros((0, VECTOR_WIDTH)), some.column("clear").to_numpy()))
        parts.append(units.select("unit", "c", "radius").mapInArrow(_reached(sent), "unit bigint, cluster bigint"))
    near = parts[0]
    for part in parts[1:]:
        near = near.unionByName(part)
    return near.join(shapes.withColumnRenamed("grp", "home"), "cluster").select("unit", "cluster", "centre", "clear", "home")


def _near_rows(near: DataFrame, rows: DataFrame) -> DataFrame:
    """``cluster, v``: of the units near sets, the rows of other groups that are not clear of them."""
    near = near.join(rows.select("unit", "grp", "v"), "unit").where(F.col("grp") != F.col("home"))
    return near.where(_off("v", "centre") < F.col("clear")).select("cluster", "v")


def _standing(found: DataFrame, near: DataFrame, classes: DataFrame, limits: Limits) -> DataFrame:
    """``rep, cluster`` of the sets that no row ``near`` undoes. A row outside can only undo a set, and with it all that hold it."""
    near = stage(near.select("cluster", "v"), "near")
    touched = found.join(near.select("cluster").distinct(), "cluster")
    own = touched.join(classes.select("rep", "v"), "rep").select("cluster", "block", "rep", "v", "width", "rough", F.lit(False).alias("foreign"))
    said = _beside(own, near, limits)
    if found.where("rough").limit(1).count():
        said = stage(said, "undone")
        doubt = said.where(F.col("rep").isNotNull()).join(said.where(F.col("rep").isNull()).select("cluster"), "cluster", "left_anti")
        if doubt.limit(1).count():
            own = stage(own.join(doubt.select("cluster").distinct(), "cluster"), "doubted")
            some = stage(own.join(doubt.select("rep"), "rep"), "doubt")
            blocks = some.select("cluster", "block").distinct()
            both = some.select("cluster", "block", "rep", "v", F.lit(False).alias("late")).unionByName(own.drop("block").join(blocks, "cluster").select("cluster", "block", "rep", "v", F.lit(True).alias("late")))
            both = both.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "late")
            widths = stage(both.groupBy("cluster", "block").applyInArrow(_widths, "cluster bigint, rep bigint, width double"), "widths")
            measured = some.drop("width", "rough").join(widths, ["cluster", "rep"]).withColumn("rough", F.lit(False))
            said = said.where(F.col("rep").isNull()).unionByName(_beside(measured, near, limits))
    undone = said.where(F.col("rep").isNull()).select("cluster").distinct()
    return found.join(undone, "cluster", "left_anti").select("rep", "cluster")


def _beside(own: DataFrame, near: DataFrame, limits: Limits) -> DataFrame:
    """What ``_undone`` says of the blocks of sets."""
    columns = ["cluster", "block", "rep", "v", "width", "rough", "foreign"]
    blocks = own.select("cluster", "block").distinct()
    other = near.join(blocks, "cluster").withColumns({"rep": F.lit(0).cast("bigint"), "width": F.lit(0.0), "rough": F.lit(False), "foreign": F.lit(True)})
    both = own.select(columns).unionByName(other.select(columns)).repartition("cluster", "block").sortWithinPartitions("cluster", "block", "foreign")
    return both.groupBy("cluster", "block").applyInArrow(_undone(limits), "cluster bigint, rep bigint")


def _whole_views(members: DataFrame, units: DataFrame, trees, lost: DataFrame, found: DataFrame, classes: DataFrame, limits: Limits) -> DataFrame:
    """``rep, cluster``: sets that hold whole views.

    A set with a unit that sees no gap in a view holds all of the view. Sets hold no smaller ones, so there is none if a row of
    the view is in a set that was ``found``, or if another such unit of it has been ruled out. Views that are left are one
    group if they share a unit.
    """
    seen = stage(view(units, trees, limits, ["unit", "c"]).select("unit", "cell"), "seen")
    taken = found.select(F.col("rep").alias("id")).join(members.select("id", "unit"), "id").select("unit").distinct()
    ruled = lost.join(seen.join(taken, "unit").select("cell").distinct(), "cell").select("unit")
    live = lost.select("cell").distinct().join(seen.join(taken.unionByName(ruled).distinct(), "unit").select("cell").distinct(), "cell", "left_anti")
    inside = stage(seen.join(live, "cell"), "whole_views")
    if not inside.limit(1).count():
        return found.where("false")
    labels = grouped(inside.select("unit").distinct(), inside.join(inside.groupBy("cell").agg(F.min("unit").alias("b")), "cell").select(F.col("unit").alias("a"), "b"))
    rows = members.select("id", "copies", "v", "unit").join(labels, "unit", "left").withColumn("of", F.col("grp")).withColumn("grp", F.coalesce("grp", "unit"))
    sizes = rows.where(F.col("of").isNotNull()).groupBy("grp").agg(F.sum("copies").alias("gn"), F.count("*").alias("held"))
    whole = _sets_of_large(rows.drop("of"), stage(sizes.where(F.col("gn") >= limits.least).select("grp", "held"), "large"), limits)
    return _standing(whole, _near_rows(_near_large(whole, units), rows), classes, limits)


def cluster_records(df: DataFrame, key: str = "icsd_id", vector: str = "pca32", order: str = "row_ix", limits: Limits = Limits(), among: DataFrame | None = None) -> DataFrame:
    """``id, cluster``: the records that belong to a cluster, named by its smallest record.

    A cluster is a set of at least ``least`` records outside of which everything is at least ``apart`` times as far from each
    member as any other member is, and which contains no smaller such set. Rows without a valid vector and null keys take no
    part, repeated keys count once, equal vectors are separate records at distance 0. Of ``among``, a frame of one column, only keys
    in it take part. No rows give no rows. Other columns are ignored.
    """
    with staging():
        return keep_staged(_cluster(df, key, vector, order, limits, among))


def _cluster(df: DataFrame, key: str, vector: str, order: str, limits: Limits, among: DataFrame | None) -> DataFrame:
    classes, several = distinct_vectors(df, key, vector, order, among)
    reps = classes.withColumnRenamed("rep", "id")
    total = reps.count()
    if not total:
        return df.sparkSession.createDataFrame([], "id bigint, cluster bigint")
    cells, spread = route(reps, total, limits)
    members = stage(cells.groupBy("cell").applyInArrow(_make_units(limits, limits.widest * spread), _MEMBER), "members")
    units = stage(members.where(F.col("c").isNotNull()).select("unit", "n", "c", "rms", "radius"), "units")
    trees = view_trees(units, limits)
    pairs, lost = link_units(units, trees, limits)
    labels = grouped(units, pairs)
    # centre and radii of each group from its units
    parts = units.join(labels, "unit")
    dims = range(VECTOR_WIDTH)
    mean = parts.groupBy("grp").agg(*[(F.sum(F.col("n") * F.col("c")[k].cast("double")) / F.sum("n")).cast("float").alias(f"m{k}") for k in dims])
    centre = mean.select("grp", F.array(*[f"m{k}" for k in dims]).alias("gc"))
    off = F.aggregate(F.zip_with("c", "gc", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e.cast("double"))
    shape = parts.join(centre, "grp").withColumn("off", F.sqrt(off)).groupBy("grp").agg(
        F.sum("n").alias("gn"), F.max(F.col("off") + F.col("radius")).alias("gradius"), F.sqrt(F.sum(F.col("n") * (F.col("off") ** 2 + F.col("rms") ** 2)) / F.sum("n")).alias("grms"), F.first("gc").alias("gc")
    )
    known = stage(parts.join(shape, "grp"), "groups")
    around = view(known, trees, limits, ["unit", "c", "radius", "grp", "gn", "gc", "gradius", "grms"])
    around = stage(around.groupBy("cell").applyInArrow(_surroundings(limits), "grp bigint, unit bigint, kind int"), "around")
    within = around.where("kind = 2").select("grp", "unit").distinct()
    if within.limit(1).count():
        pairs = within.join(labels.withColumnRenamed("grp", "other"), "unit").select(F.col("grp").alias("a"), F.col("other").alias("b")).distinct()
        renamed = grouped(labels.select(F.col("grp").alias("unit")).distinct(), pairs).withColumnRenamed("unit", "old").withColumnRenamed("grp", "new")
        labels = stage(labels.join(renamed.withColumnRenamed("old", "grp"), "grp").select("unit", F.col("new").alias("grp")), "labels")
        around = around.join(renamed.withColumnRenamed("old", "grp"), "grp").select(F.col("new").alias("grp"), "unit", "kind")
        around = around.join(labels.withColumnRenamed("grp", "own"), "unit").where(F.col("own") != F.col("grp")).drop("own")
    rows = stage(members.select("id", "copies", "v", "unit").join(labels, "unit"), "rows")
    sizes = rows.groupBy("grp").agg(F.sum("copies").alias("gn"), F.count("*").alias("held")).where(F.col("gn") >= limits.least)
    small = sizes.where(F.col("held") <= limits.exact_rows).select("grp")
    large = stage(sizes.where(F.col("held") > limits.exact_rows).select("grp", "held"), "large")
    own = rows.join(small, "grp").select("grp", "id", "copies", "v")
    found = stage(own.groupBy("grp").applyInArrow(_isolate(limits), _SETS), "sets")
    sets = found.where(F.col("centre").isNotNull()).select("cluster", "grp", "centre", "clear")
    near = around.where("kind = 0").select("grp", "unit").distinct().join(sets, "grp").join(units.select("unit", "c", "radius"), "unit")
    near = near.where(_off("c", "centre") - F.col("radius") < F.col("clear")).select("unit", "cluster", "centre", "clear", F.col("grp").alias("home"))
    if large.limit(1).count():
        of_large = _sets_of_large(rows, large, limits)
        found, near = found.unionByName(of_large), near.unionByName(_near_large(of_large, units))
    of_rep = _standing(found, _near_rows(near, rows), classes, limits)
    if lost.limit(1).count():
        of_rep = stage(of_rep, "found")
        of_rep = of_rep.unionByName(_whole_views(members, units, trees, lost, of_rep, classes, limits))
    of_rep = stage(of_rep, "standing")
    copies = several.where("id <> rep").join(of_rep, "rep").select("id", "cluster")
    return stage(of_rep.select(F.col("rep").alias("id"), "cluster").unionByName(copies), "clusters")


def member_distances(clusters: DataFrame, df: DataFrame, key: str = "icsd_id", vector: str = "pca32", order: str = "row_ix") -> DataFrame:
    """``id, cluster, distance``: adds how far each record lies from the centre of its cluster. Sums are made before anything
    is exchanged, so a cluster of any size is no burden."""
    classes, several = distinct_vectors(df, key, vector, order)
    of = classes.select(F.col("rep").alias("id"), "v").unionByName(several.where("id <> rep").join(classes.select("rep", "v"), "rep").select("id", "v"))
    named = stage(clusters.join(of, "id"), "named")
    dims = [F.avg(F.col("v")[k].cast("double")).alias(f"m{k}") for k in range(VECTOR_WIDTH)]
    centres = named.groupBy("cluster").agg(*dims).select("cluster", F.array(*[f"m{k}" for k in range(VECTOR_WIDTH)]).alias("m"))
    off = F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
    return named.join(centres, "cluster").select("id", "cluster", F.sqrt(off).alias("distance"))


def describe(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """``cluster, size, radius, typical``: the records nearest to the centre, nearest first, ties by the smaller key."""
    from .topn import top_n

    best = top_n(clusters.withColumnRenamed("distance", "d"), "cluster", "d", "id", typical)
    names = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "id"))), lambda s: s["id"]).alias("typical"))
    return clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.max("distance").alias("radius")).join(names, "cluster")


def _pair(batches: Iterator) -> Iterator:
    import numpy as np

    kept = None  # cluster, first and last record of the run that reaches the end of what was read
    part = 0

    def out(cluster, a, b, run):
        return pa.RecordBatch.from_arrays([pa.array(cluster, pa.int64()), pa.array([part] * len(cluster), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([run] * len(cluster), pa.bool_())], names=["cluster", "part", "a", "b", "run"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g, i, part = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)[0].as_py()
        same = g[1:] == g[:-1]
        yield out(g[1:][same], i[:-1][same], i[1:][same], False)
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        runs = [[g[s], i[s], i[e - 1]] for s, e in zip(starts, np.append(starts[1:], len(g)), strict=True)]
        if kept:
            if kept[0] == runs[0][0]:
                yield out([kept[0]], [kept[2]], [runs[0][1]], False)
                runs[0][1] = kept[1]
            else:
                runs.insert(0, kept)
        kept = runs.pop()
        if runs:
            yield out(*zip(*runs, strict=True), True)
    if kept:
        yield out([kept[0]], [kept[1]], [kept[2]], True)


def chain(clusters: DataFrame) -> DataFrame:
    """``a, b``: records of one cluster that follow each other in the order of their keys, over a range-partitioned sort, so
    that a cluster of any size spreads over partitions."""
    ranged = clusters.select("cluster", "id").repartitionByRange("cluster", "id").sortWithinPartitions("cluster", "id").withColumn("part", F.spark_partition_id())
    pairs = stage(ranged.mapInArrow(_pair, "cluster bigint, part int, a bigint, b bigint, run boolean"), "chain")
    next_first = F.lead("a").over(Window.partitionBy("cluster").orderBy("part"))
    across = pairs.where("run").select(F.col("b").alias("x"), next_first.alias("y")).where(F.col("y").isNotNull())
    return pairs.where(~F.col("run")).select("a", "b").unionByName(across.select(F.col("x").alias("a"), F.col("y").alias("b")))
