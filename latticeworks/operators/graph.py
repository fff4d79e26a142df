"""Neighbour graphs over vectors, and what is computed on graphs.

A graph is a DataFrame of edges ``src, dst, weight`` with src < dst. Operators that look at all edges at once run as joins and
aggregations; those that need a whole component (Louvain, eigenvector centrality) take one component per task and refuse
components beyond ``COMPONENT_EDGES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percentiles
from ..functions.vectors import gaussian
from ..session import stage

COMPONENT_EDGES = 5_000_000


#: Rows in a block of the exact neighbour search.
BLOCK_ROWS = 8192


def _knn(k: int):
    """The k nearest of a block's rows, which come first, among all rows as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own, x, name, d, other = [], None, None, None, None

        def take(y, ids):
            nonlocal d, other
            squares, few = (y * y).sum(1), min(k + 4, len(ids))
            step = max(1, 2_000_000 // len(ids))
            for s in range(0, len(x), step):
                part = x[s : s + step]
                rough = squares - 2 * (part @ y.T)
                rough[ids[None, :] == name[s : s + step, None]] = np.inf
                near = np.argpartition(rough, few - 1, axis=1)[:, :few]
                exact = np.sqrt(((part[:, None, :] - y[near]) ** 2).sum(2))
                exact[ids[near] == name[s : s + step, None]] = np.inf
                both_d, both_i = np.concatenate([d[s : s + step], exact], 1), np.concatenate([other[s : s + step], ids[near]], 1)
                order = np.lexsort((both_i, both_d), axis=1)[:, :k]
                d[s : s + step], other[s : s + step] = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_i, order, 1)

        def begin():
            nonlocal x, name, d, other
            x, name = np.concatenate([y for y, _ in own]), np.concatenate([i for _, i in own])
            d, other = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(name.dtype).max if name.dtype.kind == "i" else name[0], name.dtype)
            take(x, name)

        for batch in batches:
            if not batch.num_rows:
                continue
            late = batch.column("late").to_numpy(zero_copy_only=False)
            y = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            ids = batch.column("key").to_numpy(zero_copy_only=False)
            if not late.all():
                if x is not None:
                    raise RuntimeError("the rows of a block must come first")
                own.append((y[~late], ids[~late]))
            if late.any():
                if x is None:
                    begin()
                take(y[late], ids[late])
        if x is None and own:
            begin()
        if x is not None:
            row, col = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(name[row]), pa.array(other[row, col]), pa.array(d[row, col])], names=["src", "dst", "dist"])

    return run


def knn(df: DataFrame, k: int, key: str, v: str) -> DataFrame:
    """``src, dst, dist, rk``: the k nearest other rows of each row, exactly, ties by the smaller key.

    Rows are cut into blocks by a hash of the key; a task holds one block and lets all rows stream by, so nothing passes through
    the driver and memory is that of a block. The work is quadratic by nature. A row is never its own neighbour, equal vectors
    are. Nulls must be left out before.
    """
    rows = df.select(F.col(key).alias("key"), F.col(v).alias("v"))
    kind, n = dict(df.dtypes)[key], rows.count()
    blocks = max(-(-n // BLOCK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // 256)), 1)
    block = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(blocks)).cast("int")
    sent = rows.withColumn("block", block).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select("to", (F.col("to") != F.col("block")).alias("late"), "key", "v").repartition("to").sortWithinPartitions("to", "late")
    found = sent.groupBy("to").applyInArrow(_knn(k), f"src {kind}, dst {kind}, dist double")
    return found.withColumn("rk", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")))


def mutual(directed: DataFrame) -> DataFrame:
    """The directed edges whose reverse is there as well."""
    back = directed.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return directed.join(back, ["src", "dst"], "left_semi")


def gaussian_edges(directed: DataFrame) -> DataFrame:
    """``src, dst, weight``: undirected edges weighted exp(-(d / sigma)^2), sigma the median positive distance (1 without any,
    1e-8 at the least); of two directions the heavier."""
    sigma = percentiles(directed.where("dist > 0").select("dist"), "dist", [0.5]).agg(F.greatest(F.coalesce(F.max(F.col("q")[0]), F.lit(1.0)), F.lit(1e-8)).alias("sigma"))
    weighted = directed.crossJoin(F.broadcast(sigma)).withColumn("w", gaussian(F.col("dist"), F.col("sigma")))  # one row
    return weighted.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``a, b`` and the weight, if there is one, in both directions."""
    more = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *more).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *more))


def components(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """``node, component``: the smallest node that edges lead to. Labels travel along edges and then to their own label's
    label, so rounds grow with the logarithm of the longest chain; each is written before the next."""
    both = stage(both_ways(edges.select("src", "dst")).distinct(), "edges")
    labels = stage(nodes.select(F.col(key).alias("node"), F.col(key).alias("component")).distinct(), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        step = labels.join(around, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("new"))
        further = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = stage(step.join(further, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("component")), "labels")
        labels = after.select("node", "component")
        if not after.where("component < old").limit(1).count():
            return labels


def drop_small(labels: DataFrame, least: int, column: str = "component") -> DataFrame:
    """Marks members of parts with fewer than ``least`` nodes as noise, -1. Sizes are counted before anything is exchanged."""
    small = labels.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") < least).select(column, F.lit(True).alias("_small"))
    return labels.join(small, column, "left").withColumn(column, F.when(F.col("_small"), F.lit(-1).cast("bigint")).otherwise(F.col(column))).select(*labels.columns)


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges.select("src", "dst")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """``x, y, z`` with x < y < z, all three joined. Paths start at the end of lower degree, which bounds what a hub opens."""
    deg = degree(edges)
    e = edges.select("src", "dst").join(deg.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    down = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    e = e.select(F.when(down, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(down, F.col("dst")).otherwise(F.col("src")).alias("v"))
    paths = e.select("u", F.col("v").alias("p")).join(e.select("u", F.col("v").alias("q")), "u").where(F.col("p") < F.col("q"))
    closed = paths.join(edges.select(F.col("src").alias("p"), F.col("dst").alias("q")), ["p", "q"])
    s = F.array_sort(F.array("u", "p", "q"))
    return closed.select(s[0].alias("x"), s[1].alias("y"), s[2].alias("z"))


def clustering(edges: DataFrame) -> DataFrame:
    """``node, degree, triangles, clustering``: the share of a node's pairs of neighbours that are joined, 0 below degree 2."""
    at = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    out = degree(edges).join(at, "node", "left").withColumn("triangles", F.coalesce("t", F.lit(0)).cast("bigint")).drop("t")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return out.withColumn("clustering", F.when(F.col("degree") > 1, F.col("triangles") / F.nullif(pairs, F.lit(0.0))).otherwise(0.0))


def weighted_clustering(edges: DataFrame) -> DataFrame:
    """``node, clustering``: triangles count with the geometric mean of their weights, as parts of the largest weight."""
    top = edges.agg(F.max("weight").alias("top"))
    w = edges.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("weight") / F.nullif(F.col("top"), F.lit(0.0))).alias("w"))  # one row
    t = triangles(edges)
    for p, q, name in (("x", "y", "wa"), ("y", "z", "wb"), ("x", "z", "wc")):
        t = t.join(w.select(F.col("src").alias(p), F.col("dst").alias(q), F.col("w").alias(name)), [p, q])
    strength = t.select(F.explode(F.array("x", "y", "z")).alias("node"), F.cbrt(F.col("wa") * F.col("wb") * F.col("wc")).alias("g")).groupBy("node").agg(F.sum("g").alias("g"))
    out = degree(edges).join(strength, "node", "left")
    pairs = F.col("degree") * (F.col("degree") - 1)
    return out.select("node", F.when(F.col("degree") > 1, 2 * F.coalesce("g", F.lit(0.0)) / F.nullif(pairs, F.lit(0))).otherwise(0.0).alias("clustering"))


def core_numbers(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``node, core``: the largest k such that the node has k neighbours within the k-core.

    Every node starts with its degree and takes the h-index of its neighbours' values until none changes, which ends at the core
    numbers; all nodes move at once, so rounds are few and each is one join. Along a path one node moves in a round. If
    ``most_rounds`` are not enough, that is an error.
    """
    both = stage(both_ways(edges.select("src", "dst")).distinct(), "edges")
    core = stage(degree(edges).select("node", F.col("degree").cast("int").alias("core")), "core")
    for done in count():
        if done == most_rounds:
            raise ValueError(f"core numbers still change after {most_rounds} rounds")
        seen = both.join(core.select(F.col("node").alias("b"), "core"), "b").groupBy("a", "core").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("core")))
        h = seen.withColumn("upto", upto).groupBy(F.col("a").alias("node")).agg(F.max(F.least("core", F.col("upto").cast("int"))).alias("h"))
        after = stage(core.join(h, "node").select("node", F.col("core").alias("old"), F.least("core", "h").alias("core")), "core")
        core = after.select("node", "core")
        if not after.where("core < old").limit(1).count():
            break
    return core


def _by_component(edges: DataFrame, labels: DataFrame) -> DataFrame:
    joined = edges.join(labels.select(F.col("node").alias("src"), "component"), "src")
    most = joined.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if most > COMPONENT_EDGES:
        raise ValueError(f"a component has {most} edges; coarsen it first, for example with propagate_labels")
    return joined


def eigenvector(edges: DataFrame, labels: DataFrame, rounds: int = 500, still: float = 1e-6) -> DataFrame:
    """``node, centrality``: the leading eigenvector of each component's weights, of length 1; a single node has 1."""
    import numpy as np

    def solve(pdf):
        import pandas as pd

        nodes = np.unique(np.concatenate([pdf.src, pdf.dst]))
        a, b, w = np.searchsorted(nodes, pdf.src), np.searchsorted(nodes, pdf.dst), pdf.weight.to_numpy()
        if len(nodes) <= 400:
            m = np.zeros((len(nodes), len(nodes)))
            m[a, b] = m[b, a] = w
            x = np.abs(np.linalg.eigh(m)[1][:, -1])
        else:
            x = np.full(len(nodes), len(nodes) ** -0.5)
            for _ in range(rounds):
                # the shift keeps two-sided components from swinging
                y = x + np.bincount(a, w * x[b], len(nodes)) + np.bincount(b, w * x[a], len(nodes))
                y /= np.linalg.norm(y)
                done = np.abs(y - x).sum() < len(nodes) * still
                x = y
                if done:
                    break
        return pd.DataFrame({"node": nodes, "centrality": x})

    solved = _by_component(edges, labels).groupBy("component").applyInPandas(solve, "node bigint, centrality double")
    return labels.select("node").join(solved, "node", "left").withColumn("centrality", F.coalesce("centrality", F.lit(1.0)))


def betweenness(edges: DataFrame, weight: str | None = "weight") -> DataFrame:
    """``node, betweenness``: shares of shortest paths through each node, between 0 and 1. The weight is the length.

    Sources are spread over tasks; each task has the whole graph, so this is for contracted graphs: more than
    ``COMPONENT_EDGES`` edges are refused.
    """
    n_edges = edges.count()
    if n_edges > COMPONENT_EDGES:
        raise ValueError("betweenness is for contracted graphs")
    cols = ["src", "dst"] + ([weight] if weight else [])
    graph = edges.select(*cols).toPandas()
    sent = edges.sparkSession.sparkContext.broadcast([tuple(r) for r in graph.itertuples(index=False)])
    nodes = both_ways(edges.select("src", "dst")).select(F.col("a").alias("node")).distinct()

    def run(batches):
        import heapq

        import pandas as pd

        near: dict = {}
        for s, d, *w in sent.value:
            near.setdefault(s, []).append((d, w[0] if w else 1.0))
            near.setdefault(d, []).append((s, w[0] if w else 1.0))
        for pdf in batches:
            total = dict.fromkeys(near, 0.0)
            for source in pdf.node:
                dist, paths, before, order, heap, tie = {source: 0.0}, {source: 1.0}, {source: []}, [], [(0.0, 0, source)], 0
                done = set()
                while heap:
                    d, _, u = heapq.heappop(heap)
                    if u in done:
                        continue
                    done.add(u)
                    order.append(u)
                    for v, w in near[u]:
                        if v in done:
                            continue
                        step = d + w
                        if v not in dist or step < dist[v] - 1e-12:
                            dist[v], paths[v], before[v] = step, paths[u], [u]
                            tie += 1
                            heapq.heappush(heap, (step, tie, v))
                        elif abs(step - dist[v]) <= 1e-12:
                            paths[v] += paths[u]
                            before[v].append(u)
                share = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in before[v]:
                        share[u] += paths[u] / paths[v] * (1 + share[v])
                    if v != source:
                        total[v] += share[v]
            yield pd.DataFrame({"node": list(total), "part": list(total.values())})

    parts = nodes.repartition(edges.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "node bigint, part double")
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return parts.groupBy("node").agg((F.sum("part") * scale).alias("betweenness"))


def _louvain(pdf, resolution: float, total: float):
    import numpy as np

    nodes = np.unique(np.concatenate([pdf.src, pdf.dst]))
    near = [dict() for _ in nodes]
    for a, b, w in zip(np.searchsorted(nodes, pdf.src), np.searchsorted(nodes, pdf.dst), pdf.weight, strict=True):
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    own = np.arange(len(nodes))
    loops = [0.0] * len(nodes)
    while True:
        k = [sum(x.values()) + 2 * s for x, s in zip(near, loops, strict=True)]
        group, held, moved = list(range(len(near))), list(k), False
        for _ in range(100):
            changed = False
            for i in range(len(near)):
                to: dict = {}
                for j, w in near[i].items():
                    to[group[j]] = to.get(group[j], 0.0) + w
                was = group[i]
                held[was] -= k[i]
                best, gain = was, to.get(was, 0.0) - resolution * k[i] * held[was] / (2 * total)
                for c in sorted(to):
                    g = to[c] - resolution * k[i] * held[c] / (2 * total)
                    if g > gain + 1e-12:
                        best, gain = c, g
                group[i] = best
                held[best] += k[i]
                changed |= best != was
            moved |= changed
            if not changed:
                break
        if not moved:
            return nodes, own
        _, group = np.unique(group, return_inverse=True)
        own = group[own]
        n = int(group.max()) + 1
        new, new_loops = [dict() for _ in range(n)], [0.0] * n
        for i, x in enumerate(near):
            new_loops[group[i]] += loops[i]
            for j, w in x.items():
                if group[i] == group[j]:
                    new_loops[group[i]] += w / 2
                else:
                    new[group[i]][group[j]] = new[group[i]].get(group[j], 0.0) + w
        near, loops = new, new_loops


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, least: int = 1, key: str = "node") -> DataFrame:
    """``node, community``: modularity communities, largest first, ties by the smallest member; -1 for those below ``least``.

    Nodes are visited in key order, so the result is the same every time. Components are worked on apart, with the weight of
    the whole graph in the modularity, through which alone they touch.
    """
    labels = components(nodes, edges, key)
    total = float(edges.agg(F.sum("weight")).first()[0] or 0.0)

    def run(pdf):
        import numpy as np
        import pandas as pd

        names, own = _louvain(pdf, resolution, total)
        low = np.full(int(own.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, own, names)
        return pd.DataFrame({"node": names, "first": low[own]})

    found = _by_component(edges, labels).groupBy("component").applyInPandas(run, "node bigint, first bigint")
    named = labels.join(found, "node", "left").select("node", F.coalesce("first", "node").alias("first"))
    sizes = named.groupBy("first").agg(F.count("*").alias("size"))
    kept = sizes.where(F.col("size") >= least).withColumn("community", F.row_number().over(Window.orderBy(F.desc("size"), "first")).cast("bigint") - 1)
    return named.join(kept, "first", "left").select("node", F.coalesce("community", F.lit(-1).cast("bigint")).alias("community"))


def propagate_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 5, key: str = "node") -> DataFrame:
    """``node, label``: each node takes the heaviest label around it, ties by the smaller one; coarsens a giant component."""
    both, labels = both_ways(edges), nodes.select(F.col(key).alias("node"), F.col(key).alias("label"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("weight").alias("w"))
        top = votes.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(-F.col("w"), F.col("label"))).alias("s")).select("node", F.col("s.label").alias("new"))
        labels = stage(labels.join(top, "node", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
    return labels


def modularity(edges: DataFrame, labels: DataFrame, community: str = "community", resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of a partition."""
    e = edges.join(labels.select(F.col("node").alias("src"), F.col(community).alias("cs")), "src").join(labels.select(F.col("node").alias("dst"), F.col(community).alias("cd")), "dst")
    ends = e.select(F.col("cs").alias("c"), "weight").unionByName(e.select(F.col("cd").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    total = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"))
    squares = ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return total.crossJoin(squares).select((F.col("inside") / F.col("m") - resolution * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def contract(edges: DataFrame, labels: DataFrame, group: str) -> DataFrame:
    """``src, dst, n``: pairs of different groups joined by an edge, and by how many."""
    e = edges.join(labels.select(F.col("node").alias("src"), F.col(group).alias("gs")), "src").join(labels.select(F.col("node").alias("dst"), F.col(group).alias("gd")), "dst")
    e = e.where(F.col("gs").isNotNull() & F.col("gd").isNotNull() & (F.col("gs") != F.col("gd")))
    return e.groupBy(F.least("gs", "gd").alias("src"), F.greatest("gs", "gd").alias("dst")).agg(F.count("*").alias("n"))


def top_neighbours(pairs: DataFrame) -> DataFrame:
    """``node, total, top``: edges to other groups, and the group with most of them, ties by the smaller."""
    return both_ways(pairs).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("total"), F.min(F.struct(-F.col("n"), F.col("b"))).alias("s")).select("node", "total", F.col("s.b").alias("top"))


def layout(pairs: DataFrame, rounds: int = 300, seed: int = 42) -> DataFrame:
    """``node, x, y``: a spring layout of a contracted graph, computed on the driver; at most 20,000 nodes."""
    import numpy as np

    nodes = both_ways(pairs.select("src", "dst")).select(F.col("a").alias("node")).distinct().limit(20_001).toPandas().node.sort_values().to_numpy()
    if len(nodes) > 20_000:
        raise ValueError("a layout is for a contracted graph of at most 20,000 nodes")
    e = pairs.toPandas()
    a, b, w = np.searchsorted(nodes, e.src), np.searchsorted(nodes, e.dst), np.log1p(e.n.to_numpy(dtype=float))
    x, ideal = np.random.default_rng(seed).uniform(-0.5, 0.5, (len(nodes), 2)), max(len(nodes), 1) ** -0.5
    for step in range(rounds):
        move = np.zeros_like(x)
        for s in range(0, len(nodes), 1000):
            d = x[s : s + 1000, None, :] - x[None, :, :]
            gap = np.maximum((d * d).sum(2), 1e-6)
            move[s : s + 1000] += (d * (ideal * ideal / gap)[:, :, None]).sum(1)
        pull = (x[b] - x[a]) * (w * np.linalg.norm(x[b] - x[a], axis=1) / ideal)[:, None]
        np.add.at(move, a, pull)
        np.add.at(move, b, -pull)
        size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9)
        x += move / size * np.minimum(size, 0.1 * (1 - step / rounds) + 1e-3)
    rows = [(int(n), float(p), float(q)) for n, (p, q) in zip(nodes, x, strict=True)]
    return pairs.sparkSession.createDataFrame(rows, "node bigint, x double, y double")


def convex_hull(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``group, at, x, y``: the corners of each group's hull, counter-clockwise from the leftmost; none for fewer than three
    points. Each input partition first keeps the corners of its own points, so a task never holds a large group."""
    kind = dict(df.dtypes)[group]

    def corners(points):
        points = sorted(set(points))
        if len(points) < 3:
            return points

        def half(ps):
            out: list = []
            for p in ps:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        return half(points) + half(points[::-1])

    def local(batches):
        import pandas as pd

        kept: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                kept[g] = corners(kept.get(g, []) + list(zip(part.x, part.y, strict=True)))
        rows = [(g, *p) for g, ps in kept.items() for p in ps]
        yield pd.DataFrame(rows, columns=["g", "x", "y"])

    def final(pdf):
        import pandas as pd

        ps = corners(list(zip(pdf.x, pdf.y, strict=True)))
        ps = ps if len(ps) > 2 else []
        return pd.DataFrame([(pdf.g.iloc[0], k, *p) for k, p in enumerate(ps)], columns=["g", "at", "x", "y"])

    points = df.where(F.col(group).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    out = points.mapInPandas(local, f"g {kind}, x double, y double").groupBy("g").applyInPandas(final, f"g {kind}, at int, x double, y double")
    return out.select(F.col("g").alias(group), "at", "x", "y")


def density(df: DataFrame, x: str, y: str, cells: int = 180, bandwidth: float = 1.0, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``i, j, x, y, density``: a Gaussian kernel density on a grid, over all points.

    The bandwidth is Scott's factor times ``bandwidth`` along each axis. Points are first counted into a grid four times as fine,
    which bounds the work by the grid instead of by the points; the shift is at most an eighth of a cell.
    """
    s = df.agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy")).first()
    if not s["n"] or not s["sx"] or not s["sy"]:
        return df.sparkSession.createDataFrame([], "i int, j int, x double, y double, density double")
    x0, x1, y0, y1 = bounds or (s["x0"], s["x1"], s["y0"], s["y1"])
    factor = s["n"] ** (-1 / 6) * bandwidth
    hx, hy, fine = s["sx"] * factor, s["sy"] * factor, 4 * cells
    bin_of = lambda c, a, b: F.least(F.floor((F.col(c) - a) / ((b - a) / fine)), F.lit(fine - 1))
    mass = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).groupBy(bin_of(x, x0, x1).alias("a"), bin_of(y, y0, y1).alias("b")).agg(F.count("*").alias("n"))

    # the kernel is a product: rows are smoothed along x before what is left is smoothed along y
    grid = df.sparkSession.range(cells).select(F.col("id").cast("int").alias("i"))
    at = lambda k, a, b, n: F.lit(a) + (F.col(k) + 0.5) * ((b - a) / n)
    kernel = lambda d, h: F.exp(-F.pow(d / h, 2) / 2) / (h * (2 * 3.141592653589793) ** 0.5)
    along = mass.crossJoin(F.broadcast(grid)).withColumn("w", F.col("n") * kernel(at("a", x0, x1, fine) - at("i", x0, x1, cells), hx)).groupBy("b", "i").agg(F.sum("w").alias("w"))
    both = along.crossJoin(F.broadcast(grid.withColumnRenamed("i", "j"))).withColumn("w", F.col("w") * kernel(at("b", y0, y1, fine) - at("j", y0, y1, cells), hy)).groupBy("i", "j").agg((F.sum("w") / s["n"]).alias("density"))
    return both.select("i", "j", at("i", x0, x1, cells).alias("x"), at("j", y0, y1, cells).alias("y"), "density")
