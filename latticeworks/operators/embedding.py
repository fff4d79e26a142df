"""Vectors of structures from their sites: message passing along weighted neighbours, then pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pass_messages(x, edges, rounds: int = 3):
    """Rounds of x_i + sum(w x_j) / sum(w) over the neighbours of each site; a site without neighbours stays as it is.

    ``edges`` is (site, neighbour, weight) as three arrays; weights of a site that sum to 0 divide by 1.
    """
    import numpy as np

    a, b, w = (np.asarray(e) for e in edges)
    total = np.bincount(a, w, len(x)) if len(a) else np.zeros(len(x))
    has = np.bincount(a, minlength=len(x)) > 0 if len(a) else np.zeros(len(x), bool)
    total = np.where(total == 0, 1.0, total)
    for _ in range(rounds):
        around = np.zeros_like(x)
        if len(a):
            np.add.at(around, a, w[:, None] * x[b])
        x = np.where(has[:, None], x + around / total[:, None], x)
    return x


def pool(x, extra):
    """Mean, maximum and variance over the sites, then what holds for the whole structure."""
    import numpy as np

    return np.concatenate([x.mean(0), x.max(0), x.var(0), extra])


def embed(structures: DataFrame, key: str, sites: str, edges: str, extra: str, rounds: int = 3, most_sites: int = 256) -> DataFrame:
    """``key, ok, v, error``: a vector per structure.

    ``sites`` is ARRAY<ARRAY<DOUBLE>>, the descriptor of each site; ``edges`` ARRAY<STRUCT<i INT, j INT, w DOUBLE>>; ``extra``
    ARRAY<DOUBLE>. Structures without sites, with more than ``most_sites``, or with a vector that is not finite are not ok and
    say why; they stay in the result. Each structure is small, so this is a map over Arrow batches.
    """
    kind = dict(structures.dtypes)[key]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, ok, vectors, errors = batch.column(0), [], [], []
            for s, e, g in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                try:
                    if not s:
                        raise ValueError("no sites")
                    if len(s) > most_sites:
                        raise ValueError(f"{len(s)} sites")
                    rows = e or []
                    x = pass_messages(np.array(s, float), ([r["i"] for r in rows], [r["j"] for r in rows], [r["w"] for r in rows]), rounds)
                    v = pool(x, np.array(g or [], float))
                    if not np.isfinite(v).all():
                        raise ValueError("not finite")
                    ok.append(True)
                    vectors.append(v.tolist())
                    errors.append(None)
                except (ValueError, IndexError, TypeError) as x:
                    ok.append(False)
                    vectors.append(None)
                    errors.append(str(x)[:200])
            yield pa.RecordBatch.from_arrays([keys, pa.array(ok, pa.bool_()), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[key, "ok", "v", "error"])

    return structures.select(key, sites, edges, extra).mapInArrow(run, f"`{key}` {kind}, ok boolean, v array<double>, error string")


def failures(embedded: DataFrame, n: int = 500) -> DataFrame:
    """The first failures in key order, for a log."""
    key = embedded.columns[0]
    return embedded.where(~F.col("ok")).select(key, "error").orderBy(key).limit(n)


#: How local geometry is described: by distances and neighbours in twelve numbers, not at all, or by order parameters of a package.
MODES = ("fast_local", "chem_only", "matminer_ops")


def describe(s, mode: str = "fast_local", ionic_radii: dict[str, float] | None = None):
    """Sites, edges and what holds for the whole structure: per site seven numbers of its elements and twelve of its geometry.

    The twelve are, over the neighbours of ``structures.neighbours``: sum of weights, mean and deviation of distances, how many
    weigh something, largest weight, smallest and largest distance, how many elements, and the first four numbers of the
    neighbours' elements in their weighted mean. ``chem_only`` leaves them 0 and has no edges. ``matminer_ops`` needs a package
    that is not part of this library.
    """
    import numpy as np

    from ..functions import elements, structures

    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode == "matminer_ops":
        raise ValueError("matminer_ops needs a package of order parameters; hand ready site descriptors to embed")
    chem = np.array([elements.vector(x, ionic_radii) for x in s.species])
    geometry, edges = np.zeros((len(chem), 12)), ([], [], [])
    if mode == "fast_local":
        if s.places is None:
            raise ValueError("no coordinates")
        a, b, w, d = structures.neighbours(s)
        for i in range(len(chem)):
            at = np.flatnonzero(a == i)
            if len(at):
                wi, di = w[at], d[at]
                kinds = {k for j in b[at] for k in s.species[j]}
                around = (wi[:, None] * chem[b[at]]).sum(0) / (wi.sum() or 1.0)
                geometry[i] = [wi.sum(), di.mean(), di.std(), (wi > 0).sum(), wi.max(), di.min(), di.max(), len(kinds), *around[:4]]
        edges = (a, b, w)
    weight = sum(share * elements.WEIGHTS[elements.NUMBER[k] - 1] for x in s.species for k, share in x.items() if k in elements.NUMBER)
    return np.concatenate([chem, geometry], 1), edges, [*s.cell, s.volume, weight / s.volume * 1.66053907, len(chem)]


def featurize(texts: DataFrame, key: str, text: str, mode: str = "fast_local", rounds: int = 3, most_sites: int = 256, ionic_radii: dict[str, float] | None = None) -> DataFrame:
    """``key, ok, v, error``: a vector of 66 numbers per structure given as JSON or CIF text, see ``describe``, ``pass_messages``
    and ``pool``. What cannot be read is not ok and says why; null texts too. Other columns are ignored."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    kind = dict(texts.dtypes)[key]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions import structures

        for batch in batches:
            vectors, errors = [], []
            for t in batch.column(1).to_pylist():
                try:
                    s = structures.parse(t)
                    if not 0 < len(s.species) <= most_sites:
                        raise ValueError(f"{len(s.species)} sites")
                    x, edges, extra = describe(s, mode, ionic_radii)
                    v = pool(pass_messages(x, edges, rounds), np.array(extra, float))
                    if not np.isfinite(v).all():
                        raise ValueError("not finite")
                    vectors.append(v.tolist())
                    errors.append(None)
                except ValueError as e:
                    vectors.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e is None for e in errors], pa.bool_()), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[key, "ok", "v", "error"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, ok boolean, v array<double>, error string")
