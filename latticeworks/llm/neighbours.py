"""The nearest vectors of every vector, by a permutation index.

Pivots are drawn from the vectors. Each vector is represented by the order of its nearest pivots and posted in the inverted
files of the first ``places`` of them. A query walks the files of its own nearest pivots in their order and reranks what is
posted there by Euclidean distance; a vector met in several files counts once. Vectors that lie far from all pivots have a
less telling order, so they are posted in more files and ask more.

For pairs within a radius a vector is posted with its nearest pivot alone, and a query walks that of its own nearest pivot and
every file that reaches to within the radius of it: the plane halfway between two pivots parts what is posted with them, so a
query further from that plane than the radius needs only one of the two. No other file can hold such a vector, so none is lost.

Ranking what is posted by the footrule distance of two orders before it is reranked does not pay in 32 dimensions, see the
README; the order decides where a vector is posted and what is asked, and all of that is compared exactly.

Files of neighbouring pivots are kept together in buckets of about equal work, estimated on a bounded sample; a bucket of one
file with more work than a task should have is asked in several parts. Every vector is posted and asks; equal vectors form one
class, so that copies cost nothing. The number of pivots follows the number of vectors, so a file keeps its size and the work
grows in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import VECTOR_WIDTH, distinct_vectors, drawn, keep_staged, matrix, stage, staging


@dataclass(frozen=True)
class Permutations:
    """Parameters of the index. ``most_pivots`` bounds what is sampled and sent to the tasks (1 MB per 8,192)."""

    per_pivot: int = 128  #: vectors per pivot
    most_pivots: int = 131072
    places: int = 4  #: files that a vector is posted in
    asked: int = 10  #: files that it asks at least
    far: float = 3.0  #: vectors this many times as far from their pivot as the median ...
    far_places: int = 8  #: ... are posted in so many
    far_asked: int = 48  #: ... and ask so many
    reach: float = 1.15  #: files of pivots up to this many times as far as the nearest are asked as well ...
    most_asked: int = 64  #: ... up to so many; where the vectors of a cluster have many files, more of them are near
    direct: int = 4096  #: of more pivots only those of groups that may matter are compared
    group: int = 64  #: pivots in a group
    sample: int = 16384  #: vectors on which work is estimated
    task_pairs: float = 6e8  #: comparisons aimed at per task
    task_posts: int = 32768  #: postings of a bucket of several files at most
    looked: int = 32768  #: vectors whose files are looked up together


class Pivots:
    """Pivots, and which of them are nearest to given vectors."""

    def __init__(self, pivots, options: Permutations):
        import numpy as np

        self.middle = pivots.mean(0) if len(pivots) else np.zeros(VECTOR_WIDTH, np.float32)
        self.x = pivots - self.middle
        self.squares = (self.x * self.x).sum(1)
        self.columns = np.concatenate([self.x, np.ones((len(self.x), 1), np.float32), self.squares[:, None]], 1).T.copy()
        self.groups = None
        if len(pivots) > options.direct:
            by = halved(self.x, lambda rows: len(rows) <= options.group)
            centres = np.stack([self.x[rows].mean(0) for rows in by])
            radius = np.array([np.sqrt(((self.x[rows] - c) ** 2).sum(1).max()) for rows, c in zip(by, centres, strict=True)])
            self.groups = by, centres, radius * np.float32(1 + 1e-5)
            self.enough = max(8 * options.far_asked, 512)

    def _squared(self, y, among=None):
        """Squared distances of the rows of y to pivots, as one product."""
        import numpy as np

        own = (y * y).sum(1)[:, None]
        return np.concatenate([-2 * y, own, np.ones_like(own)], 1) @ (self.columns if among is None else self.columns[:, among])

    def nearest(self, x, least, reach: float = 0.0, most: int = 0):
        """(row, pivot, distance, rank): of each row of x its nearest pivots in order, at least ``least`` of them, a function of the
        distances of the first, and ``most`` of those up to ``reach`` times as far."""
        import numpy as np

        return self._joined(self._few(y, among, least, reach, most, rows) for y, among, rows in self._looks(x, 0.0))

    def around(self, x, within: float):
        """(row, pivot, distance, rank): of each row of x its nearest pivot, and every pivot that is the nearest of any vector
        ``within`` of the row. Such a vector lies on the other side of the plane halfway between the two pivots, or on it."""
        import numpy as np

        def some(y, among, rows):
            d, own = self._squared(y, among), (y * y).sum(1)
            at = d.argmin(1)
            first = np.maximum(d[np.arange(len(y)), at], 0)
            slack = 4e-6 * (own + float(self.squares.max()))
            ring = (np.sqrt(first + slack) + 2 * within) ** 2 + slack
            d[np.arange(len(y)), at] = -1  # stands first, whatever is rounded
            r, c = np.nonzero(d <= ring[:, None])
            one, other = (at[r], c) if among is None else (among[at[r]], among[c])
            e = self.x[other] - self.x[one]
            e = np.sqrt(np.einsum("ij,ij->i", e, e))
            d = np.where(c == at[r], first[r], d[r, c])
            keep = d - first[r] <= 2 * within * (1 + 1e-5) * e + 2 * slack[r]
            r, other, d = r[keep], other[keep], d[keep]
            order = np.lexsort((other, d, other != one[keep], r))
            r, other, d = r[order], other[order], d[order]
            return rows[r], other, np.sqrt(np.maximum(d, 0)), np.arange(len(r)) - np.searchsorted(r, r)

        return self._joined(some(y, among, rows) for y, among, rows in self._looks(x, 2 * within))

    @staticmethod
    def _joined(parts):
        import numpy as np

        parts = list(parts)
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4

    def _few(self, y, among, least, reach, most_near, names):
        import numpy as np

        d = self._squared(y, among)
        first = np.maximum(d.min(1), 0)
        k = np.minimum(least(np.sqrt(first)), d.shape[1])
        if reach:
            k = np.maximum(k, np.minimum((d <= (reach * reach * first)[:, None]).sum(1), most_near))
        most = int(k.max())
        best = np.argpartition(d, most - 1, axis=1)[:, :most] if most < d.shape[1] else np.tile(np.arange(most), (len(y), 1))
        d = np.take_along_axis(d, best, 1)
        order = np.argsort(d, axis=1, kind="stable")
        best, d = np.take_along_axis(best, order, 1), np.take_along_axis(d, order, 1)
        row, rank = np.nonzero(np.arange(most)[None, :] < k[:, None])
        pivot = best[row, rank]
        return names[row], (pivot if among is None else among[pivot]), np.sqrt(np.maximum(d[row, rank], 0)), rank

    def _looks(self, x, margin):
        """Rows, less the middle, the pivots that are compared with them, and the rows' numbers: all pivots, or those of the groups
        nearest to the rows' own group and of every group that may hold one within the margin. Rows of one group are taken
        together, so what is done for a group is done once for many rows."""
        import numpy as np

        if self.groups is None:
            for s in range(0, len(x), 1024):
                y = x[s : s + 1024] - self.middle
                yield y, None, np.arange(s, s + len(y))
            return
        by, centres, radius = self.groups
        squares, sizes = (centres * centres).sum(1), np.array([len(b) for b in by])
        own = np.concatenate([(squares - 2 * ((x[s : s + 4096] - self.middle) @ centres.T)).argmin(1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
        ranked = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.diff(own[ranked], prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(ranked)), strict=True):
            g = own[ranked[a]]
            order = np.argsort(((centres - centres[g]) ** 2).sum(1), kind="stable")
            take = order[: int(np.searchsorted(np.cumsum(sizes[order]), self.enough)) + 1]
            among = np.concatenate([by[t] for t in take])
            for s in range(a, b, 1024):
                rows = ranked[s : min(s + 1024, b)]
                y = x[rows] - self.middle
                to = np.sqrt(np.maximum(squares - 2 * (y @ centres.T) + (y * y).sum(1)[:, None], 0))
                far = np.sqrt(np.maximum(self._squared(y, among).min(1), 0)) * (1 + 1e-4) + margin + 1e-3
                holds = (to - radius[None, :]) <= far[:, None]
                holds[:, take] = False
                # rows that need many more groups apart from those that need few
                for some in parted(holds.sum(1)):
                    more = np.flatnonzero(holds[some].any(0))
                    yield y[some], np.concatenate([among, *(by[t] for t in more)]), rows[some]


def parted(needs):
    """Row numbers in up to three parts by how much the rows need."""
    import numpy as np

    bounds = np.unique(np.quantile(needs, [0.5, 0.9]))
    kind = np.searchsorted(bounds, needs)
    return [some for k in range(len(bounds) + 1) if len(some := np.flatnonzero(kind == k))]


def halved(x, fits):
    """Row numbers of x in parts, cut in two by two-means until each ``fits``."""
    import numpy as np

    from .cells import halve

    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) < 2 or fits(rows):
            out.append(rows)
            continue
        side = halve(x[rows], 8)
        todo += [rows[~side], rows[side]]
    return out


class Nearest:
    """The k nearest rows found so far of each row, by distance and name, each at most once."""

    def __init__(self, n: int, k: int, within: float):
        import numpy as np

        self.k, self.limit = k, np.full(n, within * within * (1 + 1e-6))
        self.d, self.i = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)

    def offer(self, q, other, d, ids):
        """Rows ``q``, others and squared distances; the pairs are new or repeated."""
        import numpy as np

        some = np.unique(q)
        held_q, held_i, held_d = np.repeat(some, self.k), self.i[some].ravel(), self.d[some].ravel()
        real = held_i >= 0
        q, other, d = np.concatenate([held_q[real], q]), np.concatenate([held_i[real], other]), np.concatenate([held_d[real], d])
        order = np.lexsort((ids[other], d, q))
        q, other, d = q[order], other[order], d[order]
        # the same pair has the same distance, so repeats stand side by side
        new = np.append(True, (q[1:] != q[:-1]) | (other[1:] != other[:-1]))
        q, other, d = q[new], other[new], d[new]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        keep = place < self.k
        q, other, d, place = q[keep], other[keep], d[keep], place[keep]
        self.d[q, place], self.i[q, place] = d, other
        full = place == self.k - 1
        self.limit[q[full]] = np.minimum(self.limit[q[full]], d[full])


def _walk(k: int, within: float):
    def run(got):
        import numpy as np

        got = got.combine_chunks()
        ids, x, copies = got.column("rep").to_numpy(), matrix(got.column("v")), got.column("copies").to_numpy()
        best = Nearest(len(ids), k, within)

        def listed(name):
            column = got.column(name).combine_chunks()
            n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, pivot = np.repeat(np.arange(len(ids)), n), column.flatten().to_numpy()
            rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((rank, pivot))
            return row[order], pivot[order], rank[order]

        post, post_pivot, _ = listed("posts")
        ask, ask_pivot, ask_rank = listed("asks")
        files = np.unique(post_pivot)
        ends = np.searchsorted(post_pivot, [files, files + 1])
        asks = np.searchsorted(ask_pivot, [files, files + 1])

        def compare(file, asking, first):
            px = x[file] - x[file[0]]
            squares = (px * px).sum(1)
            px = np.concatenate([px, squares[:, None]], 1).T.copy()
            top, few = float(squares.max()), min(k + 1, len(file))
            step = max(1, 400_000 // len(file))
            for s in range(0, len(asking), step):
                q = asking[s : s + step]
                y = x[q] - x[file[0]]
                own = (y * y).sum(1)
                d = np.concatenate([-2 * y, np.ones((len(y), 1), np.float32)], 1) @ px
                limit = best.limit[q] - own
                if first and np.isinf(within) and few < len(file):
                    limit = np.minimum(limit, np.partition(d, few - 1, axis=1)[:, few - 1])
                r, c = np.nonzero(d <= (limit + 4e-6 * (own + top))[:, None])
                a, b = q[r], file[c]
                ok = a != b
                a, b = a[ok], b[ok]
                if len(a):
                    e = x[a].astype(np.float64) - x[b]
                    e = np.einsum("ij,ij->i", e, e)
                    ok = e <= best.limit[a]
                    if ok.any():
                        best.offer(a[ok], b[ok], e[ok], ids)

        # the nearest files first, so that what is asked later has a limit
        for first in (True, False):
            for f in range(len(files)):
                span = slice(asks[0, f], asks[1, f])
                asking = ask[span][(ask_rank[span] == 0) == first]
                if len(asking):
                    compare(post[ends[0, f] : ends[1, f]], asking, first)
        row, col = np.nonzero(best.i >= 0)
        other = best.i[row, col]
        return pa.table({"rep": ids[row], "near": ids[other], "d2": best.d[row, col], "own": copies[row], "copies": copies[other]})

    return run


_FOUND = "rep bigint, near bigint, d2 double, own int, copies int"
_SENT = "bucket int, part int, rep bigint, copies int, posts array<smallint>, asks array<smallint>, v array<float>"


def _ragged(values, sizes):
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _files(pivots: Pivots, x, options: Permutations, far: float, within: float):
    """(row, pivot, distance, rank) of the files that the rows of x ask, and in how many of the first each is posted. Within a
    radius a vector is posted with its nearest pivot and asks the files that may hold one so near."""
    import numpy as np

    if np.isfinite(within):
        return *pivots.around(x, within), np.ones(len(x), np.int64)
    row, pivot, d, rank = pivots.nearest(x, lambda first: np.where(first > far, options.far_asked, options.asked), options.reach, options.most_asked)
    first = np.zeros(len(x), np.float32)
    first[row[rank == 0]] = d[rank == 0]
    return row, pivot, d, rank, np.where(first > far, options.far_places, options.places)


def _many(batches: Iterator, rows: int) -> Iterator:
    """Batches put together until they hold ``rows``."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=n)[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=n)[0]


def _represent(sent, options: Permutations, within: float):
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        pivots, bucket, local, parts, far = sent.value
        for batch in _many(batches, options.looked):
            rep = batch.column(0).to_numpy()
            row, pivot, d, rank, places = _files(pivots, matrix(batch.column(2)), options, far, within)
            order = np.lexsort((rank, bucket[pivot], row))
            row, pivot, d, rank = row[order], pivot[order], d[order], rank[order]
            to = bucket[pivot]
            starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (to[1:] != to[:-1])))
            m = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))  # the message of each entry
            posted = rank < places[row]
            m_row, m_to = row[starts], to[starts]
            n_posts = np.bincount(m, posted, len(starts)).astype(np.int64)
            n_asks = np.bincount(m, minlength=len(starts))
            mine = ((rep[m_row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[m_to]
            # a posting goes to all parts of a bucket, its questions to one
            copies = np.where(n_posts > 0, parts[m_to], 1)
            k = np.repeat(np.arange(len(starts)), copies)
            part = np.arange(len(k)) - np.repeat(np.cumsum(copies) - copies, copies)
            part = np.where(copies[k] > 1, part, mine[k])
            asks = np.where(part == mine[k], n_asks[k], 0)
            post_values, post_start = local[pivot[posted]], np.cumsum(n_posts) - n_posts
            spread = lambda start, n: np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            posts = _ragged(post_values[spread(post_start[k], n_posts[k])], n_posts[k])
            asked_lists = _ragged(local[pivot][spread(starts[k], asks)], asks)
            took = batch.take(pa.array(m_row[k]))
            names = ["bucket", "part", "rep", "copies", "posts", "asks", "v"]
            for a in range(0, len(k), 20_000):
                cut = slice(a, a + 20_000)
                t = took.slice(a, 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(m_to[k][cut].astype(np.int32)), pa.array(part[cut].astype(np.int32)), t.column(0), t.column(1), posts.slice(a, 20_000), asked_lists.slice(a, 20_000), t.column(2)], names=names)

    return run


def nearest_classes(classes: DataFrame, k: int, options: Permutations = Permutations(), within: float = float("inf")) -> DataFrame:
    """``rep, near, d2, own, copies``: up to k near classes of each class from every bucket that it asked, with the sizes of both,
    none further than ``within``. A pair can come from several buckets; the best k are still to be taken."""
    import numpy as np

    spark = classes.sparkSession
    total = classes.count()
    n_pivots = int(min(options.most_pivots, max(2, -(-total // options.per_pivot))))
    if np.isfinite(within):
        # none is lost whatever their number; of so many, finding the files takes about as long as walking them
        n_pivots = int(min(n_pivots, max(2, 2 * np.ceil(total**0.5))))
    pivots = Pivots(drawn(classes, "rep", "v", n_pivots, total, 11), options)
    if not len(pivots.x):
        return spark.createDataFrame([], _FOUND)
    # work of each file, estimated on a sample
    some = drawn(classes, "rep", "v", options.sample, total, 13)
    some = some if len(some) else pivots.x + pivots.middle
    first = pivots.nearest(some, lambda f: np.ones(len(f), np.int64))[2]
    far = np.float32(options.far * np.median(first[first > 0])) if (first > 0).any() else np.float32(np.inf)
    row, pivot, _, rank, places = _files(pivots, some, options, far, within)
    scale = total / len(some)
    posts = np.maximum(np.bincount(pivot[rank < places[row]], minlength=len(pivots.x)), 0.5) * scale
    asks = np.maximum(np.bincount(pivot, minlength=len(pivots.x)), 0.5) * scale
    work = posts * asks
    by = halved(pivots.x, lambda rows: work[rows].sum() <= options.task_pairs and posts[rows].sum() <= options.task_posts and len(rows) <= 32767)
    bucket, local, parts = np.empty(len(pivots.x), np.int32), np.empty(len(pivots.x), np.int16), np.ones(len(by), np.int64)
    for b, rows in enumerate(by):
        bucket[rows], local[rows] = b, np.arange(len(rows))
        parts[b] = max(1, int(np.ceil(work[rows].sum() / options.task_pairs)))
    sent = spark.sparkContext.broadcast((pivots, bucket, local, parts, far))
    messages = classes.select("rep", "copies", "v").mapInArrow(_represent(sent, options, within), _SENT)
    return messages.groupBy("bucket", "part").applyInArrow(_walk(k, within), _FOUND)


def _ranked(classes: DataFrame, k: int, options: Permutations, within: float = float("inf")) -> DataFrame:
    """``rep, near, distance, own, copies``: near classes of which a key may be among the k nearest of a key of ``rep``: fewer than
    k other keys are strictly nearer, those of the own class among them."""
    found = nearest_classes(classes, k, options, within).repartition("rep").groupBy("rep", "near").agg(F.min("d2").alias("d2"), F.first("own").alias("own"), F.first("copies").alias("copies"))
    by = Window.partitionBy("rep").orderBy("d2", "near")
    best = found.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k)
    nearer = F.sum("copies").over(Window.partitionBy("rep").orderBy("d2")) - F.sum("copies").over(Window.partitionBy("rep", "d2"))
    best = best.withColumn("before", F.col("own") - 1 + nearer).where(F.col("before") < k)
    return best.select("rep", "near", F.sqrt("d2").alias("distance"), "own", "copies")


def _by_key(several: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """``id, near, distance``: the pairs of keys behind pairs of classes, and those within a class. Only classes of several keys
    are looked up; the first k + 1 keys of a class stand for it as neighbours."""
    from .topn import top_n

    listed = top_n(several.withColumn("s", F.lit(0.0)), "rep", "s", "id", k + 1).select("rep", F.col("id").alias("other"))
    plain = ranked.where("copies = 1").withColumn("other", F.col("near"))
    full = ranked.where("copies > 1").join(listed.withColumnRenamed("rep", "near"), "near").select(*plain.columns)
    both = plain.unionByName(full)
    single = both.where("own = 1").select(F.col("rep").alias("id"), "other", "distance")
    copied = both.where("own > 1").join(several, "rep").select("id", "other", "distance")
    out = single.unionByName(copied)
    out = out.unionByName(several.join(listed, "rep").where("id <> other").select("id", "other", F.lit(0.0).alias("distance")))
    best = Window.partitionBy("id").orderBy("distance", "other")
    return out.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k).withColumnRenamed("other", "near")


def nearest(df: DataFrame, k: int = 5, key: str = "icsd_id", vector: str = "pca32", order: str = "row_ix", options: Permutations = Permutations()) -> DataFrame:
    """``id, rk, near, distance``: the k nearest other keys of every key with a valid vector, ties by the smaller key.

    Distances are Euclidean, computed exactly; which of the nearest are found depends on ``options`` (recall is measured in the
    tests and stated in the README). Rows whose vector is null, of another length or not finite take no part; neither do null
    keys. A key that occurs several times keeps the vector of its smallest ``order``. With fewer than k other keys all come out.
    Keys with equal vectors are neighbours at distance 0. Other columns are ignored.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    with staging():
        classes, several = distinct_vectors(df, key, vector, order)
        return keep_staged(stage(_by_key(several, stage(_ranked(classes, k, options), "ranked"), k).select("id", "rk", "near", "distance"), "nearest"))


def close_pairs(df: DataFrame, within: float = 0.25, k: int = 5, key: str = "icsd_id", vector: str = "pca32", order: str = "row_ix", options: Permutations = Permutations()) -> DataFrame:
    """``a, b`` with a < b: keys at most ``within`` apart, one of them among the k nearest of the other. None is lost: a vector is
    posted with its nearest pivot, and a query walks every file that may hold one within the radius. See ``nearest``."""
    if k < 1 or within < 0:
        raise ValueError("k must be at least 1 and within not negative")
    with staging():
        classes, several = distinct_vectors(df, key, vector, order)
        ranked = stage(_ranked(classes, k, options, within).where(F.col("distance") <= within), "close")
        pairs = _by_key(several, ranked, k).select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()
        return keep_staged(stage(pairs, "pairs"))
