"""Numeric parts of the clustering: bisecting k-means in memory, units, links between units, exact isolation."""

from __future__ import annotations

import heapq

import numpy as np


def squared(x, y):
    """Squared distances of the rows of x and y, in double precision of the norms, not below 0."""
    d = (y * y).sum(1) - 2 * (x @ y.T)
    d += (x * x).sum(1)[:, None]
    return np.maximum(d, 0, out=d)


def halve(x, rounds: int = 3):
    """Two-means of the rows of x from the halves along the axis of largest spread: a mask of the second part. Both parts have
    members if there are two rows."""
    centred = x - x.mean(0)
    axis = centred[np.argmax((centred * centred).sum(1))]
    for _ in range(4):
        axis = centred.T @ (centred @ axis)
        axis /= max(float(np.linalg.norm(axis)), 1e-30)
    along = centred @ axis
    side = along > 0
    for _ in range(rounds):
        n = int(side.sum())
        if not 0 < n < len(x):
            break
        a, b = x[~side].mean(0), x[side].mean(0)
        new = x @ (b - a) > (b @ b - a @ a) / 2
        if (new == side).all():
            break
        side = new
    if not 0 < int(side.sum()) < len(x):
        side = np.zeros(len(x), bool)
        side[np.argsort(along, kind="stable")[len(x) // 2 :]] = True
    return side


def bisect(x, leaves: int):
    """Bisecting k-means: the node with the largest dispersion is split until there are ``leaves``; nodes of more than four
    times their share of rows come first. Gives the centres."""
    heap: list = []
    share, tie = max(1.0, 4 * len(x) / max(leaves, 1)), 0

    def push(rows):
        nonlocal tie
        part = x[rows]
        spread = float(((part - part.mean(0)) ** 2).sum())
        heapq.heappush(heap, (-(len(rows) > share), -spread, tie, rows))
        tie += 1

    push(np.arange(len(x)))
    done = []
    while heap and len(heap) + len(done) < leaves:
        _, spread, _, rows = heapq.heappop(heap)
        if len(rows) < 2 or spread == 0:
            done.append(rows)
            continue
        side = halve(x[rows])
        push(rows[~side])
        push(rows[side])
    return np.stack([x[r].mean(0) for r in [*done, *(h[3] for h in heap)]]).astype(np.float32)


def components(n: int, a, b):
    """The smallest member of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def units(x, copies, most: int, least: int, widest: float):
    """Splits a cell by bisecting k-means until the nodes hold at most ``most`` rows, then into compact units.

    Rows of a node belong together if they are linked by distances of at most 1.3 times what each has to its nearest; pieces of
    fewer than ``least`` rows stay single rows unless they lie as close to a larger piece as its own rows do. A piece wider than
    ``widest`` (rms) is no unit: its rows stay single. Gives the unit number of each row; a cut too many costs little, since
    units are linked afterwards.
    """
    out = np.full(len(x), -1, np.int64)
    todo, n = [np.arange(len(x))], 0
    while todo:
        rows = todo.pop()
        if len(rows) > most:
            side = halve(x[rows])
            todo += [rows[~side], rows[side]]
            continue
        if len(rows) >= least:
            p = x[rows]
            d = np.sqrt(squared(p, p))
            np.fill_diagonal(d, np.inf)
            near = d.min(1)
            a, b = np.nonzero(d <= 1.3 * np.minimum(near[:, None], near[None, :]))
            label = components(len(rows), a, b)
            _, label, size = np.unique(label, return_inverse=True, return_counts=True)
            large = size[label] >= least
            for piece in np.flatnonzero(size >= least):
                own = label == piece
                close = 1.3 * float(np.median(near[own]))
                small = np.flatnonzero(~large)
                if len(small):
                    join = small[d[np.ix_(small, np.flatnonzero(own))].min(1) <= close]
                    label[join] = piece
                    large[join] = True
                own = np.flatnonzero(label == piece)
                part = p[own]
                if float(((part - part.mean(0)) ** 2).sum(1).mean()) <= widest * widest:
                    out[rows[own]] = n
                    n += 1
    single = np.flatnonzero(out < 0)
    out[single] = n + np.arange(len(single))
    return out


def summaries(x, copies, unit):
    """Per unit: the row that stands first, rows with their copies, centre, rms and largest radius."""
    order = np.argsort(unit, kind="stable")
    starts = np.flatnonzero(np.diff(unit[order], prepend=-1))
    count = np.diff(np.append(starts, len(order)))
    centre = np.add.reduceat(x[order].astype(np.float64), starts) / count[:, None]
    off = ((x[order] - np.repeat(centre, count, 0)) ** 2).sum(1)
    return order[starts], np.add.reduceat(copies[order], starts), centre.astype(np.float32), np.sqrt(np.add.reduceat(off, starts) / count), np.sqrt(np.maximum.reduceat(off, starts))


#: Links of a view: neighbours looked at, the gap that may bound a cluster of units, and what is near a compact unit.
NEAR, GAP, TOUCH = 128, 1.2, 1.1


def links(ids, n, c, r, least: int):
    """What the units of one view say: (from, to, distance, reach of from), see ``clusters.link_units``.

    A unit of ``least`` rows or more is linked to others of that size whose centre lies within 1.1 times both rms radii: parts
    of one cluster, since two sets each 1.3 times as far from the other as they are wide lie at least 1.17 radii apart. A
    smaller one is linked to all that come before the first gap behind ``least`` rows. If ``NEAR`` units show no gap, all of the
    view are looked at, and links lead to the nearest and to the smallest before the gap, which rows of one set have in common.
    A unit that sees no gap in the view is linked to itself at an infinite reach: a set with it holds the whole view.
    """
    big = n >= least
    src, dst, dist, reach = [], [], [], []
    k = min(NEAR, len(ids) - 1)
    if k < 1:
        return src, dst, dist, reach
    step = max(1, 2_000_000 // len(ids))
    for s in range(0, len(ids), step):
        rows = np.arange(s, min(s + step, len(ids)))
        d = np.sqrt(squared(c[rows], c))
        d[np.arange(len(rows)), rows] = np.inf
        touching = big[rows][:, None] & big[None, :] & (d <= TOUCH * np.minimum(r[rows][:, None], r[None, :]))
        for i in np.flatnonzero(touching.any(1)):
            to = np.flatnonzero(touching[i])
            for v in {int(to[np.argmin(ids[to])]), int(to[np.argmin(d[i, to])])}:
                src.append(ids[rows[i]])
                dst.append(ids[v])
                dist.append(0.0)
                reach.append(0.0)
        small = np.flatnonzero(~big[rows])
        if not len(small):
            continue
        ds = d[small]
        part = np.argpartition(ds, k - 1, axis=1)[:, :k]
        pd = np.take_along_axis(ds, part, 1)
        order = np.argsort(pd, axis=1, kind="stable")
        part, pd = np.take_along_axis(part, order, 1), np.take_along_axis(pd, order, 1)
        held = n[rows[small]][:, None] + np.cumsum(n[part], axis=1)
        gap = (held[:, :-1] >= least) & (pd[:, 1:] >= GAP * pd[:, :-1])
        if k == len(ids) - 1:  # the view ends behind the last unit
            gap = np.append(gap, (held[:, -1] >= least)[:, None], 1)
        first = np.argmax(gap, axis=1)
        for i in np.flatnonzero(gap.any(1)):
            e = int(first[i]) + 1
            src += [ids[rows[small[i]]]] * e
            dst += ids[part[i, :e]].tolist()
            dist += pd[i, :e].tolist()
            reach += [float(pd[i, e - 1])] * e
        open_ = np.flatnonzero(~gap.any(1)) if k < len(ids) - 1 else np.zeros(0, np.int64)
        if not len(open_):
            continue
        # ``NEAR`` units hold more than ``least`` rows, so any gap behind them counts
        unit, every = ids[rows[small[open_]]], ds[open_]
        ranked = np.sort(every, axis=1)[:, k - 1 : -1]  # the last is the unit itself
        ends = ranked[:, 1:] >= GAP * ranked[:, :-1]
        ended = ends.any(1)
        bound = ranked[np.arange(len(open_)), np.argmax(ends, axis=1)]
        for u in unit[~ended]:
            src.append(u)
            dst.append(u)
            dist.append(0.0)
            reach.append(np.inf)
        least_id = np.where(every <= bound[:, None], ids[None, :], np.iinfo(np.int64).max).argmin(1)
        for i in np.flatnonzero(ended):
            for v in {*part[open_[i], :least].tolist(), int(least_id[i])}:
                src.append(unit[i])
                dst.append(ids[v])
                dist.append(float(every[i, v]))
                reach.append(float(bound[i]))
    return src, dst, dist, reach


#: Rows from which the orders of a whole group are not sorted in full.
WHOLE_ORDERS = 768


class Profiles:
    """The orders of distances of the rows of a block within a group that is seen batch by batch, as far as gaps need them.

    A gap in the order of all rows is a gap in the order of any of them. So each row's distances to a sample of its block are
    sorted first; between two of them that are less than ``apart`` apart there can be no gap, and what falls
    there is only counted. What falls into the open intervals, below the first, into gaps and above the last, is listed. The
    sample grows with the group, so that a row lists some ``LISTED`` others whatever the size.
    """

    LISTED = 512

    def __init__(self, ids, weight, name, x, held: int, least: int, apart: float):
        self.ids, self.least, self.ratio = ids, least, apart * apart * (1 - 1e-12)
        self.middle = x.astype(np.float64).mean(0)
        self.x, self.weight, self.name = x - self.middle, weight.astype(np.int64), name
        n = len(x)
        sample = np.linspace(0, n - 1, min(n, max(512, held // self.LISTED))).astype(np.int64)
        step = 4096
        sample = np.unique(sample)
        known = np.empty((n, len(sample)))
        for s in range(0, n, step):
            known[s : s + step] = squared(self.x[s : s + step], self.x[sample])
        known[sample, np.arange(len(sample))] = np.inf
        known.sort(axis=1)
        # a row's own place in the sample is infinite
        self.low = known[:, 0] if known.shape[1] else np.full(n, np.inf)
        finite = np.isfinite(known)
        self.high = np.where(finite, known, -np.inf).max(1, initial=-np.inf)
        a, b = known[:, :-1], known[:, 1:]
        row, at = np.nonzero((b >= self.ratio * a) & (b > a) & np.isfinite(b))
        self.gap_row, self.gap_a, self.gap_b = row, a[row, at], b[row, at]
        self.gapped = np.unique(row)
        self.plain = np.setdiff1d(np.arange(n), row)
        self.squares = (self.x * self.x).sum(1)
        self.products = np.concatenate([-2 * self.x, np.ones((n, 1))], 1).astype(np.float32)
        self.inside = np.zeros((len(row), 4))  # rows, records and the halves of names up to a gap
        self.seen = np.zeros(3, np.int64)  # rows, records, names of the group
        self.lists: list = []
        self.add(ids, weight, name, x, True)

    def _list(self, row, d, weight, name):
        self.lists.append((row.astype(np.int32), d, weight, name))

    def add(self, ids, weight, name, x, own: bool = False):
        weight = weight.astype(np.int64)
        self.seen += np.array([len(x), weight.sum(), name.sum()], np.int64)
        y = x - self.middle
        squares = (y * y).sum(1)
        # distances less the squares of the block's rows, in one product; what may be listed is looked at again in double precision
        with_squares = np.concatenate([y, squares[:, None]], 1).astype(np.float32)
        step = max(1, 4_000_000 // max(len(x), 1))
        for s in range(0, len(self.plain), step):
            rows = self.plain[s : s + step]
            d = self.products[rows] @ with_squares.T
            slack = 4e-6 * (self.squares[rows] + squares.max())
            low, high = self.low[rows] - self.squares[rows] + slack, self.high[rows] - self.squares[rows] - slack
            r, c = np.nonzero((d < low.astype(np.float32)[:, None]) | (d > high.astype(np.float32)[:, None]))
            r = rows[r]
            e = self.x[r] - y[c]
            e = np.einsum("ij,ij->i", e, e)
            if own:
                e[r == c] = -1  # itself
            out = (e < self.low[r]) | (e > self.high[r])
            self._list(r[out], e[out], weight[c[out]], name[c[out]])
        if not len(self.gap_row):
            return
        halves = np.stack([np.ones(len(x)), weight.astype(float), (name & 0xFFFFFFFF).astype(float), (name >> 32).astype(float)], 1)
        step = max(1, 2_000_000 // max(len(x), 1))
        for s in range(0, len(self.gapped), step):
            rows = self.gapped[s : s + step]
            d = squared(self.x[rows], y)
            if own:
                d[np.arange(len(d)), rows] = -1
            r, c = np.nonzero((d < self.low[rows, None]) | (d > self.high[rows, None]))
            self._list(rows[r], d[r, c], weight[c], name[c])
            lo, hi = np.searchsorted(self.gap_row, [rows[0], rows[-1] + 1])
            for g in range(lo, hi, step):
                some = slice(g, min(g + step, hi))
                at = d[np.searchsorted(rows, self.gap_row[some])]
                below = at <= self.gap_a[some, None]
                self.inside[some] += below @ halves
                r, c = np.nonzero(~below & (at < self.gap_b[some, None]))
                self._list(self.gap_row[some][r], at[r, c], weight[c], name[c])

    def proposals(self):
        """(rows of the block, sums of the names within, rows within, widths) of beginnings that end at a gap and hold enough."""
        row, first, weight, name = (np.concatenate(c) for c in zip(*self.lists, strict=True))
        first, count = np.maximum(first, 0), np.ones(len(row), np.int64)
        order = np.lexsort((first, row))
        row, first, count, weight, name = (c[order] for c in (row, first, count, weight, name))
        ends = np.searchsorted(row, np.arange(len(self.x) + 1))
        sums = np.stack([np.concatenate([[0], np.cumsum(c)]) for c in (count, weight, name)], 1)

        def listed(r, limit, right):
            """Sums over what rows r list below (or up to) the limits."""
            lo, hi = ends[r], ends[r + 1]
            while (lo < hi).any():
                mid = (lo + hi) // 2
                at = first[np.minimum(mid, len(first) - 1)]
                go = (lo < hi) & ((at <= limit) if right else (at < limit))
                lo, hi = np.where(go, mid + 1, lo), np.where(go, hi, np.minimum(mid, hi))
            return sums[lo] - sums[ends[r]]

        # what is not listed lies in zones, which end at the gaps and at the last of the known distances
        last_row = np.flatnonzero(np.isfinite(self.low))
        halves = self.inside.astype(np.int64)
        until = np.stack([halves[:, 0], halves[:, 1], halves[:, 2] + (halves[:, 3] << 32)], 1)
        beyond = sums[ends[last_row + 1]] - sums[ends[last_row]] - listed(last_row, self.high[last_row], True)
        z_row = np.concatenate([self.gap_row, last_row])
        z_last = np.concatenate([self.gap_a, self.high[last_row]])
        z_next = np.concatenate([self.gap_b, np.full(len(last_row), np.inf)])
        until = np.concatenate([until, self.seen - beyond])
        order = np.lexsort((z_last, z_row))
        z_row, z_last, z_next, until = z_row[order], z_last[order], z_next[order], until[order]
        later = np.flatnonzero(z_row[1:] == z_row[:-1]) + 1  # zones behind another of the same row
        z_first = self.low[z_row]
        z_first[later] = z_next[later - 1]
        before = listed(z_row, z_first, False)
        begun = before.copy()
        begun[later] += until[later - 1] - before[later - 1]
        held = until - begun
        some = held[:, 0] > 0
        row, first, last = np.concatenate([row, z_row[some]]), np.concatenate([first, z_first[some]]), np.concatenate([first, z_last[some]])
        count, weight, name = (np.concatenate([c, held[some, k]]) for k, c in enumerate((count, weight, name)))
        order = np.lexsort((last, first, row))
        row, first, last = row[order], first[order], last[order]
        start = np.searchsorted(row, row)
        count, weight, name = (np.cumsum(c[order]) for c in (count, weight, name))
        count, weight, name = (c - np.append(0, c)[start] for c in (count, weight, name))
        following = np.append(np.where(row[1:] == row[:-1], first[1:], np.inf), np.inf)
        at = np.flatnonzero((following >= self.ratio * last) & (following > last) & (weight >= self.least))
        for s in range(0, len(at), 65536):
            i = at[s : s + 65536]
            yield row[i], name[i], count[i], np.sqrt(last[i])


def proposals(x, weight, name, rows, own: int, least: int, apart: float):
    """The beginnings of the order of distances of each of ``rows`` that end at a gap of ``apart`` and hold ``least`` records, none
    of them from behind the first ``own`` rows: (row, sum of the names within, rows within, squared width)."""
    heavy = weight.astype(np.int64)
    exact = x.astype(np.float64)
    step = max(1, 4_000_000 // len(x))
    for s in range(0, len(rows), step):
        some = rows[s : s + step]
        d = squared(exact[some], exact)
        d[np.arange(len(some)), some] = 0
        ranked = np.sort(d, axis=1)
        following = np.append(ranked[:, 1:], np.full((len(some), 1), np.inf), 1)
        # d is squared; a first outside row at 0 is one at 0 times the distance
        gap = (following >= apart * apart * ranked * (1 - 1e-12)) & (following > ranked)
        if least <= len(x):  # without copies the first rows cannot be enough
            gap[:, : max(0, least - int(heavy.max()) - 1 if heavy.max() == 1 else 0)] = False
        for i, k in zip(*np.nonzero(gap), strict=True):
            inside = d[i] <= ranked[i, k]
            if not inside[own:].any() and int(heavy[inside].sum()) >= least:
                yield int(some[i]), int(name[inside].sum()), int(inside.sum()), float(ranked[i, k])


def isolated(x, weight, own: int, least: int, apart: float):
    """The smallest isolated sets among the first ``own`` rows, the others being outside.

    A set is isolated if it has ``least`` records (rows with their copies) and if for every member whatever is outside lies at
    least ``apart`` times as far as any other member. Such a set is a beginning of the order of distances of each of its
    members, so every row proposes the beginnings of its own order that end at a wide enough gap, and a set is isolated if all
    its rows propose it. Isolated sets are nested or disjoint. Gives a label per row, -1 outside of all.
    """
    name = np.random.default_rng(1).integers(1, 2**62, len(x), dtype=np.int64)
    if own == len(x) > WHOLE_ORDERS:
        profiles = Profiles(np.arange(own), weight, name, x, own, least, apart)
        said = list(profiles.proposals())
    else:
        said = [tuple(np.array(c) for c in zip(*p, strict=True)) for p in (list(proposals(x, weight, name, np.arange(own), own, least, apart)),) if p]
        said = [(i, total, count, np.sqrt(width)) for i, total, count, width in said]
    label, used, found = np.full(own, -1, np.int64), np.zeros(own, bool), 0
    if not said:
        return label
    row, total, count, width = (np.concatenate(c) for c in zip(*said, strict=True))
    order = np.lexsort((row, total, count))
    row, total, count, width = row[order], total[order], count[order], width[order]
    starts = np.flatnonzero(np.append(True, (total[1:] != total[:-1]) | (count[1:] != count[:-1])))
    votes = np.diff(np.append(starts, len(row)))
    for s in starts[votes == count[starts]]:
        inside = row[s : s + count[s]]
        if not used[inside].any():
            label[inside] = found
            found += 1
        used[inside] = True
    return label


def bounds(x, seeds, apart: float):
    """How far from each row of x the other members at most lie of an isolated set that holds the row and none of the seeds: such a
    set keeps ``apart`` times its width from the nearest of them."""
    out = np.full(len(x), np.inf, np.float32)
    if not len(seeds):
        return out
    middle = seeds.mean(0)
    t = seeds - middle
    own = (t * t).sum(1)
    step = max(1, 4_000_000 // len(t))
    for s in range(0, len(x), step):
        y = x[s : s + step] - middle
        squares = (y * y).sum(1)
        d = (own[None, :] - 2 * (y @ t.T)).min(1) + squares
        out[s : s + step] = np.sqrt(np.maximum(d, 0) + 4e-6 * (squares + own.max())) / apart * (1 + 1e-5)
    return out


def mates(x, bound, y, other, same: bool = False):
    """Masks of the rows of x and of y that have one of the other within the bounds of both; itself does not count."""
    middle = x.mean(0)
    a, b = x - middle, y - middle
    squares, top = (a * a).sum(1), (b * b).sum(1)
    a = np.concatenate([-2 * a, squares[:, None], np.ones((len(a), 1), np.float32)], 1)
    b = np.concatenate([b, np.ones((len(b), 1), np.float32), top[:, None]], 1).T.copy()
    slack = 4e-6 * (squares + top.max(initial=0))
    mine, theirs = np.zeros(len(x), bool), np.zeros(len(y), bool)
    step = max(1, 4_000_000 // max(len(y), 1))
    for s in range(0, len(x), step):
        d = a[s : s + step] @ b
        r, c = np.nonzero(d <= (bound[s : s + step] ** 2 + slack[s : s + step])[:, None])
        keep = d[r, c] <= other[c] ** 2 + slack[r + s]
        if same:
            keep &= r + s != c
        mine[r[keep] + s] = True
        theirs[c[keep]] = True
    return mine, theirs
