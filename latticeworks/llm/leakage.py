"""Evaluation texts that leak into training text, found over a positional inverted index.

The index is sharded by document: a task turns its documents into postings, the positions at which each term of the
evaluation items stands, ordered by term. Term counts over all documents say which terms are rare. A passage with at most one
word in ten changed, dropped or added holds an unbroken run of six of its words (20 words, 2 changes, 3 runs), so the list of
the rarest word of every six-word window of an item is taken and intersected, position by position, with the lists of the
other five in order of rarity; what is left are exact phrase matches. Each is then extended in both directions, spending the
changes that the rule allows, which gives the proximity matches. No list of a frequent term is ever walked, no posting is
exchanged, and what is broadcast are the terms and windows of the items, whose size is checked.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Words that a passage must have, how many of them may differ, and the unbroken run that this guarantees.
PASSAGE, ONE_IN, RUN = 20, 10, 6
#: A closing sentence that this many items share is a stock instruction and no text of the item.
STOCK = 3
#: The most words that all items may have together; the windows of larger sets are searched in several passes.
ITEM_WORDS = 500_000

_HYPHEN_BREAK = re.compile(r"[-‐‑­][ \t]*(?:\r\n|\r|\n)[ \t>|*#]*")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>")
_REMOVED = dict.fromkeys([0x27, 0x2019, 0x2018, 0x2D, 0x2010, 0x2011, 0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0x5F, 0x2A, 0x60, 0x7E])
#: Letters of other scripts that look like Latin ones, and what they look like.
_ALIKE = dict(zip(map(ord, "аеорсухіјѕһԁвкмнтгαορνικτυχβε"), "aeopcyxijshdbkmhtraopviktuxbe", strict=True))
_OTHER = re.compile("[Ͱ-ӿ]")
_DELETE = b"'-_*`~"
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text without what does not count: case, marks, markup, hyphens and line breaks, character variants."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", text)
    if "-" in text or "\xad" in text or "\u2010" in text or "\u2011" in text:
        text = _HYPHEN_BREAK.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
        if _OTHER.search(text):
            text = " ".join(w.translate(_ALIKE) if re.search("[a-z]", w) else w for w in text.split(" "))
        text = text.translate(_REMOVED)
        if not text.isascii():
            text = "".join(c if c < "\x80" else "" if unicodedata.combining(c) else c if c.isalnum() else " " for c in text)
            if not text.isascii():
                return [w.encode() for w in re.findall(r"\w+", text)]
    return text.encode().translate(_TABLE, _DELETE).split()


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.?!;])\s+", text.strip()) if s]


class Items:
    """The evaluation items as term numbers. Neither nulls nor texts shorter than a passage can leak."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        import numpy as np

        texts = [(i, t) for i, t in sorted({(i, t) for i, t in rows if i is not None and t}) if words(t)]
        closing = Counter(tuple(words(sentences(t)[-1])) for _, t in texts)
        self.ids, parts = [], []
        for i, t in texts:
            own, last = words(t), words(sentences(t)[-1])
            # with nothing else, the sentence is the item's own text
            if closing[tuple(last)] >= STOCK and len(last) < len(own):
                own = own[: -len(last)]
            if len(own) >= PASSAGE:
                self.ids.append(i)
                parts.append(own)
        self.terms = {w: k + 1 for k, w in enumerate(sorted({w for p in parts for w in p}))}
        self.parts = [np.array([self.terms[w] for w in p], np.int32) for p in parts]

    def windows(self, counts: dict[int, int]):
        """Per distinct window: its terms, and the order of its places from the rarest term on. Also where each window stands."""
        import numpy as np

        stack = [np.lib.stride_tricks.sliding_window_view(p, RUN) for p in self.parts]
        if not stack:
            return np.zeros((0, RUN), np.int32), np.zeros((0, RUN), np.int8), [], []
        grams, inverse = np.unique(np.concatenate(stack), axis=0, return_inverse=True)
        df = np.zeros(len(self.terms) + 1, np.int64)
        for term, n in counts.items():
            df[term] = n
        order = np.argsort(df[grams], axis=1, kind="stable").astype(np.int8)
        item = np.concatenate([np.full(len(s), k) for k, s in enumerate(stack)])
        place = np.concatenate([np.arange(len(s)) for s in stack])
        by = np.argsort(inverse.ravel(), kind="stable")
        return grams, order, np.stack([item[by], place[by]], 1), np.searchsorted(inverse.ravel()[by], np.arange(len(grams) + 1))


def build_index(docs: DataFrame, terms: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, terms, positions``: where in each document terms of the items stand. Written once."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        number = sent.value.get
        for batch in batches:
            at, sizes, found, where = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = words(t)
                if len(w) < RUN:
                    continue
                ids = np.fromiter((number(x, 0) for x in w), np.int32, len(w))
                pos = np.flatnonzero(ids)
                if len(pos) >= RUN:
                    at.append(i)
                    sizes.append(len(w))
                    found.append(ids[pos])
                    where.append(pos.astype(np.int32))
            if at:
                ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (found, where)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(sizes, pa.int32()), *lists], names=[key, "n_words", "terms", "positions"])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_words int, terms array<int>, positions array<int>"
    return stage(docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, schema), "postings")


def _furthest(item, doc, changes: int) -> list[int]:
    """How many words of ``item`` a common beginning with ``doc`` covers with 0 to ``changes`` words changed, dropped or added."""
    n, m = len(item), len(doc)

    def slide(i: int, d: int) -> int:
        j = i + d
        while i < n and j < m and item[i] == doc[j]:
            i += 1
            j += 1
        return i

    reach = {0: slide(0, 0)}  # by diagonal, doc minus item
    out = [reach[0]]
    for _ in range(changes):
        new: dict[int, int] = {}
        for d, i in reach.items():
            for e, k in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # changed, dropped, added
                if k <= n and 0 <= k + e <= m and k > new.get(e, -1):
                    new[e] = k
        reach = {d: slide(i, d) for d, i in new.items()}
        # a change behind the last common word covers a word of the item as well, as long as the item has one
        out.append(max([out[-1], *reach.values()]))
    return out


def holds_passage(item, doc, a: int, b: int, length: int) -> bool:
    """Whether a passage around the common run item[a:a+length] = doc[b:b+length] satisfies the rule.

    It is enough to look for 20 words with 2 changes and for 30 words with 3: of a longer passage one half does as well.
    """
    if length >= PASSAGE:
        return True
    span = 2 * PASSAGE
    left = _furthest(item[max(0, a - span) : a][::-1], doc[max(0, b - span) : b][::-1], 3)
    right = _furthest(item[a + length : a + length + span], doc[b + length : b + length + span], 3)
    return any(left[i] + length + right[k - i] >= k * ONE_IN + (PASSAGE - 2 * ONE_IN) * (k == 2) and left[i] + length + right[k - i] >= PASSAGE for k in (0, 1, 2, 3) for i in range(k + 1))


def _search(terms, positions, sizes, parts, grams, order, stands, bounds, lists_of) -> list[tuple[int, int]]:
    """(document, item) of a shard: intersects posting lists from the rarest term on, then extends what is left."""
    import numpy as np

    # one row of places: each document's words at its own offset, with a gap that no passage spans
    offset = np.concatenate([[0], np.cumsum(sizes + 1)])
    counts = np.array([len(t) for t in terms])
    flat_terms = np.concatenate(terms)
    flat = np.concatenate(positions).astype(np.int64) + np.repeat(offset[:-1], counts)
    forward = np.zeros(int(offset[-1]) + RUN, np.int32)
    forward[flat] = flat_terms
    by_term = np.argsort(flat_terms, kind="stable")
    starts = np.searchsorted(flat_terms[by_term], np.arange(lists_of + 2))
    postings = flat[by_term]
    rarest = grams[np.arange(len(grams)), order[:, 0]]
    lengths = starts[rarest + 1] - starts[rarest]
    found = []
    live = np.flatnonzero(lengths)
    # windows are taken in groups, so that their lists fit in memory together
    limit, group, size = 2_000_000, [], 0
    for w in [*live.tolist(), None]:
        if w is None or size + lengths[w] > limit and group:
            if group:
                g = np.array(group)
                window = np.repeat(g, lengths[g])
                inner = np.arange(len(window)) - np.repeat(np.cumsum(lengths[g]) - lengths[g], lengths[g])
                at = postings[starts[rarest[window]] + inner] - order[window, 0]
                ok = at >= 0
                window, at = window[ok], at[ok]
                for k in range(1, RUN):
                    place = order[window, k]
                    ok = forward[at + place] == grams[window, place]
                    window, at = window[ok], at[ok]
                found.append((window, at))
            group, size = [], 0
        if w is not None:
            group.append(w)
            size += lengths[w]
    if not found:
        return []
    window, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    n = bounds[window + 1] - bounds[window]
    hit = np.repeat(np.arange(len(window)), n)
    stand = stands[np.repeat(bounds[window], n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)]
    at = at[hit]
    doc = np.searchsorted(offset, at, "right") - 1
    item, place = stand[:, 0], stand[:, 1]
    # windows that follow each other on one diagonal are one run
    diagonal = at - place
    by = np.lexsort((place, diagonal, item, doc))
    doc, item, place, diagonal, at = doc[by], item[by], place[by], diagonal[by], at[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(doc))) + RUN - 1
    out: dict[tuple[int, int], bool] = {}
    for f, size in sorted(zip(first.tolist(), length.tolist(), strict=True), key=lambda x: -x[1]):
        pair = int(doc[f]), int(item[f])
        if pair not in out:
            own = forward[offset[pair[0]] : offset[pair[0] + 1] - 1]
            if holds_passage(parts[pair[1]].tolist(), own.tolist() if size < PASSAGE else own, int(place[f]), int(at[f] - offset[pair[0]]), size):
                out[pair] = True
    return list(out)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item``: each document with each item of which it holds a passage.

    A passage is at least 20 consecutive words of the item, at most one in ten of them changed, dropped or added, also at its
    ends. Hyphenated words count as one. Null and empty texts and items of fewer words give nothing;
    repeated items count once; copies of a document each give their rows. Other columns are ignored. The items are the stated
    query set: their words are counted first, and more than ``ITEM_WORDS`` are refused; call once per part of such a set.
    """
    rows = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(item, item_text).distinct()
    held = rows.agg(F.sum(F.length(item_text))).first()[0] or 0
    if held > 8 * ITEM_WORDS:
        raise ValueError("too many evaluation items for one call; pass them in parts")
    known = Items([tuple(r) for r in rows.collect()])
    index = build_index(docs, known.terms, key, text)
    counts = {r["term"]: r["n"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast((known.ids, known.parts, len(known.terms), *known.windows(counts)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids, parts, n_terms, grams, order, stands, bounds = sent.value
        for batch in batches:
            if not batch.num_rows or not len(grams):
                continue
            lists = [[x.to_numpy() for x in _rows(batch.column(k))] for k in (2, 3)]
            pairs = _search(*lists, batch.column(1).to_numpy().astype(np.int64), parts, grams, order, stands, bounds, n_terms)
            if pairs:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for d, _ in pairs])), pa.array([ids[i] for _, i in pairs])], names=[key, item])

    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    return index.mapInArrow(run, f"`{key}` {kinds[0]}, `{item}` {kinds[1]}")


def _rows(lists) -> list:
    ends = lists.offsets.to_numpy()
    values = lists.values
    return [values.slice(a, b - a) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
