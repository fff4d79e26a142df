"""Splitting oversized texts at natural boundaries.

Prefix sums of the tokens of each pre-token give the token offset of every possible cut; the cuts of each kind (paragraph,
line, sentence, word, pre-token) stand in a sorted array, and a binary search finds the last one under the limit. The next
piece steps back by the overlap. Where no cut lies within the limit, the piece ends hard, at a character.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .tokens import VOCABULARY, codec

KINDS = ("paragraph", "line", "sentence", "word", "part", "hard", "end")
_SENTENCE_END = ".!?…。！？;:"
_CLOSING = "\"')]}»”’"


def cut_kinds(text: str, ends):
    """The kind of the cut behind each pre-token (0 paragraph to 4 part), for pre-tokens that end at ``ends``.

    What counts is the run of blanks around the cut: two line ends make a paragraph, one a line, blanks behind a sentence mark
    (perhaps closed by a bracket or quote) a sentence, other blanks a word. Of the cuts in one run only the last has its kind,
    the ones before it are parts, so that a piece does not begin with what is left of a gap.
    """
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = codes < 0x2100
    blank = np.zeros(len(codes), bool)
    for c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, 0x2028, 0x2029):
        blank |= codes == c
    blank |= small & (codes >= 0x2000) & (codes <= 0x200A)
    # \r\n is one line end
    line = (codes == 0x0A) | (codes == 0x2028) | (codes == 0x85) | ((codes == 0x0D) & ~np.append(codes[1:] == 0x0A, False))
    paragraph = codes == 0x2029
    n = len(codes)
    where = np.arange(n)
    before = np.maximum.accumulate(np.where(~blank, where, -1))  # last character that is no blank, up to each
    after = np.minimum.accumulate(np.where(~blank, where, n)[::-1])[::-1]  # the next one
    lines = np.concatenate([[0], np.cumsum(line + 2 * paragraph)])
    left = before[ends - 1]
    right = np.append(after, n)[np.minimum(ends, n)]
    breaks = lines[right] - lines[left + 1]
    marks = np.isin(codes, np.array([ord(c) for c in _SENTENCE_END], np.uint32))
    closing = np.isin(codes, np.array([ord(c) for c in _CLOSING], np.uint32))
    at = np.maximum(left, 0)
    inner = np.maximum(at - 1, 0)
    ended = (left >= 0) & (marks[at] | (closing[at] & marks[inner]))
    gap = right > left + 1
    kind = np.where(~gap, 4, np.where(breaks >= 2, 0, np.where(breaks == 1, 1, np.where(ended, 2, 3))))
    last = np.append(right[1:] != right[:-1], True)
    return np.where(last | (kind == 4), kind, 4)


def cut_points(tokens, kinds, limit: int, overlap: int, hard) -> list[tuple[int, int, int]]:
    """(first token, end token, kind) of each piece of a text whose pre-tokens end at the token offsets ``tokens``.

    A piece takes the coarsest kind that has a cut in the upper half of its room, else the coarsest with any cut that leaves
    more than the overlap; the last cut of that kind is taken. ``hard(i)`` gives the last token offset at or below i where a
    character ends.
    """
    import numpy as np

    total = int(tokens[-1])
    by_kind = [tokens[kinds <= k] for k in range(5)]
    pieces, start = [], 0
    while total - start > limit:
        room, half, least = start + limit, start + limit // 2, start + overlap
        found = None
        for low in (half, least):
            for k, at in enumerate(by_kind):
                p = int(np.searchsorted(at, room, "right")) - 1
                if p >= 0 and at[p] > low:
                    found = int(at[p]), k
                    break
            if found:
                break
        if not found:
            found = hard(room), 5
            if found[0] <= least:  # a single character of more tokens than that
                found = room, 5
        pieces.append((start, *found))
        start = found[0] - overlap
    pieces.append((start, total, 6))
    return pieces


def split_texts(df: DataFrame, limit: int = 512, overlap: int = 32, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, with_text: bool = False) -> DataFrame:
    """``key, piece, first_token, end_token, first_char, end_char, cut``: the pieces of every text, in order from 0; with
    ``with_text`` also ``piece_text``.

    A piece has at most ``limit`` tokens and consecutive ones share exactly ``overlap``. A text within the limit is one piece;
    the null and the empty text are one piece of no tokens. Characters are numbered by code point from 0; a piece that begins
    within a character begins with that character. Every row is split by itself, repeated keys too; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codes = codec(vocabulary)
        lengths = codes.token_bytes()
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    at.append(i)
                    rows.append((0, 0, 0, 0, 0, 6))
                    continue
                # a token covers a byte at least
                words = codes.pretokens(t)
                packed = list(map(codes.packed.__getitem__, words))
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                total = int(sizes.sum())
                if total <= limit:
                    at.append(i)
                    rows.append((0, 0, total, 0, len(t), 6))
                    continue
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
                offsets = np.cumsum(sizes)
                kinds = cut_kinds(t, ends)
                raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                begins = np.append((raw & 0xC0) != 0x80, True)  # bytes at which a character begins
                chars = np.cumsum(begins) - 1
                bytes_at = np.concatenate([[0], np.cumsum(lengths[np.frombuffer(b"".join(packed), np.int32)])])

                def hard(token: int, bytes_at=bytes_at, begins=begins) -> int:
                    while token > 0 and not begins[bytes_at[token]]:
                        token -= 1
                    return token

                for k, (a, b, kind) in enumerate(cut_points(offsets, kinds, limit, overlap, hard)):
                    at.append(i)
                    rows.append((k, a, b, int(chars[bytes_at[a]]), int(chars[bytes_at[b]]), kind))
            if at:
                cols = list(zip(*rows, strict=True))
                out = [batch.column(0).take(pa.array(at)), *[pa.array(c, pa.int32()) for c in cols[:5]], pa.array([KINDS[c] for c in cols[5]], pa.string())]
                if with_text:
                    texts = [batch.column(1)[i].as_py() or "" for i in range(batch.num_rows)]
                    out.append(pa.array([texts[i][a:b] for i, a, b in zip(at, cols[3], cols[4], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[key, "piece", "first_token", "end_token", "first_char", "end_char", "cut", "piece_text"][: len(out)])

    schema = f"`{key}` {dict(df.dtypes)[key]}, piece int, first_token int, end_token int, first_char int, end_char int, cut string" + (", piece_text string" if with_text else "")
    return df.select(key, text).mapInArrow(run, schema)


def oversized(df: DataFrame, limit: int = 512, overlap: int = 32, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` of the texts that were cut: those with a second piece."""
    return split_texts(df, limit, overlap, key, text, vocabulary).where("piece = 1").select(key)
