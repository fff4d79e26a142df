"""A public byte-level BPE vocabulary run by sentencepiece.

``byte_bpe_50k`` comes as ranks. The sentencepiece model is serialised here, byte by byte, from those ranks: every token is a
piece whose bytes are mapped to printable characters, its score is the negative rank, and normalisation is the identity. BPE
in sentencepiece joins the best-scored neighbours first and the leftmost of equals, which is how ranks are applied, so the
pieces of a pre-token are its tokens. Texts are cut into pre-tokens by the vocabulary's own pattern; decoding maps pieces back.
Nothing is trained and no vocabulary file is copied: its path is a parameter.
"""

from __future__ import annotations

import base64
import re
import struct

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which texts of this vocabulary are cut into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts for texts in which letters, digits and blanks are those of ASCII or Latin letters; see ``_ODD``.
_PLAIN = re.compile(r" ?[^\W\d_]+| ?[0-9]+|'(?:[sdmt]|ll|ve|re)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[sdmt]|ll|ve|re)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Characters whose class the standard library may see differently: control separators and all beyond Latin letters and common marks.
_ODD = re.compile("[\x1c-\x1f\x80-\xa0²³¹¼-¾ɐ-‑―-‗‛„-‥‧-\U0010ffff]")
#: Pre-tokens whose ids a worker remembers; beyond it the memory starts anew.
MEMORY = 200_000
#: A pre-token longer than this is not remembered.
_LONG = 64


def printable() -> list[str]:
    """A printable character for each byte: itself where it has a visible form in Latin-1, else one from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for byte in range(256):
        out.append(chr(byte if byte in shown else spare))
        spare += byte not in shown
    return out


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol buffer field: a varint, a 32-bit float or a length-delimited value."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a byte-level BPE vocabulary; piece k is the token of rank k."""
    shown = printable()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(shown[b] for b in t).encode()) + _field(2, -float(k)) + _field(3, normal)) for k, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, -1e9) + _field(3, unknown)))
    trainer = _field(2, _field(3, bpe) + _field(4, len(pieces)))
    # name; no dummy prefix, no removal and no escaping of blanks
    normaliser = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + normaliser


class Codec:
    """Encodes and decodes texts. One of each vocabulary is kept per Python worker; see ``codec``."""

    def __init__(self, path: str = VOCABULARY):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.whole = regex.compile(PATTERN)
        self.shown = dict(enumerate(printable()))
        self.back = {c: b for b, c in self.shown.items()}
        self.size = len(ranks)
        self.packed: dict[str, bytes] = _Memory(self)

    def pretokens(self, text: str) -> list[str]:
        if text.isascii():
            if not _ODD.search(text):
                return _ASCII.findall(text)
        elif not _ODD.search(text):
            return _PLAIN.findall(text)
        return self.whole.findall(text)

    def of_pretoken(self, word: str) -> list[int]:
        return self.model.encode(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("i").tolist()

    def encode_packed(self, text: str) -> bytes:
        """The ids as 32-bit integers of this machine."""
        return b"".join(map(self.packed.__getitem__, self.pretokens(text)))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: list[int]) -> bytes:
        return bytes(self.back[c] for i in ids for c in self.model.id_to_piece(int(i)))

    def token_bytes(self):
        """The number of bytes of each token."""
        import numpy as np

        return np.array([len(self.model.id_to_piece(k)) for k in range(self.size)], np.int32)


class _Memory(dict):
    """Packed ids by pre-token, worked out when first met."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        ids = self.codec.of_pretoken(word)
        packed = struct.pack(f"={len(ids)}i", *ids)
        if len(word) <= _LONG:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = packed
        return packed


_codecs: dict[str, Codec] = {}


def codec(path: str = VOCABULARY) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]
