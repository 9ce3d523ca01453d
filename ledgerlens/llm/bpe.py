"""Byte-level BPE encoding and decoding in linear time.

The bytes of a piece are read as Latin-1 and one Aho-Corasick pass gives the longest vocabulary entry at every place.
An encoding is then a path of tokens in which every neighbouring pair is compatible: merging the two tokens' bytes
greedily gives just these two tokens. Compatibility is memoised. The search starts from the longest match, falls back to
shorter ones, and marks places from which no path goes on, so each place is given up once at most: the result is the
one greedy merging would give. The reasoning follows the published backtracking encoders for BPE.

Defined cases: null text is empty and has no tokens; special tokens' strings are ordinary text; any rows, repeated ids
included, are encoded one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import regex
from pyspark.sql import DataFrame

from ledgerlens.llm import common

#: Pieces that are remembered, and the longest one that is.
CACHE, CACHED_BYTES = 600_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Pieces(dict):
    """Packed ids by piece, for at most ``CACHE`` pieces at a time."""

    def __init__(self, coder: Encoder) -> None:
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        packed = self.coder.pack(piece)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """Encodes pieces of text; one for each task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick

        self.find = regex.compile(pattern).findall
        self.rank = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)
        self.table = np.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], object)

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``; a single byte is itself twice."""
        if (found := self.parts.get(token)) is None:
            parts = [self.rank[b] for b in (bytes([x]) for x in self.bytes_of[token])]
            while len(parts) > 2:
                best, at = min((self.rank.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best >= token:
                    break
                parts[at : at + 2] = [best]
            found = self.parts[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging never joins bytes across the border of these tokens."""
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._undisturbed(left, right)
        return known

    def _undisturbed(self, left: int, right: int) -> bool:
        # Merges made so far all have ranks below ``bound``. Undo the later merge of the two sides until only bytes meet.
        bound = 1 << 60
        while True:
            across = self.rank.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < bound:
                return False
            a, b = self.split(left), self.split(right)
            can_left, can_right = a[1] != left, b[0] != right
            if not can_left and not can_right:
                return True
            if can_left and (left > right or not can_right):
                bound, left = min(bound, left), a[1]
            else:
                bound, right = min(bound, right + 1), b[0]

    def shorter(self, token: bytes) -> bytes | None:
        """The longest proper prefix that is a token."""
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in self.rank:
                return token[:n]
        return None

    def encode_bytes(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        latin = piece.decode("latin-1")

        def longest(place: int) -> bytes | None:
            """Every byte is a token, so the leftmost longest match from ``place`` starts there."""
            return next(self.automaton.iter_long(latin, place), (0, None))[1] if place < len(latin) else None

        path: list[bytes] = []
        dead, at, trying = set(), 0, longest(0)
        while at < len(piece):
            while trying is not None and (at + len(trying) in dead or path and not self.compatible(self.rank[path[-1]], self.rank[trying])):
                trying = self.shorter(trying)
            if trying is not None:
                path.append(trying)
                at += len(trying)
                trying = longest(at)
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                trying = path.pop()
                at -= len(trying)
                trying = self.shorter(trying)
        return [self.rank[t] for t in path]

    def pack(self, piece: str) -> bytes:
        ids = self.encode_bytes(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of ``text``, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(self.table[np.frombuffer(packed, "<u4")].tolist())


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with packed token ids of ``text_col`` in the binary column ``ids_col``."""
    return _mapped(df, ranks, pattern, text_col, f"{ids_col} binary", lambda coder, text: {ids_col: coder.encode(text)})


def encode_digest(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256: each text is encoded, and its ids are decoded again."""

    def both(coder: Encoder, text: str) -> dict:
        packed = coder.encode(text)
        return {"n_tokens": len(packed) // 4, "ids_sha256": hashlib.sha256(packed).hexdigest(), "decoded_sha256": hashlib.sha256(coder.decode(packed)).hexdigest()}

    return _mapped(df.select(*keep, text_col), ranks, pattern, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", both, keep)


def _mapped(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str, added: str, make, keep: tuple[str, ...] | None = None) -> DataFrame:
    keep = tuple(df.columns) if keep is None else keep
    sent = df.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary file
    names = [x.split()[0] for x in added.split(", ")]
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep if c not in names)

    def each():
        coder = Encoder(sent.value, pattern)

        def work(columns: dict[str, list]) -> dict[str, list]:
            rows = [make(coder, t or "") for t in columns[text_col]]
            return columns | {n: [r[n] for r in rows] for n in names}

        return work

    return common.map_rows(df.select(*dict.fromkeys((*keep, text_col))), f"{kept}, {added}", each)


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of an installed public vocabulary."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of packed ids in ``out_col``; null ids give null."""
    sent = df.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})

    def each():
        token = sent.value.__getitem__

        def work(columns: dict[str, list]) -> dict[str, list]:
            return columns | {out_col: [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in columns[ids_col]]}

        return work

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out_col)
    return common.map_rows(df, f"{kept}, `{out_col}` binary", each)


__all__ = ["Encoder", "decode", "encode", "encode_digest", "public_ranks", "read_ranks"]
