"""Byte-level BPE encoding and decoding by longest matches with backtracking.

The vocabulary's byte strings, mapped to Latin-1, form an Aho-Corasick automaton.
One pass over a pre-token gives the longest token at every position. The encoder
takes the longest token that fits its left neighbour, where two tokens fit if
merging their joint bytes alone gives back the same two; it falls back to shorter
tokens, or gives up the neighbour, where none fits. A sequence whose neighbours
all fit is the one that merging by rank gives. Fits are remembered.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tieout.llm.frames import map_arrow

#: Entries of each memo before it starts anew.
MEMO_PIECES = 1_000_000
MEMO_FITS = 500_000


class ByteBPE:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        size = max(self.ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.latin = latin_pattern(pattern)
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.matcher.add_word(token.decode("latin-1"), (len(token), rank))
        self.matcher.make_automaton()
        #: The next shorter token that starts a token, or -1.
        self.shorter = [-1] * size
        for token, rank in self.ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (found := self.ranks.get(token[:n])) is not None:
                    self.shorter[rank] = found
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merging by rank, step by step: the definition that ``fit`` rests on."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        known = self.fits.get(left << 32 | right)
        if known is None:
            if len(self.fits) >= MEMO_FITS:
                self.fits.clear()
            known = self.fits[left << 32 | right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        mapped = data.decode("latin-1")
        out = [rank for _, (_, rank) in self.matcher.iter_long(mapped)]
        fits, good = self.fits, 1
        for left, right in zip(out, out[1:]):
            known = fits.get(left << 32 | right)
            if not (self.fit(left, right) if known is None else known):
                break
            good += 1
        else:
            return out
        token = out[good]
        del out[good:]
        at, size = sum(len(self.bytes[t]) for t in out), len(data)
        # of the tokens that start at one place the longest comes last
        longest = {end + 1 - n: rank for end, (n, rank) in self.matcher.iter(mapped)}
        dead: set[int] = set()
        while True:
            end = at + len(self.bytes[token])
            if end not in dead and (not out or self.fit(out[-1], token)):
                out.append(token)
                if end == size:
                    return out
                at, token = end, longest[end]
                continue
            token = self.shorter[token]
            while token < 0:
                # nothing that starts here fits what stands before: no encoding passes this point by that way
                dead.add(at)
                last = out.pop()
                at -= len(self.bytes[last])
                token = self.shorter[last]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        pieces = (self.latin if BEYOND.search(text) is None else self.pattern).findall(text)
        known = self.pieces
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) >= MEMO_PIECES:
                known.clear()
            for piece in set(pieces).difference(known):
                coded = self.encode_bytes(piece.encode())
                known[piece] = struct.pack(f"<{len(coded)}I", *coded)
            return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


BEYOND = re.compile(r"[^\x00-\xff]")


def latin_pattern(pattern: str) -> re.Pattern:
    """The pattern with its classes written out for code points below 256, where ``re`` is exact and faster."""
    of = {k: "".join(f"\\x{c:02x}" for c in range(256) if regex.fullmatch(rf"\p{{{k}}}", chr(c))) for k in ("L", "N", "White_Space")}
    inner = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", lambda _: f"[^{of['White_Space']}{of['L']}{of['N']}]", pattern)
    for name, by in ((r"\p{L}", f"[{of['L']}]"), (r"\p{N}", f"[{of['N']}]"), (r"\s", f"[{of['White_Space']}]"), (r"\S", f"[^{of['White_Space']}]")):
        inner = inner.replace(name, by)
    return re.compile(inner)


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_ids(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian 32-bit integers) and ``decoded`` (the bytes they give back).

    Null texts count as empty and give empty binaries. Every row stays, repeated
    ones too; columns named like an output are replaced, others pass through.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rest = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*rest, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])

    def make():
        bpe = encoder(path)

        def work(batch: pa.RecordBatch):
            coded = [bpe.encode(t or "") for t in batch.column(text).to_pylist()]
            return [*(batch.column(f.name) for f in rest), coded, list(map(bpe.decode, coded))]

        return work

    return map_arrow(df, make, schema, text)


def encode_digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` without ``text``, with n_tokens and the digests of ids and decoded bytes: what leaves the worker is small."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = ("n_tokens", "ids_sha256", "decoded_sha256")
    rest = [f for f in df.schema.fields if f.name not in (text, *added)]
    schema = T.StructType([*rest, T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.StringType()) for n in added[1:])])

    def make():
        bpe = encoder(path)

        def work(batch: pa.RecordBatch):
            coded = [bpe.encode(t or "") for t in batch.column(text).to_pylist()]
            return [
                *(batch.column(f.name) for f in rest),
                [len(c) // 4 for c in coded],
                [hashlib.sha256(c).hexdigest() for c in coded],
                [hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded],
            ]

        return work

    return map_arrow(df, make, schema, text)


def op2_byte_bpe(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``df``.

    Null and empty texts give 0 tokens and the digests of nothing; rows of equal
    text are alike, repeated rows stay, null ids pass through. Of merges of equal
    rank the leftmost comes first, as in the library. An empty table gives an empty result.
    """
    return encode_digests(df.select("doc_id", "text"))
