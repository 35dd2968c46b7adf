"""BPE encoding and decoding by an index of pair occurrences.

The pre-tokens of a slice of a partition that aren't known yet lie one after the
other in one array of symbols. An index maps each pair that has a rank to all its
positions in that array. Active ranks are applied in ascending order, each at all
its positions at once; a merge only touches the two pairs beside it, whose
positions are added to the lists of their ranks. Pre-tokens don't overlap, so a
rank that is the lowest of all is the lowest of each pre-token that has it, and
the result is the one of merging each pre-token by itself. What a pre-token comes
to is remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from tieout.llm.byte_bpe import BEYOND, latin_pattern
from tieout.llm.frames import map_arrow
from tieout.llm.token_count import NO_RANK, PairTable, byte_names

#: Characters of remembered pre-tokens before the memo starts anew.
MEMO_CHARS = 12_000_000
#: Characters that are letters, numbers, space and anything else by every version of Unicode in use.
STAND_INS = {"L": "文", "N": "٣", "S": "\u2003", "P": "☃"}


class PairBPE:
    """A byte-level BPE vocabulary with ordered merges and added tokens, as the tokenizers library reads it."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        ids, names = spec["model"]["vocab"], byte_names()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left, self.right, self.merged = ([ids[x] for x in side] for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.table = PairTable(*(np.array(x, np.int64) for x in (self.left, self.right, self.merged)))
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(zip(self.left, self.right)):
            self.ranks.setdefault(a << 32 | b, rank)
        self.symbols = np.array([ids[n] for n in names], np.int64)
        back = {n: b for b, n in enumerate(names)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in [*ids.items(), *added.items()]:
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.added = {token: np.array([i], "<i4").tobytes() for token, i in added.items()}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.latin = latin_pattern(pattern)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.settled: set[str] = set()
        self.odd: dict[int, str] = {}
        self.memo: dict[str, bytes] = {}
        self.held = 0

    # pre-tokens

    def _class(self, c: str) -> str:
        """The class that the library's own table of characters gives; tables differ in what newer versions of Unicode added."""
        return next((k for k, before in (("L", "a"), ("N", "1"), ("P", "!")) if len(self.library.pre_tokenize_str(before + c)) == 1), "S")

    def _settle(self, chars: set[str]) -> None:
        for c in chars:
            own = next((k for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\p{White_Space}")) if regex.fullmatch(p, c)), "P")
            if (theirs := self._class(c)) != own:
                self.odd[ord(c)] = STAND_INS[theirs]
        self.settled |= chars

    def _plain(self, text: str) -> list[str]:
        if BEYOND.search(text) is None:
            return self.latin.findall(text)
        chars = set(text)
        if fresh := chars - self.settled:
            self._settle(fresh)
        if self.odd and any(ord(c) in self.odd for c in chars):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.odd))]
        return self.pattern.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and added tokens of a text, in order."""
        if self.split is None or (parts := self.split.split(text))[1:] == []:
            return self._plain(text)
        return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else self._plain(part))]

    # merging

    def apply(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit integers) of each of ``pieces``, all merged together over one index of pairs."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.symbols[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(sizes)
        n = len(symbols)
        inside = np.ones(n, bool)
        inside[ends[sizes > 0] - 1] = False
        after = np.where(inside, np.arange(1, n + 1), -1)
        before = np.r_[-1, np.where(inside[:-1], np.arange(n - 1), -1)] if n else after
        at = np.flatnonzero(inside)
        rank = self.table.ranks[self.table.find(symbols[at], symbols[at + 1])]
        at, rank = at[rank != NO_RANK], rank[rank != NO_RANK]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else rank
        where = {r: x.tolist() for r, x in zip(rank[first].tolist(), np.split(at, first[1:]))} if len(rank) else {}
        active = list(where)
        heapq.heapify(active)
        sym, nxt, prv = symbols.tolist(), after.tolist(), before.tolist()
        ranks, left, right, merged = self.ranks, self.left, self.right, self.merged
        while active:
            r = heapq.heappop(active)
            a, b, new = left[r], right[r], merged[r]
            # of overlapping occurrences the leftmost comes first
            for i in sorted(where.pop(r)):
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # an earlier merge took one of the two
                k, p = nxt[j], prv[i]
                sym[i], sym[j], nxt[i] = new, -1, k
                if k >= 0:
                    prv[k] = i
                    if (q := ranks.get(new << 32 | sym[k])) is not None:
                        if q in where:
                            where[q].append(i)
                        else:
                            where[q] = [i]
                            heapq.heappush(active, q)
                if p >= 0 and (q := ranks.get(sym[p] << 32 | new)) is not None:
                    if q in where:
                        where[q].append(p)
                    else:
                        where[q] = [p]
                        heapq.heappush(active, q)
        left_over = np.array(sym, np.int64)
        stays = left_over >= 0
        ids = left_over[stays].astype("<i4").tobytes()
        cuts = (np.r_[0, np.cumsum(stays)][np.r_[0, ends]] * 4).tolist()
        return [ids[x:y] for x, y in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts = [self.pieces(t) for t in texts]
        fresh = list(set().union(*parts).difference(self.memo, self.added))
        if self.held > MEMO_CHARS:
            self.memo.clear()
            self.held, fresh = 0, list(set().union(*parts).difference(self.added))
        if not self.memo:
            self.memo.update(self.added)
        self.memo.update(zip(fresh, self.apply([p.encode() for p in fresh])))
        self.held += sum(map(len, fresh))
        return [b"".join(map(self.memo.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids, added tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> PairBPE:
    return PairBPE(path)


def _mapped(df: DataFrame, text: str, path: str | None, dropped: tuple[str, ...], added: list[T.StructField], columns) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    gone = {c.lower() for c in (*dropped, *(f.name for f in added))}
    rest = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType([*rest, *added])

    def make():
        bpe = encoder(path)

        def work(batch: pa.RecordBatch):
            coded = bpe.encode([t or "" for t in batch.column(text).to_pylist()])
            return [*(batch.column(f.name) for f in rest), *columns(bpe, coded)]

        return work

    return map_arrow(df, make, schema, text)


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` (array of int) and ``decoded`` (the text that they give back).

    Null texts count as empty: no ids, and the empty text. Strings of added tokens
    inside a text become those tokens; nothing is added, cut or padded. Every row
    stays, repeated ones too; columns named like an output are replaced, whatever
    their case, and others pass through.
    """
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]

    def columns(bpe: PairBPE, coded: list[bytes]):
        cuts = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32())
        return [pa.ListArray.from_arrays(pa.array(cuts), flat), list(map(bpe.decode, coded))]

    return _mapped(df, text, path, (), added, columns)


def encode_digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` without ``text``, with n_tokens and the digests of ids and decoded text: what leaves the worker is small."""
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def columns(bpe: PairBPE, coded: list[bytes]):
        return [
            [len(c) // 4 for c in coded],
            [hashlib.sha256(",".join(map(str, np.frombuffer(c, "<i4").tolist())).encode()).hexdigest() for c in coded],
            [hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded],
        ]

    return _mapped(df, text, path, (text,), added, columns)


def op13_pair_bpe(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``df``.

    Null and empty texts give 0 tokens and the digests of nothing; rows of equal
    text are alike, repeated rows stay, null ids pass through. Of overlapping
    occurrences of a pair the leftmost is merged, as in the library. Memory
    follows a slice of about 4 MB of texts, or one text where it is longer. An
    empty table gives an empty result.
    """
    return encode_digests(df.select("doc_id", "text"))
