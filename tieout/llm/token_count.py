"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged array of symbol ids. In each round
every unfinished sequence applies its own lowest-rank pair, all sequences at
once; what survives when no pair has a rank is counted. White space separates
pre-tokens in this vocabulary, so a text's count is the sum over its
white-space chunks, and chunks already counted are looked up.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.frames import map_arrow

#: Chunks whose counts a worker remembers before it starts anew.
MEMO_CHUNKS = 400_000
NO_RANK = np.int64(1) << 40


class PairTable:
    """Pairs of symbol ids to (rank, merged id): open addressing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int64)
        self.merged = np.zeros(size, np.int64)
        keys = left.astype(np.int64) << 32 | right
        slots = self._slot(keys)
        for rank, (key, slot, new) in enumerate(zip(keys.tolist(), slots.tolist(), merged.tolist())):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & (size - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, new

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a slot without a rank where there is none."""
        keys = left << 32 | right
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            open_ = open_[(seen != keys[open_]) & (seen != -1)]
        return slot


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """Symbols left in each sequence after all merges."""
    out = lengths.astype(np.int64).copy()
    which = np.flatnonzero(out > 1)
    seq = np.repeat(np.arange(len(out)), out)
    keep = out[seq] > 1
    symbols, seq = symbols[keep].astype(np.int64), seq[keep]
    while len(symbols):
        # a pair starts at every symbol but the last of its sequence
        inside = np.empty(len(seq), bool)
        inside[-1] = False
        np.equal(seq[:-1], seq[1:], out=inside[:-1])
        rank = np.full(len(seq), NO_RANK, np.int64)
        at = np.flatnonzero(inside)
        slot = table.find(symbols[at], symbols[at + 1])
        rank[at] = table.ranks[slot]
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(seq)])
        done = best == NO_RANK
        out[seq[starts[done]]] = sizes[done]
        hit = rank == np.repeat(np.where(done, -1, best), sizes)
        merged = np.zeros(len(seq), np.int64)
        merged[at] = table.merged[slot]
        # in a run of overlapping equal pairs every second one applies, from the left
        pos = np.flatnonzero(hit)
        run = np.flatnonzero(np.r_[True, np.diff(pos) > 1]) if len(pos) else pos
        if len(run) < len(pos):
            offset = np.arange(len(pos)) - np.repeat(run, np.diff(np.r_[run, len(pos)]))
            pos = pos[offset % 2 == 0]
        symbols[pos] = merged[pos]
        gone = np.zeros(len(seq), bool)
        gone[pos + 1] = True
        left = sizes - np.add.reduceat(gone, starts)
        over = left == 1
        out[seq[starts[over & ~done]]] = 1
        stay = ~gone & ~np.repeat(done | over, sizes)
        symbols, seq = symbols[stay], seq[stay]
    del which
    return out


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, as the tokenizers library reads it."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, ids = spec["model"], spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = PairTable(
            np.array([ids[a] for a, _ in pairs], np.int64), np.array([ids[b] for _, b in pairs], np.int64), np.array([ids[a + b] for a, b in pairs], np.int64)
        )
        names = byte_names()
        end = model["end_of_word_suffix"] or ""
        self.inner = np.array([ids[names[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[names[b] + end] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", r"\p{White_Space}"))
        self.memo: dict[str, int] = {}

    def chunks(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            # one character at a time, so no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.split() if ODD_SPACE.search(text) is None else WHITE.split(text)

    def learn(self, chunks: list[str]) -> None:
        """Count the tokens of chunks that the memo lacks."""
        pieces, owner = [], []
        for i, chunk in enumerate(chunks):
            found = [chunk] if chunk.isascii() and chunk.isalpha() else self.words.findall(chunk)
            pieces += found
            owner += [i] * len(found)
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        counts = np.bincount(np.array(owner, np.int64), weights=merge_all(symbols, lengths, self.table), minlength=len(chunks)) if raw else np.zeros(len(chunks))
        self.memo.update(zip(chunks, counts.astype(np.int64).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        parts: list[list[str]] = []
        extra = [0] * len(texts)
        for i, text in enumerate(texts):
            if self.special_split is not None and "<|" in text and (found := self.special_split.split(text))[1:]:
                extra[i] = len(found) // 2
                parts.append([c for piece in found[::2] for c in self.chunks(piece)])
            else:
                parts.append(self.chunks(text))
        if len(self.memo) > MEMO_CHUNKS:
            self.memo.clear()
        fresh = set().union(*parts).difference(self.memo)
        if fresh:
            self.learn(list(fresh))
        get = self.memo.__getitem__
        return [n + sum(map(get, p)) for n, p in zip(extra, parts)]


ODD_SPACE = re.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")


def byte_names() -> list[str]:
    """Byte-level alphabets write a printable Latin-1 byte as itself and the others, in order, from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_counts(df: DataFrame, text: str = "text", path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``df`` with ``out``, the tokens of each whole ``text`` (null counts as empty: 0 tokens).

    Every row stays, repeated rows too; other columns pass through. A column
    already named ``out`` is replaced. Special strings in a text count one each,
    as the library takes them; nothing is added, cut or padded.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    rest = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*rest, T.StructField(out, T.LongType())])

    def make():
        vocab = vocabulary(path)

        def work(batch: pa.RecordBatch):
            counts = vocab.count(["" if t is None else t for t in batch.column(text).to_pylist()])
            return [*(batch.column(f.name) for f in rest), counts]

        return work

    return map_arrow(df, make, schema, text)


def op1_token_counts(df: DataFrame, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``df``.

    Null and empty texts have 0 of both; rows of equal text count alike, repeated
    rows stay, null ids pass through. An empty table gives an empty result.
    """
    thin = df.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts(thin).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
