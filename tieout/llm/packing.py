"""Variable-capacity best-fit packing of documents into training sequences.

Pieces, longest first, go to the open bin that they leave the least room in.
Where none fits, a bin is opened. For each permitted length it is worked out what the
pieces that are left would fill such a bin with, and the length it would shrink to;
the one that costs least for each token is opened, so all lengths are weighed
together. At the end each bin shrinks to the least permitted length that holds what
it got.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.frames import stored
from tieout.llm.token_count import token_counts

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence of c tokens: a fixed part, c, and a part that grows with its square.
FIXED, SQUARE = 64.0, 1 / 65536
#: Pieces that are packed together, about.
SHARD_PIECES = 40_000


def cost(length: int) -> float:
    return FIXED + length + SQUARE * length * length


def filling(room: int, many: np.ndarray, have: int) -> int:
    """Tokens that pieces of the sizes left, largest first, fill of ``room``; ``many`` counts sizes and bit n of ``have`` tells that there are some of size n."""
    left = room
    while left > 0 and (fits := have & ((1 << left + 1) - 1)):
        n = fits.bit_length() - 1
        left -= n * min(int(many[n]), left // n)
        have &= (1 << n) - 1
    return room - left


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, its final length) of each size; sizes are positive and at most the largest length. Ties go to the earlier piece and the lesser length."""
    ladder = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: dict[int, list[int]] = {}
    free = 0  # bit r is set if some open bin has r tokens left
    left_over: list[int] = []
    opened: list[int] = []
    many = np.bincount(sizes, minlength=ladder[-1] + 1)
    have = sum(1 << n for n in np.flatnonzero(many).tolist())
    for i in order.tolist():
        n = int(sizes[i])
        many[n] -= 1
        if not many[n]:
            have &= ~(1 << n)
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            own = room[r]
            b = own.pop()
            if not own:
                free &= ~(1 << r)
        else:
            rates = []
            for c in ladder[bisect_left(ladder, n) :]:
                full = n + filling(c - n, many, have)
                rates.append((cost(ladder[bisect_left(ladder, full)]) / full, c))
            r = min(rates)[1]
            b = len(opened)
            opened.append(r)
            left_over.append(r)
        bins[i], offsets[i] = b, opened[b] - r
        left_over[b] = r - n
        room.setdefault(r - n, []).append(b)
        free |= 1 << (r - n)
    filled = np.array(opened, np.int64) - np.array(left_over, np.int64)
    steps = np.array(ladder, np.int64)
    return bins, offsets, steps[np.searchsorted(steps, filled)][bins] if len(opened) else bins


def pack_documents(df: DataFrame, tokens: str = "n_tokens", lengths: tuple[int, ...] = LENGTHS, spread: str | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, bin_length, bin_offset): where each piece of each row of ``df`` goes.

    A document longer than the largest length is cut into pieces of that length
    and a rest; pieces count from 0. A row without tokens (0 or null) has one
    piece of 0 tokens and no bin. Rows are dealt by a hash of the column
    ``spread``, or of the id where none is named, over shards that are packed apart, so the
    memory a task takes is bounded; a bin holds pieces of one shard. Repeated rows
    are packed each. An empty table gives an empty result.
    """
    top = max(lengths)
    n = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    spot = F.xxhash64(spread or "doc_id")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), spot.alias("spot"))
    pieces = rows.select("doc_id", "n", "spot", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / top) - 1))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("n_tokens"), F.xxhash64("spot", "piece").alias("spot"))
    pieces = stored(pieces, "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "piece", "n_tokens", "bin_id", "bin_length", "bin_offset")])
    arrow = pa.schema([(f.name, pa.int64()) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sizes = table.column("n_tokens").to_numpy()
            some = np.flatnonzero(sizes > 0)
            packed = pack(sizes[some], lengths)
            out = []
            for values in (packed[0] + (now << 32), packed[2], packed[1]):
                column = np.zeros(len(sizes), np.int64)
                column[some] = values
                out.append(pa.array(column, mask=sizes <= 0))
            return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("doc_id", "piece", "n_tokens")), *out], schema=arrow)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    if held and shard[a] != now:
                        yield close()
                        held = []
                    now = int(shard[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield close()

    dealt = pieces.withColumn("shard", F.pmod("spot", F.lit(shards)))
    # the order within a shard is fixed, so a lost task packs alike when it runs again
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "spot", "doc_id", "piece").mapInArrow(run, schema)


def pack_texts(df: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """``pack_documents`` over the token counts of whole texts."""
    counted = token_counts(df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("spot")))
    return pack_documents(counted.drop("text"), lengths=lengths, spread="spot")


def op5_best_fit_packing(df: DataFrame) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, bin_length, bin_offset for every piece of every row.

    Null and empty texts have one piece of 0 tokens without a bin; repeated rows
    are packed each. An empty table gives an empty result.
    """
    return pack_texts(df)
