"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases bottom-up. At each level, runs of one symbol become
one phrase, and the rest is cut by deterministic coin tossing: a symbol's label is
the place and value of the lowest bit in which it differs from its left neighbour;
two more rounds on the labels leave a handful of values, and phrases begin where
the label is a local minimum. A phrase's name depends on its symbols alone, so
equal substrings get equal names away from their ends, wherever they stand. The
fingerprint keeps the smallest hashed names of one fixed level, by which the share
of common names of two texts can be told.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.frames import SLICE_BYTES

#: Levels of phrases; a phrase of the last one spans about 20 characters.
LEVELS = 3
#: Names a fingerprint keeps, of 32 bits each.
KEPT = 128
#: Ranges of ids for each square root of the number of documents.
RANGES = 0.5

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing against the left neighbour; a text's first symbol keeps its lowest bit."""
    left = np.empty_like(labels)
    left[1:] = labels[:-1]
    left[0] = 0
    differ = labels ^ left
    low = differ & (~differ + np.uint64(1))
    # the place of the single bit that is left
    place = np.frexp(low.astype(np.float64))[1].astype(np.uint64) - np.uint64(1)
    out = place * np.uint64(2) + ((labels >> place) & np.uint64(1))
    out[first] = labels[first] & np.uint64(1)
    return out


def level(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level's phrases and the document of each; ``doc`` ascends."""
    # runs of one symbol are one symbol that knows its length
    new = np.empty(len(symbols), bool)
    new[0] = True
    new[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    if len(at) < len(symbols):
        length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
        symbols, doc = symbols[at], doc[at]
        symbols = np.where(length > 1, mix(symbols + length * np.uint64(0x9E3779B97F4A7C15)), symbols)
    first = np.empty(len(symbols), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    label = symbols
    for _ in range(3):  # 64 bits to below 128, below 14, below 8 values
        label = toss(label, first)
    # a phrase starts at a document's first symbol and at each local minimum of the labels
    start = first.copy()
    inner = np.zeros(len(symbols), bool)
    inner[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] <= label[2:])
    # neither the second nor the last symbol of a document starts one
    inner[1:] &= ~first[:-1]
    inner[:-1] &= ~first[1:]
    start |= inner & ~first
    at = np.flatnonzero(start)
    # a name is a polynomial in the phrase's symbols: prefix sums of symbol times power, made free of the place
    size = np.diff(np.append(at, len(symbols)))
    offset = np.arange(len(symbols)) - np.repeat(at, size)
    power = mix(offset.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    names = mix(np.add.reduceat(mix(symbols) * power, at) + size.astype(np.uint64))
    return names, doc[at]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text: ascending 32-bit names, at most KEPT; none for an empty text."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    out = [np.empty(0, np.uint32)] * len(texts)
    lengths = np.array([len(r) for r in raw], np.int64)
    if not lengths.sum():
        return out
    symbols = mix(np.concatenate(raw).astype(np.uint64) + np.uint64(1))
    doc = np.repeat(np.arange(len(texts)), lengths)
    for _ in range(LEVELS):
        symbols, doc = level(symbols, doc)
    names = (mix(symbols) >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for d, a, b in zip(doc[starts].tolist(), starts.tolist(), np.append(starts[1:], len(doc)).tolist()):
        own = np.sort(names[a:b])
        out[d] = own[np.append(True, own[1:] != own[:-1])][:KEPT]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common names that two fingerprints tell: of the smallest names of both together, those in both. Two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEPT]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def written(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprint_texts(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text as a hex string, empty for null and empty texts; a column named ``out`` is replaced."""
    from tieout.llm.frames import map_arrow

    rest = [f for f in df.schema.fields if f.name != out]

    def make():
        def work(batch: pa.RecordBatch):
            found = fingerprints([t or "" for t in batch.column(text).to_pylist()])
            return [*(batch.column(f.name) for f in rest), [written(x) for x in found]]

        return work

    return map_arrow(df, make, T.StructType([*rest, T.StructField(out, T.StringType())]), text)


def with_next(df: DataFrame, schema: T.StructType, work) -> DataFrame:
    """Run ``work(ids, texts, next_texts)`` over ``df`` (doc_id, text) in ascending doc_id, each text with the next one; the last with the first.

    Ranges of ids go to partitions of their own, sorted there and read as a
    stream, so a text moves once. The first row of a range goes to the range
    before as well. Both the number of ranges and the rows of one grow with the
    square root of the rows, so what is known of ranges stays small. Null ids come
    first; rows that share an id follow each other in the order of their texts'
    hashes. An empty table gives an empty result.
    """
    n = df.count()
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    parts = math.ceil(RANGES * math.sqrt(n))
    ranked = df.withColumn("k", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("rank", F.xxhash64("text"))
    # rows without an id lie below all ids, by their texts' hashes, so they take ranges of their own
    ranked = ranked.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-(2.0**65)) + F.col("rank").cast("double")))
    cuts = sorted(set(ranked.approxQuantile("at", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    if cuts:
        # a binary search; ids that one double stands for stay in one range
        ranked = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="range").transform(ranked)
    else:
        ranked = ranked.withColumn("range", F.lit(0))
    ranked = ranked.withColumn("range", F.col("range").cast("int"))
    heads = ranked.groupBy("range").agg(F.min(F.struct("k", "rank")).alias("head"))
    order = Window.orderBy("range")  # one row a range
    before = F.coalesce(F.lag("range").over(order), F.last("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("range", "head.k", "head.rank", before.alias("before"))
    sent = ranked.join(F.broadcast(heads), ["range", "k", "rank"], "left")
    # equal rows may all be heads; the first that comes ends the range before
    to = F.when(F.col("before").isNull(), F.array(F.struct("range", F.lit(False).alias("last")))).otherwise(F.array(F.struct("range", F.lit(False).alias("last")), F.struct(F.col("before").alias("range"), F.lit(True).alias("last"))))
    sent = sent.select("doc_id", "text", "rank", F.explode(to).alias("to")).select("doc_id", "text", "rank", "to.range", "to.last")
    sent = sent.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "last", "doc_id", "rank")
    arrow = pa.schema([pa.field(f.name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int | None, str] | None = None
        ids: list = []
        texts: list[str] = []
        nexts: list[str] = []
        held = 0
        for batch in batches:
            for doc_id, text, last in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "last"))):
                text = text or ""
                if waiting is not None:
                    ids.append(waiting[0])
                    texts.append(waiting[1])
                    nexts.append(text)
                    held += len(waiting[1])
                waiting = None if last else (doc_id, text)
                if held >= SLICE_BYTES // 4:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(work(ids, texts, nexts), arrow)], schema=arrow)
                    ids, texts, nexts, held = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(work(ids, texts, nexts), arrow)], schema=arrow)

    return sent.select("doc_id", "text", "last").mapInArrow(run, schema)


_OP9 = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]
)


def _edited(ids, texts, nexts):
    changed = []
    for a, b in zip(texts, nexts):
        half = len(a) // 2
        changed.append(a[: len(a) - half] + b[:half])
    # the next text is mostly the next one of the batch
    apart = [i for i, b in enumerate(nexts) if i + 1 == len(texts) or b is not texts[i + 1]]
    found = fingerprints([*texts, *changed, *(nexts[i] for i in apart)])
    own, edit = found[: len(texts)], found[len(texts) : 2 * len(texts)]
    follow = own[1:] + own[:1]
    for i, f in zip(apart, found[2 * len(texts) :]):
        follow[i] = f
    return [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        [written(x) for x in own],
        [written(x) for x in edit],
        [likeness(x, y) for x, y in zip(own, edit)],
        [likeness(x, y) for x, y in zip(own, follow)],
    ]


def op9_fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A null text counts as empty. A single row is its own next. Rows that share an id
    follow each other by their texts' hashes; null ids come first. An empty table
    gives an empty result.
    """
    return with_next(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _OP9, _edited)
