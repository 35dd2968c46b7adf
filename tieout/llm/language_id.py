"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of bit masks holds a Bloom filter for every language: bit l of a slot
belongs to language l. Anding the masks at an n-gram's few slots returns all
languages that contain the n-gram. A text is scored by the share of its n-grams
each language contains, corrected for the filter's false positives; the largest
decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.frames import free_name, map_arrow, remainder, sampled, stored

#: Characters of an n-gram; words are padded by one blank.
GRAM = 4
#: Slots of a table for each n-gram in it, before the number becomes a power of two, and slots an n-gram has.
ROOM = 6
HASHES = 2
#: Languages a mask has bits for; more languages take more masks.
MASK = 64
#: Training rows at most (an about exact bound, chosen by a hash of the id).
TRAIN_ROWS = 30_000
#: An n-gram that is so much rarer in a language than in another counts as quoted from there and doesn't enter.
QUOTED = 0.02
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of anything but letters as one blank."""
    if text.isascii():
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        code, good = raw.astype(np.uint32), (raw >= 97) & (raw <= 122)
    else:
        low = text.lower()
        code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        good = (code >= 97) & (code <= 122)
        beyond = code > 127
        if beyond.any():
            kinds = np.unique(code[beyond])
            is_letter = np.fromiter((chr(c).isalpha() for c in kinds.tolist()), bool, len(kinds))
            good[beyond] = is_letter[np.searchsorted(kinds, code[beyond])]
    code = np.where(good, code, np.uint32(32))
    keep = good.copy()
    keep[1:] |= good[:-1]
    return code[keep]


def grams(text: str | None) -> np.ndarray:
    """64-bit names of all n-grams of a whole text, in order; none without a letter."""
    code = letters(text) if text else np.empty(0, np.uint32)
    if not (code != 32).any():
        return np.empty(0, np.uint64)
    code = np.concatenate([[32], code, [32]] if code[-1] != 32 else [[32], code]).astype(np.uint64)
    if len(code) < GRAM:
        code = np.concatenate([code, np.full(GRAM - len(code), 32, np.uint64)])
    n = len(code) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out * np.uint64(0x100000001B3) + code[i : i + n]
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def slot_bits(n_grams: int) -> int:
    """Bits of a slot's number in a table of so many n-grams."""
    return max(10, math.ceil(math.log2(max(1, n_grams) * ROOM)))


def slots(names: np.ndarray, bits: int) -> list[np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return [((names >> np.uint64(bits * i)) & low).astype(np.int64) for i in range(HASHES)]


def mask_kind(languages: int) -> type:
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if languages <= np.iinfo(t).bits)


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: list[np.ndarray]
    false_rate: np.ndarray

    @classmethod
    def over(cls, languages: list[str], tables: list[np.ndarray]) -> LanguageFilters:
        """Filters over finished tables, one for each MASK languages."""
        filled = []
        for start, masks in zip(range(0, len(languages), MASK), tables):
            filled += [np.count_nonzero(masks & masks.dtype.type(1 << b)) / len(masks) for b in range(min(MASK, len(languages) - start))]
        return cls(languages, tables, np.array(filled) ** HASHES)

    @classmethod
    def of(cls, languages: list[str], members: list[np.ndarray]) -> LanguageFilters:
        """Filters of n-grams at hand."""
        bits = slot_bits(len(np.unique(np.concatenate(members))) if members else 0)
        tables = []
        for start in range(0, len(languages), MASK):
            own = members[start : start + MASK]
            kind = mask_kind(len(own))
            masks = np.zeros(1 << bits, kind)
            for bit, names in enumerate(own):
                for at in slots(names, bits):
                    masks[np.unique(at)] |= kind(1 << bit)
            tables.append(masks)
        return cls.over(languages, tables)

    def containing(self, names: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the mask of the languages that contain it, table by table."""
        out = []
        for masks in self.masks:
            first, *rest = slots(names, len(masks).bit_length() - 1)
            found = masks[first]
            for at in rest:
                found &= masks[at]
            out.append(found)
        return out

    def shares(self, names: np.ndarray) -> np.ndarray:
        """For each language its corrected share of the n-grams."""
        hits: list[int] = []
        for found in self.containing(names):
            many = min(MASK, len(self.languages) - len(hits))
            if many <= 8:
                by_mask = np.bincount(found, minlength=256)
                hits += [int(by_mask[(np.arange(256) >> b & 1) == 1].sum()) for b in range(many)]
            else:
                hits += [np.count_nonzero(found & found.dtype.type(1 << b)) for b in range(many)]
        return np.clip((np.array(hits) / len(names) - self.false_rate) / (1 - self.false_rate), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        names = grams(text)
        if not len(names) or not self.languages:
            return UNKNOWN, 0.0
        share = self.shares(names)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = TRAIN_ROWS) -> LanguageFilters:
    """Filters from the rows of ``df`` with a language; at most about ``bound`` of them, chosen by a hash of the id.

    All n-grams of these rows enter, however rare, but those that fail the test of
    QUOTED: documents quote other languages. n-grams are counted in the workers and
    summed by a shuffle; what reaches the driver is the table, ROOM masks for each
    distinct n-gram of the bounded rows. No rows give filters that call every text
    unknown.
    """
    rows = sampled(df.where(F.col(lang).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")), bound, "id")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def make():
        def work(batch: pa.RecordBatch):
            own: dict[str, list[np.ndarray]] = {}
            for t, tag in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own.setdefault(tag, []).append(grams(t))
            counted = [(tag, *np.unique(np.concatenate(found), return_counts=True)) for tag, found in own.items()]
            tags = [tag for tag, names, _ in counted for _ in range(len(names))]
            join = [np.concatenate([c[i] for c in counted]) if counted else np.empty(0, np.int64) for i in (1, 2)]
            return [tags, pa.array(join[0].astype(np.uint64).view(np.int64)), pa.array(join[1].astype(np.int64))]

        return work

    counts = stored(map_arrow(rows, make, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters.over([], [])
    share = F.col("n") / F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("lang")]
    best = F.max("share").over(Window.partitionBy("gram"))
    found = counts.withColumn("share", share).withColumn("best", best).where(F.col("share") >= QUOTED * F.col("best")).select("lang", "gram")
    found = stored(found, "entering")
    bits = slot_bits(found.select("gram").distinct().count())
    tables = []
    for start in range(0, len(languages), MASK):
        own = languages[start : start + MASK]
        bit = F.create_map(*[F.lit(x) for i, tag in enumerate(own) for x in (tag, i)])[F.col("lang")]
        at = F.explode(F.array(*[F.shiftrightunsigned("gram", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(HASHES)]))
        filled = found.where(F.col("lang").isin(own)).select(at.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
        masks = np.zeros(1 << bits, mask_kind(len(own)))
        masks[filled["slot"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64).astype(masks.dtype)
        tables.append(masks)
    return LanguageFilters.over(languages, tables)


def identify(df: DataFrame, model: LanguageFilters, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its corrected share of the text's n-grams (0 to 1).

    A null text or one without a letter is ``und`` with score 0. Ties go to the
    first language in alphabetical order. Rows and other columns stay; columns
    named like an output are replaced.
    """
    rest = [f for f in df.schema.fields if f.name.lower() not in (lang.lower(), score.lower())]
    schema = T.StructType([*rest, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # a table that the training rows bound

    def make():
        filters = shared.value

        def work(batch: pa.RecordBatch):
            found = [filters.decide(t) for t in batch.column(text).to_pylist()]
            return [*(batch.column(f.name) for f in rest), [x[0] for x in found], [x[1] for x in found]]

        return work

    return map_arrow(df, make, schema, text)


def op7_language_id(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learnt from rows whose crc32(doc_id) mod 3 is not 1. An empty table gives an empty result."""
    held = remainder("doc_id", 3) == 1
    model = train(df.where(~held))
    return identify(df.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def keep_identified(df: DataFrame, least: float = 0.1) -> DataFrame:
    """The rows of ``df`` whose text is in one of the learnt languages: not ``und``, score at least ``least``; their columns stay as they are, an empty table stays empty."""
    held = remainder("doc_id", 3) == 1
    model = train(df.where(~held))
    lang, score = free_name(df, "lang_pred"), free_name(df, "score")
    found = identify(df, model, lang=lang, score=score)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
