"""Keys that stand inside free text: containment measured and published as a column."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.operators.profile import text_key_stats

# Fixed values of the containment rules.
MIN_CARRIER_ROWS = 5
MIN_CONTAINMENT = 0.5
MIN_KEY_CHARS = 4
MIN_NUMERIC_KEY_CHARS = 6
ALREADY_JOINED = 0.25


def usable_key(df: DataFrame, key: str) -> bool:
    """Whether a key's values are long enough to be found in text without chance hits."""
    s = text_key_stats(df, key).first()
    return bool(s.n) and s.min_length >= (MIN_NUMERIC_KEY_CHARS if s.all_digits else MIN_KEY_CHARS)


def literal_overlap(carrier: DataFrame, text: str, keys: DataFrame, key: str) -> DataFrame:
    """(shared, total): distinct carrier values that equal a key, and all; a quarter or more is an ordinary join."""
    values = carrier.select(F.trim(text).alias("v")).where("v <> ''").distinct()
    k = keys.select(F.trim(F.col(key).cast("string")).alias("v")).where("v <> ''").distinct()
    return values.join(k.withColumn("hit", F.lit(1)), "v", "left").agg(F.count("hit").alias("shared"), F.count("*").alias("total"))


#: Fewest characters of an anchor where a key has more.
ANCHOR_CHARS = 16
#: Most characters of an anchor.
WIDE_CHARS = 64
#: Bytes of a text that are cut at a time, at least; what is looked at carries such a piece and the one before it.
STRETCH = 256
#: Words of 64 bits at most that say which anchors and ends there are; beyond what they can tell apart, more places go to the join.
MOST_WORDS = 1 << 20

_FOUND = "text_id int, row_id bigint, key_id int, n_keys bigint, found_key string"


def as_bytes(column: str) -> Column:
    """A string with a character for each of its bytes."""
    return F.decode(F.col(column).cast("binary"), "ISO-8859-1")


def grid(shortest: int, n_keys: int) -> tuple[int, int]:
    """(step, width): anchors of so many characters are looked up at every step-th place of a text.

    The last ``shortest`` characters of a key hold an anchor wherever the grid lies. A longer
    step means fewer places, but as many anchors a key and as many ends to try where one is met
    by chance, so that the bits needed grow with its square (``contained``).
    """
    step = max(1, min((shortest + 1) // 2, shortest - ANCHOR_CHARS + 1, math.isqrt(MOST_WORDS * 16 // n_keys)))
    return step, min(shortest - step + 1, WIDE_CHARS)


def contained(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_id, row_id, key_id, n_keys, found_key): how many distinct keys of each kind a text holds, and the key where it is one.

    ``texts`` is (text_id, row_id, t) of any number of columns, ``keys`` (key_id, k),
    each numbered by column; all pairs of them are one job. A key's end is its last
    characters, as many as the shortest key of its column has. Texts are cut into
    anchors where they lie, at the places of a ``grid``; every end holds one of them.
    A table of bits of one size, broadcast, tells which substrings can be an anchor,
    and which of the ends around those can be a key's. Only those move, with as many
    characters before them as the longest key has; they meet the keys in an equi-join
    and are compared in full. Blank keys match nothing; texts without a key are left out.
    """
    spark = texts.sparkSession
    k = keys.select("key_id", F.trim(F.col("k").cast("string")).alias("k")).where("k <> ''").distinct()
    facts = k.groupBy("key_id").agg(F.min(F.octet_length("k")).alias("shortest"), F.max(F.octet_length("k")).alias("longest"), F.count("*").alias("n")).collect()  # a row a column
    if not facts:
        return spark.createDataFrame([], _FOUND)
    grids = {n: grid(n, sum(f.n for f in facts)) for n in {f.shortest for f in facts}}
    longest = max(f.longest for f in facts)

    def by(column: str, values: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(column)]

    k = k.withColumn("n", by("key_id", {f.key_id: f.shortest for f in facts})).withColumn("b", as_bytes("k")).withColumn("end", F.expr("right(b, n)"))
    step, width = by("n", {n: s for n, (s, _) in grids.items()}), by("n", {n: w for n, (_, w) in grids.items()})

    n_words = 64
    while n_words < MOST_WORDS and n_words * 16 < sum(f.n * grids[f.shortest][0] ** 2 for f in facts):
        n_words *= 2

    def word(value: str) -> Column:
        return F.shiftright(F.xxhash64("n", value).bitwiseAND(F.lit(n_words * 64 - 1)), 6).alias("word")

    def one(value: str) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.xxhash64("n", value).bitwiseAND(F.lit(63)).cast("int"))

    ends = k.select("n", "end", step.alias("step"), width.alias("w"))
    anchors = F.transform(F.sequence(F.lit(0), F.col("step") - 1), lambda e: F.substring("end", F.col("n") - F.col("w") - e + 1, F.col("w")))
    marks = ends.select("n", F.explode(F.concat(F.array("end"), anchors)).alias("mark"))
    words = F.broadcast(marks.groupBy(word("mark")).agg(F.bit_or(one("mark")).alias("bits")))  # MOST_WORDS rows at most

    def marked(rows: DataFrame, value: str) -> DataFrame:
        return rows.withColumn("word", word(value)).join(words, "word").where(F.col("bits").bitwiseAND(one(value)) != 0).drop("word", "bits")

    # pieces of a text, each with the one before it and what may stand behind it
    piece, ahead = max(STRETCH, longest), max(grids) - 1
    pieces = F.regexp_extract_all(as_bytes("t"), F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    beside = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))
    cut = F.transform("pieces", lambda x, i: F.struct(beside(i - 1).alias("head"), F.concat(x, F.substring(beside(i + 1), 1, ahead)).alias("body")))
    rows = texts.where(F.octet_length("t") >= min(grids)).select("text_id", F.col("row_id").cast("bigint").alias("row_id"), pieces.alias("pieces"))
    rows = rows.select("text_id", "row_id", F.explode(cut).alias("x")).select("text_id", "row_id", "x.*")

    def places(n: int) -> Column:
        """The anchors of the grid that start in the piece, for ends of n bytes."""
        step, w = grids[n]
        return F.regexp_extract_all(F.substring("body", 1, piece + w - 1), F.lit(f"(?s)(?=(.{{{w}}})).{{1,{step}}}"), F.lit(1))

    each = rows.select("text_id", "row_id", "head", "body", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), places(n).alias("anchors")) for n in sorted(grids)])).alias("x")).select("text_id", "row_id", "head", "body", "x.*")
    every = each.select("text_id", "row_id", "head", "body", "n", F.posexplode("anchors").alias("i", "anchor"))
    held = marked(every, "anchor").select("text_id", "row_id", F.concat_ws("", "head", "body").alias("s"), "n", (F.length("head") + F.col("i") * step + width).alias("at"), F.col("anchor").alias("end"))
    if any(w < n for n, (_, w) in grids.items()):  # the ends that may hold the anchor
        tried = held.select("text_id", "row_id", "s", "n", F.explode(F.sequence(F.col("at"), F.col("at") + step - 1)).alias("at")).where((F.col("at") >= F.col("n")) & (F.col("at") <= F.length("s")))
        held = marked(tried.withColumn("end", F.expr("substring(s, at - n + 1, n)")), "end")
    # the characters up to the end
    sent = held.select("text_id", "row_id", "n", "end", F.substring("s", F.greatest(F.col("at") - longest + 1, F.lit(1)), F.least(F.lit(longest), F.col("at"))).alias("upto"))
    full = sent.join(k, ["n", "end"]).where(F.col("upto").endswith(F.col("b")))
    return full.groupBy("text_id", "row_id", "key_id").agg(F.count_distinct("k").alias("n_keys"), F.when(F.count_distinct("k") == 1, F.min("k")).alias("found_key"))


def contained_keys(carrier: DataFrame, text: str, keys: DataFrame, key: str, row_id: str = "row_id") -> DataFrame:
    """(row_id, n_keys, found_key) of one text column against one key column, as of ``contained``."""
    texts = carrier.select(F.lit(0).alias("text_id"), F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("t"))
    return contained(texts, keys.select(F.lit(0).alias("key_id"), F.col(key).alias("k"))).select("row_id", "n_keys", "found_key")


def search(sources: dict[str, DataFrame], texts: dict[str, list[str]], keys: dict[str, list[str]]) -> DataFrame:
    """(carrier, text, key_dataset, key, n_rows, resolved, ambiguous, coverage) of every text column that holds keys of another source; one job whatever the columns.

    Key columns too short to be told from chance are left out (``usable_key``).
    """
    spark = next(iter(sources.values())).sparkSession
    schema = "carrier string, text string, key_dataset string, key string, n_rows bigint, resolved bigint, ambiguous bigint, coverage double"
    text_ids = [(d, c) for d, cs in texts.items() for c in cs]
    key_ids = [(d, c) for d, cs in keys.items() for c in cs]
    if not text_ids or not key_ids:
        return spark.createDataFrame([], schema)

    def labelled(ids: list[tuple[str, str]], label: str, value: str) -> DataFrame:
        parts = []
        for d in dict.fromkeys(d for d, _ in ids):
            cells = F.explode(F.array(*[F.struct(F.lit(i).alias(label), F.col(c).cast("string").alias(value)) for i, (own, c) in enumerate(ids) if own == d]))
            parts.append(sources[d].select("row_id", cells.alias("x")).select("row_id", "x.*"))
        return reduce(DataFrame.unionByName, parts)

    all_keys = labelled(key_ids, "key_id", "k").select("key_id", F.trim("k").alias("k")).where("k <> ''").distinct()
    digits = F.bool_and(F.col("k").rlike("^[0-9]*$"))
    long = F.min(F.length("k")) >= F.when(digits, MIN_NUMERIC_KEY_CHARS).otherwise(MIN_KEY_CHARS)
    good = {r.key_id for r in all_keys.groupBy("key_id").agg(long.alias("long")).where("long").collect()}  # a row a column
    if not good:
        return spark.createDataFrame([], schema)
    found = contained(labelled(text_ids, "text_id", "t"), all_keys.where(F.col("key_id").isin(*good)))
    names = lambda ids, label, d, c: spark.createDataFrame([(i, *x) for i, x in enumerate(ids)], f"{label} int, {d} string, {c} string")
    counts = found.groupBy("text_id", "key_id").agg(F.count_if(F.col("n_keys") == 1).alias("resolved"), F.count_if(F.col("n_keys") > 1).alias("ambiguous"))
    sizes = reduce(DataFrame.unionByName, [sources[d].agg(F.count("*").alias("n_rows")).select(F.lit(d).alias("carrier"), "n_rows") for d in texts if texts[d]])
    out = counts.join(names(text_ids, "text_id", "carrier", "text"), "text_id").join(names(key_ids, "key_id", "key_dataset", "key"), "key_id").where("carrier <> key_dataset").join(sizes, "carrier")
    return out.select("carrier", "text", "key_dataset", "key", "n_rows", "resolved", "ambiguous", F.round(F.try_divide("resolved", "n_rows"), 6).alias("coverage"))


def worth(found: DataFrame) -> DataFrame:
    """The rows of ``search`` that are candidates: enough rows, and half of them resolved."""
    return found.where((F.col("n_rows") >= MIN_CARRIER_ROWS) & (F.col("resolved") > 0) & (F.col("resolved") / F.col("n_rows") >= MIN_CONTAINMENT))


def containment(carrier: DataFrame, text: str, keys: DataFrame, key: str) -> DataFrame:
    """(n_rows, resolved, ambiguous, coverage) of a carrier's rows against a key."""
    found = contained_keys(carrier, text, keys, key)
    counts = found.agg(F.count_if(F.col("n_keys") == 1).alias("resolved"), F.count_if(F.col("n_keys") > 1).alias("ambiguous"))
    return carrier.agg(F.count("*").alias("n_rows")).crossJoin(counts).withColumn("coverage", F.round(F.try_divide("resolved", "n_rows"), 6))


def publish(carrier: DataFrame, text: str, keys: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """``carrier`` with the key found in each row's text; null where there is none or more than one.

    A name that the carrier already has gets ``_ref`` appended.
    """
    name = name or key
    while name in carrier.columns:
        name += "_ref"
    found = contained_keys(carrier, text, keys, key).where("n_keys = 1").select("row_id", F.col("found_key").alias(name))
    return carrier.join(found, "row_id", "left")


def find(carrier: DataFrame, text: str, keys: DataFrame, key: str) -> dict | None:
    """The measured containment as a join candidate, or None where a rule declines it."""
    if not usable_key(keys, key):
        return None
    o = literal_overlap(carrier, text, keys, key).first()
    if o.total and o.shared / o.total >= ALREADY_JOINED:
        return None
    c = containment(carrier, text, keys, key).first()
    if c.n_rows < MIN_CARRIER_ROWS or not c.resolved or c.resolved / c.n_rows < MIN_CONTAINMENT:
        return None
    return {"embedded_in": text, "key": key, "coverage": c.coverage, "resolved": c.resolved, "ambiguous": c.ambiguous}
