"""Hard negatives by distributed radix selection.

Anchors ask for the best k rows of a window of scores: first for their positives,
then, for each positive, for the rows of another label whose score lies in a
share of the positive's. Rows and anchors meet in blocks. Each task counts the
scores of its rows in a histogram of each window's interval; the histograms are
added, the bucket with the kth row becomes the next interval, and so on digit by
digit. Where one score is left that many rows share, the digits of their ids
follow. An interval with few enough rows ends the search of its window, and only
the rows from there up are gathered and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.frames import stored

#: Rows and anchors of one block, and the blocks of rows that there are at least. Shape the plan and drop nothing.
BLOCK_ROWS = 16_384
BLOCK_ANCHORS = 8_192
LEAST_BLOCKS = 48
#: Bits of a digit.
DIGIT = 10
#: A window of no more rows than this, from its best one down, is gathered.
GATHER = 64
#: Scores that numpy holds at a time.
SCORES = 1 << 22
LIMIT = 1 << 62
LAST = (1 << 63) - 1

_WINDOW = ("w", "lo", "hi", "need", "by_id", "at", "shift", "top", "floor_score", "floor_id")


def prepared(df: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each component x as floor(256 x).

    Rows with a null id, label or vector, or a null or non-finite component, are
    left out. Rows of one id count as one, the smallest by label and vector.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = (F.col("label") if label is None else label).cast("bigint")
    rows = df.select("vec_id", own.alias("label"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(sound)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.struct("label", F.transform("x", lambda c: F.floor(c * 256)).alias("v")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


class _Side:
    """Ids, labels and vectors of one side of a block, by length and label."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = table["vec_id"].to_numpy().astype(np.int64)
        self.labels = table["label"].to_numpy().astype(np.int64)
        lists = pa.concat_arrays(table["v"].chunks)
        offsets = lists.offsets.to_numpy()
        self.flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts, self.sizes = offsets[:-1].astype(np.int64), np.diff(offsets)

    def take(self, picked: np.ndarray, size: int) -> np.ndarray:
        return self.flat[self.starts[picked][:, None] + np.arange(size)]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``; those beyond 2^62 are held there."""
    norm = [float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0)) for x in (a, b)]
    # no partial sum is larger than the product of the norms
    most = norm[0] * norm[1] * 1.001 + 1
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < LIMIT:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LIMIT, LIMIT).astype(np.int64)


def _windows(anchors: pa.Table, slots: int) -> dict[str, np.ndarray]:
    """The windows' fields as [anchor, slot]; an absent window is one that nothing lies in."""
    lists = anchors["windows"].to_pylist()
    out = {k: np.zeros((len(lists), slots), np.int64) for k in _WINDOW}
    out["lo"][:], out["hi"][:] = 1, 0
    out["top"][:], out["floor_score"][:] = 0, 1
    for i, own in enumerate(lists):
        for s, w in enumerate(own):
            for k in _WINDOW:
                out[k][i, s] = w[k]
    return out


def _met(rows: _Side, anchors: _Side, low: np.ndarray, high: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, anchors, scores) of the pairs of a block with a score from the anchor's ``low`` to its ``high``; never a row with itself."""
    for size in np.unique(anchors.sizes):
        for label in np.unique(anchors.labels[anchors.sizes == size]):
            asking = np.flatnonzero((anchors.sizes == size) & (anchors.labels == label))
            asked = np.flatnonzero((rows.sizes == size) & ((rows.labels == label) == same))
            if not len(asked):
                continue
            data = rows.take(asked, size)
            step = max(1, SCORES // len(asked))
            for at in range(0, len(asking), step):
                cols = asking[at : at + step]
                scores = _products(data, anchors.take(cols, size))
                keep = (scores >= low[cols]) & (scores <= high[cols])
                if same:
                    keep &= rows.ids[asked][:, None] != anchors.ids[cols]
                r, c = np.nonzero(keep)
                yield asked[r], cols[c], scores[r, c]


def _counting(same: bool, slots: int):
    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            rows, anchors, w = _Side(left), _Side(right), _windows(right, slots)
            by_id = w["by_id"] == 1
            low = np.where(w["lo"] > w["hi"], LAST, np.where(by_id, w["at"], w["lo"])).min(axis=1)
            high = np.where(w["lo"] > w["hi"], -LAST, np.where(by_id, w["at"], w["hi"])).max(axis=1)
            held: list[np.ndarray] = []
            for r, c, score in _met(rows, anchors, low, high, same):
                for s in range(slots):
                    ids, of_id = rows.ids[r], by_id[c, s]
                    lo, hi, shift = w["lo"][c, s], w["hi"][c, s], w["shift"][c, s]
                    x = np.where(of_id, ids, score)
                    inside = (x >= lo) & (x <= hi) & (~of_id | (score == w["at"][c, s]))
                    bucket = np.where(of_id, x - lo, hi - x)[inside] >> shift[inside]
                    keys, n = np.unique((c[inside] * slots + s) << DIGIT | bucket, return_counts=True)
                    held.append(np.stack([keys, n]))
            if held:
                # parts of one anchor and slot lie in one label and length, so in one or more pieces by columns only: no key twice
                both = np.concatenate(held, axis=1)
                both = both[:, np.argsort(both[0], kind="stable")]
                window = both[0] >> DIGIT
                start = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else window
                upto = np.cumsum(both[1])
                before = upto - both[1] - np.repeat((upto - both[1])[start], np.diff(np.r_[start, len(window)]))
                # the kth row of all is no deeper than the kth of these
                stays = before < w["need"].reshape(-1)[window]
                key, n = both[0][stays], both[1][stays]
                a, s = (key >> DIGIT) // slots, (key >> DIGIT) % slots
                out = [anchors.ids[a], w["w"][a, s], key & ((1 << DIGIT) - 1), n]
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("anchor_id", "w", "bucket", "n"), out or [[], [], [], []])})

    return count


def _gathering(same: bool, slots: int):
    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            rows, anchors, w = _Side(left), _Side(right), _windows(right, slots)
            low = np.where(w["floor_score"] > w["top"], LAST, w["floor_score"]).min(axis=1)
            high = np.where(w["floor_score"] > w["top"], -LAST, w["top"]).max(axis=1)
            for r, c, score in _met(rows, anchors, low, high, same):
                for s in range(slots):
                    least = w["floor_score"][c, s]
                    inside = (score <= w["top"][c, s]) & ((score > least) | (score == least) & (rows.ids[r] <= w["floor_id"][c, s]))
                    for x, y in zip(out, (anchors.ids[c], w["w"][c, s], rows.ids[r], score)):
                        x.append(y[inside])
        return pa.table({k: pa.array(np.concatenate(x) if x else [], pa.int64()) for k, x in zip(("anchor_id", "w", "vec_id", "score"), out)})

    return gather


def _bits(x: Column) -> Column:
    return F.length(F.bin(x))


def select_top(rows: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, ids: tuple[int, int], blocks: tuple[int, int], slots: int) -> DataFrame:
    """(anchor_id, w, vec_id, score, rank): the best ``k`` rows of each window, higher scores first, then smaller ids; all rows where there are fewer.

    ``rows`` and ``anchors`` are (vec_id, label, v), ``windows`` (anchor_id, w, lo,
    hi) of scores, at most ``slots`` an anchor. Rows of the anchor's label are
    asked if ``same``, all others if not. ``ids`` bounds the ids of rows, and
    ``blocks`` counts the blocks of rows and of anchors.
    """
    by_row, by_anchor = blocks
    # each row goes to every block of anchors, each anchor to every block of rows
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(by_row))).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(by_anchor - 1))))

    def met(state: DataFrame, make, schema: str) -> DataFrame:
        fields = F.struct(*[F.col(c).cast("bigint").alias(c) for c in _WINDOW])
        own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # names of its own beside those of the rows
        asking = own.join(state.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(fields).alias("windows")), "vec_id")  # at most ``slots`` windows an anchor
        spread = asking.withColumn("h", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(by_anchor)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(by_row - 1).cast("bigint"))))
        return dealt.groupBy("g", "h").cogroup(spread.groupBy("g", "h")).applyInArrow(make(same, slots), schema)

    start = windows.select(
        "anchor_id", "w", "lo", "hi", F.lit(k).cast("bigint").alias("need"), F.lit(0).alias("by_id"), F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("shift"),
        F.col("hi").alias("top"), F.col("lo").alias("floor_score"), F.lit(LAST).alias("floor_id"), F.lit(False).alias("done"),
    )
    shift = F.greatest(_bits(F.col("hi") - F.col("lo")) - DIGIT, F.lit(0))
    state, ended = stored(start.withColumn("shift", shift), "windows"), []
    upto = Window.partitionBy("anchor_id", "w").orderBy("bucket")
    while not state.isEmpty():
        seen = met(state, _counting, "anchor_id long, w long, bucket long, n long").groupBy("anchor_id", "w", "bucket").agg(F.sum("n").alias("n"))
        seen = seen.withColumn("above", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["above"])
        both = state.join(seen, ["anchor_id", "w"], "left").where("bucket IS NULL OR above < need")
        # of the buckets that begin before the kth row the last one has it, if its rows suffice
        last = both.groupBy("anchor_id", "w").agg(F.max_by(F.struct(*[c for c in both.columns if c not in ("anchor_id", "w")]), F.coalesce("bucket", F.lit(-1))).alias("x")).select("anchor_id", "w", "x.*")
        width = F.expr("shiftleft(1L, shift) - 1")
        offset = F.expr("shiftleft(bucket, shift)")
        found = F.coalesce(F.col("above") + F.col("n") >= F.col("need"), F.lit(False))
        hi = F.when(F.col("by_id") == 1, F.least(F.col("hi"), F.col("lo") + offset + width)).otherwise(F.col("hi") - offset)
        lo = F.when(F.col("by_id") == 1, F.col("lo") + offset).otherwise(F.greatest(F.col("lo"), F.col("hi") - offset - width))
        few = F.lit(k) - F.col("need") + F.col("above") + F.col("n") <= GATHER
        step = last.select(
            "anchor_id", "w", found.alias("found"), few.alias("few"), F.when(found, lo).otherwise(F.col("lo")).alias("lo"), F.when(found, hi).otherwise(F.col("hi")).alias("hi"),
            F.when(found, F.col("need") - F.col("above")).otherwise(F.col("need")).alias("need"), "by_id", "at", "top", "floor_score", "floor_id",
        )
        one = F.col("lo") == F.col("hi")
        done = ~F.col("found") | F.col("few") | (one & (F.col("by_id") == 1))
        score_end, id_end = done & F.col("found") & (F.col("by_id") == 0), done & F.col("found") & (F.col("by_id") == 1)
        to_ids = ~done & one & (F.col("by_id") == 0)
        step = step.select(
            "anchor_id", "w",
            F.when(to_ids, F.lit(ids[0])).otherwise(F.col("lo")).alias("lo"), F.when(to_ids, F.lit(ids[1])).otherwise(F.col("hi")).alias("hi"), "need",
            F.when(to_ids, 1).otherwise(F.col("by_id")).alias("by_id"), F.when(to_ids, F.col("lo")).otherwise(F.col("at")).alias("at"), F.lit(0).alias("shift"), "top",
            F.when(score_end, F.col("lo")).when(id_end, F.col("at")).otherwise(F.col("floor_score")).alias("floor_score"), F.when(id_end, F.col("hi")).otherwise(F.col("floor_id")).alias("floor_id"), done.alias("done"),
        ).withColumn("shift", shift)
        step = stored(step, "windows")
        ended.append(step.where("done"))
        state = step.where("NOT done")
    if not ended:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, w bigint, vec_id bigint, score bigint, rank int")
    over = ended[0]
    for x in ended[1:]:
        over = over.unionByName(x)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
    return met(over, _gathering, "anchor_id long, w long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` (vec_id, label, v), one row an id.

    Anchors are the rows whose id ``every`` divides. An anchor's positives are its
    best ``positives`` other rows of its label; for each of them the best
    ``negatives`` rows of another label are taken whose score is from ``low`` to
    ``high`` hundredths of the positive's. Vectors of different lengths have no
    score. Scores beyond 2^62 count as 2^62.
    """
    rows = stored(rows, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    anchor = F.col("vec_id") % every == 0
    facts = rows.agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.max(square).alias("square"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last")).first()
    spark = rows.sparkSession
    if not facts.anchors:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    blocks = (max(LEAST_BLOCKS, -(-facts.n // BLOCK_ROWS)), -(-facts.anchors // BLOCK_ANCHORS))
    bound = min(LIMIT // 2, int(facts.square * 1.001) + 1)
    asking, ids = rows.where(anchor), (facts.first, facts.last)
    whole = asking.select(F.col("vec_id").alias("anchor_id"), F.lit(0).cast("bigint").alias("w"), F.lit(-bound).alias("lo"), F.lit(bound).alias("hi"))
    near = stored(select_top(rows, asking, whole, positives, True, ids, blocks, 1).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # a negative score's share lies above it: no window
    p = F.col("positive_score")
    share = lambda c, up: F.expr(f"(positive_score div 100) * {c} + ((positive_score % 100) * {c} + {up}) div 100")
    windows = near.where(p >= 0).select("anchor_id", F.col("positive_id").alias("w"), share(low, 99).alias("lo"), share(high, 0).alias("hi")).where("lo <= hi")
    far = select_top(rows, asking, windows, negatives, False, ids, blocks, positives)
    found = far.select("anchor_id", F.col("w").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(df: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over all rows of ``df`` (vec_id, label, embedding).

    Where 7 divides vec_id, label is (label + 1) % 10. Rows with a null vec_id,
    label or vector, or a null or non-finite component, take no part; rows of one
    vec_id count as one, the smallest by label and vector. Equal scores go by the
    smaller vec_id. Anchors without positives, positives without negatives and an
    empty table give no rows. Other columns aren't read.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(df, label))


#: All anchors against all rows. For small tables only.
OP11_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
    other AS negative_id, positive_score, score AS negative_score
  FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT * FROM ranked WHERE rank <= 3
"""
