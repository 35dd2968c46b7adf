"""Toxicity by maximum-scoring segment search.

Words get log-odds of toxic against other documents, shrunk by an informative
Dirichlet prior (the word's share of all documents); a word too rare for a score
of its own takes that of its leading letters. A linear scan over a text's word
scores finds all maximal segments. A segment's significance follows the extreme
value law of maximal segments, with its parameters from the word scores of other
documents, and a text's significant segments are summed into one value, which a
logistic curve fitted on the labelled rows turns into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.frames import free_name, map_arrow, remainder, sampled, stored

#: Labelled rows that a model is fitted on, about, chosen by a hash of the id.
TRAIN_ROWS = 30_000
#: Leading letters that stand for rare words, longest first.
STEMS = (6, 5, 4)
#: Documents that the Dirichlet prior counts as; a feature's part is its share of all documents.
PRIOR = 10.0
#: A feature scores if its log-odds are this large and so many standard deviations from 0.
ODDS, Z = 2.0, 2.5
#: Chance of a share of toxic documents like a feature's must be below the number of features tested to minus this power.
#: Copies of documents make chance finds likelier than independent documents would, hence more than 1.
#: The second holds for stems, which stand for words never seen.
STRICT, STRICT_STEM = 1.5, 3.0
#: Scores are held within this bound; words outside the lexicon get DRIFT.
BOUND, DRIFT = 6.0, -0.25
#: Steps of the scores' distribution, and sums of how many words K is worked out from.
GRID, SUMS = 0.05, 60
#: A segment counts as significant at this expected number of equal ones in a text.
EXPECTED = 0.5
WORDS = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Distinct words and stems of a whole text, stems marked by a closing star."""
    words = {w.lower() for w in set(WORDS.findall(text))}
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past last, sum) of a sequence, in linear time.

    Candidates are kept as a list of disjoint segments with the running sums left
    of and at the end of each; a new positive score joins leftwards to the last
    candidate with a smaller left sum whose right sum doesn't reach its own.
    """
    lefts: list[float] = []
    rights: list[float] = []
    spans: list[tuple[int, int]] = []
    back: list[int] = []  # the nearest earlier candidate with a smaller left sum
    positive = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for at in positive.tolist():
        left, right, start = float(sums[at]), float(sums[at + 1]), at
        while True:
            j = len(lefts) - 1
            while j >= 0 and lefts[j] >= left:
                j = back[j]
            if j < 0 or rights[j] >= right:
                break
            # everything from candidate j on is one segment now
            left, start = lefts[j], spans[j][0]
            del lefts[j:], rights[j:], spans[j:], back[j:]
        lefts.append(left)
        rights.append(right)
        spans.append((start, at + 1))
        back.append(j)
    return [(a, b, r - v) for (a, b), v, r in zip(spans, lefts, rights)]


def extreme_value(steps: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of the law P(best >= s) = 1 - exp(-K n e^(-lambda s)) for independent scores of negative mean.

    Scores are ``steps`` (integers) times GRID. lambda solves
    sum(share * e^(lambda * score)) = 1, and K follows from the sums S_k of k
    scores: K = e^(-2 sigma) / ((1 - e^(-lambda)) E[X e^(lambda X)]) with
    sigma = sum over k of (E[e^(lambda S_k); S_k < 0] + P(S_k >= 0)) / k, in units
    of GRID; its terms fall off geometrically.
    """
    mean = float((steps * shares).sum())
    if mean >= 0 or steps.max() <= 0:
        return 1.0, 1.0
    grown = lambda x: float((shares * np.exp(x * steps)).sum())
    low, high = 0.0, GRID
    while grown(high) < 1 and high < 64 * GRID:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if grown(middle) < 1 else (low, middle)
    first = int(steps.min())
    one = np.zeros(int(steps.max()) - first + 1)
    np.add.at(one, steps - first, shares)
    total, start, sigma = np.array([1.0]), 0, 0.0
    for k in range(1, SUMS + 1):
        total, start = np.convolve(total, one), start + first
        at = np.arange(start, start + len(total))
        sigma += float(total[at >= 0].sum() + (total[at < 0] * np.exp(high * at[at < 0])).sum()) / k
    k = math.exp(-2 * sigma) / (-math.expm1(-high) * float((shares * steps * np.exp(high * steps)).sum()))
    return high / GRID, k


@dataclass
class ToxicityModel:
    scores: dict[str, float]
    rate: float
    k: float
    slope: float
    intercept: float

    def word(self, word: str) -> float:
        word = word.lower()
        own = self.scores.get(word)
        if own is None:
            for n in STEMS:
                if len(word) >= n and (own := self.scores.get(word[:n] + "*")) is not None:
                    break
        return DRIFT if own is None else own

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments in words with their sums, and the number of words."""
        words = WORDS.findall(text)
        scored = dict.fromkeys(words)
        for w in scored:
            scored[w] = self.word(w)
        values = np.fromiter(map(scored.__getitem__, words), np.float64, len(words))
        return (maximal_segments(values) if len(words) and values.max() > 0 else []), len(words)

    def value(self, text: str | None) -> float:
        """Sum over significant segments of the surprise beyond the significance bound."""
        if not text:
            return 0.0
        found, n = self.segments(text)
        bound = math.log(self.k * n / EXPECTED) if n else 0.0
        return sum(s for *_, w in found if (s := self.rate * w - bound) > 0)

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant toxic passages: first character, past the last, expected number of equal ones in the text."""
        if not text:
            return []
        found, n = self.segments(text)
        spans = [m.span() for m in WORDS.finditer(text)]
        out = [(spans[a][0], spans[b - 1][1], self.k * n * math.exp(-self.rate * w)) for a, b, w in found]
        return [x for x in out if x[2] <= EXPECTED]

    def probability(self, value: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * math.log1p(value)))))

    def score(self, text: str | None) -> float:
        return self.probability(self.value(text))


def fit_curve(rows: Iterable[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over log1p(value), from (value, label, count) rows, lightly shrunk."""
    data = np.array([(math.log1p(v), y, n) for v, y, n in rows], np.float64).reshape(-1, 3)
    w = np.zeros(2)
    if not len(data):
        return 0.0, -2.0
    x = np.c_[np.ones(len(data)), data[:, 0]]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.array([1e-3, 1e-2])
        gradient = x.T @ (data[:, 2] * (p - data[:, 1])) + pull * w
        curve = (x * (data[:, 2] * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[1]), float(w[0])


def testable(sizes: dict[int, int], base: float) -> tuple[int, int]:
    """(fewest documents a feature must be in, features in as many): Tarone's rule.

    ``sizes`` counts features by their documents, ``base`` is the toxic share. A
    feature in c documents has the least chance, base ** c, where all are toxic; c is
    the smallest number for which that passes when all features in c or more
    documents are tested. Those in fewer can't pass, whatever their labels.
    """
    left = sum(sizes.values())
    for c in range(1, max(sizes, default=0) + 2):
        if -c * math.log(base) >= STRICT * (math.log(left + 1) + 1) if base < 1 else False:
            return c, left
        left -= sizes.get(c, 0)
    return max(sizes, default=0) + 1, 0


def train(rows: DataFrame, bound: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from ``rows`` (id, text, toxic: 0 or 1); about ``bound`` of them at most, chosen by a hash of the id.

    Document counts of words and stems are made in the workers and summed by a
    shuffle. A feature in so few documents that not even toxic ones alone could pass
    the test counts as none that was tested (``testable``). Only the others, where
    they are more often in toxic documents than in all, reach the driver, so the
    size of the training rows bounds them.
    Rows with a null label are left out. Without toxic rows every score is low.
    """
    # read three times below: written once, so the corpus is scanned once
    rows = sampled(stored(rows.where(F.col("toxic").isNotNull()).select("id", "text", "toxic"), "training"), bound, "id")
    counted = T.StructType([T.StructField("feature", T.StringType()), T.StructField("n", T.LongType()), T.StructField("bad", T.LongType())])

    def count():
        def work(batch: pa.RecordBatch):
            both, bad = Counter(), Counter()
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = features(text or "")
                both.update(own)
                both[""] += 1
                if toxic:
                    bad.update(own)
                    bad[""] += 1
            names = list(both)
            return [names, [both[x] for x in names], [bad[x] for x in names]]

        return work

    sums = map_arrow(rows.select("id", "text", "toxic"), count, counted).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sums = stored(sums, "features")
    whole = sums.where("feature = ''").first()
    if whole is None or whole.bad == 0:
        return ToxicityModel({}, 1.0, 1.0, 0.0, -4.0)
    n, bad = float(whole.n), float(whole.bad)
    good = n - bad
    # at most one row for each number of documents
    sizes = {r.n: r.features for r in sums.where("feature <> ''").groupBy("n").agg(F.count("*").alias("features")).collect()}
    least, tested = testable(sizes, bad / n)
    table = sums.where((F.col("feature") != "") & (F.col("n") >= least) & (F.col("bad") * n > F.col("n") * bad)).orderBy("feature").toPandas()
    prior = PRIOR * (table["n"].to_numpy() + 1) / (n + 2)
    y1, y0 = table["bad"].to_numpy(float), (table["n"] - table["bad"]).to_numpy(float)
    odds = lambda y, size: np.log((y + prior) / np.maximum(size + PRIOR - y - prior, 1e-9))
    delta = odds(y1, bad) - odds(y0, good)
    z = delta / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    base, toxic_share = bad / n, y1 / (y1 + y0)
    with np.errstate(divide="ignore", invalid="ignore"):
        away = toxic_share * np.log(toxic_share / base) + np.where(toxic_share < 1, (1 - toxic_share) * np.log((1 - toxic_share) / (1 - base)), 0)
    stems = table["feature"].str.endswith("*").to_numpy(bool)
    unlikely = (toxic_share > base) & ((y1 + y0) * away >= np.where(stems, STRICT_STEM, STRICT) * (math.log(tested + 1) + 1))
    table = table.assign(score=np.clip(delta, -BOUND, BOUND), z=z)
    table = table[(table["z"] >= Z) & (delta >= ODDS) & unlikely].sort_values(["z", "feature"], ascending=[False, True])
    scores = dict(zip(table["feature"], table["score"].astype(float)))
    # a stem speaks for unseen words only where no single word makes up most of it
    counts = dict(zip(table["feature"], table["bad"]))
    for word, own in counts.items():
        for size in STEMS if not word.endswith("*") else ():
            if 1.5 * own > counts.get(stem := word[:size] + "*", 0):
                scores.pop(stem, None)
    model = ToxicityModel(scores, 1.0, 1.0, 1.0, 0.0)
    _calibrate(rows, model)
    return model


def _calibrate(rows: DataFrame, model: ToxicityModel) -> None:
    """Extreme-value parameters from the words of other documents, then the curve from all rows; both from small histograms."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(model)
    scored = T.StructType([T.StructField("score", T.LongType()), T.StructField("n", T.LongType())])

    def words():
        own = held.value

        def work(batch: pa.RecordBatch):
            counts = Counter()
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not toxic:
                    counts.update(round(own.word(w) / GRID) for w in WORDS.findall(text or ""))
            return [list(counts), list(counts.values())]

        return work

    part = rows.select("id", "text", "toxic")
    seen = {r.score: r.n for r in map_arrow(part, words, scored).groupBy("score").agg(F.sum("n").alias("n")).collect()}
    # one positive word in all the text that was read is the least that is assumed
    top = round(max(model.scores.values(), default=1.0) / GRID)
    seen[top] = seen.get(top, 0) + 1
    steps = np.array(sorted(seen), np.int64)
    model.rate, model.k = extreme_value(steps, np.array([seen[x] for x in steps.tolist()], float) / sum(seen.values()))
    held = spark.sparkContext.broadcast(model)

    def measured():
        own = held.value

        def work(batch: pa.RecordBatch):
            counts = Counter((round(math.log1p(own.value(t)), 1), int(y)) for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            return [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]

        return work

    shape = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("y", T.LongType()), T.StructField("n", T.LongType())])
    histogram = map_arrow(part, measured, shape).groupBy("value", "y").agg(F.sum("n").alias("n")).collect()
    model.slope, model.intercept = fit_curve((math.expm1(r.value), r.y, r.n) for r in histogram)


def score_texts(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: toxic likelier) of each whole text.

    Null, empty and wordless texts get the score of a text without findings.
    Rows and other columns stay; a column named ``score`` is replaced.
    """
    rest = [f for f in df.schema.fields if f.name.lower() != score.lower()]
    schema = T.StructType([*rest, T.StructField(score, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_ROWS

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch):
            return [*(batch.column(f.name) for f in rest), [own.score(t) for t in batch.column(text).to_pylist()]]

        return work

    return map_arrow(df, make, schema, text)


def training_rows(df: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """(id, text, toxic) of the labelled documents outside the held-out remainder."""
    known = labels.where((remainder("doc_id", modulus) != held) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    part = sampled(known, TRAIN_ROWS, "id")
    # ids and labels of about TRAIN_ROWS documents at most, so texts needn't move
    return df.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(part), "id").select("id", "text", "toxic")


def op6_toxicity(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learnt from labels whose crc32(doc_id) mod 4 is not 2.

    Null and empty texts score as texts without findings; rows of equal text score
    alike; an id labelled twice counts as toxic if either label says so. An empty
    table gives an empty result; without labels every score is low.
    """
    model = train(training_rows(df, labels))
    scored = score_texts(df.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def keep_civil(df: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose text scores below ``limit``, with their columns as they are; an empty table stays empty."""
    model = train(training_rows(df, labels))
    name = free_name(df, "score")
    return score_texts(df, model, score=name).where(F.col(name) < limit).drop(name)
