"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees propose rules, each path from a root to a node being a
conjunction of bounds on statistics. A lasso logistic regression over the rules
keeps a few and weighs them. Statistics and kept rules are Spark column
expressions, so scoring is one projection in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.frames import remainder, sampled

#: Labelled rows that rules are fitted on, about, chosen by a hash of the id.
TRAIN_ROWS = 30_000
TREES, DEPTH, BINS, RATE = 24, 3, 48, 0.3
#: Weight of the lasso's penalty for each training row.
PENALTY = 4e-4
LEAST_IN_NODE = 8


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; null counts as empty. Shares are of characters, words or lines."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    without = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
    found = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    words, lines = F.split(t, "[ \n]"), F.split(t, "\n")
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "blank_share": without(" ") / n,
        "line_share": without("\n") / n,
        "pipe_share": without("|") / n,
        "bang_share": without("!") / n,
        "stop_share": without(".") / n,
        "comma_share": without(",") / n,
        "upper_share": found(r"\p{Lu}") / n,
        "digit_share": found(r"[0-9]") / n,
        "symbol_share": found(r"[^\p{L}\p{N}\s.,!|]") / n,
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, above or not, threshold) that must all hold."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s) > v if above else F.col(s) <= v for s, above, v in self.bounds])

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, [data[s] > v if above else data[s] <= v for s, above, v in self.bounds])


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics' columns."""
        total = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights)], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree_rules(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, curve: np.ndarray, rows: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Paths (feature, above, cut) of one tree's nodes and the step it takes for each row."""
    paths, step = [], np.zeros(len(x))
    stack = [((), rows)]
    while stack:
        path, own = stack.pop()
        g, h = gradient[own], curve[own]
        best = None
        if len(path) < DEPTH and len(own) >= 2 * LEAST_IN_NODE:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f in range(x.shape[1]):
                bins = len(cuts[f]) + 1
                gs, hs, ns = (np.cumsum(np.bincount(x[own, f], weights=w, minlength=bins))[:-1] for w in (g, h, np.ones(len(own))))
                fair = (ns >= LEAST_IN_NODE) & (len(own) - ns >= LEAST_IN_NODE)
                if fair.any():
                    gain = np.where(fair, gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole, -np.inf)
                    at = int(gain.argmax())
                    if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                        best = (gain[at], f, at)
        if path:
            paths.append(path)
        if best is None:
            step[own] = -RATE * g.sum() / (h.sum() + 1)
            continue
        _, f, at = best
        above = x[own, f] > at
        stack += [((*path, (f, True, at)), own[above]), ((*path, (f, False, at)), own[~above])]
    return paths, step


def fit(data: dict[str, np.ndarray], labels: np.ndarray, seed: int = 7) -> RuleEnsemble:
    """Rules and lasso weights from statistics and 0/1 labels. One class alone, or no row, gives an intercept only."""
    y = labels.astype(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    names = list(data)
    cuts = [np.unique(np.quantile(data[s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in names]
    x = np.stack([np.searchsorted(c, data[s], side="left") for s, c in zip(names, cuts)], 1)
    rng = np.random.default_rng(seed)
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    seen: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        paths, _ = _tree_rules(x, cuts, p - y, p * (1 - p), rows)
        for path in paths:
            merged: dict[tuple[int, bool], int] = {}
            for f, above, at in path:
                key = (f, above)
                merged[key] = at if key not in merged else (max if above else min)(merged[key], at)
            # a row is above a cut's bin exactly if its statistic is above the cut
            seen.setdefault(Rule(tuple(sorted((names[f], above, float(cuts[f][at])) for (f, above), at in merged.items()))))
        raw += _applied(paths, x, p - y, p * (1 - p))
    rules = list(seen)
    held = np.stack([r.holds(data) for r in rules], 1).astype(float)
    spread = held.std(0)
    rules = [r for r, s in zip(rules, spread) if s > 0]
    held, spread = held[:, spread > 0], spread[spread > 0]
    centred = (held - held.mean(0)) / spread
    w, b = _lasso(centred, y)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    weights = w[keep] / spread[keep]
    return RuleEnsemble([rules[i] for i in keep], weights.tolist(), float(b - (weights * held.mean(0)[keep]).sum()))


def _applied(paths: list[tuple], x: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Steps of a tree for all rows: each leaf, a path that no other extends, takes a Newton step."""
    longer = {p[:-1] for p in paths}
    out = np.zeros(len(x))
    for path in paths:
        if path not in longer:
            own = reduce(np.logical_and, [(x[:, f] > at) == above for f, above, at in path])
            out[own] = -RATE * gradient[own].sum() / (curve[own].sum() + 1)
    return out


def _lasso(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the mean logistic loss plus the penalty; the intercept is free."""
    n = len(y)
    z = np.c_[np.ones(n), x]
    v = np.ones(z.shape[1])
    for _ in range(30):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    pace = 4 * n / float(np.linalg.norm(z @ v) ** 2)
    w = np.zeros(z.shape[1])
    w[0] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    limit = np.full(len(w), pace * PENALTY)
    limit[0] = 0
    for _ in range(rounds):
        step = ahead - pace * (z.T @ (1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30))) - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - limit, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[1:], float(w[0])


def train(df: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, bound: int = TRAIN_ROWS) -> RuleEnsemble:
    """An ensemble from labelled rows outside the held-out remainder, about ``bound`` of them at most.

    Only statistics reach the driver: a dozen numbers a row. Rows with a null label are left out.
    """
    known = labels.where((remainder("doc_id", modulus) != held) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    part = sampled(known, bound, "doc_id")
    # ids and labels of about TRAIN_ROWS documents at most, so texts needn't move
    rows = df.select("doc_id", "text").join(F.broadcast(part), "doc_id")
    stats = statistics(F.col("text"))
    table = rows.select(*(c.alias(n) for n, c in stats.items()), "quality").toPandas()
    # rows come in any order; what is fitted must not depend on it
    table = table.sort_values(list(table.columns), kind="stable")
    return fit({n: table[n].to_numpy(float) for n in stats}, table["quality"].to_numpy())


def score_texts(df: DataFrame, model: RuleEnsemble, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: better quality likelier) of each whole text; null and empty texts are scored as empty.

    Other columns stay, a column named ``score``, whatever its case, is replaced.
    """
    stats = statistics(F.col(text))
    keep = [c for c in df.columns if c.lower() != score.lower()]
    if {c.lower() for c in keep} & {"__stats", *(n.lower() for n in stats)}:
        return _apart(df, model, keep, stats, score)
    whole = df.select(*keep, F.struct(*(c.alias(n) for n, c in stats.items())).alias("__stats"))
    return whole.select(*keep, "__stats.*").select(*keep, model.score().alias(score))


def _apart(df: DataFrame, model: RuleEnsemble, keep: list[str], stats: dict[str, Column], score: str) -> DataFrame:
    """As score_texts, where columns of ``df`` are named like statistics: they step aside in a struct."""
    held = df.select(F.struct(*keep).alias("__row"), *(c.alias(n) for n, c in stats.items()))
    return held.select("__row", model.score().alias("__score")).select("__row.*", F.col("__score").alias(score))


def op10_quality(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learnt from labels whose crc32(doc_id) mod 3 is not 1.

    Null and empty texts are scored as empty; rows of equal text score alike; an id
    labelled twice counts as good if either label says so. Without labels every
    score is 0.5. An empty table gives an empty result.
    """
    model = train(df, labels)
    scored = score_texts(df.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
