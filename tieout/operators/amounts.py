"""The shape of a relationship, and which amounts agree across it.

All pairs of amount expressions are measured in one aggregate over one join,
whatever their number, so a search costs a join and not a query for each pair.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.expr import LIVE, numeric_text

# Fixed values of the shape and amount rules.
UNIQUE_KEY = 0.98
NEARLY_UNIQUE = 0.5
DOMINANCE = 1.5
AMOUNT_AGREEMENT = 0.60
MIN_AMOUNT_ROWS = 3
NUMERIC_TEXT = 0.80
PARTITION_MAX_DISTINCT = 12
MAX_RESIDUAL = 1.00
#: Pairs measured in one aggregate; more are measured in several, for the size of the generated code.
PAIRS_AT_ONCE = 24


@dataclass(frozen=True)
class Amounts:
    left: str
    right: str
    agreement: float
    exact: int
    joined: int
    spread: int
    tolerance_minor: int = 0
    strategy: str = "row"
    partition: tuple[str, str] | None = None


def signed_pair(df: DataFrame, columns: list[str]) -> tuple[str, str] | None:
    """The first pair of number columns of which never both are set and each is set three times or more."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return None
    both = [F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    row = df.agg(*both, *[F.count(c).alias(f"n_{c}") for c in columns]).first()
    return next(((a, b) for i, (a, b) in enumerate(pairs) if row[f"p{i}"] == 0 and min(row[f"n_{a}"], row[f"n_{b}"]) >= 3), None)


def numeric_text_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, numeric_n, ratio, usable): text columns that hold numbers in four of five values."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]))
    s = df.select(cells.alias("c")).select("c.*").where("v IS NOT NULL").groupBy("column").agg(F.count("*").alias("n"), F.count_if(numeric_text(F.col("v"))).alias("numeric_n"))
    ratio = F.col("numeric_n") / F.col("n")
    return s.select("column", "n", "numeric_n", F.round(ratio, 6).alias("ratio"), ((F.col("n") >= 3) & (ratio >= NUMERIC_TEXT)).alias("usable"))


def side_stats(df: DataFrame, key: str) -> DataFrame:
    """(n_keys, n_distinct, ratio, is_unique) of one side of a relationship."""
    s = df.agg(F.count(key).alias("n_keys"), F.count_distinct(F.col(key)).alias("n_distinct"))
    ratio = F.try_divide("n_distinct", "n_keys")
    return s.select("n_keys", "n_distinct", F.round(ratio, 6).alias("ratio"), F.coalesce(ratio >= UNIQUE_KEY, F.lit(False)).alias("is_unique"))


def _is_one(own: Column, other: Column) -> Column:
    return (own >= UNIQUE_KEY) | ((own >= NEARLY_UNIQUE) & (own >= DOMINANCE * other))


def classify(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(left_ratio, right_ratio, shape): '1:1', '1:N', 'N:1' or 'N:M', which is declined."""
    l = left.agg((F.count_distinct(F.col(left_key)) / F.count(left_key)).alias("lr"))
    r = right.agg((F.count_distinct(F.col(right_key)) / F.count(right_key)).alias("rr"))
    one_l, one_r = _is_one(F.col("lr"), F.col("rr")), _is_one(F.col("rr"), F.col("lr"))
    shape = F.when(one_l & one_r, "1:1").when(one_l, "1:N").when(one_r, "N:1").otherwise("N:M")
    return l.crossJoin(r).select(F.round("lr", 6).alias("left_ratio"), F.round("rr", 6).alias("right_ratio"), shape.alias("shape"))


def _double(c: str) -> Column:
    return F.col(c).try_cast("double") if isinstance(c, str) else c


def row_probes(left: DataFrame, left_key: str, left_amounts: list[str], right: DataFrame, right_key: str, right_amounts: list[str], group: list[str] | None = None) -> DataFrame:
    """(left_amount, right_amount, n_both, n_exact, spread, joined) for every pair of amounts over one join on the keys.

    A pair of values agrees if they differ by less than half a cent and the left
    one is an amount at all; ``spread`` counts the distinct agreed values, so that
    a constant doesn't pass for an amount. ``group`` adds keys to the aggregate.
    """
    l = left.select(F.col(left_key).alias("__k"), *[_double(c).alias(f"__l{i}") for i, c in enumerate(left_amounts)])
    r = right.select(F.col(right_key).alias("__k"), *[_double(c).alias(f"__r{i}") for i, c in enumerate(right_amounts)], *(group or []))
    both = l.join(r, "__k")
    pairs = [(i, j) for i in range(len(left_amounts)) for j in range(len(right_amounts))]
    out = None
    for start in range(0, len(pairs), PAIRS_AT_ONCE):
        part, aggs, agreed = pairs[start : start + PAIRS_AT_ONCE], [F.count("*").alias("joined")], []
        for i, j in part:
            x, y = F.col(f"__l{i}"), F.col(f"__r{j}")
            live = x.isNotNull() & y.isNotNull() & (F.abs(x) >= LIVE)
            agrees = live & (F.abs(x - y) < LIVE)
            aggs.append(F.struct(F.lit(left_amounts[i]).alias("left_amount"), F.lit(right_amounts[j]).alias("right_amount"), F.count_if(live).alias("n_both"), F.count_if(agrees).alias("n_exact")).alias(f"s{i}_{j}"))
            agreed.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(agrees, F.round(x, 2)).alias("v")))
        probes = (both.groupBy(*group) if group else both.groupBy()).agg(*aggs)
        rows = probes.select(*(group or []), "joined", F.explode(F.array(*[F.col(f"s{i}_{j}") for i, j in part])).alias("s")).select(*(group or []), "s.*", "joined")
        # distinct agreed values are counted over the pairs that agree; count_distinct of each pair would copy every row for each
        values = both.select(*(group or []), F.explode(F.filter(F.array(*agreed), lambda a: a["v"].isNotNull())).alias("a")).select(*(group or []), "a.*").distinct()
        name = lambda of, k: F.element_at(F.array(*[F.lit(c) for c in of]), F.col(k) + 1)
        spread = values.groupBy(*(group or []), "i", "j").agg(F.count("*").alias("spread")).select(*(group or []), name(left_amounts, "i").alias("left_amount"), name(right_amounts, "j").alias("right_amount"), "spread")
        rows = rows.join(spread, [*(group or []), "left_amount", "right_amount"], "left").select(*(group or []), "left_amount", "right_amount", "n_both", "n_exact", F.coalesce("spread", F.lit(0).cast("bigint")).alias("spread"), "joined")
        out = rows if out is None else out.unionByName(rows)
    return out


def scored(probes: DataFrame) -> DataFrame:
    """Probes with agreement (of the joined rows) and whether they pass the rules for an amount."""
    agreement = F.try_divide("n_exact", "joined")
    passed = (F.col("n_both") >= MIN_AMOUNT_ROWS) & (F.col("spread") >= 2) & (agreement >= AMOUNT_AGREEMENT)
    return probes.withColumn("agreement", F.round(agreement, 6)).withColumn("passed", F.coalesce(passed, F.lit(False)))


def best_row_amounts(probes: DataFrame, left_amounts: list[str], right_amounts: list[str]) -> Amounts | None:
    """The best pair that passes: by agreement, exact rows (one more for a like name), then column order. A driver choice among pairs."""
    rows = [r for r in scored(probes).collect() if r.passed]
    if not rows:
        return None
    order = lambda r: (-(r.n_exact / r.joined), -(r.n_exact + (r.left_amount == r.right_amount)), left_amounts.index(r.left_amount), right_amounts.index(r.right_amount))
    r = min(rows, key=order)
    return Amounts(r.left_amount, r.right_amount, r.n_exact / r.joined, r.n_exact, r.joined, r.spread)


def aggregate_probes(one: DataFrame, one_key: str, one_amounts: list[str], many: DataFrame, many_key: str, many_amounts: list[str]) -> DataFrame:
    """(one_amount, many_amount, n_live, n_exact, n_near, worst, spread, joined): one row against the sum of its many.

    The many side is summed by key before the join. ``worst`` is the largest
    difference within the tolerated residual.
    """
    sums = many.where(F.col(many_key).isNotNull()).groupBy(F.col(many_key).alias("__k")).agg(*[F.sum(F.coalesce(F.col(c).try_cast("decimal(38,6)"), F.lit(0))).cast("double").alias(f"__m{j}") for j, c in enumerate(many_amounts)])
    both = one.select(F.col(one_key).alias("__k"), *[_double(c).alias(f"__o{i}") for i, c in enumerate(one_amounts)]).join(sums, "__k")
    pairs, aggs = [(i, j) for i in range(len(one_amounts)) for j in range(len(many_amounts))], [F.count("*").alias("joined")]
    for i, j in pairs:
        o, m = F.col(f"__o{i}"), F.col(f"__m{j}")
        d = F.abs(o - m)
        live = o.isNotNull() & (F.abs(o) >= LIVE)
        near = live & (d <= MAX_RESIDUAL)
        aggs.append(F.struct(F.lit(one_amounts[i]).alias("one_amount"), F.lit(many_amounts[j]).alias("many_amount"), F.count_if(live).alias("n_live"), F.count_if(live & (d < LIVE)).alias("n_exact"), F.count_if(near).alias("n_near"), F.round(F.coalesce(F.max(F.when(near, d)), F.lit(0.0)), 4).alias("worst"), F.count_distinct(F.when(near, F.round(o, 2))).alias("spread")).alias(f"s{i}_{j}"))
    return both.agg(*aggs).select("joined", F.explode(F.array(*[F.col(f"s{i}_{j}") for i, j in pairs])).alias("s")).select("s.*", "joined")


def best_aggregate_amounts(probes: DataFrame, one_amounts: list[str], many_amounts: list[str]) -> Amounts | None:
    """The best pair of an aggregate relationship, with the tolerance that its near rows need."""
    rows = [r for r in probes.collect() if r.joined and r.n_live >= MIN_AMOUNT_ROWS and r.spread >= 2 and r.n_near / r.joined >= AMOUNT_AGREEMENT]
    if not rows:
        return None
    tolerance = lambda r: math.ceil(round(r.worst, 4) * 100)
    r = min(rows, key=lambda r: (-(r.n_near / r.joined), -r.n_exact, tolerance(r), one_amounts.index(r.one_amount), many_amounts.index(r.many_amount)))
    return Amounts(r.one_amount, r.many_amount, r.n_near / r.joined, r.n_exact, r.joined, r.spread, tolerance(r), "aggregate")


def best_partitioned_amounts(probes: DataFrame, left_amounts: list[str], right_amounts: list[str]) -> tuple[Amounts, str, str] | None:
    """The best pair within one value of a partition column, and that column and value: by rows that agree, then agreement, column and value.

    A narrow partition agrees with itself easily, so the rows it explains decide. A driver choice among pairs.
    """
    rows = [r for r in scored(probes).collect() if r.passed]
    if not rows:
        return None
    r = min(rows, key=lambda r: (-r.n_exact, -(r.n_exact / r.joined), r.part_column, r.part_value, left_amounts.index(r.left_amount), right_amounts.index(r.right_amount)))
    return Amounts(r.left_amount, r.right_amount, r.n_exact / r.joined, r.n_exact, r.joined, r.spread, 0, "partitioned"), r.part_column, r.part_value


def partition_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of the columns with 2 to 12 values, values of three rows or more."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(cells.alias("c")).select("c.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    total = F.count("*").over(Window.partitionBy("column"))
    return counts.withColumn("d", total).where(F.col("d").between(2, PARTITION_MAX_DISTINCT) & (F.col("n") >= 3)).drop("d")


def partitioned_probes(one: DataFrame, one_key: str, one_amounts: list[str], many: DataFrame, many_key: str, many_amounts: list[str], columns: list[str]) -> DataFrame:
    """Row probes within each value of each partition column of the many side, all in one grouped aggregate."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("part_column"), F.col(c).cast("string").alias("part_value")) for c in columns]))
    split = many.select(many_key, *many_amounts, cells.alias("c")).select(many_key, *many_amounts, "c.*")
    kept = partition_values(many, columns).select(F.col("column").alias("part_column"), F.col("value").alias("part_value"))
    # a dozen values a column at most
    split = split.join(F.broadcast(kept), ["part_column", "part_value"], "left_semi")
    return row_probes(one, one_key, one_amounts, split, many_key, many_amounts, ["part_column", "part_value"])
