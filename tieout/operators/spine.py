"""Flow order of sources: which one comes first, and the order of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the spine rules.
CONTAINMENT = 0.99
PRECEDENCE_AGREEMENT = 0.8
MIN_PAIR_ROWS = 5


def adjacency(members: DataFrame) -> DataFrame:
    """(a, b): sources that share a proposal, both ways."""
    own = members.select("proposal_id", "dataset").distinct()
    l, r = own.alias("l"), own.alias("r")
    return l.join(r, (F.col("l.proposal_id") == F.col("r.proposal_id")) & (F.col("l.dataset") != F.col("r.dataset"))).select(F.col("l.dataset").alias("a"), F.col("r.dataset").alias("b")).distinct()


def member_pairs(members: DataFrame, a: str, b: str) -> DataFrame:
    """(a_row, b_row) of rows of two sources in one proposal."""
    l = members.where(F.col("dataset") == a).select("proposal_id", F.col("row_id").alias("a_row"))
    r = members.where(F.col("dataset") == b).select("proposal_id", F.col("row_id").alias("b_row"))
    return l.join(r, "proposal_id").select("a_row", "b_row").distinct()


def precedence(pairs: DataFrame, left: DataFrame, left_dates: list[str], right: DataFrame, right_dates: list[str]) -> DataFrame:
    """(left_column, right_column, n_before, n_after, agreement) for every pair of date columns, as ISO text.

    Ties and values that aren't ISO-shaped don't count. All column pairs are
    counted over one join.
    """
    l = left.select(F.col("row_id").alias("a_row"), *[F.col(c).cast("string").alias(f"__l{i}") for i, c in enumerate(left_dates)])
    r = right.select(F.col("row_id").alias("b_row"), *[F.col(c).cast("string").alias(f"__r{j}") for j, c in enumerate(right_dates)])
    both = pairs.join(l, "a_row").join(r, "b_row")
    cells, aggs = [], []
    for i, lc in enumerate(left_dates):
        for j, rc in enumerate(right_dates):
            x, y = F.col(f"__l{i}"), F.col(f"__r{j}")
            iso = x.rlike("^[0-9]{4}-") & y.rlike("^[0-9]{4}-")
            aggs += [F.count_if(iso & (x < y)).alias(f"b{i}_{j}"), F.count_if(iso & (x > y)).alias(f"a{i}_{j}")]
            cells.append(F.struct(F.lit(lc).alias("left_column"), F.lit(rc).alias("right_column"), F.col(f"b{i}_{j}").alias("n_before"), F.col(f"a{i}_{j}").alias("n_after")))
    out = both.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return out.withColumn("agreement", F.round(F.try_divide(F.greatest("n_before", "n_after"), F.col("n_before") + F.col("n_after")), 6))


def precedence_edge(counts: DataFrame, a: str, b: str) -> tuple[str, str] | None:
    """(earlier, later) if the column pair with most decided rows has five and agrees in four of five. A driver choice among column pairs."""
    rows = sorted(counts.collect(), key=lambda r: -(r.n_before + r.n_after))
    if not rows or (n := rows[0].n_before + rows[0].n_after) < MIN_PAIR_ROWS:
        return None
    best = max(rows[0].n_before, rows[0].n_after)
    if best / n < PRECEDENCE_AGREEMENT:
        return None
    return (a, b) if rows[0].n_before == best else (b, a)


def flow_order(datasets: list[str], edges: list[tuple[str, str]], degree: dict[str, int] | None = None) -> list[str]:
    """Sources by the number of their direct and indirect predecessors, then degree, then name. Tens of nodes, on the driver."""
    before: dict[str, set[str]] = {d: set() for d in datasets}
    for a, b in edges:
        before[b].add(a)
    while True:
        grown = {d: own | {x for p in own for x in before[p]} - {d} for d, own in before.items()}
        if grown == before:
            return sorted(datasets, key=lambda d: (len(before[d]), -(degree or {}).get(d, 0), d))
        before = grown


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """(value,): the text at position n div 2 of the ordered ISO-shaped values.

    Values are counted by day first; windows run over the days and over the values
    of the one day that holds the median, never over all rows.
    """
    v = df.select(F.col(column).cast("string").alias("v")).where(F.col("v").rlike("^[0-9]{4}-")).groupBy("v").agg(F.count("*").alias("c")).withColumn("day", F.substring("v", 1, 10))
    upto = lambda by: F.sum("c").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    days = v.groupBy("day").agg(F.sum("c").alias("c")).withColumn("upto", upto("day"))
    middle = F.floor(F.max("upto").over(Window.partitionBy()) / 2)
    first = days.withColumn("middle", middle).where(F.col("upto") > F.col("middle")).agg(F.min_by(F.struct("day", (F.col("upto") - F.col("c")).alias("before"), "middle"), "day").alias("f")).select("f.*")
    inside = v.join(F.broadcast(first), "day").withColumn("upto", upto("v"))  # one row
    return inside.where(F.col("before") + F.col("upto") > F.col("middle")).agg(F.min("v").alias("value"))


def stage_order(datasets: list[str], edges: list[tuple[str, str]], medians: dict[str, str]) -> list[str]:
    """Sources as a transaction passes them: by precedence where that is known, else by median date, the undated last as uploaded."""
    if edges:
        known = {x for e in edges for x in e}
        return [d for d in flow_order([d for d in datasets if d in known], edges)] + [d for d in datasets if d not in known]
    return sorted(datasets, key=lambda d: (not medians.get(d), medians.get(d) or "", datasets.index(d)))


def infer_spine(datasets: list[str], edges: list[tuple[str, str]], medians: dict[str, str], containment: dict[tuple[str, str], float], declared: str | None = None) -> tuple[str | None, str]:
    """(spine, why): declared, only, precedence, earliest median, containment or first upload, in this order."""
    if declared in datasets:
        return declared, "declared"
    if not datasets:
        return None, "none"
    if len(datasets) == 1:
        return datasets[0], "only"
    if edges:
        first = flow_order(datasets, edges)[0]
        if any(a == first for a, _ in edges):
            return first, "precedence"
    dated = {d: m for d, m in medians.items() if m}
    if len(dated) > 1 and len(set(dated.values())) > 1:
        return min(dated, key=lambda d: (dated[d], d)), "median"
    # a source whose values all are in another, and not the other way round, depends on it
    inside = [(a, b) for (a, b), c in containment.items() if c >= CONTAINMENT and containment.get((b, a), 0.0) < CONTAINMENT]
    if inside:
        score = {d: (sum(b == d for _, b in inside) - sum(a == d for a, _ in inside), sum(b == d for _, b in inside)) for d in datasets}
        return max(datasets, key=lambda d: (score[d], -datasets.index(d))), "containment"
    return datasets[0], "first"
