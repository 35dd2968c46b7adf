"""Which columns join: value overlap between sources, and tracing a value through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.operators.profile import long_values

# Fixed values of the overlap and trace rules.
MIN_DISTINCT = 2
ENUM_MAX_DISTINCT = 12
MIN_COVERAGE = 0.25
USABLE_COVERAGE = 0.5
FANOUT = 4
MAX_HITS = 24


def column_values(sources: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(dataset, ordinal, column, value, n) of the distinct non-blank values of every column; one shuffle with partial counts."""
    return long_values(sources, columns).where("value <> ''").groupBy("dataset", "ordinal", "column", "value").agg(F.count("*").alias("n"))


def column_stats(values: DataFrame) -> DataFrame:
    """(dataset, ordinal, column, n_distinct, n_rows, enum_like): a column is enum-like with few values that repeat."""
    s = values.groupBy("dataset", "ordinal", "column").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_rows"))
    return s.withColumn("enum_like", (F.col("n_distinct") <= ENUM_MAX_DISTINCT) & (F.col("n_rows") > 2 * F.col("n_distinct")))


def overlap_matrix(values: DataFrame, k: int | None = 40) -> DataFrame:
    """Join candidates between columns of different sources, best first.

    (left_dataset, left_column, right_dataset, right_column, shared,
    left_coverage, right_coverage, jaccard, left_ordinal, right_ordinal). Shared
    values are counted by an equi-join of the distinct values, so cost follows
    the values and not the pairs of columns; pairs of two enum-like columns are
    dropped before it. ``k`` is the length of the report, None for all.
    """
    stats = column_stats(values).where(F.col("n_distinct") >= MIN_DISTINCT)
    # at most one row a column: small, and joined to the values by column
    known = values.join(stats, ["dataset", "ordinal", "column"]).select("dataset", "ordinal", "column", "value", "n_distinct", "enum_like")
    l, r = known.alias("l"), known.alias("r")
    met = l.join(r, (F.col("l.value") == F.col("r.value")) & (F.col("l.dataset") < F.col("r.dataset")) & ~(F.col("l.enum_like") & F.col("r.enum_like")))
    keys = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("l", "left"), ("r", "right")) for c in ("dataset", "column", "ordinal", "n_distinct")]
    pairs = met.select(*keys).groupBy(*[f"{n}_{c}" for n in ("left", "right") for c in ("dataset", "column", "ordinal", "n_distinct")]).agg(F.count("*").alias("shared"))
    lc, rc = F.col("shared") / F.col("left_n_distinct"), F.col("shared") / F.col("right_n_distinct")
    out = pairs.where(F.greatest(lc, rc) >= MIN_COVERAGE).select(
        "left_dataset",
        "left_column",
        "right_dataset",
        "right_column",
        "shared",
        F.round(lc, 3).alias("left_coverage"),
        F.round(rc, 3).alias("right_coverage"),
        F.round(F.col("shared") / (F.col("left_n_distinct") + F.col("right_n_distinct") - F.col("shared")), 3).alias("jaccard"),
        "left_ordinal",
        "right_ordinal",
    )
    order = [F.desc(F.greatest("left_coverage", "right_coverage")), F.desc("shared"), "left_dataset", "left_ordinal", "right_dataset", "right_ordinal"]
    return out.orderBy(*order) if k is None else out.orderBy(*order).limit(k)


def usable_pairs(pairs: DataFrame, text_columns: dict[str, list[str]], min_coverage: float = USABLE_COVERAGE) -> DataFrame:
    """Candidates between two text columns of which one is covered by ``min_coverage`` or more."""
    text = {f"{d}.{c}" for d, cs in text_columns.items() for c in cs}
    both = [F.concat_ws(".", f"{s}_dataset", f"{s}_column").isin(*text) for s in ("left", "right")]
    return pairs.where(both[0] & both[1] & (F.greatest("left_coverage", "right_coverage") >= min_coverage))


def strongest_keys(pairs: DataFrame) -> DataFrame:
    """The best candidate of each pair of sources; ties by shared values, then column order."""
    best = F.greatest("left_coverage", "right_coverage")
    rank = F.row_number().over(Window.partitionBy("left_dataset", "right_dataset").orderBy(F.desc(best), F.desc("shared"), "left_ordinal", "right_ordinal"))
    return pairs.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def identifier_columns(values: DataFrame) -> DataFrame:
    """(dataset, column) of the columns that name things rather than classes of things."""
    return column_stats(values).where("NOT enum_like").select("dataset", "column")


def examples(values: DataFrame, left: tuple[str, str], right: tuple[str, str], k: int = 3) -> DataFrame:
    """The k smallest shared values of two columns."""
    a, b = (values.where((F.col("dataset") == d) & (F.col("column") == c)).select("value") for d, c in (left, right))
    return a.join(b, "value", "left_semi").orderBy("value").limit(k)


def trace(index: DataFrame, value: str, max_hops: int = 2, fanout: int = FANOUT, max_hits: int | None = MAX_HITS) -> DataFrame:
    """(dataset, row_id, hop, via) of rows that a value leads to over identifier columns.

    ``index`` is ``long_values`` over identifier columns. Hop 0 holds the rows
    with the value, up to fanout + 1 a column; later hops follow the rows' other
    identifiers of 3 to 64 characters without blanks, leaving out a token that
    more than ``fanout`` rows of a column share. A row appears at its first hop.
    ``max_hits`` is the length of the report, None for all.
    """
    index = index.select("dataset", "row_id", "column", "value")
    nth = F.row_number().over(Window.partitionBy("dataset", "column").orderBy("row_id"))
    seen = index.where(F.col("value") == value).withColumn("nth", nth).where(F.col("nth") <= fanout + 1)
    seen = seen.groupBy("dataset", "row_id").agg(F.min("value").alias("via")).withColumn("hop", F.lit(0))
    used = seen.sparkSession.createDataFrame([(value,)], "token string")
    frontier = seen
    for hop in range(1, max_hops + 1):
        cells = index.join(frontier.select("dataset", "row_id"), ["dataset", "row_id"], "left_semi")
        tokens = cells.where("length(value) BETWEEN 3 AND 64 AND NOT value RLIKE '[ ]'").select(F.col("value").alias("token")).distinct().join(used, "token", "left_anti")
        hits = index.join(tokens, F.col("value") == F.col("token"))
        common = hits.groupBy("token", "dataset", "column").agg(F.count("*").alias("n")).where(F.col("n") <= fanout)
        found = hits.join(common, ["token", "dataset", "column"], "left_semi").join(seen, ["dataset", "row_id"], "left_anti")
        frontier = found.groupBy("dataset", "row_id").agg(F.min("token").alias("via")).withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
        used = used.unionByName(tokens)
    order = ["hop", "dataset", "row_id"]
    out = seen.select("dataset", "row_id", "hop", "via")
    return out if max_hits is None else out.orderBy(*order).limit(max_hits)
