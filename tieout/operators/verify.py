"""Independent verification of proposals: invariants recomputed from source rows, as one job over all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.expr import exact_number, hundredths, minor_of_characters, money_characters
from tieout.operators.profile import source_columns
from tieout.sources.store import written

#: Money-like cells up to which sums and differences of two cells are tried.
MAX_PAIR_COLUMNS = 12
CODES = (
    "members_resolve",
    "spans_two_datasets",
    "member_record_consistent",
    "amounts_traceable",
    "balance_recomputed",
    "balance_matches_record",
    "single_claim_per_edge",
    "currency_uniform",
    "timing_consistent",
    "no_residual_evidence",
    "confidence_consistent",
    "duplicate_rows_excluded",
)


def with_cells(df: DataFrame, columns: list[str], name: str = "cells") -> DataFrame:
    """``df`` with the cells of ``columns`` in order: column, money value or null, whole number or null.

    Ids are included, as the lenient reading takes them. What a text's money
    characters are is a column of its own first, so it is found once a cell;
    whole and decimal numbers are scaled as they are. A value beyond 64 bits is null.
    """
    kinds = dict(df.dtypes)
    texts = {c: f"__kept{i}" for i, c in enumerate(columns) if not exact_number(kinds[c])}
    read = df.select("*", *[money_characters(F.col(c)).alias(k) for c, k in texts.items()])
    value = lambda c: minor_of_characters(F.col(texts[c])) if c in texts else hundredths(F.col(c))
    own = [F.struct(F.lit(c).alias("column"), value(c).alias("minor"), F.col(c).cast("string").try_cast("bigint").alias("whole")) for c in columns]
    return read.select(*df.columns, F.array(*own).alias(name))


def source_cells(sources: dict[str, DataFrame]) -> DataFrame:
    """(dataset, row_id, cells): the cells of each row."""
    return reduce(DataFrame.unionByName, [with_cells(df, source_columns(df)).select(F.lit(name).alias("dataset"), "row_id", "cells") for name, df in sources.items()])


def resolve(members: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Members with ``resolved``: whether the source has the row they point at."""
    ids = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("dataset"), "row_id") for n, df in sources.items()]).withColumn("resolved", F.lit(True))
    return members.join(ids, ["dataset", "row_id"], "left").fillna(False, ["resolved"])


def trace_of(amount: Column, cells: Column) -> Column:
    """How cells give an amount ('cell', 'minor', 'difference', 'sum') or null. Zero is never traced, and cells without a money value tell nothing.

    ``cells`` should be a plain column: lambdas make an expression anew for each pair.
    """
    a = F.abs(amount)
    c = F.coalesce(cells, F.array().cast("array<struct<column:string,minor:bigint,whole:bigint>>"))
    few = F.size(F.filter(c, lambda x: x["minor"].isNotNull())) <= MAX_PAIR_COLUMNS

    def pairs(fit) -> Column:
        return F.exists(c, lambda x: F.exists(c, lambda y: (x["column"] != y["column"]) & fit(x["minor"], y["minor"])))

    return (
        F.when(amount.isNull() | (a == 0), F.lit(None))
        .when(F.exists(c, lambda x: F.abs(x["minor"]) == a), "cell")
        .when(F.exists(c, lambda x: x["minor"].isNotNull() & (F.abs(x["whole"]) == a)), "minor")
        .when(few & pairs(lambda x, y: F.abs(F.try_subtract(x, y)) == a), "difference")
        .when(few & pairs(lambda x, y: F.abs(F.try_add(x, y)) == a), "sum")
    )


def traced(members: DataFrame, cells: DataFrame) -> DataFrame:
    """Members with ``traced_by``: how the row's own cells give the amount, as of ``trace_of``."""
    both = members.join(cells, ["dataset", "row_id"], "left")
    return both.select(*members.columns, trace_of(F.col("amount_minor"), F.col("cells")).alias("traced_by"))


def currency_column(df: DataFrame) -> str | None:
    """The first text column whose values, twenty at most, are all three-letter codes."""
    texts = [c for c, t in df.dtypes if t == "string" and c in source_columns(df)]
    if not texts:
        return None
    row = df.agg(*[F.bool_and(F.upper(F.trim(c)).rlike("^[A-Z]{3}$")).alias(f"ok_{c}") for c in texts], *[F.approx_count_distinct(c).alias(f"n_{c}") for c in texts]).first()
    # the estimate only screens; the count that decides is exact
    for c in texts:
        if row[f"ok_{c}"] and row[f"n_{c}"] <= 40 and df.select(F.upper(F.trim(c))).distinct().limit(21).count() <= 20:
            return c
    return None


def currencies(members: DataFrame, sources: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """(proposal_id, n_with_currency, n_currencies) over the members of datasets with a currency column."""
    parts = [sources[n].select(F.lit(n).alias("dataset"), "row_id", F.upper(F.trim(c)).alias("currency")) for n, c in columns.items() if c]
    if not parts:
        return members.where(F.lit(False)).select("proposal_id", F.lit(0).cast("bigint").alias("n_with_currency"), F.lit(0).cast("bigint").alias("n_currencies"))
    rows = members.join(reduce(DataFrame.unionByName, parts), ["dataset", "row_id"]).withColumn("currency", F.when(F.col("currency") != "", F.col("currency")))
    return rows.groupBy("proposal_id").agg(F.count("currency").alias("n_with_currency"), F.count_distinct("currency").alias("n_currencies"))


def clashes(props: DataFrame, members: DataFrame, status: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """(proposal_id, n_clashes): members that another accepted proposal holds on the same edge.

    ``recorded`` has the members of every proposal that ``status`` knows; without it ``members`` has.
    """
    own = members.join(props.select("proposal_id", "edge"), "proposal_id").select("proposal_id", "edge", "dataset", "row_id")
    accepted = status.where("status = 'accepted'").select("proposal_id", "edge")
    held = (members if recorded is None else recorded).join(accepted, "proposal_id").select(F.col("proposal_id").alias("by"), "edge", "dataset", "row_id")
    return own.join(held, ["edge", "dataset", "row_id"]).where("by <> proposal_id").groupBy("proposal_id").agg(F.count("*").alias("n_clashes"))


def population_columns(props: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(rule, dataset, column): for each dataset the column that holds most of a rule's group keys; ties by column order."""
    from tieout.operators.profile import long_values

    keys = props.select("rule", F.col("group_key").alias("value")).distinct()
    values = long_values(sources).select("dataset", "ordinal", "column", "value").distinct()
    hit = values.join(keys, "value").groupBy("rule", "dataset", "column", "ordinal").agg(F.count("*").alias("n"))
    return hit.groupBy("rule", "dataset").agg(F.max_by("column", F.struct("n", -F.col("ordinal"))).alias("column"))


def _visible(sources: dict[str, DataFrame], columns: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, dataset, group_key, n_visible): the rows that carry a key in a rule's population column."""
    parts = [sources[n].select(F.lit(rule).alias("rule"), F.lit(n).alias("dataset"), F.trim(F.col(c).cast("string")).alias("group_key")) for rule, n, c in columns]
    return reduce(DataFrame.unionByName, parts).groupBy("rule", "dataset", "group_key").agg(F.count("*").alias("n_visible"))


def residual_evidence(props: DataFrame, members: DataFrame, sources: dict[str, DataFrame], columns: list[tuple[str, str, str]]) -> DataFrame:
    """(proposal_id, n_taken, n_visible, n_left) over the datasets that a group has members in.

    ``columns`` is (rule, dataset, population column). Visible are the rows that
    carry the group's key there, left those of a dataset beyond what the group
    took of it. Groups whose key no such column carries are absent.
    """
    if not columns:
        return props.where(F.lit(False)).select("proposal_id", *[F.lit(0).cast("bigint").alias(c) for c in ("n_taken", "n_visible", "n_left")])
    visible = _visible(sources, columns)
    taken = members.groupBy("proposal_id", "dataset").agg(F.count("*").alias("n_taken")).join(props.select("proposal_id", "rule", "group_key"), "proposal_id")
    both = taken.join(visible, ["rule", "dataset", "group_key"])
    left = F.sum(F.greatest(F.col("n_visible") - F.col("n_taken"), F.lit(0).cast("bigint")))
    return both.groupBy("proposal_id").agg(F.sum("n_taken").alias("n_taken"), F.sum("n_visible").alias("n_visible"), left.alias("n_left"))


def duplicated(members: DataFrame, marks: DataFrame) -> DataFrame:
    """(proposal_id, n_duplicates): members whose first copy is in the same group; ``marks`` is (dataset, row_id, dup_of)."""
    own = members.select("proposal_id", "dataset", "row_id").join(marks.where("dup_of IS NOT NULL"), ["dataset", "row_id"])
    first = members.select("proposal_id", "dataset", F.col("row_id").alias("dup_of"))
    return own.join(first, ["proposal_id", "dataset", "dup_of"], "left_semi").groupBy("proposal_id").agg(F.count("*").alias("n_duplicates"))


def _facts(props: DataFrame, members: DataFrame, sources: dict[str, DataFrame], currency: dict[str, str], population: list[tuple[str, str, str]], status: DataFrame | None, recorded: DataFrame | None, marks: DataFrame | None) -> DataFrame:
    """What is known of each proposal, from one union of narrow rows that is added up by proposal and dataset, then by proposal.

    Each row says one thing: a member as recorded, a member's source row as it is
    now, a clash with an accepted claim, a copy beside its first, or how many rows
    carry the group's key. Each source is joined once, its money cells are read
    only where a member points, and a large group is added up where its rows are.
    """
    rows = [members.select("proposal_id", "dataset", F.lit(1).alias("n"), "amount_minor")]
    for name, df in sources.items():
        # the source's columns keep their names, so the member's step aside
        own = members.where(F.col("dataset") == name).select(F.col("proposal_id").alias("__p"), F.col("amount_minor").alias("__a"), "row_id")
        now = own.join(df.select("row_id", *source_columns(df)), "row_id")
        code = F.upper(F.trim(currency[name])) if currency.get(name) else F.lit("")
        now = with_cells(now.withColumn("__code", F.when(code != "", code)), source_columns(df), "__cells")
        rows.append(now.select(F.col("__p").alias("proposal_id"), F.lit(name).alias("dataset"), F.lit(1).alias("resolved"), trace_of(F.col("__a"), F.col("__cells")).isNotNull().cast("int").alias("traced"), F.col("__code").alias("currency")))
    if status is not None:
        accepted = status.where("status = 'accepted'").select("proposal_id", "edge")
        held = (members if recorded is None else recorded).join(accepted, "proposal_id").groupBy("edge", "dataset", "row_id").agg(F.count("*").alias("claims"), F.min("proposal_id").alias("by"))
        own = members.join(props.select("proposal_id", "edge"), "proposal_id").select("proposal_id", "edge", "dataset", "row_id")
        rows.append(own.join(held, ["edge", "dataset", "row_id"]).where("claims > 1 OR by <> proposal_id").select("proposal_id", "dataset", F.lit(1).alias("clash")))
    if marks is not None:
        rows.append(duplicated(members, marks).select("proposal_id", F.lit("").alias("dataset"), F.col("n_duplicates").alias("copies")))
    if population:
        rows.append(_visible(sources, population).join(props.select("proposal_id", "rule", "group_key"), ["rule", "group_key"]).select("proposal_id", "dataset", F.col("n_visible").alias("visible")))
    kinds = {"n": "int", "amount_minor": "bigint", "resolved": "int", "traced": "int", "currency": "string", "clash": "int", "copies": "bigint", "visible": "bigint"}
    whole = [r.select("proposal_id", "dataset", *[(F.col(c) if c in r.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]) for r in rows]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sides = reduce(DataFrame.unionByName, whole).groupBy("proposal_id", "dataset").agg(
        total("n"), F.count("amount_minor").alias("n_amounts"), F.sum("amount_minor").alias("balance"), total("resolved"), total("traced"), F.count("currency").alias("n_currency"), F.min("currency").alias("low"), F.max("currency").alias("high"), total("clash"), total("copies"), F.max("visible").alias("visible")
    )
    has = F.col("n") > 0
    return sides.groupBy("proposal_id").agg(
        (F.sum("n") == F.sum("resolved")).alias("resolved"),
        F.sum("n").alias("n"),
        F.count_if(has).alias("n_datasets"),
        F.array_join(F.array_sort(F.collect_set(F.when(has, F.col("dataset")))), ",").alias("edge_now"),
        F.sum("n_amounts").alias("n_amounts"),
        F.sum("traced").alias("n_traced"),
        F.sum("balance").cast("bigint").alias("balance_now"),
        F.sum("n_currency").alias("n_with_currency"),
        (F.min("low") == F.max("high")).alias("one_currency"),
        F.sum("clash").alias("n_clashes"),
        F.sum("copies").alias("n_duplicates"),
        F.sum(F.when(has, F.greatest(F.col("visible") - F.col("n"), F.lit(0)))).alias("n_left"),
    )


def _invariant(code: str, passed: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), passed.cast("boolean").alias("passed"))


def verify(
    props: DataFrame,
    members: DataFrame,
    sources: dict[str, DataFrame],
    currency: dict[str, str],
    population: list[tuple[str, str, str]],
    timed: DataFrame | None = None,
    status: DataFrame | None = None,
    recorded: DataFrame | None = None,
    marks: DataFrame | None = None,
) -> DataFrame:
    """(proposal_id, status, checked, failed, invariants) of every proposal.

    An invariant passes, fails or doesn't apply (null); a proposal fails if any
    of its invariants does. ``population`` is (rule, dataset, column); ``recorded``
    has the members of the proposals of ``status``; ``marks`` are duplicate marks,
    which are reported and never fail.
    """
    members = written(members, "verifying")
    facts = _facts(props, members, sources, currency, population, status, recorded, marks)
    joined = props.join(facts, "proposal_id", "left")
    joined = joined.join(timed.select("rule", "group_key", "late"), ["rule", "group_key"], "left") if timed is not None else joined.withColumn("late", F.lit(None).cast("boolean"))
    amounts = F.col("n_amounts") > 0
    whole = F.col("has_amounts") & amounts
    claims = F.col("confidence").isin("exact", "within_tolerance")
    within = F.abs("balance_now") <= F.col("tolerance_minor")
    derived = F.when(F.col("balance_now") == 0, "exact").when(within, "within_tolerance").otherwise("unbalanced")
    checks = F.array(
        _invariant("members_resolve", F.coalesce("resolved", F.lit(False))),
        _invariant("spans_two_datasets", F.coalesce(F.col("n_datasets") >= 2, F.lit(False))),
        _invariant("member_record_consistent", F.coalesce((F.col("n") == F.col("member_count")) & (F.col("edge_now") == F.col("edge")), F.lit(False))),
        _invariant("amounts_traceable", F.when(amounts, F.col("n_traced") == F.col("n_amounts"))),
        _invariant("balance_recomputed", F.when(whole & claims & (F.col("n_traced") == F.col("n_amounts")), within)),
        _invariant("balance_matches_record", F.when(whole, F.col("balance_now") == F.col("balance_minor"))),
        _invariant("single_claim_per_edge", F.coalesce(F.col("n_clashes"), F.lit(0)) == 0),
        _invariant("currency_uniform", F.when(F.col("n_with_currency") >= 2, F.col("one_currency"))),
        _invariant("timing_consistent", ~F.col("late")),
        _invariant("no_residual_evidence", F.coalesce(F.col("n_left"), F.lit(0)) == 0),
        _invariant("confidence_consistent", F.when(whole & F.col("confidence").isin("exact", "within_tolerance", "unbalanced"), derived == F.col("confidence"))),
    )
    # said only where there are any, and never judged
    said = F.when(F.col("n_duplicates") > 0, F.array(_invariant("duplicate_rows_excluded", F.lit(None)))).otherwise(F.array().cast("array<struct<code:string,passed:boolean>>"))
    out = joined.select("proposal_id", F.concat(checks, said).alias("invariants"))
    failed = F.transform(F.filter("invariants", lambda x: ~x["passed"]), lambda x: x["code"])
    return out.select("proposal_id", F.when(F.size(failed) > 0, "fail").otherwise("pass").alias("status"), F.size(F.filter("invariants", lambda x: x["passed"].isNotNull())).alias("checked"), failed.alias("failed"), "invariants")


def latest(log: DataFrame, by: str = "proposal_id", order: str = "seq") -> DataFrame:
    """The last record of each proposal in an append-only log."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
