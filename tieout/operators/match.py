"""Match groups: members from a rule, balances, confidence, and what keeps a group back.

Members are rows (group_key, dataset, row_id, role, amount_minor); a proposal is
what one group of a rule comes to. Everything is set-based: one shuffle by group
assembles, and claims and rejections are anti-joins by edge and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.expr import minor
from tieout.sources.store import written

CONFIDENCE = ("exact", "within_tolerance", "high", "ambiguous", "unbalanced")
OPEN_STATUSES = ("pending", "accepted", "review_later")


def _member(name: str, row: str, role: str, amount: Column) -> Column:
    return F.struct(F.lit(name).alias("dataset"), F.col(row).alias("row_id"), F.lit(role).alias("role"), amount.cast("bigint").alias("amount_minor"))


def row_level_members(left: tuple[str, DataFrame, str, str | None], right: tuple[str, DataFrame, str, str | None], where: Column | None = None) -> DataFrame:
    """Members of a one-to-one rule: both rows of each joined pair, from a single join.

    A side is (name, rows, key, amount or None); the right amount is negated so
    that a balanced group sums to 0. ``where`` restricts the right side.
    """
    (ln, l, lk, la), (rn, r, rk, ra) = left, right
    r = r if where is None else r.where(where)
    amount = lambda c, sign: F.lit(None) if c is None else sign * minor(F.col(c))
    a = l.select(F.col(lk).cast("string").alias("group_key"), _member(ln, "row_id", "left", amount(la, 1)).alias("a"))
    b = r.select(F.col(rk).cast("string").alias("group_key"), _member(rn, "row_id", "right", amount(ra, -1)).alias("b"))
    return a.join(b, "group_key").select("group_key", F.explode(F.array("a", "b")).alias("m")).select("group_key", "m.*")


def aggregate_members(one: tuple[str, DataFrame, str, str | None], many: tuple[str, DataFrame, str, str | None]) -> DataFrame:
    """Members of a one-to-many rule: rows of either side whose key the other side has, by two semi-joins."""
    (on, o, ok, oa), (mn, m, mk, ma) = one, many
    amount = lambda c, sign: F.lit(None) if c is None else sign * minor(F.col(c))
    a = o.select(F.col(ok).cast("string").alias("group_key"), _member(on, "row_id", "one", amount(oa, 1)).alias("m"))
    b = m.select(F.col(mk).cast("string").alias("group_key"), _member(mn, "row_id", "many", amount(ma, -1)).alias("m"))
    kept_a, kept_b = a.join(b, "group_key", "left_semi"), b.join(a, "group_key", "left_semi")
    return kept_a.unionByName(kept_b).select("group_key", "m.*")


def collapsed(members: DataFrame) -> DataFrame:
    """One row for each (group, dataset, row), of each rule where rules are named; of repeats the one with the first role and smallest amount."""
    keys = [*(["rule"] if "rule" in members.columns else []), "group_key", "dataset", "row_id"]
    return members.groupBy(*keys).agg(F.min(F.struct("role", "amount_minor")).alias("f")).select(*keys, "f.role", "f.amount_minor")


def contested_rows(members: DataFrame) -> DataFrame:
    """(dataset, row_id, n_groups) of rows in more than one group."""
    return members.groupBy("dataset", "row_id").agg(F.count_distinct("group_key").alias("n_groups")).where("n_groups > 1")


def confidence(contested: Column, has_amounts: Column, balance: Column, tolerance: Column, n_datasets: Column) -> Column:
    return (
        F.when(contested, "ambiguous")
        .when(has_amounts & (balance != 0) & (F.abs(balance) > tolerance), "unbalanced")
        .when(n_datasets < 2, "ambiguous")
        .when(has_amounts & (balance == 0), "exact")
        .when(has_amounts, "within_tolerance")
        .otherwise("high")
    )


def proposals(members: DataFrame, rule: str, tolerance_minor: int = 0) -> DataFrame:
    """(proposal_id, rule, group_key, edge, member_count, balance_minor, has_amounts, contested, tolerance_minor, confidence).

    A group needs two members; ids follow from rule, key and members, so running
    a rule again gives the same ids.
    """
    return _groups(collapsed(members).withColumn("rule", F.lit(rule)), tolerance_minor)


def _groups(rows: DataFrame, tolerance_minor: int) -> DataFrame:
    """``proposals`` of collapsed members of any number of rules."""
    twice = F.count("*").over(Window.partitionBy("rule", "dataset", "row_id")) > 1
    marked = rows.withColumn("shared", twice)
    groups = marked.groupBy("rule", "group_key").agg(
        F.count("*").alias("member_count"),
        F.sum(F.coalesce("amount_minor", F.lit(0))).cast("bigint").alias("balance_minor"),
        (F.count("*") == F.count("amount_minor")).alias("has_amounts"),
        F.max("shared").alias("contested"),
        F.array_join(F.array_sort(F.collect_set("dataset")), ",").alias("edge"),
        F.count_distinct("dataset").alias("n_datasets"),
        # order-free digest of the members: no list of a group is gathered
        F.bit_xor(F.xxhash64("dataset", "row_id")).alias("digest"),
    )
    groups = groups.where("member_count >= 2")
    tol = F.lit(tolerance_minor).cast("bigint")
    return groups.select(
        F.xxhash64("rule", "group_key", "digest").alias("proposal_id"),
        "rule",
        "group_key",
        "edge",
        "member_count",
        F.when(F.col("has_amounts"), F.col("balance_minor")).alias("balance_minor"),
        "has_amounts",
        "contested",
        tol.alias("tolerance_minor"),
        confidence(F.col("contested"), F.col("has_amounts"), F.col("balance_minor"), tol, F.col("n_datasets")).alias("confidence"),
    )


def members_of(props: DataFrame, members: DataFrame) -> DataFrame:
    """Collapsed members with their proposal's id."""
    return collapsed(members).join(props.select("proposal_id", "group_key"), "group_key").select("proposal_id", "group_key", "dataset", "row_id", "role", "amount_minor")


def both_of(members: DataFrame, tolerance_minor: int = 0) -> tuple[DataFrame, DataFrame]:
    """(proposals, their members) of all rules at once; ``members`` have a ``rule``.

    Rows are collapsed and stored once; the groups come from one pass over them
    and the ids go back to them by one join.
    """
    rows = written(collapsed(members), "collapsed")
    props = written(_groups(rows, tolerance_minor), "groups")
    own = rows.join(props.select("proposal_id", "rule", "group_key"), ["rule", "group_key"])
    return props, own.select("proposal_id", "group_key", "dataset", "row_id", "role", "amount_minor")


def duplicate_members(members: DataFrame, marks: DataFrame) -> DataFrame:
    """Members with duplicate_of set where the row's first copy is in the same group; ``marks`` is (dataset, row_id, dup_of)."""
    flagged = members.join(marks, ["dataset", "row_id"], "left")
    first = members.select(F.col("group_key"), F.col("dataset"), F.col("row_id").alias("dup_of"), F.lit(True).alias("here"))
    return flagged.join(first, ["group_key", "dataset", "dup_of"], "left").select(*members.columns, F.when(F.col("here"), F.col("dup_of")).alias("duplicate_of"))


def claimed(status: DataFrame, members: DataFrame, wanted: str = "accepted") -> DataFrame:
    """(edge, dataset, row_id) of rows in proposals of a status."""
    return members.join(status.where(F.col("status") == wanted).select("proposal_id", "edge"), "proposal_id").select("edge", "dataset", "row_id").distinct()


def skip_reasons(props: DataFrame, members: DataFrame, existing: DataFrame, claims: DataFrame) -> DataFrame:
    """(proposal_id, reason): groups that are not proposed again ('existing_key') or hold a row claimed on their edge ('claimed')."""
    rows = members.join(props.select("proposal_id", "edge"), "proposal_id")
    hit = rows.join(claims, ["edge", "dataset", "row_id"], "left_semi").select("proposal_id").distinct().withColumn("c", F.lit(True))
    known = existing.where("status <> 'rejected'").select("rule", "group_key").distinct().withColumn("k", F.lit(True))
    both = props.join(known, ["rule", "group_key"], "left").join(hit, "proposal_id", "left")
    return both.select("proposal_id", F.when(F.col("k"), "existing_key").when(F.col("c"), "claimed").alias("reason")).where("reason IS NOT NULL")


def held_back(props: DataFrame, members: DataFrame, rejected: DataFrame) -> DataFrame:
    """proposal_id of groups that touch a row rejected on their edge; these wait for a person."""
    rows = members.join(props.select("proposal_id", "edge"), "proposal_id")
    return rows.join(rejected, ["edge", "dataset", "row_id"], "left_semi").select("proposal_id").distinct()


def eligible(props: DataFrame, trusted: list[str], held: DataFrame) -> DataFrame:
    """Groups that a trusted rule may release without a person: exact and not held back."""
    ok = (F.col("confidence") == "exact") & F.col("rule").isin(*trusted)
    return props.where(ok).join(held, "proposal_id", "left_anti")


def against(members: DataFrame, props: DataFrame, dataset: str, counterpart: str | None) -> DataFrame:
    """``members`` of proposals whose edge links ``dataset`` with ``counterpart``; all of them without one."""
    if counterpart is None:
        return members
    sides = F.split("edge", ",")
    linking = props.where(F.array_contains(sides, dataset) & F.array_contains(sides, counterpart))
    return members.join(linking.select("proposal_id"), "proposal_id", "left_semi")


def unmatched(rows: DataFrame, dataset: str, members: DataFrame) -> DataFrame:
    """Rows of a source that no given member stands for."""
    return rows.join(members.where(F.col("dataset") == dataset).select("row_id").distinct(), "row_id", "left_anti")


def explained(note: DataFrame, props: DataFrame) -> DataFrame:
    """``note`` with explains_residual: whether a group balances within its tolerance once duplicates are left out."""
    both = note.join(props.select("group_key", "tolerance_minor"), "group_key")
    return both.select(*note.columns, (F.abs("balance_without") <= F.col("tolerance_minor")).alias("explains_residual"))


def duplicate_note(members: DataFrame) -> DataFrame:
    """(group_key, duplicate_minor, balance_without): what duplicate members add to a group's balance."""
    dup = F.sum(F.when(F.col("duplicate_of").isNotNull(), F.col("amount_minor")).otherwise(0)).cast("bigint")
    g = members.groupBy("group_key").agg(dup.alias("duplicate_minor"), F.sum("amount_minor").cast("bigint").alias("balance_minor"), F.count("duplicate_of").alias("n_duplicates"))
    return g.where("n_duplicates > 0").select("group_key", "duplicate_minor", "balance_minor", (F.col("balance_minor") - F.col("duplicate_minor")).alias("balance_without"))


def unmatched_examples(rows: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """The first rows by id, a few columns of each, for a report."""
    return rows.select("row_id", *columns).orderBy("row_id").limit(k)
