"""End-to-end chains: every spine row with the proposals that carry it from stage to stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("exception", "unmatched", "incomplete", "pending", "reconciled")


def labelled_members(spine: DataFrame, spine_name: str, label: str, members: DataFrame, status: DataFrame) -> DataFrame:
    """(label, proposal_id, n_owners): the open proposals of each spine label, and how many labels share one."""
    open_ = status.where(F.col("status").isin("pending", "accepted", "review_later")).select("proposal_id")
    own = members.where(F.col("dataset") == spine_name).join(open_, "proposal_id", "left_semi")
    legs = own.join(spine.select("row_id", F.col(label).cast("string").alias("label")), "row_id").select("label", "proposal_id").distinct()
    owners = legs.groupBy("proposal_id").agg(F.count("*").alias("n_owners"))
    return legs.join(owners, "proposal_id").select("label", "proposal_id", "n_owners")


def reached(legs: DataFrame, members: DataFrame, status: DataFrame) -> DataFrame:
    """(label, proposal_id, n_owners) with one hop more: proposals that hold a row of a label's own proposals.

    A row of a proposal that several labels share goes by the first of them, so a
    batch of k labels and m rows makes m rows and not k * m.
    """
    open_ = status.where(F.col("status").isin("pending", "accepted", "review_later")).select("proposal_id")
    named = legs.groupBy("proposal_id").agg(F.min("label").alias("label"))
    rows = named.join(members, "proposal_id").select("label", "dataset", "row_id").distinct()
    more = legs.select("label", "proposal_id").unionByName(rows.join(members.join(open_, "proposal_id", "left_semi").select("proposal_id", "dataset", "row_id"), ["dataset", "row_id"]).select("label", "proposal_id")).distinct()
    owners = more.groupBy("proposal_id").agg(F.count("*").alias("n_owners"))
    return more.join(owners, "proposal_id").select("label", "proposal_id", "n_owners")


def modal_legs(legs: DataFrame) -> DataFrame:
    """(n_legs,): the commonest number of legs, the lowest of ties."""
    counts = legs.groupBy("label").agg(F.count("*").alias("n_legs")).groupBy("n_legs").agg(F.count("*").alias("c"))
    return counts.agg(F.max_by("n_legs", F.struct("c", -F.col("n_legs"))).alias("modal"))


def chain_states(spine: DataFrame, label: str, legs: DataFrame, status: DataFrame) -> DataFrame:
    """(label, n_legs, n_shared, state) of each spine label."""
    known = legs.join(status.select("proposal_id", "status", "confidence"), "proposal_id")
    facts = known.groupBy("label").agg(
        F.count("*").alias("n_legs"),
        F.count_if(F.col("n_owners") > 1).alias("n_shared"),
        F.bool_or(F.col("confidence").isin("unbalanced", "ambiguous")).alias("broken"),
        F.bool_or(F.col("status") != "accepted").alias("waiting"),
    )
    labels = spine.select(F.col(label).cast("string").alias("label")).where("label IS NOT NULL").distinct()
    both = labels.join(facts, "label", "left").crossJoin(F.broadcast(modal_legs(legs)))  # one row
    state = F.when(F.col("n_legs").isNull(), "unmatched").when(F.col("broken"), "exception").when(F.col("n_legs") < F.col("modal"), "incomplete").when(F.col("waiting"), "pending").otherwise("reconciled")
    return both.select("label", F.coalesce("n_legs", F.lit(0)).alias("n_legs"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"), state.alias("state"))


def hops(legs: DataFrame, members: DataFrame, status: DataFrame, stages: list[str]) -> DataFrame:
    """(label, from_stage, to_stage, proposal_id, hop_state) for each step between neighbouring stages.

    The first leg by id that spans both stages stands for a step; a step that no
    leg spans is missing.
    """
    spans = members.groupBy("proposal_id").agg(F.collect_set("dataset").alias("has"))  # as many as there are stages
    rows = legs.join(spans, "proposal_id").join(status.select("proposal_id", "confidence"), "proposal_id")
    steps = [(a, b) for a, b in zip(stages, stages[1:])]
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage")) for i, (a, b) in enumerate(steps)]))
    every = rows.select("label").distinct().select("label", pair.alias("s")).select("label", "s.*")
    spanning = rows.select("label", "proposal_id", "confidence", "has", pair.alias("s")).select("label", "proposal_id", "confidence", "has", "s.*").where(F.array_contains("has", F.col("from_stage")) & F.array_contains("has", F.col("to_stage")))
    first = spanning.groupBy("label", "step").agg(F.min(F.struct("proposal_id", "confidence")).alias("f")).select("label", "step", "f.*")
    state = F.when(F.col("confidence").isNull(), "missing").when(F.col("confidence") == "exact", "matched").when(F.col("confidence") == "within_tolerance", "tolerance").when(F.col("confidence") == "high", "unchecked").when(F.col("confidence") == "ambiguous", "ambiguous").otherwise("off")
    return every.join(first, ["label", "step"], "left").select("label", "step", "from_stage", "to_stage", "proposal_id", state.alias("hop_state"))


def hop_duplicates(steps: DataFrame, members: DataFrame) -> DataFrame:
    """(label, step, duplicate_in): the sources, by name, of which a step's proposal has more than one row."""
    many = members.groupBy("proposal_id", "dataset").agg(F.count("*").alias("n")).where("n > 1")
    named = many.groupBy("proposal_id").agg(F.array_join(F.array_sort(F.collect_set("dataset")), ",").alias("duplicate_in"))  # as many as there are stages
    return steps.where("proposal_id IS NOT NULL").select("label", "step", "proposal_id").join(named, "proposal_id").select("label", "step", "duplicate_in")


def break_reasons(steps: DataFrame, props: DataFrame) -> DataFrame:
    """(label, reason): the gravest thing on a chain's steps: a difference, an ambiguity, a gap, in this order."""
    rows = steps.join(props.select("proposal_id", "balance_minor"), "proposal_id", "left")
    grave = F.when(F.col("hop_state") == "off", 1).when(F.col("hop_state") == "ambiguous", 2).when(F.col("hop_state") == "missing", 3)
    text = (
        F.when(F.col("hop_state") == "off", F.concat(F.lit("differ by "), F.abs("balance_minor").cast("string"), F.lit(" minor between "), "from_stage", F.lit(" and "), "to_stage"))
        .when(F.col("hop_state") == "ambiguous", F.concat(F.lit("ambiguous between "), "from_stage", F.lit(" and "), "to_stage"))
        .otherwise(F.concat(F.lit("nothing from "), "from_stage", F.lit(" to "), "to_stage"))
    )
    return rows.where(grave.isNotNull()).groupBy("label").agg(F.min_by(text, F.struct(grave, "step")).alias("reason"))


def hold_reasons(legs: DataFrame, status: DataFrame, verified: DataFrame) -> DataFrame:
    """(label, failed): the failed checks of a chain's legs that aren't accepted, from their last verification."""
    rows = legs.join(status.where("status <> 'accepted'").select("proposal_id"), "proposal_id", "left_semi").join(verified.where("status = 'fail'").select("proposal_id", "failed"), "proposal_id")
    return rows.select("label", F.explode("failed").alias("f")).groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("failed"))


def leftovers(sources: dict[str, DataFrame], spine_name: str, members: DataFrame, status: DataFrame) -> DataFrame:
    """(dataset, row_id) of rows outside the spine that no open proposal holds; all of them."""
    open_ = members.join(status.where(F.col("status").isin("pending", "accepted", "review_later")).select("proposal_id"), "proposal_id", "left_semi").select("dataset", "row_id").distinct()
    out = None
    for name, df in sources.items():
        if name != spine_name:
            rows = df.select(F.lit(name).alias("dataset"), "row_id")
            out = rows if out is None else out.unionByName(rows)
    return out.join(open_, ["dataset", "row_id"], "left_anti")


def ordered(states: DataFrame) -> DataFrame:
    """Chains for a report: worst state first, then label."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    return states.orderBy(rank, "label")
