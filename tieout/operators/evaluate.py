"""Scoring of outcomes against labelled expectations, and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHED_CODES = ("MATCHED", "REFUND_MATCHED")
MISSING_CODES = ("MISSING_PROCESSOR", "MISSING_INTERNAL", "MISSING_BANK_SETTLEMENT", "INVALID_SOURCE_ROW")


def outcome(code: Column) -> Column:
    """MATCHED, MISSING or EXCEPTION."""
    return F.when(code.isin(*MATCHED_CODES), "MATCHED").when(code.isin(*MISSING_CODES), "MISSING").otherwise("EXCEPTION")


def verdicts(keys: DataFrame, status: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """(key, predicted, auto): what the engine made of each labelled key."""
    known = status
    if verified is not None:
        known = status.join(verified.select("proposal_id", F.col("status").alias("checked")), "proposal_id", "left")
    else:
        known = status.withColumn("checked", F.lit(None).cast("string"))
    blocked = (F.col("checked") == "fail") & (F.col("status") != "accepted")
    bad = F.coalesce(blocked, F.lit(False)) | F.col("confidence").isin("unbalanced", "ambiguous")
    auto = (F.col("status") == "accepted") & F.col("confidence").isin("exact", "within_tolerance")
    g = known.groupBy(F.col("group_key").alias("key")).agg(F.bool_or(bad).alias("bad"), F.bool_or(auto).alias("auto"))
    both = keys.join(g, "key", "left")
    return both.select("key", F.when(F.col("bad").isNull(), "MISSING").when(F.col("bad"), "EXCEPTION").otherwise("MATCHED").alias("predicted"), F.coalesce("auto", F.lit(False)).alias("auto"))


def confusion(rows: DataFrame) -> DataFrame:
    """(expected, predicted, n)."""
    return rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def scores(rows: DataFrame) -> DataFrame:
    """(n, accuracy, precision, recall, f1, false_auto_rate) with MATCHED as the positive class."""
    hit = lambda c: F.count_if(c)
    e, p = F.col("expected") == "MATCHED", F.col("predicted") == "MATCHED"
    t = rows.agg(F.count("*").alias("n"), hit(F.col("expected") == F.col("predicted")).alias("right"), hit(e & p).alias("tp"), hit(p).alias("pp"), hit(e).alias("ep"), hit(F.col("auto")).alias("autos"), hit(F.col("auto") & ~e).alias("wrong_autos"))
    precision, recall = F.try_divide("tp", "pp"), F.try_divide("tp", "ep")
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    return t.select("n", *[F.round(c, 6).alias(n) for n, c in (("accuracy", F.try_divide("right", "n")), ("precision", precision), ("recall", recall), ("f1", f1), ("false_auto_rate", F.try_divide("wrong_autos", "autos")))])


def member_exact(wanted: DataFrame, found: DataFrame, verdict: DataFrame) -> DataFrame:
    """(checked, exact): keys called MATCHED with values to check, and those whose group has all of them.

    ``wanted`` and ``found`` are (key, value), ``verdict`` (key, predicted). A right
    answer with the wrong rows is luck.
    """
    asked = wanted.join(verdict.where("predicted = 'MATCHED'").select("key"), "key", "left_semi").distinct()
    hit = asked.join(found.select("key", "value").distinct().withColumn("hit", F.lit(1)), ["key", "value"], "left")
    by_key = hit.groupBy("key").agg((F.count("*") == F.count("hit")).alias("whole"))
    return by_key.agg(F.count("*").alias("checked"), F.count_if("whole").alias("exact"))


def unlabelled(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """(n_labelled, n_unlabelled, consistent): a fixture may leave a tenth of its keys without a label."""
    rest = keys.join(labels, "key", "left_anti").agg(F.count("*").alias("n_unlabelled"))
    return labels.agg(F.count("*").alias("n_labelled")).crossJoin(rest).withColumn("consistent", F.col("n_unlabelled") <= 0.1 * F.col("n_labelled"))


def run_metrics(facts: DataFrame) -> DataFrame:
    """(model, calls, tokens, cost_micros, latency_ms) of run facts, by model."""
    return facts.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens").cast("bigint").alias("tokens"), F.sum("cost_micros").cast("bigint").alias("cost_micros"), F.sum("latency_ms").cast("bigint").alias("latency_ms"))
