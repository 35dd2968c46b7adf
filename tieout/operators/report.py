"""Close report: coverage, value, exceptions, decisions and a checksum of what was decided."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions.expr import minor
from tieout.operators.verify import latest


def coverage_by_dataset(sources: dict[str, DataFrame], members: DataFrame, status: DataFrame) -> DataFrame:
    """(dataset, n_rows, matched, unmatched): rows in accepted proposals of any edge."""
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("dataset"), "n_rows") for n, df in sources.items()])
    taken = members.join(status.where("status = 'accepted'").select("proposal_id"), "proposal_id", "left_semi").select("dataset", "row_id").distinct().groupBy("dataset").agg(F.count("*").alias("matched"))
    both = rows.join(taken, "dataset", "left").fillna(0, ["matched"])
    return both.withColumn("unmatched", F.col("n_rows") - F.col("matched"))


def coverage_by_edge(members: DataFrame, status: DataFrame) -> DataFrame:
    """(edge, dataset, matched): distinct rows each side has in accepted proposals of the edge."""
    rows = members.join(status.where("status = 'accepted'").select("proposal_id", "edge"), "proposal_id")
    return rows.select("edge", "dataset", "row_id").distinct().groupBy("edge", "dataset").agg(F.count("*").alias("matched"))


def coverage_sides(sources: dict[str, DataFrame], members: DataFrame, status: DataFrame) -> DataFrame:
    """(edge, dataset, n_rows, matched, unmatched): of each side of an edge with accepted proposals, the rows that these hold and the rest."""
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("dataset"), "n_rows") for n, df in sources.items()])
    both = coverage_by_edge(members, status).join(rows, "dataset")
    return both.select("edge", "dataset", "n_rows", "matched", (F.col("n_rows") - F.col("matched")).alias("unmatched"))


def coverage_totals(by_dataset: DataFrame) -> DataFrame:
    return by_dataset.agg(F.sum("n_rows").alias("n_rows"), F.sum("matched").alias("matched"), F.sum("unmatched").alias("unmatched"))


def value_by_currency(members: DataFrame, status: DataFrame, currency: DataFrame) -> DataFrame:
    """(currency, gross_minor, reconciled_minor, open_minor, residual_minor); ``currency`` is (dataset, row_id, currency).

    A proposal's gross is the sum of its positive amounts; what isn't accepted is
    open; the residual is what unbalanced proposals are off by.
    """
    rows = members.join(currency, ["dataset", "row_id"], "left")
    first = F.min(F.when(F.col("currency").isNotNull(), F.struct("dataset", "row_id", "currency")))
    g = rows.groupBy("proposal_id").agg(F.sum(F.when(F.col("amount_minor") > 0, F.col("amount_minor")).otherwise(0)).cast("bigint").alias("gross"), first.alias("f"))
    p = g.join(status.select("proposal_id", "status", "confidence", "balance_minor"), "proposal_id").withColumn("currency", F.coalesce(F.col("f.currency"), F.lit("?")))
    total = lambda c: F.sum(c).cast("bigint")
    done = F.col("status") == "accepted"
    return p.groupBy("currency").agg(
        total("gross").alias("gross_minor"),
        total(F.when(done, F.col("gross")).otherwise(0)).alias("reconciled_minor"),
        total(F.when(done, 0).otherwise(F.col("gross"))).alias("open_minor"),
        total(F.when(F.col("confidence") == "unbalanced", F.abs("balance_minor")).otherwise(0)).alias("residual_minor"),
    )


def dataset_value(df: DataFrame, name: str, amount: str, members: DataFrame, status: DataFrame) -> DataFrame:
    """(dataset, total_minor, matched_minor, duplicate_minor) of a source's amount column; marked duplicates count apart."""
    taken = members.where(F.col("dataset") == name).join(status.where("status = 'accepted'").select("proposal_id"), "proposal_id", "left_semi").select("row_id").distinct().withColumn("hit", F.lit(True))
    dup = F.col("dup_kind").isNotNull() if "dup_kind" in df.columns else F.lit(False)
    rows = df.select("row_id", minor(F.col(amount)).alias("m"), dup.alias("dup")).join(taken, "row_id", "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0)).cast("bigint")
    return rows.agg(total(~F.col("dup")).alias("total_minor"), total(~F.col("dup") & F.col("hit")).alias("matched_minor"), total(F.col("dup")).alias("duplicate_minor")).select(F.lit(name).alias("dataset"), "total_minor", "matched_minor", "duplicate_minor")


def amount_vote(members: DataFrame, cells: DataFrame) -> DataFrame:
    """(dataset, column): the column that holds most of a source's member amounts as they are; ties by name. ``cells`` is as of ``verify.source_cells``."""
    hit = F.explode(F.filter("cells", lambda x: F.abs(x["minor"]) == F.abs(F.col("amount_minor"))))
    votes = members.where("amount_minor <> 0").join(cells, ["dataset", "row_id"]).select("dataset", hit.alias("c")).groupBy("dataset", F.col("c.column").alias("column")).agg(F.count("*").alias("n"))
    return votes.groupBy("dataset").agg(F.min_by("column", F.struct(-F.col("n"), "column")).alias("column"))


def exceptions_by_cause(verified: DataFrame, status: DataFrame, n_unmatched: int) -> DataFrame:
    """(cause, n): failed checks of last verifications, unbalanced and ambiguous proposals, unmatched rows."""
    failed = verified.select(F.explode("failed").alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))
    kinds = status.where(F.col("confidence").isin("unbalanced", "ambiguous")).groupBy(F.col("confidence").alias("cause")).agg(F.count("*").alias("n"))
    rest = status.sparkSession.createDataFrame([("unmatched_rows", n_unmatched)], "cause string, n bigint")
    return failed.unionByName(kinds).unionByName(rest)


def decision_ledger(events: DataFrame) -> DataFrame:
    """(kind, actor, n) of the event log."""
    return events.groupBy("kind", "actor").agg(F.count("*").alias("n"))


def decision_counters(events: DataFrame) -> DataFrame:
    """One row of named counts: what the engine and what people decided, and what verification held up."""
    kind, person = F.col("kind"), F.col("actor") != "system"
    return events.agg(
        F.count_if(kind == "proposed").alias("proposed"),
        F.count_if(kind == "auto_accepted").alias("auto_accepted"),
        F.count_if((kind == "accepted") & person).alias("accepted_by_person"),
        F.count_if(kind == "rejected").alias("rejected"),
        F.count_if(kind == "review_later").alias("review_later"),
        F.count_if(kind == "verification_failed").alias("held_by_verification"),
        F.count_if(kind == "verification_overridden").alias("overridden"),
    )


def detail_field(events: DataFrame, field: str) -> DataFrame:
    """``events`` with ``field`` of their JSON detail; null where the detail isn't JSON or lacks it."""
    return events.withColumn(field, F.get_json_object("detail", f"$.{field}"))


def status_summary(status: DataFrame) -> DataFrame:
    """(status, confidence, n, needs_review)."""
    g = status.groupBy("status", "confidence").agg(F.count("*").alias("n"))
    return g.withColumn("needs_review", F.col("status").isin("pending", "review_later"))


#: Neighbouring row ids, or digests, that one digest stands for.
PIECE = 4096
#: Lines that a leaf of the checksum's tree has, about.
LEAF = 256


def decision_lines(status: DataFrame, members: DataFrame) -> DataFrame:
    """(rule, group_key, line_hash): one digest a proposal, of rule, key, confidence, status and its members.

    Members go by pieces: a digest of the ids of each stretch of PIECE row ids of a
    source, and one of each PIECE such digests, so no list grows with a group.
    """
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("row_id")), lambda x: x.cast("string")), ",")
    pieces = members.groupBy("proposal_id", "dataset", F.expr(f"row_id div {PIECE}").alias("piece")).agg(F.sha2(ids, 256).alias("h"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "h"))), lambda x: x["h"]), ",")
    stretches = pieces.groupBy("proposal_id", "dataset", F.expr(f"piece div {PIECE}").alias("stretch")).agg(F.sha2(inner, 256).alias("h"))
    own = stretches.groupBy("proposal_id").agg(joined(F.concat_ws(":", "dataset", F.lpad(F.col("stretch").cast("string"), 12, "0"), "h")).alias("m"))
    line = F.concat_ws("|", "rule", "group_key", "confidence", "status", "m")
    return status.join(own, "proposal_id").select("rule", "group_key", F.sha2(line, 256).alias("line_hash"))


def checksum(lines: DataFrame) -> DataFrame:
    """(checksum,): the root of a tree of digests over ranges of the lines' hashes, the same at any layout.

    Leaves are the ranges of one prefix of hexadecimal digits, as long as leaves
    have about LEAF lines; a node above has its sixteen ranges' digests at most.
    """
    n = lines.count()
    digits = 0
    while n > LEAF * 16**digits:
        digits += 1
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    level = lines.groupBy(F.substring("line_hash", 1, digits).alias("range")).agg(joined("line_hash").alias("h"))
    for size in range(digits - 1, -1, -1):
        level = level.groupBy(F.substring("range", 1, size).alias("range")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
    # one row, or none where there are no lines
    return level.agg(F.substring(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)), 1, 24).alias("checksum"))


def period(df: DataFrame, columns: list[str]) -> DataFrame:
    """(earliest, latest) over date columns whose text starts with a year."""
    cells = F.explode(F.array(*[F.col(c).cast("string") for c in columns]))
    return df.select(cells.alias("v")).where(F.col("v").rlike("^[0-9]{4}")).agg(F.min("v").alias("earliest"), F.max("v").alias("latest"))


def latest_verification(log: DataFrame) -> DataFrame:
    return latest(log)
