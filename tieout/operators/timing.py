"""Settlement timing: spans of groups, the usual span of a rule, and what is late."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.sources.store import written

# Fixed values of the timing rules; seconds.
MIN_GROUPS = 8
IQR_MULTIPLIER = 1.5
GAP_DOMINANCE = 1.5
MAX_FLAGGED_SHARE = 0.5
MIN_GAP_SECONDS = 43_200


def group_spans(instants: DataFrame) -> DataFrame:
    """(rule, group_key, span_s) from (rule, group_key, instant_s); groups with fewer than two instants have none."""
    g = instants.where("instant_s IS NOT NULL").groupBy("rule", "group_key").agg((F.max("instant_s") - F.min("instant_s")).alias("span_s"), F.count("*").alias("n"))
    return g.where("n >= 2").select("rule", "group_key", "span_s")


def ranges(spans: DataFrame) -> DataFrame:
    """(rule, range, low, high, c, upto, n, lowest): spans counted in ranges of MIN_GAP_SECONDS, with the running count.

    As many rows a rule as its spans have half days between them, however many
    groups there are; they are counted where they lie before they move.
    """
    at = F.floor(F.col("span_s") / MIN_GAP_SECONDS).alias("range")
    counted = spans.groupBy("rule", at).agg(F.min("span_s").alias("low"), F.max("span_s").alias("high"), F.count("*").alias("c"))
    order, whole = Window.partitionBy("rule").orderBy("range"), Window.partitionBy("rule")
    return counted.withColumns({"upto": F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.sum("c").over(whole), "lowest": F.min("low").over(whole)})


def quantiles(spans: DataFrame) -> DataFrame:
    """(rule, n, q1, median, q3): exact, interpolated between neighbours.

    The ranges tell where the six rows lie that the three quantiles rest on; only
    those ranges are counted by value, so no task holds a rule's spans.
    """
    known = ranges(spans)
    at = lambda q: F.lit(q) * (F.col("n") - 1)
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), (F.ceil(at(q)) if up else F.floor(at(q))).alias("rank"), (at(q) - F.floor(at(q))).alias("part")) for i, q in enumerate((0.25, 0.5, 0.75)) for up in (False, True)]))
    picked = known.select("rule", "range", "n", (F.col("upto") - F.col("c")).alias("before"), "upto", asked.alias("a")).select("rule", "range", "n", "before", "upto", "a.*").where("rank >= before AND rank < upto")
    inside = spans.withColumn("range", F.floor(F.col("span_s") / MIN_GAP_SECONDS)).join(picked.select("rule", "range").distinct(), ["rule", "range"]).groupBy("rule", "range", "span_s").agg(F.count("*").alias("k"))
    ends = F.sum("k").over(Window.partitionBy("rule", "range").orderBy("span_s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = inside.withColumn("ends", ends).join(picked, ["rule", "range"]).where("rank >= before + ends - k AND rank < before + ends")
    value = lambda i, up: F.max(F.when((F.col("q") == i) & (F.col("up") == up), F.col("span_s").cast("double")))
    part = lambda i: F.max(F.when(F.col("q") == i, F.col("part")))
    return found.groupBy("rule").agg(F.max("n").alias("n"), *[(value(i, False) + (value(i, True) - value(i, False)) * part(i)).alias(name) for i, name in enumerate(("q1", "median", "q3"))])


def gap_threshold(spans: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, below, gap): the widest gap above the median that parts few late spans from the rest.

    A gap of MIN_GAP_SECONDS or more can't lie within a range of that length, so
    the ends of neighbouring ranges tell all of them. ``known`` are the rules'
    quantiles, where they are at hand.
    """
    order = Window.partitionBy("rule").orderBy("range")
    steps = ranges(spans).select("rule", F.col("high").alias("below"), F.lead("low").over(order).alias("above"), "upto", "n", "lowest")
    steps = steps.join((quantiles(spans) if known is None else known).select("rule", "median"), "rule").withColumn("gap", F.col("above") - F.col("below"))
    fair = (F.col("below") >= F.col("median")) & (F.col("gap") >= MIN_GAP_SECONDS) & (F.col("gap") > GAP_DOMINANCE * F.greatest(F.col("below") - F.col("lowest"), F.lit(MIN_GAP_SECONDS))) & ((F.col("n") - F.col("upto")) / F.col("n") <= MAX_FLAGGED_SHARE)
    return steps.where(fair).groupBy("rule").agg(F.max_by("below", F.struct("gap", -F.col("below"))).alias("below"), F.max("gap").alias("gap"))


def baselines(spans: DataFrame) -> DataFrame:
    """(rule, n, median, threshold, by): rules with eight groups or more; the gap decides, else the quartiles."""
    known = written(quantiles(spans), "quantiles")  # a row for each rule
    q = known.where(F.col("n") >= MIN_GROUPS)
    wide = F.greatest(F.col("q3") + IQR_MULTIPLIER * (F.col("q3") - F.col("q1")), F.col("median") + MIN_GAP_SECONDS)
    both = q.join(gap_threshold(spans, known), "rule", "left")
    return both.select("rule", "n", "median", F.coalesce(F.col("below").cast("double"), wide).alias("threshold"), F.when(F.col("below").isNotNull(), "gap").otherwise("quartiles").alias("by"))


def timing(spans: DataFrame) -> DataFrame:
    """(rule, group_key, span_s, threshold, late) of the groups of rules with a baseline."""
    spans = written(spans, "spans")  # read by the ranges, the quantiles and the gaps
    return spans.join(baselines(spans).select("rule", "threshold"), "rule").withColumn("late", F.col("span_s") > F.col("threshold"))
