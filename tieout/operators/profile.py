"""Column profiles over one long table of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.expr import signature

MARKS = ("row_id", "dup_of", "dup_kind")


def source_columns(df: DataFrame) -> list[str]:
    """Columns of the source itself, without row ids and marks."""
    return [c for c in df.columns if c not in MARKS]


def long_values(sources: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(dataset, row_id, ordinal, column, value) of every non-null cell, trimmed strings; one scan a source."""
    parts = []
    for name, df in sources.items():
        picked = (columns or {}).get(name) or source_columns(df)
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for i, c in enumerate(picked)]))
        parts.append(df.select(F.lit(name).alias("dataset"), "row_id", cells.alias("c")).select("dataset", "row_id", "c.*").where("value IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each non-null value occurs, all columns in one shuffle with partial counts."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("c")).select("c.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, non_null, nulls, n_distinct, is_unique, min_value, max_value) of each column."""
    columns = columns or source_columns(df)
    typed = df.agg(F.count("*").alias("n"), *[f(c).cast("string").alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))])
    edges = typed.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{i}").alias("min_value"), F.col(f"hi_{i}").alias("max_value")) for i, c in enumerate(columns)])).alias("c")).select("n", "c.*")
    counted = value_counts(df, columns).groupBy("column").agg(F.sum("n").alias("non_null"), F.count("*").alias("n_distinct"))
    known = edges.join(counted, "column", "left").fillna(0, ["non_null", "n_distinct"])
    return known.select("column", "n", "non_null", (F.col("n") - F.col("non_null")).alias("nulls"), "n_distinct", ((F.col("n_distinct") == F.col("non_null")) & (F.col("n") > 0)).alias("is_unique"), "min_value", "max_value")


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(column, value, n, rank): each column's most frequent values, ties by value."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return value_counts(df, columns).withColumn("rank", rank).where(F.col("rank") <= k)


def pattern(df: DataFrame, column: str) -> DataFrame:
    """(signature, n): the shapes of a column's distinct values."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().groupBy(signature(F.col(column)).alias("signature")).agg(F.count("*").alias("n"))


def dominant_pattern(df: DataFrame, column: str) -> DataFrame:
    """(signature, coverage): the commonest shape and its share of distinct values, ties by signature."""
    shapes = pattern(df, column)
    best = shapes.agg(F.min_by("signature", F.struct(-F.col("n"), "signature")).alias("signature"), F.max("n").alias("top"), F.sum("n").alias("total"))
    return best.select("signature", F.round(F.col("top") / F.col("total"), 6).alias("coverage"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Trimmed distinct values of a column, blanks left out; no cap."""
    return df.select(F.trim(F.col(column).cast("string")).alias("value")).where("value IS NOT NULL AND value <> ''").distinct()


def key_stats(df: DataFrame, key: str) -> DataFrame:
    """(n, n_distinct, ratio) of a key's non-null values."""
    return df.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(F.col(key)).alias("n_distinct")).withColumn("ratio", F.round(F.try_divide("n_distinct", "n"), 6))


def text_key_stats(df: DataFrame, key: str) -> DataFrame:
    """(n, n_distinct, min_length, all_digits): what decides whether a key may be looked for inside text."""
    k = F.trim(F.col(key).cast("string"))
    return df.select(k.alias("k")).where("k IS NOT NULL AND k <> ''").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_distinct"), F.min(F.length("k")).alias("min_length"), F.bool_and(F.col("k").rlike("^[0-9]*$")).alias("all_digits"))
