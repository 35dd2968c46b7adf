"""Duplicate rows: exact ones, and near ones that differ in their identifiers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.operators.profile import source_columns

#: Share of rows that the most distinct columns must tell apart for a near scan.
IDENTITY_FLOOR = 0.5
#: Share of distinct values that a text column must have to carry an event's reference.
REFERENCE_RATIO = 0.5


def exact_marks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_id, dup_of): rows equal in all source columns to an earlier row, and the first such row. Nulls equal nulls."""
    columns = columns or source_columns(df)
    # 128 bits stand for a row, so neither long texts nor many copies of one row meet in a task; hashes pass over nulls, so flags go with the values
    cells = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    named = df.select("row_id", F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit(1), *cells).alias("h2"))
    first = named.groupBy("h1", "h2").agg(F.min("row_id").alias("dup_of"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(first, ["h1", "h2"]).where("row_id <> dup_of").select("row_id", "dup_of")


#: Standard error of estimated distinct counts, and how many of it an estimate is trusted within.
RSD, SURE = 0.02, 6


def identity_columns(df: DataFrame, columns: list[str] | None = None) -> tuple[list[str], dict[str, int], int]:
    """The columns that tie for most distinct values, distinct counts, and the row count. A driver decision over column counts.

    All columns are estimated in one pass. Exact are the counts of those that the
    estimates leave open: which may be the largest, or near a share that decides.
    """
    columns = columns or source_columns(df)
    row = df.agg(F.count("*").alias("__n"), *[F.approx_count_distinct(F.col(c), RSD).alias(c) for c in columns]).first()
    n, counts = row["__n"], {c: row[c] for c in columns}
    most = max(counts.values(), default=0)
    if not n or not most:
        return [], counts, n
    off = RSD * SURE
    leading = [c for c in columns if counts[c] * (1 + off) >= most * (1 - off)]
    near = lambda c, share: abs(counts[c] / n - share) <= 2 * off * share
    open_ = leading if len(leading) > 1 or near(leading[0], IDENTITY_FLOOR) else []
    open_ = [c for c in columns if c in open_ or near(c, REFERENCE_RATIO)]
    if open_:
        # hashes of the columns in question only, as long rows with their numbers
        names = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2"))) for i, c in enumerate(open_)])
        exact = df.select(F.explode(names).alias("x")).where("x IS NOT NULL").select("x.*").distinct().groupBy("i").agg(F.count("*").alias("k"))
        counts |= {open_[r.i]: r.k for r in exact.collect()}
    leading = [c for c in leading if c in open_] or leading
    most = max(counts[c] for c in leading)
    if most / n < IDENTITY_FLOOR:
        return [], counts, n
    return [c for c in leading if counts[c] == most], counts, n


def near_marks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_id, dup_of) of rows that repeat an earlier row in everything but the identity columns.

    The shared columns must be two at least, with a number and a text that tells
    half of the rows apart, so that two like payments are not called one.
    """
    columns = columns or source_columns(df)
    identity, counts, n = identity_columns(df, columns)
    kinds = dict(df.dtypes)
    event = [c for c in columns if c not in identity]
    numeric = any(kinds[c].startswith(("bigint", "int", "double", "float", "decimal", "smallint")) for c in event)
    reference = any(kinds[c] == "string" and n and counts[c] / n >= REFERENCE_RATIO for c in event)
    if not identity or len(event) < 2 or not (numeric and reference):
        return df.select("row_id", F.col("row_id").alias("dup_of")).limit(0)
    return exact_marks(df, event)


def mark_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with dup_of and dup_kind ('exact', 'near' or null); running it again gives the same marks."""
    plain = df.drop("dup_of", "dup_kind")
    columns = columns or source_columns(plain)
    exact = exact_marks(plain, columns).withColumn("dup_kind", F.lit("exact"))
    once = plain.join(exact.select("row_id"), "row_id", "left_anti")
    near = near_marks(once, columns).withColumn("dup_kind", F.lit("near"))
    return plain.join(exact.unionByName(near), "row_id", "left")


def without_duplicates(df: DataFrame, exclude: bool = True) -> DataFrame:
    """Rows that count under the duplicate policy of a dataset."""
    return df.where(F.col("dup_kind").isNull()) if exclude and "dup_kind" in df.columns else df


def duplicate_summary(marked: DataFrame) -> DataFrame:
    """(dup_kind, n) of a marked dataset."""
    return marked.where("dup_kind IS NOT NULL").groupBy("dup_kind").agg(F.count("*").alias("n"))


def duplicate_examples(marked: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """(dup_kind, row_id, dup_of, columns): the first ``k`` copies of each kind by row id, for a report."""
    rank = F.row_number().over(Window.partitionBy("dup_kind").orderBy("row_id"))
    return marked.where("dup_kind IS NOT NULL").withColumn("__rank", rank).where(F.col("__rank") <= k).select("dup_kind", "row_id", "dup_of", *columns)
