"""Reconciliation sources derived from the ``orders`` table, for queries and tests.

Every column follows from integer arithmetic on the order key, so both engines
that compare results build the same rows at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ref(prefix: str, base: int, key) -> F.Column:
    return F.concat(F.lit(prefix), (F.lit(base) + key).cast("string"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        (k + 1).alias("row_id"),
        _ref("ORD-", 1000000, k).alias("order_ref"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(k % 97 == 5, "USD").otherwise("INR").alias("currency"),
        (F.lit(EPOCH) + k * 3600).alias("posted_s"),
    )


def gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture an order; none where key % 60 = 19, two where key % 60 = 27, short by 100 where key % 50 = 6."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    copies = F.when(F.col("o_orderkey") % 60 == 19, F.array().cast("array<int>")).when(F.col("o_orderkey") % 60 == 27, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    x = orders.withColumn("copy", F.explode(copies)).withColumn("k", F.col("o_orderkey") * 2 + F.col("copy"))
    key = F.col("o_orderkey")
    return x.select(
        F.col("k").cast("bigint").alias("row_id"),
        _ref("pay-", 1000000, F.col("k")).alias("txn_id"),
        _ref("ORD-", 1000000, key).alias("order_ref"),
        (F.col("o_totalprice").cast("decimal(18,2)") - F.when(key % 50 == 6, 100).otherwise(0).cast("decimal(18,2)")).alias("gross_amount"),
        F.lit("INR").alias("currency"),
        F.concat(F.lit("BATCH-"), (F.lit(100000) + F.expr("o_orderkey div 20")).cast("string")).alias("batch_id"),
        (F.lit(EPOCH) + key * 3600 + (key % 90) * 60 + (F.col("k") % 2) * 60).alias("captured_s"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One credit a batch; captures of even rows are not paid, every fortieth batch (11) comes six days late."""
    number = F.substring("batch_id", 7, 20).cast("bigint")
    paid = F.when(F.col("row_id") % 2 == 1, F.col("gross_amount")).otherwise(F.lit(0).cast("decimal(18,2)"))
    by_batch = gateway(spark, sf_dir).groupBy("batch_id").agg(F.sum(paid).cast("decimal(18,2)").alias("credit_amount"), F.max("captured_s").alias("last_s"))
    return by_batch.select(
        (number - 99999).alias("row_id"),
        F.concat(F.lit("NEFT CR-"), "batch_id", F.lit("-SETTLEMENT")).alias("narration"),
        "credit_amount",
        F.lit("INR").alias("currency"),
        (F.col("last_s") + 86400 + F.when(number % 40 == 11, 518400).otherwise(0)).alias("value_s"),
    )


#: The same sources as common table expressions of the oracle.
SQL = """
ledger AS (
  SELECT o_orderkey + 1 AS row_id, concat('ORD-', CAST(1000000 + o_orderkey AS VARCHAR)) AS order_ref,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CASE WHEN o_orderkey % 97 = 5 THEN 'USD' ELSE 'INR' END AS currency,
    1704067200 + o_orderkey * 3600 AS posted_s FROM orders
), gateway AS (
  SELECT k AS row_id, concat('pay-', CAST(1000000 + k AS VARCHAR)) AS txn_id, concat('ORD-', CAST(1000000 + o_orderkey AS VARCHAR)) AS order_ref,
    CAST(o_totalprice AS DECIMAL(18,2)) - CAST(CASE WHEN o_orderkey % 50 = 6 THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS gross_amount,
    'INR' AS currency, concat('BATCH-', CAST(100000 + o_orderkey // 20 AS VARCHAR)) AS batch_id,
    1704067200 + o_orderkey * 3600 + (o_orderkey % 90) * 60 + (k % 2) * 60 AS captured_s
  FROM (SELECT o_orderkey, o_totalprice, o_orderkey * 2 + 1 AS k FROM orders WHERE o_orderkey % 60 <> 19
        UNION ALL SELECT o_orderkey, o_totalprice, o_orderkey * 2 + 2 FROM orders WHERE o_orderkey % 60 = 27) x
), bank AS (
  SELECT CAST(substr(batch_id, 7) AS BIGINT) - 99999 AS row_id, concat('NEFT CR-', batch_id, '-SETTLEMENT') AS narration,
    CAST(sum(CASE WHEN row_id % 2 = 1 THEN gross_amount ELSE CAST(0 AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS credit_amount, 'INR' AS currency,
    max(captured_s) + 86400 + CASE WHEN CAST(substr(batch_id, 7) AS BIGINT) % 40 = 11 THEN 518400 ELSE 0 END AS value_s
  FROM gateway GROUP BY batch_id
)"""
