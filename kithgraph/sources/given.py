"""Transaction and identity views over the given star-schema tables.

The mapping stands in for the two raw files: one transaction per event, an optional
identity row for a quarter of them, and nulls, blanks and mixed case where the raw files
have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_704_067_200  # 2024-01-01 UTC
SPLIT_DT = 24 * 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "k": F.regexp_extract("props", "([0-9]+)", 1).cast("int"),
            "dt": F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(EPOCH),
        }
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction view: key, time, amount, label, card, address, email and flag columns."""
    events = _numbered(table(spark, sf_dir, "events"))
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    base = events.join(customer, F.col("user_id") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return base.selectExpr(
        "event_id AS TransactionID",
        "dt AS TransactionDT",
        "value AS TransactionAmt",
        "CASE WHEN event_type = 'error' AND (user_id % 10 = 3 OR k % 10 = 7) THEN 1 ELSE 0 END AS isFraud",
        "substr('WCHSR', cast(event_id % 5 + 1 AS int), 1) AS ProductCD",
        "CASE WHEN event_id % 250 <> 0 THEN user_id END AS card1",
        "CASE user_id % 4 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard'"
        " WHEN 2 THEN 'american express' ELSE 'discover' END AS card4",
        "CASE WHEN user_id % 3 = 0 THEN 'credit' ELSE 'debit' END AS card6",
        "cast(100 + c_nationkey AS double) AS addr1",
        "CASE WHEN event_id % 9 <> 0 THEN cast(n_regionkey AS double) END AS addr2",
        "CASE WHEN event_id % 3 = 0 THEN value / 10 END AS dist1",
        "CASE WHEN event_id % 5 <> 0 THEN concat(' ', c_mktsegment, '.com') END AS P_emaildomain",
        "CASE WHEN event_id % 4 = 1 THEN CASE k % 3 WHEN 0 THEN 'building.com'"
        " WHEN 1 THEN 'Furniture.com' ELSE 'gmail.com' END END AS R_emaildomain",
        "CASE k % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END AS M1",
    )


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity side view; an event carries identity data when its number divides by four."""
    return (
        _numbered(table(spark, sf_dir, "events"))
        .filter("event_id % 4 = 0")
        .selectExpr(
            "event_id AS TransactionID",
            "CASE WHEN k % 50 = 0 THEN NULL WHEN k % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS DeviceType",
            "CASE WHEN k < 20 THEN 'Windows' WHEN k < 30 THEN 'iOS Device'"
            " WHEN k < 35 THEN 'rv:11 Trident/7.0' WHEN k < 38 THEN NULL"
            " ELSE concat('SM-A', k, ' Build/NRD', event_id % 3) END AS DeviceInfo",
            "CASE WHEN event_id % 28 = 0 THEN 'IP_PROXY:ANONYMOUS'"
            " WHEN event_id % 36 = 0 THEN 'IP_PROXY:TRANSPARENT'"
            " WHEN event_id % 44 = 0 THEN 'NotFound' END AS id_23",
            "CASE WHEN k % 2 = 0 THEN NULL WHEN k % 3 = 0 THEN 'Windows 10' ELSE 'Android 7.0' END AS id_30",
            "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'safari 11.0' ELSE 'chrome 63.0' END AS id_31",
        )
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: same-card same-time ties, no labels."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("TransactionID"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("TransactionDT"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.col("o_custkey").alias("card1"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given embedding table as (transactionId, embedding, isFraud)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("transactionId"),
        "embedding",
        F.when(F.col("label") == 0, F.lit(1)).otherwise(F.lit(0)).alias("isFraud"),
    )


def predictions(tx: DataFrame) -> DataFrame:
    """A model-free score with many ties, for checking the metrics without training."""
    return tx.select(
        "TransactionID",
        "isFraud",
        (
            (
                F.lit(2)
                + F.lit(35) * F.col("isFraud")
                + F.pmod(F.col("TransactionID") * 7919, F.lit(61))
            )
            / F.lit(100.0)
        ).alias("proba"),
    )
