"""Entity risk aggregates and their way back to the transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions import normalize as N
from kithgraph.operators.edges import RELS
from kithgraph.operators.skew import attach
from kithgraph.operators.temporal import rolling_entity_rate
from kithgraph.session import cut_lineage

ENTITY = ("rel_type", "key")


def link(edges: DataFrame, tx: DataFrame) -> DataFrame:
    """Stored (transactionId, rel_type, key) edges with the payload of their transactions."""
    payload = tx.select(
        F.col("TransactionID").cast("bigint").alias("transactionId"),
        F.col("TransactionDT").cast("bigint").alias("transactionDT"),
        F.col("TransactionAmt").cast("double").alias("transactionAmt"),
        F.col("isFraud").cast("int").alias("isFraud"),
    )
    return edges.select("transactionId", *ENTITY).join(payload, "transactionId")


def entity_stats(links: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """tx_count, fraud_count and fraud_rate per entity; a missing label is not fraud."""
    return (
        links.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("tx_count"),
            F.sum(N.is_fraud("isFraud")).cast("bigint").alias("fraud_count"),
        )
        .withColumn("fraud_rate", N.rate(F.col("fraud_count"), F.col("tx_count")))
    )


def attach_entity_stats(links: DataFrame, stats: DataFrame) -> DataFrame:
    """Each link with the stats of its entity (null if the entity has none)."""
    return attach(links, stats, ENTITY, "tx_count")


def scoped_stats(
    links: DataFrame,
    label_scope: str = "all",
    split_dt: int | None = None,
    exclude_self: bool = False,
    lookback_s: int | None = None,
) -> DataFrame:
    """Entity stats seen by each link under a label scope.

    `all` counts every transaction, its own label included. `train` counts those up to
    `split_dt` only. `rolling` counts the `lookback_s` seconds before the transaction.
    `exclude_self` takes the transaction's own row out of the counts it is part of.
    """
    if label_scope == "rolling":
        if lookback_s is None:
            raise ValueError("label_scope='rolling' needs lookback_s")
        return rolling_entity_rate(links, lookback_s).withColumnsRenamed(
            {
                "prior_tx_count": "tx_count",
                "prior_fraud_count": "fraud_count",
                "prior_fraud_rate": "fraud_rate",
            }
        )
    if label_scope == "train":
        if split_dt is None:
            raise ValueError("label_scope='train' needs split_dt")
        seen = F.col("transactionDT") <= split_dt
    elif label_scope == "all":
        seen = F.lit(True)
    else:
        raise ValueError(f"unknown label scope {label_scope!r}")
    one = F.when(seen, F.lit(1)).otherwise(F.lit(0))
    fraud = F.when(seen, N.is_fraud("isFraud")).otherwise(F.lit(0))
    # `_rows` is the number of links the entity has, which is what decides the join's balance.
    stats = links.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(one).cast("bigint").alias("tx_count"),
        F.sum(fraud).cast("bigint").alias("fraud_count"),
    )
    out = attach(links, stats, ENTITY, "_rows")
    n, f = F.col("tx_count"), F.col("fraud_count")
    if exclude_self:
        n, f = n - one, f - fraud
    out = out.select(
        "transactionId", *ENTITY, n.cast("bigint").alias("tx_count"), f.cast("bigint").alias("fraud_count")
    )
    return out.withColumn("fraud_rate", N.rate(F.col("fraud_count"), F.col("tx_count")))


def entity_features(links: DataFrame, rel_type: str, **scope) -> DataFrame:
    """Per-transaction stats of one entity type under its feature prefix."""
    return _prefixed(scoped_stats(links.filter(F.col("rel_type") == rel_type), **scope), rel_type)


def proxy_features(links: DataFrame, **scope) -> DataFrame:
    """is_proxy = 1 for any proxy label, and the fraud rate of that label."""
    return _proxied(scoped_stats(links.filter(F.col("rel_type") == "VIA_PROXY"), **scope))


def entity_frames(links: DataFrame, rel_types: Sequence[str], proxy: bool = True, **scope) -> list[DataFrame]:
    """The frames of `entity_features` for several types, and of `proxy_features`, in one pass.

    All types are scanned, aggregated and attached together as long rows, which are stored
    once; a frame is what its type has of them.
    """
    wanted = [*rel_types, *(["VIA_PROXY"] if proxy else [])]
    seen = cut_lineage(scoped_stats(links.filter(F.col("rel_type").isin(wanted)), **scope))
    frames = [_prefixed(seen.filter(F.col("rel_type") == r), r) for r in rel_types]
    return [*frames, _proxied(seen.filter(F.col("rel_type") == "VIA_PROXY"))] if proxy else frames


def _prefixed(seen: DataFrame, rel_type: str) -> DataFrame:
    prefix = RELS[rel_type].prefix
    return seen.select("transactionId", *[F.col(c).alias(f"{prefix}_{c}") for c in ("tx_count", "fraud_count", "fraud_rate")])


def _proxied(seen: DataFrame) -> DataFrame:
    return seen.select("transactionId", F.lit(1.0).alias("is_proxy"), F.col("fraud_rate").alias("proxy_fraud_rate"))


def validate_graph(nodes: DataFrame, edges: DataFrame, tx: DataFrame) -> DataFrame:
    """One row per check: count of each node label, of each edge type, and of fraud."""
    n = F.count(F.lit(1)).alias("n")
    labels = nodes.groupBy(F.concat(F.col("node_type"), F.lit(" nodes")).alias("check")).agg(n)
    rels = edges.groupBy(F.concat(F.col("rel_type"), F.lit(" rels")).alias("check")).agg(n)
    fraud = tx.agg(F.sum(N.is_fraud()).cast("bigint").alias("n"))
    fraud = fraud.select(F.lit("Fraud transactions").alias("check"), F.coalesce("n", F.lit(0)).alias("n"))
    return labels.unionByName(rels).unionByName(fraud)


def ranked(stats: DataFrame, k: int, by: str = "fraud_count", then: Sequence[str] = ("key",)) -> DataFrame:
    """The k first rows by descending `by`; keys settle ties."""
    return stats.orderBy(F.desc(by), *then).limit(k)


def top_entities(links: DataFrame, rel_type: str, k: int = 5) -> DataFrame:
    """Entities with the most fraud transactions."""
    fraud = links.filter((F.col("rel_type") == rel_type) & (F.col("isFraud") == 1))
    counts = fraud.groupBy("key").agg(F.count(F.lit(1)).alias("fraud_count"))
    return ranked(counts, k)


def proxy_fraud_table(links: DataFrame) -> DataFrame:
    """Total, fraud and fraud percentage per proxy label, highest percentage first."""
    stats = entity_stats(links.filter(F.col("rel_type") == "VIA_PROXY"), ["key"])
    return stats.select(
        F.col("key").alias("proxy"),
        F.col("tx_count").alias("total"),
        "fraud_count",
        N.pct(F.col("fraud_count"), F.col("tx_count"), 2).alias("fraud_pct"),
    ).orderBy(F.desc("fraud_pct"), "proxy")


def class_balance(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """Class counts, fraud rate and the negative/positive weight."""
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint")
    neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("bigint")
    return (
        df.agg(F.count(F.lit(1)).alias("n"), pos.alias("positives"), neg.alias("negatives"))
        .withColumn("fraud_rate", N.rate(F.col("positives"), F.col("n")))
        .withColumn("scale_pos_weight", N.rate(F.col("negatives"), F.col("positives")))
    )


def fraud_by_dimension(tx: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Fraud share per value of several columns in one pass; a missing value is a group."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]
    )
    return (
        tx.select("isFraud", F.inline(pairs))
        .groupBy("dimension", "value")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(N.is_fraud()).cast("bigint").alias("fraud"),
        )
        .withColumn("fraud_rate", N.rate(F.col("fraud"), F.col("total")))
    )
