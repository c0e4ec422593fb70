"""The analyst questions, each a named plan over links and transactions.

Thresholds default to the published ones. Every ranking ends with the entity key, so ties
at a limit are settled the same way in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions import normalize as N
from kithgraph.operators.edges import entity_key, label_of, node_type_of
from kithgraph.operators.skew import attach
from kithgraph.operators.stats import ENTITY, attach_entity_stats, entity_stats


def _of(links: DataFrame, rel_type: str) -> DataFrame:
    return links.filter(F.col("rel_type") == rel_type)


def _suspects(
    links: DataFrame, rel_type: str, name: str, keep: Column, digits: int, order: str, k: int
) -> DataFrame:
    stats = entity_stats(_of(links, rel_type), ["key"]).filter(keep)
    return (
        stats.select(
            F.col("key").alias(name),
            F.col("tx_count").alias("total_txns"),
            F.col("fraud_count").alias("fraud_txns"),
            N.pct(F.col("fraud_count"), F.col("tx_count"), digits).alias("fraud_rate_pct"),
        )
        .orderBy(F.desc(order), name)
        .limit(k)
    )


def overview(tx: DataFrame) -> DataFrame:
    """Transactions, fraud and fraud percentage."""
    counts = tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("isFraud").cast("bigint").alias("fraud_transactions"),
    )
    return counts.withColumn(
        "fraud_rate_pct", N.pct(F.col("fraud_transactions"), F.col("total_transactions"), 2)
    )


def compromised_cards(links: DataFrame, min_tx: int = 20, k: int = 10) -> DataFrame:
    """Busy cards with the most fraud."""
    return _suspects(links, "USED_CARD", "card", F.col("tx_count") >= min_tx, 1, "fraud_txns", k)


def shared_devices(
    links: DataFrame, min_tx: int = 10, min_rate: float = 0.30, k: int = 15
) -> DataFrame:
    """Devices shared by many transactions with a high fraud share."""
    keep = (F.col("tx_count") >= min_tx) & (F.col("fraud_rate") > min_rate)
    return _suspects(links, "USED_DEVICE", "device", keep, 1, "fraud_txns", k)


def email_concentration(links: DataFrame, min_tx: int = 100, k: int = 15) -> DataFrame:
    """Payer domains by fraud percentage."""
    keep = F.col("tx_count") >= min_tx
    return _suspects(links, "PAYER_EMAIL", "email_domain", keep, 2, "fraud_rate_pct", k)


def risky_addresses(links: DataFrame, min_tx: int = 50, k: int = 10) -> DataFrame:
    """Billing addresses by fraud percentage."""
    return _suspects(
        links, "BILLED_TO", "address", F.col("tx_count") >= min_tx, 2, "fraud_rate_pct", k
    )


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key."""
    return df.filter(F.col(key) == value)


def two_hop(links: DataFrame, tx_id: int) -> DataFrame:
    """Other transactions that share an entity with `tx_id`, one row per shared entity.

    The transaction has at most one entity per type, so the side that is matched against
    all links has a handful of rows.
    """
    own = _own_entities(links, tx_id)
    others = links.filter(F.col("transactionId") != tx_id)
    return others.join(F.broadcast(own), list(ENTITY)).select(
        "rel_type", "key", F.col("transactionId").alias("other_id"), "isFraud"
    )


def _own_entities(links: DataFrame, tx_id: int) -> DataFrame:
    return lookup(links, "transactionId", tx_id).select(*ENTITY).distinct()


def neighbourhood(tx: DataFrame, links: DataFrame, tx_id: int) -> DataFrame:
    """How many other transactions share the card, payer domain or device of `tx_id`.

    Three independent counts: links are distinct, so each count needs no product and no
    distinct. Entity types the transaction lacks count 0.
    """
    names = {
        "USED_CARD": "transactions_on_same_card",
        "PAYER_EMAIL": "transactions_on_same_email_domain",
        "USED_DEVICE": "transactions_on_same_device",
    }
    found = two_hop(links.filter(F.col("rel_type").isin(*names)), tx_id).agg(
        F.struct(
            *[F.count(F.when(F.col("rel_type") == rel, 1)).alias(name) for rel, name in names.items()]
        ).alias("counts")
    )
    return lookup(tx, "TransactionID", tx_id).select(
        F.col("TransactionID").alias("source_transaction"),
        F.col("isFraud").alias("is_fraud"),
        F.col("TransactionAmt").alias("amount"),
        found.scalar().alias("counts"),
    ).select("source_transaction", "is_fraud", "amount", "counts.*")


def optional_match(left: DataFrame, links: DataFrame, rel_type: str, name: str) -> DataFrame:
    """Left rows with the key of one entity type, null where there is none."""
    right = _of(links, rel_type).select("transactionId", F.col("key").alias(name))
    return left.join(right, "transactionId", "left")


def limit_then_expand(links: DataFrame, card: str, n: int = 20) -> DataFrame:
    """The first n fraud transactions of a card, then their other entities."""
    picked = (
        _of(links, "USED_CARD")
        .filter((F.col("key") == card) & (F.col("isFraud") == 1))
        .orderBy("transactionId")
        .limit(n)
        .select("transactionId", F.col("key").alias("card"), "transactionAmt")
    )
    # At most n rows by the limit above: send them to the links, not the links to them.
    rels = links.filter(F.col("rel_type").isin("PAYER_EMAIL", "BILLED_TO"))
    near = rels.join(F.broadcast(picked.select("transactionId")), "transactionId", "left_semi")
    named = near.groupBy("transactionId").agg(
        F.max(F.when(F.col("rel_type") == "PAYER_EMAIL", F.col("key"))).alias("email_domain"),
        F.max(F.when(F.col("rel_type") == "BILLED_TO", F.col("key"))).alias("address"),
    )
    return picked.join(named, "transactionId", "left")


def card_cluster(links: DataFrame, card: str, n: int = 20) -> DataFrame:
    """Fraud cluster of one card with email and address of each member."""
    return limit_then_expand(links, card, n).select(
        "card", "transactionId", "transactionAmt", "email_domain", "address"
    )


def co_occurrence(joined: DataFrame, rel_a: str, rel_b: str) -> DataFrame:
    """Entity pairs met in one transaction, with the transaction: both keys lie in its row."""
    both = joined.select(
        F.col("TransactionID").cast("bigint").alias("transactionId"),
        entity_key(rel_a).alias("key_a"),
        entity_key(rel_b).alias("key_b"),
        label_of(joined),
    )
    return both.filter(F.col("key_a").isNotNull() & F.col("key_b").isNotNull())


def card_email_amplification(
    tx: DataFrame, min_tx: int = 5, min_rate: float = 0.15, k: int = 10
) -> DataFrame:
    """Card and payer-domain pairs with a high fraud share."""
    pairs = co_occurrence(tx, "USED_CARD", "PAYER_EMAIL")
    stats = entity_stats(pairs, ["key_a", "key_b"]).filter(
        (F.col("tx_count") >= min_tx) & (F.col("fraud_rate") > min_rate)
    )
    return (
        stats.select(
            F.col("key_a").alias("card"),
            F.col("key_b").alias("email_domain"),
            F.col("tx_count").alias("total_txns"),
            F.col("fraud_count").alias("fraud_txns"),
            N.pct(F.col("fraud_count"), F.col("tx_count"), 1).alias("fraud_rate_pct"),
        )
        .orderBy(F.desc("fraud_txns"), "card", "email_domain")
        .limit(k)
    )


def high_value_devices(
    links: DataFrame, amount: float = 500, min_tx: int = 5, min_fraud: int = 2, k: int = 10
) -> DataFrame:
    """Devices with several large transactions and fraud among them."""
    large = _of(links, "USED_DEVICE").filter(F.col("transactionAmt") > amount)
    stats = large.groupBy(F.col("key").alias("device")).agg(
        F.count(F.lit(1)).alias("total_high_value"),
        F.sum(N.is_fraud()).cast("bigint").alias("fraud_high_value"),
        F.round(F.max("transactionAmt"), 2).alias("max_txn_amount"),
    )
    stats = stats.filter(
        (F.col("total_high_value") >= min_tx) & (F.col("fraud_high_value") >= min_fraud)
    ).withColumn(
        "fraud_rate_pct", N.pct(F.col("fraud_high_value"), F.col("total_high_value"), 1)
    )
    return stats.orderBy(F.desc("fraud_high_value"), "device").limit(k)


def graph_summary(tx: DataFrame, links: DataFrame) -> DataFrame:
    """One row: transactions, fraud, and distinct cards, domains and devices."""
    kinds = {"Card": "unique_cards", "EmailDomain": "unique_email_domains", "Device": "unique_devices"}
    entities = (
        links.select(node_type_of("rel_type").alias("what"), "key")
        .filter(F.col("what").isin(*kinds))
        .distinct()
        .groupBy("what")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = tx.agg(
        F.count(F.lit(1)).alias("all"), F.sum("isFraud").cast("bigint").alias("fraud")
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("all").alias("what"), F.col("all").alias("n")),
                F.struct(F.lit("fraud").alias("what"), F.col("fraud").alias("n")),
            )
        )
    )
    names = {"all": "transactions", "fraud": "fraud_transactions", **kinds}
    return totals.unionByName(entities).agg(
        *[
            F.coalesce(F.max(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(name)
            for what, name in names.items()
        ]
    )


def suspicious_reuse(links: DataFrame, min_tx: int = 10, min_fraud: int = 3) -> DataFrame:
    """Devices with more than `min_tx` transactions and more than `min_fraud` frauds."""
    stats = entity_stats(_of(links, "USED_DEVICE"), ["key"])
    return stats.filter(
        (F.col("tx_count") > min_tx) & (F.col("fraud_count") > min_fraud)
    ).select(F.col("key").alias("device"), "tx_count", "fraud_count")


def explain_flag(links: DataFrame, tx_id: int) -> DataFrame:
    """Each entity of a transaction with its linked transactions and frauds."""
    own = F.broadcast(_own_entities(links, tx_id))
    return entity_stats(links.join(own, list(ENTITY), "left_semi"))


def legit_on_fraud_cards(links: DataFrame) -> DataFrame:
    """Legitimate transactions on cards that also carry fraud, with the card's fraud count."""
    cards = _of(links, "USED_CARD")
    seen = attach_entity_stats(cards, entity_stats(cards))
    return seen.filter((F.col("fraud_count") > 0) & (F.col("isFraud") == 0)).select(
        "transactionId", F.col("key").alias("card"), F.col("fraud_count").alias("card_fraud_count")
    )


def risk_table(links: DataFrame) -> DataFrame:
    """Lookup table of entity risk: type, key, counts and rate."""
    stats = entity_stats(links)
    return stats.select(
        node_type_of("rel_type").alias("node_type"), *ENTITY, "tx_count", "fraud_count", "fraud_rate"
    )


def risk_lookup(risk: DataFrame, links: DataFrame) -> DataFrame:
    """Risk of each link's entity; an entity the table does not know gets count 0 and rate -1.

    Rows of hot entities are spread by the size of the entity in `links`, not in the table.
    """
    sizes = links.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("_rows"))
    known = sizes.join(risk.select(*ENTITY, "tx_count", "fraud_rate"), list(ENTITY), "left")
    return attach(links, known, ENTITY, "_rows").select(
        "transactionId",
        *ENTITY,
        F.coalesce("tx_count", F.lit(0)).cast("bigint").alias("tx_count"),
        F.coalesce("fraud_rate", F.lit(-1.0)).alias("fraud_rate"),
    )


def follow(pairs: DataFrame, tx: DataFrame) -> DataFrame:
    """PREV_ON_CARD pairs with both labels; transaction ids are unique, so no key is large."""
    labels = tx.select(F.col("TransactionID").cast("bigint").alias("id"), "isFraud")
    before = labels.select(F.col("id").alias("prev_id"), F.col("isFraud").alias("prev_is_fraud"))
    after = labels.select(F.col("id").alias("curr_id"), F.col("isFraud").alias("curr_is_fraud"))
    return pairs.join(before, "prev_id").join(after, "curr_id").select(
        "prev_id", "curr_id", "dt_gap_seconds", "prev_is_fraud", "curr_is_fraud"
    )
