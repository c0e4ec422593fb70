"""Point questions over the stored graph: a few blocks are read instead of all links.

`write_links` stores links twice, by entity and by transaction, and the transactions
themselves. A question first reads the entities of its transaction (or the rows of its
card), then only the blocks of these; the plans of `questions` do the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators.stats import ENTITY
from kithgraph.plans import questions as Q
from kithgraph.sources.clustered import BLOCK_ROWS, read_clustered, write_clustered

TRANSACTION_COLUMNS = ("TransactionID", "isFraud", "TransactionAmt")


def write_links(links: DataFrame, tx: DataFrame, path: str, rows: int = BLOCK_ROWS) -> None:
    """Store links and transactions; an entity with many transactions goes on over several blocks."""
    write_clustered(links, ENTITY, f"{path}/by_entity", ["transactionId"], rows)
    write_clustered(links, ["transactionId"], f"{path}/by_transaction", ENTITY, rows)
    write_clustered(tx.select(*TRANSACTION_COLUMNS), ["TransactionID"], f"{path}/transactions", rows=rows)


def links_of_entities(spark: SparkSession, path: str, entities: list[tuple[str, str]]) -> DataFrame:
    return read_clustered(spark, f"{path}/by_entity", ENTITY, entities)


def links_of_transactions(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    return read_clustered(spark, f"{path}/by_transaction", ["transactionId"], [(i,) for i in ids])


def links_around(spark: SparkSession, path: str, tx_id: int, rels: tuple[str, ...] = ()) -> DataFrame:
    """All links of the entities of one transaction, its own included; it has one entity a type at most."""
    own = links_of_transactions(spark, path, [tx_id])
    if rels:
        own = own.filter(F.col("rel_type").isin(*rels))
    return links_of_entities(spark, path, [tuple(r) for r in own.select(*ENTITY).distinct().collect()])


def neighbourhood(spark: SparkSession, path: str, tx_id: int) -> DataFrame:
    """`questions.neighbourhood` over the stored links."""
    tx = read_clustered(spark, f"{path}/transactions", ["TransactionID"], [(tx_id,)])
    near = links_around(spark, path, tx_id, ("USED_CARD", "PAYER_EMAIL", "USED_DEVICE"))
    return Q.neighbourhood(tx, near, tx_id)


def explain_flag(spark: SparkSession, path: str, tx_id: int) -> DataFrame:
    """`questions.explain_flag` over the stored links."""
    return Q.explain_flag(links_around(spark, path, tx_id), tx_id)


def card_cluster(spark: SparkSession, path: str, card: str, n: int = 20) -> DataFrame:
    """`questions.card_cluster` over the stored links: the card's blocks, then those of n transactions at most."""
    of_card = links_of_entities(spark, path, [("USED_CARD", card)])
    fraud = of_card.filter(F.col("isFraud") == 1).orderBy("transactionId").limit(n)
    ids = [r[0] for r in fraud.select("transactionId").collect()]
    others = links_of_transactions(spark, path, ids).filter(F.col("rel_type") != "USED_CARD")
    return Q.card_cluster(of_card.unionByName(others), card, n)
