"""Typed links, nodes and edges of the property graph."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions import normalize as N


class Rel(NamedTuple):
    node_type: str
    prefix: str
    columns: tuple[str, ...]


# Relationship type -> entity label, feature prefix, source columns.
RELS = {
    "USED_CARD": Rel("Card", "card", ("card1",)),
    "PAYER_EMAIL": Rel("EmailDomain", "payer_email", ("P_emaildomain",)),
    "RECIPIENT_EMAIL": Rel("EmailDomain", "recip_email", ("R_emaildomain",)),
    "BILLED_TO": Rel("BillingAddress", "billing", ("addr1", "addr2")),
    "USED_DEVICE": Rel("Device", "device", ("DeviceInfo",)),
    "HAS_OS_BROWSER": Rel("OSBrowser", "os_browser", ("id_30", "id_31")),
    "VIA_PROXY": Rel("ProxyType", "proxy", ("id_23",)),
    "IN_PRODUCT": Rel("ProductType", "product", ("ProductCD",)),
    "ON_NETWORK": Rel("CardNetwork", "network", ("card4",)),
    "IN_TIME_BUCKET": Rel("TimeBucket", "time_bucket", ("TransactionDT",)),
}
V1_RELS = ("USED_CARD", "PAYER_EMAIL", "RECIPIENT_EMAIL", "BILLED_TO", "USED_DEVICE")
V2_RELS = (*V1_RELS, "HAS_OS_BROWSER", "VIA_PROXY")
IDENTITY_RELS = ("USED_DEVICE", "HAS_OS_BROWSER", "VIA_PROXY")  # keys from the identity table
HUB_RELS = ("IN_PRODUCT", "ON_NETWORK", "IN_TIME_BUCKET")
CHAIN = "PREV_ON_CARD"
TRANSACTION = "Transaction"

_KEYS = {
    "USED_CARD": N.card_key,
    "PAYER_EMAIL": N.email_key,
    "RECIPIENT_EMAIL": N.email_key,
    "BILLED_TO": N.addr_key,
    "USED_DEVICE": N.device_key,
    "HAS_OS_BROWSER": N.os_browser_key,
    "VIA_PROXY": N.proxy_label,
    "IN_PRODUCT": N.safe_str,
    "ON_NETWORK": N.safe_str,
    "IN_TIME_BUCKET": lambda c: N.time_bucket(c).cast("string"),
}


def entity_key(rel_type: str) -> Column:
    return _KEYS[rel_type](*RELS[rel_type].columns)


def node_id(node_type: Column | str, key: Column | str) -> Column:
    return F.concat_ws(":", F.lit(node_type) if isinstance(node_type, str) else node_type, key)


def node_type_of(rel_type: Column | str) -> Column:
    c = F.col(rel_type) if isinstance(rel_type, str) else rel_type
    out = None
    for rel, spec in RELS.items():
        out = F.when(c == rel, spec.node_type) if out is None else out.when(c == rel, spec.node_type)
    return out


def with_absent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` with those of `columns` that it lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def label_of(df: DataFrame) -> Column:
    """The label, null for tables without one."""
    return (F.col("isFraud") if "isFraud" in df.columns else F.lit(None)).cast("int").alias("isFraud")


def join_identity(tx: DataFrame, identity: DataFrame | None) -> DataFrame:
    """Transactions with their identity columns, if any, and the `has_identity` flag."""
    joined = tx if identity is None else tx.join(identity, "TransactionID", "left")
    joined = with_absent(joined, ["DeviceType"])
    return joined.withColumn("has_identity", N.has_identity("DeviceType"))


def transaction_nodes(joined: DataFrame) -> DataFrame:
    """The eleven properties of a transaction node."""
    return joined.select(
        F.col("TransactionID").cast("bigint").alias("transactionId"),
        N.safe_float("TransactionDT").alias("transactionDT"),
        N.safe_float("TransactionAmt").alias("transactionAmt"),
        N.safe_str("ProductCD").alias("productCD"),
        label_of(joined),
        N.safe_str("card4").alias("card4"),
        N.safe_str("card6").alias("card6"),
        N.safe_float("addr1").alias("addr1"),
        N.safe_float("addr2").alias("addr2"),
        N.safe_float("dist1").alias("dist1"),
        N.has_identity("DeviceType").alias("hasIdentity"),
    )


def links(joined: DataFrame, rel_types: Sequence[str] = V2_RELS, unique_ids: bool = True) -> DataFrame:
    """One row per (transaction, entity) with the transaction's time, amount and label.

    All types come out of one scan. `unique_ids` states that TransactionID is a key of the
    input, in which case links are distinct already and need no shuffle. The label and the
    keys' columns may be missing.
    """
    joined = with_absent(joined, [c for r in rel_types for c in RELS[r].columns])
    payload = [
        F.col("TransactionID").cast("bigint").alias("transactionId"),
        F.col("TransactionDT").cast("bigint").alias("transactionDT"),
        F.col("TransactionAmt").cast("double").alias("transactionAmt"),
        label_of(joined),
    ]
    if len(rel_types) == 1:
        rel = rel_types[0]
        out = joined.select(*payload, F.lit(rel).alias("rel_type"), entity_key(rel).alias("key"))
    else:
        pairs = F.array(
            *[F.struct(F.lit(r).alias("rel_type"), entity_key(r).alias("key")) for r in rel_types]
        )
        out = joined.select(*payload, F.inline(pairs))
    out = out.filter(F.col("key").isNotNull())
    return out if unique_ids else out.dropDuplicates(["transactionId", "rel_type", "key"])


def links_of(
    tx: DataFrame, identity: DataFrame | None, rel_types: Sequence[str] = V2_RELS, unique_ids: bool = True
) -> DataFrame:
    """Links straight from the two tables, with no more joining than the types need.

    Types with keys in `tx` take one scan and no shuffle. Identity types join the few
    payload columns to identity rows only; without an identity table they have no links.
    With `unique_ids` off a transaction that was loaded twice still links once.
    """
    own = [r for r in rel_types if r not in IDENTITY_RELS]
    side = [r for r in rel_types if r in IDENTITY_RELS]
    if not side:
        return links(tx, own, unique_ids)
    payload = tx.select("TransactionID", "TransactionDT", "TransactionAmt", label_of(tx))
    if identity is None:
        found = links(payload.limit(0), side)
    else:
        found = links(payload.join(identity, "TransactionID"), side, unique_ids)
    return links(tx, own, unique_ids).unionByName(found) if own else found


def build_edges(joined: DataFrame, *rel_types: str) -> DataFrame:
    """Edges of the given types as (src, dst, rel_type, dt_gap_seconds), distinct as the ids are."""
    return to_edges(links(joined, rel_types or V2_RELS))


def to_edges(found: DataFrame) -> DataFrame:
    return found.select(
        node_id(TRANSACTION, F.col("transactionId").cast("string")).alias("src"),
        node_id(node_type_of("rel_type"), F.col("key")).alias("dst"),
        "rel_type",
        F.lit(None).cast("bigint").alias("dt_gap_seconds"),
    )


def chain_edges(chain: DataFrame) -> DataFrame:
    """PREV_ON_CARD pairs in the edge layout."""
    return chain.select(
        node_id(TRANSACTION, F.col("prev_id").cast("string")).alias("src"),
        node_id(TRANSACTION, F.col("curr_id").cast("string")).alias("dst"),
        F.lit(CHAIN).alias("rel_type"),
        "dt_gap_seconds",
    )


def union_edges(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All rows of several typed edge sets; nothing is removed."""
    for other in rest:
        first = first.unionByName(other)
    return first


def entity_nodes(found: DataFrame) -> DataFrame:
    """Distinct entity nodes of links; both email directions give one node type."""
    return (
        found.select(node_type_of("rel_type").alias("node_type"), "key")
        .distinct()
        .select(node_id(F.col("node_type"), F.col("key")).alias("node_id"), "node_type", "key")
    )


def transaction_ids(tx: DataFrame) -> DataFrame:
    """(node_id) of the transactions, repeated ones as often as they come."""
    return tx.select(node_id(TRANSACTION, F.col("TransactionID").cast("string")).alias("node_id"))


def build_nodes(tx: DataFrame, found: DataFrame) -> DataFrame:
    """Transaction nodes and entity nodes as (node_id, node_type, key)."""
    key = F.col("TransactionID").cast("string")
    own = tx.select(
        node_id(TRANSACTION, key).alias("node_id"), F.lit(TRANSACTION).alias("node_type"), key.alias("key")
    ).distinct()
    return own.unionByName(entity_nodes(found))


def email_domains(payer: DataFrame, recipient: DataFrame) -> DataFrame:
    """Distinct domains over both directions."""
    return payer.select("key").union(recipient.select("key")).distinct()


def project(
    nodes: DataFrame, edges: DataFrame, labels: Sequence[str], rel_types: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Undirected view of chosen labels and types: each edge in both directions.

    Parallel edges stay, so a transaction with equal payer and recipient domain counts twice.
    """
    kept = edges.filter(F.col("rel_type").isin(*rel_types))
    pair = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return (
        nodes.filter(F.col("node_type").isin(*labels)),
        kept.select("rel_type", F.inline(pair)).select("src", "dst", "rel_type"),
    )


def projection_counts(nodes: DataFrame, undirected: DataFrame) -> DataFrame:
    """Node and relationship totals of a projection, one row."""
    sizes = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), "n")
    sizes = sizes.unionByName(
        undirected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rels").alias("what"), "n")
    )
    return sizes.agg(
        F.max(F.when(F.col("what") == "nodes", F.col("n"))).alias("node_count"),
        F.max(F.when(F.col("what") == "rels", F.col("n"))).alias("relationship_count"),
    )


def degree(edges: DataFrame, by_type: bool = False) -> DataFrame:
    """Number of edge ends at each node, in total or per relationship type."""
    ends = edges.select("rel_type", F.explode(F.array("src", "dst")).alias("node_id"))
    keys = ["node_id", "rel_type"] if by_type else ["node_id"]
    return ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("degree"))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"))
