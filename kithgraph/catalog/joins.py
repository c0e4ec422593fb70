"""Joins (J1-J12) and per-transaction feature frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.catalog.registry import FEATURES, SPLIT, Given, over, query
from kithgraph.operators import edges as G
from kithgraph.operators import embed as X
from kithgraph.operators import features as Fe
from kithgraph.operators import stats as S
from kithgraph.operators import temporal as W
from kithgraph.plans import questions as Q
from kithgraph.plans import workflows


@query(
    "j1_join_identity",
    over(
        "keys",
        sql="SELECT TransactionID, isFraud, DeviceType, DeviceInfo, id_23, id_30, id_31 FROM keys",
    ),
)
def join_identity(g: Given):
    return g.joined.select(
        "TransactionID", "isFraud", "DeviceType", "DeviceInfo", "id_23", "id_30", "id_31"
    )


@query(
    "j2_restrict",
    over(
        "keys",
        sql="SELECT * FROM ident WHERE TransactionID IN (SELECT TransactionID FROM tx WHERE isFraud = 1)",
    ),
)
def restrict(g: Given):
    return Fe.restrict(g.identity, g.tx.filter(F.col("isFraud") == 1), "TransactionID")


@query(
    "j3_complement",
    over("features", sql="SELECT f.* FROM features f JOIN tx t ON t.TransactionID = f.transactionId WHERE t.isFraud = 0"),
)
def complement(g: Given):
    fraud = g.labels.filter(F.col("isFraud") == 1)
    return Fe.complement(g.features, fraud, "transactionId")


@query(
    "j4_attach_entity_stats",
    over(
        "stats",
        sql="SELECT l.transactionId, l.rel_type, l.key, s.tx_count, s.fraud_count, s.fraud_rate"
        " FROM links l JOIN stats s ON l.rel_type = s.rel_type AND l.key = s.key",
    ),
)
def attach_entity_stats(g: Given):
    return S.attach_entity_stats(g.links, S.entity_stats(g.links)).select(
        "transactionId", "rel_type", "key", "tx_count", "fraud_count", "fraud_rate"
    )


@query("j5_combine_features", over("features", sql="SELECT * FROM features"))
def combine_features(g: Given):
    frames = S.entity_frames(g.links, Fe.V2_ENTITIES)
    return Fe.combine_features([*frames, W.prev_features(g.chain)], g.ids)


@query("j5_feature_frame_v2", over("features", sql="SELECT * FROM features"))
def feature_frame_v2(g: Given):
    return g.features


_TRAIN_FEATURES = f"""
train_stats AS (
  SELECT rel_type, key, count(*) AS tx_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
    CAST(sum(isFraud) AS DOUBLE) / count(*) AS fraud_rate
  FROM links WHERE dt <= {SPLIT} GROUP BY rel_type, key),
train_chain AS (SELECT * REPLACE (CASE WHEN prev_dt <= {SPLIT} THEN prev_is_fraud END AS prev_is_fraud) FROM chain),""" + (
    FEATURES.replace("stats s_", "train_stats s_").replace("JOIN chain c", "JOIN train_chain c").replace("features AS", "train_features AS")
)


@query(
    "j5_features_train_scope",
    over("links", "chain", "keys", extra=_TRAIN_FEATURES, sql="SELECT * FROM train_features"),
)
def features_train_scope(g: Given):
    """All features from training labels only; an entity first seen later has rate -1."""
    return workflows.features(g.tx, g.identity, label_scope="train", split_dt=SPLIT)


@query(
    "j6_attach_features",
    over(
        "features",
        "vectors",
        sql="SELECT t.TransactionID, t.TransactionAmt, "
        + ", ".join(f"f.{c}" for c in Fe.V2_FEATURES)
        + ", "
        + ", ".join(f"v.embedding[{i + 1}] AS emb_{i}" for i in range(64))
        + """ FROM tx t LEFT JOIN features f ON f.transactionId = t.TransactionID
LEFT JOIN vectors v ON v.transactionId = t.TransactionID""",
    ),
)
def attach_features(g: Given):
    """All 22 features and 64 coordinates."""
    amounts = g.tx.select("TransactionID", "TransactionAmt")
    return Fe.attach_features(Fe.attach_features(amounts, g.features), X.expand_embedding(g.vectors, 64))


@query(
    "j7_two_hop",
    over(
        "links",
        sql="""SELECT b.rel_type, b.key, b.transactionId AS other_id, b.isFraud
FROM links a JOIN links b ON a.rel_type = b.rel_type AND a.key = b.key
WHERE a.transactionId = 4 AND b.transactionId <> 4""",
    ),
)
def two_hop(g: Given):
    return Q.two_hop(g.links, 4)


@query(
    "j8_optional_match",
    over("keys", sql='SELECT TransactionID AS "transactionId", isFraud, device_key AS device FROM keys'),
)
def optional_match(g: Given):
    return Q.optional_match(g.labels, g.rel("USED_DEVICE"), "USED_DEVICE", "device")


@query(
    "j9_co_occurrence",
    over(
        "keys",
        sql="""SELECT TransactionID AS "transactionId", card_key AS key_a, payer_key AS key_b, isFraud
FROM keys WHERE card_key IS NOT NULL AND payer_key IS NOT NULL""",
    ),
)
def co_occurrence(g: Given):
    return Q.co_occurrence(g.tx, "USED_CARD", "PAYER_EMAIL")


@query(
    "j10_follow",
    over("chain", sql="SELECT prev_id, curr_id, dt_gap_seconds, prev_is_fraud, curr_is_fraud FROM chain"),
)
def follow(g: Given):
    return Q.follow(W.prev_on_card(g.tx), g.tx)


@query(
    "j11_legit_on_fraud_cards",
    over(
        "stats",
        sql="""SELECT l.transactionId, l.key AS card, s.fraud_count AS card_fraud_count
FROM links l JOIN stats s ON s.rel_type = l.rel_type AND s.key = l.key
WHERE l.rel_type = 'USED_CARD' AND l.isFraud = 0 AND s.fraud_count > 0""",
    ),
)
def legit_on_fraud_cards(g: Given):
    return Q.legit_on_fraud_cards(g.rel("USED_CARD"))
