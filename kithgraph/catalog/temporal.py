"""Per-card order, rolling rates, ranking, limits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.catalog.registry import Given, over, query
from kithgraph.operators import sampling
from kithgraph.operators import stats as S
from kithgraph.operators import temporal as W
from kithgraph.plans import questions as Q

WEEK = 7 * 86_400


@query(
    "w1_next_on_card",
    over(
        "keys",
        sql="""SELECT TransactionID AS id, card_key AS card, TransactionDT AS dt, lead(TransactionID) OVER w AS next_id,
  lead(TransactionDT) OVER w AS next_dt
FROM keys WHERE card_key IS NOT NULL WINDOW w AS (PARTITION BY card_key ORDER BY TransactionDT, TransactionID)""",
    ),
)
def next_on_card(g: Given):
    return W.next_on_card(g.tx)


@query(
    "w2_prev_is_fraud",
    over("features", sql="SELECT transactionId, prev_card_is_fraud FROM features"),
)
def prev_is_fraud(g: Given):
    return W.prev_is_fraud(g.tx)


@query(
    "w3_prev_gap",
    over("features", sql="SELECT transactionId, prev_card_dt_gap FROM features"),
)
def prev_gap(g: Given):
    return W.prev_gap(g.tx)


@query(
    "w4_card_chain_rate",
    over(
        "keys",
        sql="""SELECT TransactionID AS "transactionId", round(avg(CAST(isFraud AS DOUBLE)) OVER (
  PARTITION BY card_key ORDER BY TransactionDT, TransactionID ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS card_chain_fraud_rate
FROM keys WHERE card_key IS NOT NULL""",
    ),
)
def card_chain_rate(g: Given):
    out = W.card_chain_rate(g.tx, 5)
    return out.select("transactionId", F.round("card_chain_fraud_rate", 6).alias("card_chain_fraud_rate"))


@query(
    "w5_rolling_entity_rate",
    over(
        "links",
        sql=f"""SELECT transactionId, rel_type, key, n AS prior_tx_count, CAST(coalesce(f, 0) AS BIGINT) AS prior_fraud_count,
  CAST(f AS DOUBLE) / nullif(n, 0) AS prior_fraud_rate
FROM (SELECT transactionId, rel_type, key, count(*) OVER w AS n, sum(isFraud) OVER w AS f FROM links
  WINDOW w AS (PARTITION BY rel_type, key ORDER BY dt RANGE BETWEEN {WEEK} PRECEDING AND 1 PRECEDING))""",
    ),
)
def rolling_entity_rate(g: Given):
    return W.rolling_entity_rate(g.links, WEEK)


@query(
    "a12_fraud_follow_rate",
    over(
        "chain",
        sql="""SELECT count(*) AS following_fraud_txns, CAST(sum(curr_is_fraud) AS BIGINT) AS also_fraud,
  round(100.0::DOUBLE * sum(curr_is_fraud) / count(*), 2) AS also_fraud_pct FROM chain WHERE prev_is_fraud = 1""",
    ),
)
def fraud_follow_rate(g: Given):
    return W.fraud_follow_rate(g.chain)


def _top(name: str, rel_type: str):
    @query(
        name,
        over(
            "links",
            sql=f"""SELECT key, count(*) AS fraud_count FROM links WHERE rel_type = '{rel_type}' AND isFraud = 1
GROUP BY key ORDER BY fraud_count DESC, key LIMIT 5""",
        ),
    )
    def run(g: Given):
        return S.top_entities(g.rel(rel_type), rel_type)

    return run


_top("t1_top_cards", "USED_CARD")
_top("t1_top_devices", "USED_DEVICE")


@query(
    "t3_seeded_sample",
    over(
        "tx",
        sql="""SELECT TransactionID, TransactionDT, isFraud FROM tx
ORDER BY md5(CAST(TransactionID AS VARCHAR) || '|42'), TransactionID LIMIT 2000""",
    ),
)
def seeded_sample(g: Given):
    return sampling.seeded_sample(g.tx.select("TransactionID", "TransactionDT", "isFraud"), "TransactionID", 2000)


@query(
    "t4_order_within",
    over(
        "tx",
        sql="SELECT card1, TransactionDT, TransactionID FROM tx WHERE card1 IS NOT NULL ORDER BY card1, TransactionDT, TransactionID",
    ),
)
def order_within(g: Given):
    rows = g.tx.filter("card1 IS NOT NULL").select("card1", "TransactionDT", "TransactionID")
    return W.order_within(rows, "card1", "TransactionDT", "TransactionID")


_CLUSTER = """SELECT p.card_key AS card, p.TransactionID AS "transactionId", p.TransactionAmt AS "transactionAmt",
  p.payer_key AS email_domain, p.addr_key AS address
FROM (SELECT * FROM keys WHERE card_key = '93' AND isFraud = 1 ORDER BY TransactionID LIMIT 20) p"""


@query("t5_limit_then_expand", over("keys", sql=_CLUSTER))
def limit_then_expand(g: Given):
    return Q.limit_then_expand(g.rel("USED_CARD", "PAYER_EMAIL", "BILLED_TO"), "93")


@query("q6_card_cluster", over("keys", sql=_CLUSTER))
def card_cluster(g: Given):
    return Q.card_cluster(g.rel("USED_CARD", "PAYER_EMAIL", "BILLED_TO"), "93")
