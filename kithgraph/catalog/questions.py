"""Analyst questions (Q1-Q13)."""

from __future__ import annotations

from kithgraph.catalog.registry import SPLIT, Given, over, query
from kithgraph.operators import edges as G
from kithgraph.plans import questions as Q


def _suspects(rel: str, name: str, keep: str, digits: int, order: str, k: int) -> str:
    return over(
        "stats",
        sql=f"""SELECT key AS {name}, tx_count AS total_txns, fraud_count AS fraud_txns,
  round(100.0::DOUBLE * fraud_count / tx_count, {digits}) AS fraud_rate_pct
FROM stats WHERE rel_type = '{rel}' AND {keep} ORDER BY {order} DESC, {name} LIMIT {k}""",
    )


@query(
    "q1_overview",
    over(
        "tx",
        sql="""SELECT count(*) AS total_transactions, CAST(sum(isFraud) AS BIGINT) AS fraud_transactions,
  round(100.0::DOUBLE * sum(isFraud) / count(*), 2) AS fraud_rate_pct FROM tx""",
    ),
)
def overview(g: Given):
    return Q.overview(g.tx)


@query("q2_compromised_cards", _suspects("USED_CARD", "card", "tx_count >= 20", 1, "fraud_txns", 10))
def compromised_cards(g: Given):
    return Q.compromised_cards(g.rel("USED_CARD"))


@query(
    "q3_shared_devices",
    _suspects("USED_DEVICE", "device", "tx_count >= 10 AND fraud_rate > 0.10", 1, "fraud_txns", 15),
)
def shared_devices(g: Given):
    return Q.shared_devices(g.rel("USED_DEVICE"), min_rate=0.10)


@query(
    "q4_email_concentration",
    _suspects("PAYER_EMAIL", "email_domain", "tx_count >= 100", 2, "fraud_rate_pct", 15),
)
def email_concentration(g: Given):
    return Q.email_concentration(g.rel("PAYER_EMAIL"))


@query(
    "q5_neighbourhood",
    over(
        "links",
        sql="""SELECT TransactionID AS source_transaction, isFraud AS is_fraud, TransactionAmt AS amount, """
        + ", ".join(
            f"(SELECT count(DISTINCT b.transactionId) FROM links a JOIN links b ON a.rel_type = b.rel_type AND a.key = b.key"
            f" WHERE a.rel_type = '{r}' AND a.transactionId = 4 AND b.transactionId <> 4) AS {name}"
            for r, name in (
                ("USED_CARD", "transactions_on_same_card"),
                ("PAYER_EMAIL", "transactions_on_same_email_domain"),
                ("USED_DEVICE", "transactions_on_same_device"),
            )
        )
        + " FROM tx WHERE TransactionID = 4",
    ),
)
def neighbourhood(g: Given):
    return Q.neighbourhood(g.tx, g.rel("USED_CARD", "PAYER_EMAIL", "USED_DEVICE"), 4)


@query(
    "q7_risky_addresses",
    _suspects("BILLED_TO", "address", "tx_count >= 50", 2, "fraud_rate_pct", 10),
)
def risky_addresses(g: Given):
    return Q.risky_addresses(g.rel("BILLED_TO"))


@query(
    "q8_card_email_amplification",
    over(
        "keys",
        sql="""SELECT card_key AS card, payer_key AS email_domain, count(*) AS total_txns, CAST(sum(isFraud) AS BIGINT) AS fraud_txns,
  round(100.0::DOUBLE * sum(isFraud) / count(*), 1) AS fraud_rate_pct
FROM keys WHERE card_key IS NOT NULL AND payer_key IS NOT NULL GROUP BY card_key, payer_key
HAVING count(*) >= 5 AND CAST(sum(isFraud) AS DOUBLE) / count(*) > 0.15
ORDER BY fraud_txns DESC, card, email_domain LIMIT 10""",
    ),
)
def card_email_amplification(g: Given):
    return Q.card_email_amplification(g.tx)


@query(
    "q9_high_value_devices",
    over(
        "links",
        sql="""SELECT key AS device, count(*) AS total_high_value, CAST(sum(isFraud) AS BIGINT) AS fraud_high_value,
  round(max(amt), 2) AS max_txn_amount, round(100.0::DOUBLE * sum(isFraud) / count(*), 1) AS fraud_rate_pct
FROM links WHERE rel_type = 'USED_DEVICE' AND amt > 50 GROUP BY key
HAVING count(*) >= 5 AND sum(isFraud) >= 2 ORDER BY fraud_high_value DESC, device LIMIT 10""",
    ),
)
def high_value_devices(g: Given):
    return Q.high_value_devices(g.rel("USED_DEVICE"), amount=50)


@query(
    "q10_graph_summary",
    over(
        "links",
        sql="""SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT CAST(sum(isFraud) AS BIGINT) FROM tx) AS fraud_transactions,
  (SELECT count(DISTINCT key) FROM links WHERE node_type = 'Card') AS unique_cards,
  (SELECT count(DISTINCT key) FROM links WHERE node_type = 'EmailDomain') AS unique_email_domains,
  (SELECT count(DISTINCT key) FROM links WHERE node_type = 'Device') AS unique_devices""",
    ),
)
def graph_summary(g: Given):
    return Q.graph_summary(g.tx, g.rel("USED_CARD", "PAYER_EMAIL", "RECIPIENT_EMAIL", "USED_DEVICE"))


@query(
    "q11_suspicious_reuse",
    over(
        "stats",
        sql="""SELECT key AS device, tx_count, fraud_count FROM stats
WHERE rel_type = 'USED_DEVICE' AND tx_count > 10 AND fraud_count > 3""",
    ),
)
def suspicious_reuse(g: Given):
    return Q.suspicious_reuse(g.rel("USED_DEVICE"))


@query(
    "q12_explain_flag",
    over(
        "stats",
        sql="""SELECT s.rel_type, s.key, s.tx_count, s.fraud_count, s.fraud_rate
FROM links l JOIN stats s ON s.rel_type = l.rel_type AND s.key = l.key WHERE l.transactionId = 4""",
    ),
)
def explain_flag(g: Given):
    return Q.explain_flag(g.links, 4)


@query(
    "q13_risk_table",
    over(
        "stats",
        sql="""SELECT DISTINCT l.node_type, s.rel_type, s.key, s.tx_count, s.fraud_count, s.fraud_rate
FROM links l JOIN stats s ON s.rel_type = l.rel_type AND s.key = l.key""",
    ),
)
def risk_table(g: Given):
    return Q.risk_table(g.links)


@query(
    "q13_risk_lookup",
    over(
        "links",
        extra=f"""
known AS (SELECT rel_type, key, count(*) AS tx_count, CAST(sum(isFraud) AS DOUBLE) / count(*) AS fraud_rate
  FROM links WHERE dt <= {SPLIT} GROUP BY rel_type, key)""",
        sql=f"""SELECT l.transactionId, l.rel_type, l.key, coalesce(k.tx_count, 0) AS tx_count, coalesce(k.fraud_rate, -1.0) AS fraud_rate
FROM links l LEFT JOIN known k ON k.rel_type = l.rel_type AND k.key = l.key WHERE l.dt > {SPLIT}""",
    ),
)
def risk_lookup(g: Given):
    """Later transactions against a table made from the earlier ones."""
    before = g.links.filter(f"transactionDT <= {SPLIT}")
    return Q.risk_lookup(Q.risk_table(before), g.links.filter(f"transactionDT > {SPLIT}"))


@query(
    "q13_risk_lookup_unlabelled",
    over(
        "links",
        extra=f"""
known AS (SELECT rel_type, key, count(*) AS tx_count, CAST(sum(isFraud) AS DOUBLE) / count(*) AS fraud_rate
  FROM links WHERE dt <= {SPLIT} GROUP BY rel_type, key)""",
        sql=f"""SELECT l.transactionId, l.rel_type, l.key, coalesce(k.tx_count, 0) AS tx_count, coalesce(k.fraud_rate, -1.0) AS fraud_rate
FROM links l LEFT JOIN known k ON k.rel_type = l.rel_type AND k.key = l.key
WHERE l.dt > {SPLIT} AND l.rel_type NOT IN ('USED_DEVICE', 'HAS_OS_BROWSER', 'VIA_PROXY')""",
    ),
)
def risk_lookup_unlabelled(g: Given):
    """New transactions without labels and without an identity table."""
    before = g.links.filter(f"transactionDT <= {SPLIT}")
    new = g.tx.drop("isFraud").filter(f"TransactionDT > {SPLIT}")
    return Q.risk_lookup(Q.risk_table(before), G.links_of(new, None))
