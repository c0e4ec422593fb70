"""Projections, normalisation and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.catalog.registry import SPLIT, Given, over, query
from kithgraph.functions import normalize as N
from kithgraph.operators import edges as G
from kithgraph.operators import features as Fe
from kithgraph.operators import profile as D
from kithgraph.plans import questions as Q


@query(
    "p1_safe_str",
    over(
        "keys",
        sql="SELECT TransactionID, nullif(trim(P_emaildomain), '') AS payer,"
        " nullif(trim(DeviceInfo), '') AS device FROM keys",
    ),
)
def safe_str(g: Given):
    return g.joined.select(
        "TransactionID", N.safe_str("P_emaildomain").alias("payer"), N.safe_str("DeviceInfo").alias("device")
    )


@query(
    "p2_safe_float",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS amount,
  TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS text
FROM events""",
)
def safe_float(g: Given):
    from kithgraph.sources.given import table

    events = table(g.spark, g.sf_dir, "events")
    amount = (
        F.when(F.col("event_type") == "error", "NaN")
        .when(F.col("event_type") == "view", "not known")
        .otherwise(F.col("value").cast("string"))
    )
    return events.select(
        "event_id",
        N.safe_float(amount).alias("amount"),
        N.safe_float(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"),
        N.safe_float("props").alias("text"),
    )


def _key(name: str, rel_type: str, column: str):
    @query(name, over("keys", sql=f"SELECT TransactionID, {column} AS key FROM keys"))
    def run(g: Given):
        return g.joined.select("TransactionID", G.entity_key(rel_type).alias("key"))

    return run


_key("p3_card_key", "USED_CARD", "card_key")
_key("p4_email_key", "PAYER_EMAIL", "payer_key")
_key("p5_addr_key", "BILLED_TO", "addr_key")
_key("p6_device_key", "USED_DEVICE", "device_key")
_key("p7_os_browser_key", "HAS_OS_BROWSER", "osb_key")
_key("p8_proxy_label", "VIA_PROXY", "proxy_key")


@query(
    "p9_has_identity",
    over("keys", sql="SELECT TransactionID, DeviceType IS NOT NULL AS has_identity FROM keys"),
)
def has_identity(g: Given):
    return g.joined.select("TransactionID", "has_identity")


@query(
    "p10_transaction_nodes",
    over(
        "keys",
        sql="""SELECT TransactionID AS "transactionId", CAST(TransactionDT AS DOUBLE) AS "transactionDT",
  TransactionAmt AS "transactionAmt", ProductCD AS "productCD", isFraud, card4, card6, addr1, addr2, dist1,
  DeviceType IS NOT NULL AS "hasIdentity" FROM keys""",
    ),
)
def transaction_nodes(g: Given):
    return G.transaction_nodes(g.joined)


@query(
    "p11_match_flag",
    over(
        "tx",
        sql="SELECT TransactionID, CASE M1 WHEN 'T' THEN 1.0::DOUBLE WHEN 'F' THEN 0.0::DOUBLE END AS M1 FROM tx",
    ),
)
def match_flag(g: Given):
    return g.tx.select("TransactionID", N.match_flag("M1").alias("M1"))


@query(
    "p12_temporal_split",
    over(
        "tx",
        sql=f"""SELECT 'train' AS part, count(*) AS n, min(TransactionDT) AS first_dt, max(TransactionDT) AS last_dt
FROM tx WHERE TransactionDT <= {SPLIT}
UNION ALL SELECT 'validation', count(*), min(TransactionDT), max(TransactionDT) FROM tx WHERE TransactionDT > {SPLIT}""",
    ),
)
def temporal_split(g: Given):
    def part(df, name):
        return df.agg(
            F.count(F.lit(1)).alias("n"),
            F.min("TransactionDT").alias("first_dt"),
            F.max("TransactionDT").alias("last_dt"),
        ).withColumn("part", F.lit(name))

    train, validation = Fe.temporal_split(g.tx, SPLIT)
    return part(train, "train").unionByName(part(validation, "validation"))


@query(
    "p13_split_label",
    over(
        "tx",
        sql=f"SELECT TransactionID, CASE WHEN TransactionDT <= {SPLIT} THEN 'TRAIN' ELSE 'TEST' END AS data_split FROM tx",
    ),
)
def split_label(g: Given):
    return Fe.with_split_label(g.tx, SPLIT).select("TransactionID", "data_split")


_TABULAR = ("TransactionAmt", "card1", "addr1", "addr2", "dist1")


@query(
    "p14_feature_sets",
    over(
        "features",
        sql="\nUNION ALL ".join(
            [f"SELECT '{c}' AS feature, 'tabular' AS feature_set, count({c}) AS present FROM tx" for c in _TABULAR]
            + [f"SELECT '{c}', 'graph', count({c}) FROM features" for c in Fe.V2_FEATURES]
        ),
    ),
)
def feature_sets(g: Given):
    """Each selected model input with its kind and the number of rows that have it."""
    df = Fe.attach_features(g.tx, g.features)
    kinds = {c: kind for kind, columns in Fe.feature_sets(df.dtypes).items() for c in columns}
    counts = df.agg(*[F.count(c).alias(c) for c in kinds])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(k).alias("feature_set"), F.col(c).alias("present"))
            for c, k in kinds.items()
        ]
    )
    return counts.select(F.inline(rows))


@query(
    "p15_fill_missing",
    over(
        "stats",
        "chain",
        sql="""SELECT k.TransactionID AS "transactionId",
  CAST(coalesce(s.tx_count, 0) AS DOUBLE) AS device_tx_count, coalesce(s.fraud_rate, -1.0) AS device_fraud_rate,
  CASE WHEN k.proxy_key IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS is_proxy,
  CAST(coalesce(c.dt_gap_seconds, -1) AS DOUBLE) AS prev_card_dt_gap
FROM keys k LEFT JOIN stats s ON s.rel_type = 'USED_DEVICE' AND s.key = k.device_key
LEFT JOIN chain c ON c.curr_id = k.TransactionID""",
    ),
)
def fill_missing(g: Given):
    from kithgraph.operators import stats as S
    from kithgraph.operators import temporal as W

    device = S.entity_features(g.rel("USED_DEVICE"), "USED_DEVICE").select(
        "transactionId", "device_tx_count", "device_fraud_rate"
    )
    proxy = S.proxy_features(g.rel("VIA_PROXY")).select("transactionId", "is_proxy")
    gap = W.prev_features(g.chain).select("transactionId", "prev_card_dt_gap")
    out = g.ids
    for frame in (device, proxy, gap):
        out = out.join(frame, "transactionId", "left")
    return Fe.fill_missing(out)


@query(
    "p16_pct",
    over(
        "links",
        sql="SELECT rel_type, key, round(100.0::DOUBLE * sum(isFraud) / count(*), 2) AS fraud_pct FROM links GROUP BY rel_type, key",
    ),
)
def pct(g: Given):
    return g.links.groupBy("rel_type", "key").agg(
        N.pct(F.sum("isFraud"), F.count(F.lit(1)), 2).alias("fraud_pct")
    )


@query("p17_lookup", over("tx", sql="SELECT TransactionID, card1, TransactionAmt, isFraud FROM tx WHERE card1 = 93"))
def lookup(g: Given):
    return Q.lookup(g.tx, "card1", 93).select("TransactionID", "card1", "TransactionAmt", "isFraud")


@query(
    "p18_time_bucket",
    over(
        "tx",
        sql="SELECT TransactionDT // 86400 AS day, count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS fraud FROM tx GROUP BY 1",
    ),
)
def time_bucket(g: Given):
    return g.tx.groupBy(N.time_bucket("TransactionDT").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("isFraud").alias("fraud")
    )
