"""Aggregations and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.catalog.registry import SPLIT, SQL_RELS, Given, over, query
from kithgraph.operators import features as Fe
from kithgraph.operators import profile as D
from kithgraph.operators import stats as S


@query(
    "a1_validate_graph",
    over(
        "nodes",
        sql="""SELECT node_type || ' nodes' AS "check", count(*) AS n FROM nodes GROUP BY node_type
UNION ALL SELECT rel_type || ' rels', count(*) FROM all_edges GROUP BY rel_type
UNION ALL SELECT 'Fraud transactions', CAST(sum(isFraud) AS BIGINT) FROM tx""",
    ),
)
def validate_graph(g: Given):
    return S.validate_graph(g.graph.nodes, g.graph.edges, g.tx)


@query("a2_entity_stats", over("stats", sql="SELECT * FROM stats"))
def entity_stats(g: Given):
    return S.entity_stats(g.links)


@query(
    "a2_entity_stats_exclude_self",
    over(
        "stats",
        sql="""SELECT l.transactionId, l.rel_type, l.key, s.tx_count - 1 AS tx_count, s.fraud_count - l.isFraud AS fraud_count,
  CAST(s.fraud_count - l.isFraud AS DOUBLE) / nullif(s.tx_count - 1, 0) AS fraud_rate
FROM links l JOIN stats s ON l.rel_type = s.rel_type AND l.key = s.key""",
    ),
)
def entity_stats_exclude_self(g: Given):
    return S.scoped_stats(g.links, exclude_self=True)


@query(
    "a2_entity_stats_train_scope",
    over(
        "links",
        sql=f"""SELECT l.transactionId, l.rel_type, l.key, CAST(s.n AS BIGINT) AS tx_count, CAST(s.f AS BIGINT) AS fraud_count,
  CAST(s.f AS DOUBLE) / nullif(s.n, 0) AS fraud_rate
FROM links l JOIN (
  SELECT rel_type, key, sum(CASE WHEN dt <= {SPLIT} THEN 1 ELSE 0 END) AS n,
    sum(CASE WHEN dt <= {SPLIT} THEN isFraud ELSE 0 END) AS f
  FROM links GROUP BY rel_type, key) s ON l.rel_type = s.rel_type AND l.key = s.key""",
    ),
)
def entity_stats_train_scope(g: Given):
    return S.scoped_stats(g.links, label_scope="train", split_dt=SPLIT)


def _entity(name: str, rel_type: str):
    prefix = SQL_RELS[rel_type][2]

    @query(
        name,
        over(
            "stats",
            sql=f"""SELECT l.transactionId, s.tx_count AS {prefix}_tx_count, s.fraud_count AS {prefix}_fraud_count,
  s.fraud_rate AS {prefix}_fraud_rate
FROM links l JOIN stats s ON l.rel_type = s.rel_type AND l.key = s.key WHERE l.rel_type = '{rel_type}'""",
        ),
    )
    def run(g: Given):
        return S.entity_features(g.rel(rel_type), rel_type)

    return run


_entity("a3_card_features", "USED_CARD")
_entity("a4_payer_email_features", "PAYER_EMAIL")
_entity("a5_recip_email_features", "RECIPIENT_EMAIL")
_entity("a6_billing_features", "BILLED_TO")
_entity("a7_device_features", "USED_DEVICE")
_entity("a8_os_browser_features", "HAS_OS_BROWSER")


@query(
    "a9_proxy_features",
    over(
        "stats",
        sql="""SELECT l.transactionId, 1.0::DOUBLE AS is_proxy, s.fraud_rate AS proxy_fraud_rate
FROM links l JOIN stats s ON l.rel_type = s.rel_type AND l.key = s.key WHERE l.rel_type = 'VIA_PROXY'""",
    ),
)
def proxy_features(g: Given):
    return S.proxy_features(g.rel("VIA_PROXY"))


@query(
    "a11_proxy_fraud_table",
    over(
        "stats",
        sql="""SELECT key AS proxy, tx_count AS total, fraud_count, round(100.0::DOUBLE * fraud_count / tx_count, 2) AS fraud_pct
FROM stats WHERE rel_type = 'VIA_PROXY' ORDER BY fraud_pct DESC, proxy""",
    ),
)
def proxy_fraud_table(g: Given):
    return S.proxy_fraud_table(g.rel("VIA_PROXY"))


@query(
    "a13_class_balance",
    over(
        "tx",
        sql="""SELECT count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS positives, CAST(sum(1 - isFraud) AS BIGINT) AS negatives,
  CAST(sum(isFraud) AS DOUBLE) / count(*) AS fraud_rate, CAST(sum(1 - isFraud) AS DOUBLE) / sum(isFraud) AS scale_pos_weight
FROM tx""",
    ),
)
def class_balance(g: Given):
    return S.class_balance(g.tx)


SIGNALS = list(Fe.V2_FEATURES)


@query(
    "a14_signal_summary",
    over(
        "features",
        sql="SELECT feature, round(fraud_mean, 6) AS fraud_mean, round(legit_mean, 6) AS legit_mean,"
        " round(CASE WHEN legit_mean > 1e-9 THEN fraud_mean / legit_mean END, 6) AS ratio FROM ("
        + "\nUNION ALL ".join(
            f"SELECT '{c}' AS feature, avg(CASE WHEN t.isFraud = 1 AND {c} <> -1 THEN {c} END) AS fraud_mean,"
            f" avg(CASE WHEN t.isFraud <> 1 AND {c} <> -1 THEN {c} END) AS legit_mean"
            " FROM features f JOIN tx t ON t.TransactionID = f.transactionId"
            for c in SIGNALS
        )
        + ")",
    ),
)
def signal_summary(g: Given):
    out = D.signal_summary(g.features, g.labels, SIGNALS)
    return out.select(
        "feature", *[F.round(c, 6).alias(c) for c in ("fraud_mean", "legit_mean", "ratio")]
    )


PROFILED = [
    "card1", "addr1", "addr2", "dist1", "P_emaildomain", "R_emaildomain", "M1",
    "DeviceType", "DeviceInfo", "id_23", "id_30", "id_31",
]
_NULLS = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count,"
    f" round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS missing_pct FROM keys"
    for c in PROFILED
)


@query("a15_null_profile", over("keys", sql=_NULLS))
def null_profile(g: Given):
    return D.null_profile(g.joined, PROFILED)


@query(
    "a16_cardinality",
    over(
        "keys",
        sql="\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM keys" for c in PROFILED
        ),
    ),
)
def cardinality(g: Given):
    return D.cardinality(g.joined, PROFILED)


@query("a16_cardinality_approx")
def cardinality_approx(g: Given):
    return D.cardinality(g.joined, PROFILED, approx=True)


@query(
    "a16_cardinality_sketches",
    over(
        "keys",
        sql="\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, TRUE AS near FROM keys" for c in PROFILED
        ),
    ),
)
def cardinality_sketches(g: Given):
    """Daily states added up, held against the exact numbers: within five standard errors."""
    days = g.joined.withColumn("day", F.floor(F.col("TransactionDT") / 86_400))
    merged = D.merge_sketches(D.cardinality_sketches(days, PROFILED, "day")).withColumnRenamed("distinct_values", "about")
    exact = D.cardinality(g.joined, PROFILED).join(merged, "column_name")
    off = F.abs(F.col("about") - F.col("distinct_values"))
    near = off <= 5 * 1.04 / 2 ** (D.SLOTS / 2) * F.col("distinct_values") + 0.5
    return exact.select("column_name", "distinct_values", near.alias("near"))


DIMS = ["ProductCD", "card4", "card6", "P_emaildomain", "card1"]


@query(
    "a17_fraud_by_dimension",
    over(
        "tx",
        sql="SELECT dimension, value, count(*) AS total, CAST(sum(isFraud) AS BIGINT) AS fraud,"
        " CAST(sum(isFraud) AS DOUBLE) / count(*) AS fraud_rate FROM ("
        + " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, isFraud FROM tx" for d in DIMS
        )
        + ") GROUP BY dimension, value",
    ),
)
def fraud_by_dimension(g: Given):
    return S.fraud_by_dimension(g.tx, DIMS)


@query(
    "a18_amount_profile",
    over(
        "tx",
        sql="""SELECT min(TransactionAmt) AS min_amount, max(TransactionAmt) AS max_amount,
  round(median(TransactionAmt), 6) AS median_amount,
  round((max(TransactionDT) - min(TransactionDT)) / 86400.0::DOUBLE, 6) AS span_days FROM tx""",
    ),
)
def amount_profile(g: Given):
    return D.amount_profile(g.tx).select(
        "min_amount",
        "max_amount",
        F.round("median_amount", 6).alias("median_amount"),
        F.round("span_days", 6).alias("span_days"),
    )


@query(
    "a19_identity_coverage",
    over(
        "keys",
        sql="""SELECT count(*) AS transactions, count(DeviceType) AS with_identity,
  round(100.0::DOUBLE * count(DeviceType) / count(*), 1) AS coverage_pct FROM keys""",
    ),
)
def identity_coverage(g: Given):
    return D.identity_coverage(g.joined)


@query(
    "a20_missing_tiers",
    over(
        "keys",
        sql=f"""SELECT tier, count(*) AS columns, string_agg(column_name, ',' ORDER BY column_name) AS members FROM (
SELECT column_name, CASE WHEN missing_pct <= 0 THEN 'complete' WHEN missing_pct <= 10 THEN 'low'
  WHEN missing_pct <= 50 THEN 'medium' WHEN missing_pct <= 90 THEN 'high' ELSE 'sparse' END AS tier
FROM ({_NULLS})) GROUP BY tier""",
    ),
)
def missing_tiers(g: Given):
    return D.missing_tiers(g.joined, PROFILED)


_CENTROID = over(
    "vectors",
    sql="""SELECT round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-10), 6) AS cosine,
  round(sqrt(sum((a - b) * (a - b))), 6) AS l2
FROM (SELECT pos, avg(CASE WHEN isFraud = 1 THEN x END) AS a, avg(CASE WHEN isFraud = 0 THEN x END) AS b
  FROM (SELECT isFraud, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM vectors)
  GROUP BY pos)""",
)


def _centroids(g: Given):
    return D.centroid_quality(g.vectors, 64).select(
        F.round("cosine", 6).alias("cosine"), F.round("l2", 6).alias("l2")
    )


query("a21_centroid_quality", _CENTROID)(_centroids)
query("x5_embedding_quality", _CENTROID)(_centroids)


@query(
    "a22_class_histogram",
    over(
        "tx",
        extra="""
ranges AS (SELECT isFraud AS label, min(TransactionAmt) AS lo, max(TransactionAmt) AS hi, count(*) AS total FROM tx GROUP BY isFraud)""",
        sql="""SELECT label, bin, round(lo + bin * (hi - lo) / 30, 6) AS bin_start, n, round(n / (total * (hi - lo) / 30), 6) AS density
FROM (SELECT r.label, r.lo, r.hi, r.total, CAST(least(floor((TransactionAmt - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, count(*) AS n
  FROM tx JOIN ranges r ON tx.isFraud = r.label GROUP BY ALL)""",
    ),
)
def class_histogram(g: Given):
    return D.class_histogram(g.tx, "TransactionAmt").select(
        "label", "bin", F.round("bin_start", 6).alias("bin_start"), "n", F.round("density", 6).alias("density")
    )


@query(
    "a23_key_audit",
    over(
        "nodes",
        sql="""SELECT 'duplicate node ids' AS "check", count(*) AS violations FROM (SELECT node_id FROM nodes GROUP BY node_id HAVING count(*) > 1)
UNION ALL SELECT 'duplicate edges', count(*) FROM (SELECT src, dst, rel_type FROM all_edges GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'dangling edge ends', count(*) FROM (
  SELECT src AS id FROM all_edges UNION SELECT dst FROM all_edges) WHERE id NOT IN (SELECT node_id FROM nodes)""",
    ),
)
def key_audit(g: Given):
    return D.key_audit(g.graph.nodes, g.graph.edges)
