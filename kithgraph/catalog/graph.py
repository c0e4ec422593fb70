"""Graph construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.catalog.registry import Given, over, query
from kithgraph.operators import edges as G
from kithgraph.plans import workflows
from kithgraph.operators import temporal as W


def _edges(name: str, rel_type: str):
    @query(name, over("edges", sql=f"SELECT DISTINCT * FROM edges WHERE rel_type = '{rel_type}'"))
    def run(g: Given):
        return G.build_edges(g.joined, rel_type)

    return run


_edges("g1_used_card", "USED_CARD")
_edges("g2_payer_email", "PAYER_EMAIL")
_edges("g3_recipient_email", "RECIPIENT_EMAIL")
_edges("g4_billed_to", "BILLED_TO")
_edges("g5_used_device", "USED_DEVICE")
_edges("g6_has_os_browser", "HAS_OS_BROWSER")
_edges("g7_via_proxy", "VIA_PROXY")


@query("g8_prev_on_card", over("chain", sql="SELECT prev_id, curr_id, dt_gap_seconds FROM chain"))
def prev_on_card(g: Given):
    return W.prev_on_card(g.tx)


@query(
    "g8_prev_on_card_ties",
    """SELECT prev_id, curr_id, dt_gap_seconds FROM (
  SELECT lag(o_orderkey) OVER w AS prev_id, o_orderkey AS curr_id,
    epoch_us(o_orderdate) // 1000000 - lag(epoch_us(o_orderdate) // 1000000) OVER w AS dt_gap_seconds
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
WHERE dt_gap_seconds BETWEEN 0 AND 2592000""",
)
def prev_on_card_ties(g: Given):
    """Orders hold same-card same-time ties; a 30-day window."""
    from kithgraph.sources.given import order_transactions

    return W.prev_on_card(order_transactions(g.spark, g.sf_dir), window_hours=720)


@query("g9_nodes", over("nodes", sql="SELECT node_id, node_type, key FROM nodes"))
def build_nodes(g: Given):
    return g.nodes


@query(
    "g10_project_v1",
    over(
        "nodes",
        sql="""SELECT (SELECT count(*) FROM nodes WHERE node_type IN ('Transaction', 'Card', 'EmailDomain', 'BillingAddress', 'Device')) AS node_count,
  (SELECT 2 * count(*) FROM edges WHERE rel_type IN ('USED_CARD', 'PAYER_EMAIL', 'RECIPIENT_EMAIL', 'BILLED_TO', 'USED_DEVICE')) AS relationship_count""",
    ),
)
def project_v1(g: Given):
    labels = ["Transaction", "Card", "EmailDomain", "BillingAddress", "Device"]
    found = g.rel(*G.V1_RELS)
    return G.projection_counts(*G.project(G.build_nodes(g.tx, found), G.to_edges(found), labels, G.V1_RELS))


@query(
    "g10_project_v2",
    over(
        "nodes",
        sql="SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT 2 * count(*) FROM all_edges) AS relationship_count",
    ),
)
def project_v2(g: Given):
    labels = ["Transaction", *{G.RELS[r].node_type for r in G.V2_RELS}]
    return G.projection_counts(
        *G.project(g.graph.nodes, g.graph.edges, labels, [*G.V2_RELS, G.CHAIN])
    )


@query(
    "g11_degree",
    over(
        "all_edges",
        sql="""SELECT node_id, rel_type, count(*) AS degree FROM (
  SELECT src AS node_id, rel_type FROM all_edges UNION ALL SELECT dst, rel_type FROM all_edges) GROUP BY ALL""",
    ),
)
def degree(g: Given):
    return G.degree(g.graph.edges, by_type=True)


@query(
    "g11_degree_total",
    over(
        "all_edges",
        sql="""SELECT node_id, count(*) AS degree FROM (
  SELECT src AS node_id FROM all_edges UNION ALL SELECT dst FROM all_edges) GROUP BY ALL""",
    ),
)
def degree_total(g: Given):
    return G.degree(g.graph.edges)


@query(
    "g12_hub_edges",
    over(
        "tx",
        sql="""SELECT 'Transaction:' || TransactionID AS src, dst, rel_type, CAST(NULL AS BIGINT) AS dt_gap_seconds FROM (
  SELECT TransactionID, 'ProductType:' || ProductCD AS dst, 'IN_PRODUCT' AS rel_type FROM tx
  UNION ALL SELECT TransactionID, 'CardNetwork:' || card4, 'ON_NETWORK' FROM tx
  UNION ALL SELECT TransactionID, 'TimeBucket:' || (TransactionDT // 86400), 'IN_TIME_BUCKET' FROM tx)""",
    ),
)
def hub_edges(g: Given):
    return G.build_edges(g.joined, *G.HUB_RELS)


@query(
    "g13_edge_stats",
    over("all_edges", sql="SELECT rel_type, count(*) AS edges FROM all_edges GROUP BY rel_type"),
)
def edge_stats(g: Given):
    return G.edge_stats(g.graph.edges)


@query(
    "u1_union_edges",
    over(
        "edges",
        sql="SELECT src, dst, rel_type FROM edges WHERE rel_type IN ('USED_CARD', 'PAYER_EMAIL', 'RECIPIENT_EMAIL', 'BILLED_TO', 'USED_DEVICE')",
    ),
)
def union_edges(g: Given):
    own, side = G.to_edges(g.rel(*G.V1_RELS[:-1])), G.to_edges(g.rel(G.V1_RELS[-1]))
    return G.union_edges(own, side).select("src", "dst", "rel_type")


@query(
    "g_unlabelled_edges",
    over(
        "all_edges",
        sql="SELECT src, dst, rel_type, dt_gap_seconds FROM all_edges WHERE rel_type <> 'HAS_OS_BROWSER'",
    ),
)
def unlabelled_edges(g: Given):
    """The graph of transactions without labels, with an identity table that lacks columns."""
    return workflows.graph_of(g.tx.drop("isFraud"), g.identity.drop("id_30", "id_31", "DeviceType")).edges


@query(
    "u2_email_domains",
    over("links", sql="SELECT DISTINCT key FROM links WHERE node_type = 'EmailDomain'"),
)
def email_domains(g: Given):
    return G.email_domains(g.rel("PAYER_EMAIL"), g.rel("RECIPIENT_EMAIL"))


@query(
    "u3_set_difference",
    over("tx", sql="SELECT TransactionID AS \"transactionId\" FROM tx WHERE isFraud = 0"),
)
def set_difference(g: Given):
    fraud = g.labels.filter(F.col("isFraud") == 1)
    return g.ids.subtract(fraud.select("transactionId"))
