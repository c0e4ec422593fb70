"""Graph algorithms and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.catalog.registry import Given, over, query
from kithgraph.operators import components as C
from kithgraph.operators import edges as G
from kithgraph.operators import embed as X
from kithgraph.operators import features as Fe
from kithgraph.plans import workflows

# Smallest reachable node by repeated relaxation: each step keeps one row per node.
_CC = """
both_ways AS (SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}),
cc(node, comp) USING KEY (node) AS (
  SELECT node_id, node_id FROM nodes
  UNION
  SELECT b.b, min(cc.comp) FROM cc JOIN both_ways b ON b.a = cc.node JOIN recurring.cc old ON old.node = b.b
  WHERE cc.comp < old.comp GROUP BY b.b),
members AS (
  SELECT CAST(substr(node, 13) AS BIGINT) AS tid, min(CAST(substr(node, 13) AS BIGINT)) OVER (PARTITION BY comp) AS cid
  FROM cc WHERE node LIKE 'Transaction:%'),
sizes AS (
  SELECT cid, count(*) AS n, CAST(sum(t.isFraud) AS BIGINT) AS f FROM members JOIN tx t ON t.TransactionID = tid GROUP BY cid)"""
_V1_CC = (
    "\nv1_edges AS (SELECT * FROM edges WHERE rel_type IN"
    " ('USED_CARD', 'PAYER_EMAIL', 'RECIPIENT_EMAIL', 'BILLED_TO', 'USED_DEVICE')),"
    + _CC.format(edges="v1_edges")
)
_ALL_CC = "\neight AS (SELECT src, dst FROM all_edges)," + _CC.format(edges="eight")
_CHAIN_CC = "\nchains AS (SELECT src, dst FROM chain_edges)," + _CC.format(edges="chains")
_DEVICE_CC = "\ndevices AS (SELECT src, dst FROM edges WHERE rel_type = 'USED_DEVICE')," + _CC.format(edges="devices")


def _v1(g: Given):
    found = g.rel(*G.V1_RELS)
    return C.wcc(G.to_edges(found), G.build_nodes(g.tx, found))


def _devices(g: Given):
    """Transactions joined by their devices: many components."""
    return C.wcc(G.to_edges(g.rel("USED_DEVICE")), g.nodes)


def _eight(g: Given):
    """All eight link types. The edges are read once, so links are not stored first, and entities have edges."""
    return C.wcc(G.union_edges(g.edges, G.chain_edges(g.chain)), G.transaction_ids(g.tx))


@query(
    "x1_wcc",
    over("nodes", extra=_V1_CC, recursive=True, sql='SELECT tid AS "transactionId", cid AS "componentId" FROM members'),
)
def wcc(g: Given):
    return C.transaction_components(_v1(g))


@query(
    "x1_wcc_chains",
    over("nodes", extra=_CHAIN_CC, recursive=True, sql="SELECT node AS node_id, comp AS component_id FROM cc"),
)
def wcc_chains(g: Given):
    """Long paths: every card is a chain of its transactions, cut at gaps of a day."""
    return C.wcc(G.chain_edges(g.chain), g.nodes)


@query(
    "x1_wcc_eight_types",
    over("nodes", extra=_ALL_CC, recursive=True, sql="SELECT node AS node_id, comp AS component_id FROM cc"),
)
def wcc_eight_types(g: Given):
    return _eight(g)


@query(
    "a10_component_stats",
    over(
        "nodes",
        extra=_DEVICE_CC,
        recursive=True,
        sql="""SELECT cid AS "componentId", n AS component_size, f AS component_fraud_count,
  CAST(f AS DOUBLE) / n AS component_fraud_rate FROM sizes""",
    ),
)
def component_stats(g: Given):
    return C.component_stats(C.transaction_components(_devices(g)), g.labels)


_ATTACHED = """SELECT tid AS "transactionId", m.cid AS "componentId", n AS component_size, f AS component_fraud_count,
  CAST(f AS DOUBLE) / n AS component_fraud_rate FROM members m JOIN sizes s ON s.cid = m.cid"""


@query("j12_attach_component_stats", over("nodes", extra=_DEVICE_CC, recursive=True, sql=_ATTACHED))
def attach_component_stats(g: Given):
    own = C.transaction_components(_devices(g))
    return C.attach_component_stats(own, C.component_stats(own, g.labels))


_STATS = """SELECT cid AS "componentId", n AS component_size, f AS component_fraud_count,
  CAST(f AS DOUBLE) / n AS component_fraud_rate FROM sizes"""


@query("a10_component_stats_eight_types", over("nodes", extra=_ALL_CC, recursive=True, sql=_STATS))
def component_stats_eight_types(g: Given):
    own = C.transaction_components(_eight(g))
    return C.component_stats(own, g.labels)


@query("j12_attach_component_stats_eight_types", over("nodes", extra=_ALL_CC, recursive=True, sql=_ATTACHED))
def attach_component_stats_eight_types(g: Given):
    return C.component_features(_eight(g), g.labels)


@query("x2_component_features", over("nodes", extra=_V1_CC, recursive=True, sql=_ATTACHED))
def component_features(g: Given):
    return C.component_features(_v1(g), g.labels)


@query(
    "j5_feature_frame_v1",
    over(
        "nodes",
        "features",
        extra=_V1_CC,
        recursive=True,
        sql="""SELECT x.transactionId, m.cid AS "componentId", CAST(n AS DOUBLE) AS component_size,
  CAST(f AS DOUBLE) AS component_fraud_count, CAST(f AS DOUBLE) / n AS component_fraud_rate, """
        + ", ".join(f"x.{c}" for c in Fe.V1_FEATURES[4:])
        + " FROM features x JOIN members m ON m.tid = x.transactionId JOIN sizes s ON s.cid = m.cid",
    ),
)
def feature_frame_v1(g: Given):
    return workflows.features(g.tx, g.identity, version=1)


_DIM = 4


def _fastrp_sql(dim: int, steps: int = 3) -> str:
    r = ", ".join(
        f"CAST((CASE (h // {6**i}) % 6 WHEN 0 THEN sqrt(3) WHEN 1 THEN -sqrt(3) ELSE 0 END) / n AS FLOAT) AS v{i}"
        for i in range(dim)
    )
    parts = [
        f"\nu AS (SELECT src, dst FROM all_edges UNION ALL SELECT dst, src FROM all_edges),"
        f"\ne0 AS (SELECT node, {r} FROM (SELECT src AS node, count(*) AS n, ('0x' || substr(md5(src || '|0|42'), 1, 15))::BIGINT AS h FROM u GROUP BY src))"
    ]
    for k in range(1, steps + 1):
        means = ", ".join(f"CAST(avg(CAST(v{i} AS DOUBLE)) AS FLOAT) AS v{i}" for i in range(dim))
        parts.append(f"\ne{k} AS (SELECT u.dst AS node, {means} FROM u JOIN e{k - 1} e ON e.node = u.src GROUP BY u.dst)")
        norm = "sqrt(" + " + ".join(f"CAST(v{i} AS DOUBLE) * v{i}" for i in range(dim)) + ")"
        unit = ", ".join(f"coalesce(v{i} / nullif({norm}, 0), 0) AS w{i}" for i in range(dim))
        parts.append(f"\nn{k} AS (SELECT node, {unit} FROM e{k})")
    return ",".join(parts)


@query(
    "x3_fastrp_small",
    over(
        "nodes",
        extra=_fastrp_sql(_DIM),
        sql="SELECT t.TransactionID AS \"transactionId\", "
        + ", ".join(f"round(CAST(CAST(coalesce(a.w{i}, 0) + coalesce(b.w{i}, 0) AS FLOAT) AS DOUBLE), 3) + 0.0::DOUBLE AS e{i}" for i in range(_DIM))
        + " FROM tx t LEFT JOIN n2 a ON a.node = 'Transaction:' || t.TransactionID"
        " LEFT JOIN n3 b ON b.node = 'Transaction:' || t.TransactionID",
    ),
)
def fastrp_small(g: Given):
    emb = workflows.embeddings(g.tx, g.identity, dim=_DIM)
    return emb.select(
        "transactionId",
        *[
            (F.round(F.col("embedding")[i].cast("double"), 3) + F.lit(0.0)).alias(f"e{i}")
            for i in range(_DIM)
        ],
    )


@query("x3_fastrp")
def fastrp(g: Given):
    """All 64 dimensions over the full graph."""
    return workflows.embeddings(g.tx, g.identity)


@query(
    "x4_expand_embedding",
    over(
        "vectors",
        sql="SELECT transactionId, " + ", ".join(f"embedding[{i + 1}] AS emb_{i}" for i in range(64)) + " FROM vectors",
    ),
)
def expand_embedding(g: Given):
    return X.expand_embedding(g.vectors, 64)


@query(
    "x6_covariance",
    over(
        "vectors",
        sql="""SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, count(*) AS n, round(covar_pop(a.x, b.x), 6) + 0.0::DOUBLE AS cov
FROM (SELECT transactionId AS t, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM vectors) a
JOIN (SELECT transactionId AS t, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM vectors) b
  ON a.t = b.t AND a.i <= b.i GROUP BY ALL""",
    ),
)
def covariance(g: Given):
    return X.covariance(g.vectors).withColumn("cov", F.round("cov", 6) + F.lit(0.0))


@query("x6_pca_2d")
def pca_2d(g: Given):
    return X.pca_2d(g.vectors)
