"""Registration of queries, and the frames and SQL they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import edges as G
from kithgraph.operators import temporal as W
from kithgraph.plans import workflows
from kithgraph.sources import given

SPLIT = given.SPLIT_DT
WINDOW = 86_400


class Given:
    """The frames the queries start from, built once per query and computed lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def tx(self) -> DataFrame:
        return given.transactions(self.spark, self.sf_dir)

    @cached_property
    def identity(self) -> DataFrame:
        return given.identity(self.spark, self.sf_dir)

    @cached_property
    def joined(self) -> DataFrame:
        return G.join_identity(self.tx, self.identity)

    @cached_property
    def ids(self) -> DataFrame:
        return self.tx.select(F.col("TransactionID").alias("transactionId"))

    @cached_property
    def labels(self) -> DataFrame:
        return self.tx.select(F.col("TransactionID").alias("transactionId"), "isFraud")

    @cached_property
    def links(self) -> DataFrame:
        return G.links_of(self.tx, self.identity)

    @cached_property
    def edges(self) -> DataFrame:
        return G.to_edges(self.links)

    @cached_property
    def nodes(self) -> DataFrame:
        return G.build_nodes(self.tx, self.links)

    @cached_property
    def graph(self) -> workflows.Graph:
        return workflows.graph_of(self.tx, self.identity)

    @cached_property
    def chain(self) -> DataFrame:
        return W.previous_on_card(self.tx)

    @cached_property
    def features(self) -> DataFrame:
        return workflows.features(self.tx, self.identity)

    @cached_property
    def vectors(self) -> DataFrame:
        return given.vectors(self.spark, self.sf_dir)

    @cached_property
    def pred(self) -> DataFrame:
        return given.predictions(self.tx)

    def rel(self, *rel_types: str) -> DataFrame:
        return G.links_of(self.tx, self.identity, rel_types)


class Query(NamedTuple):
    run: Callable[[Given], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Given` under a name with its checking SQL."""

    def register(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(fn, sql)
        return fn

    return register


TX = """
base AS (
  SELECT e.event_id, e.user_id, e.event_type, e.value, c.c_nationkey, c.c_mktsegment, n.n_regionkey,
    CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INTEGER) AS k,
    CAST(floor(epoch_us(e.ts) / 1000000) AS BIGINT) - 1704067200 AS dt
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
tx AS (
  SELECT event_id AS TransactionID, dt AS TransactionDT, value AS TransactionAmt,
    CASE WHEN event_type = 'error' AND (user_id % 10 = 3 OR k % 10 = 7) THEN 1 ELSE 0 END AS isFraud,
    substr('WCHSR', CAST(event_id % 5 + 1 AS INTEGER), 1) AS ProductCD,
    CASE WHEN event_id % 250 <> 0 THEN user_id END AS card1,
    CASE user_id % 4 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'american express' ELSE 'discover' END AS card4,
    CASE WHEN user_id % 3 = 0 THEN 'credit' ELSE 'debit' END AS card6,
    CAST(100 + c_nationkey AS DOUBLE) AS addr1,
    CASE WHEN event_id % 9 <> 0 THEN CAST(n_regionkey AS DOUBLE) END AS addr2,
    CASE WHEN event_id % 3 = 0 THEN value / 10 END AS dist1,
    CASE WHEN event_id % 5 <> 0 THEN concat(' ', c_mktsegment, '.com') END AS P_emaildomain,
    CASE WHEN event_id % 4 = 1 THEN CASE k % 3 WHEN 0 THEN 'building.com' WHEN 1 THEN 'Furniture.com' ELSE 'gmail.com' END END AS R_emaildomain,
    CASE k % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END AS M1
  FROM base),
ident AS (
  SELECT event_id AS TransactionID,
    CASE WHEN k % 50 = 0 THEN NULL WHEN k % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS DeviceType,
    CASE WHEN k < 20 THEN 'Windows' WHEN k < 30 THEN 'iOS Device' WHEN k < 35 THEN 'rv:11 Trident/7.0'
      WHEN k < 38 THEN NULL ELSE concat('SM-A', k, ' Build/NRD', event_id % 3) END AS DeviceInfo,
    CASE WHEN event_id % 28 = 0 THEN 'IP_PROXY:ANONYMOUS' WHEN event_id % 36 = 0 THEN 'IP_PROXY:TRANSPARENT'
      WHEN event_id % 44 = 0 THEN 'NotFound' END AS id_23,
    CASE WHEN k % 2 = 0 THEN NULL WHEN k % 3 = 0 THEN 'Windows 10' ELSE 'Android 7.0' END AS id_30,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'safari 11.0' ELSE 'chrome 63.0' END AS id_31
  FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
  WHERE event_id % 4 = 0)"""

KEYS = """
keys AS (
  SELECT t.*, i.DeviceType, i.DeviceInfo, i.id_23, i.id_30, i.id_31,
    CAST(t.card1 AS VARCHAR) AS card_key,
    nullif(lower(trim(t.P_emaildomain)), '') AS payer_key,
    nullif(lower(trim(t.R_emaildomain)), '') AS recip_key,
    CAST(CAST(trunc(t.addr1) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(trunc(t.addr2) AS BIGINT) AS VARCHAR) AS addr_key,
    nullif(substr(replace(trim(split_part(trim(i.DeviceInfo), ' Build/', 1)), 'Trident/7.0', 'Windows IE11'), 1, 200), '') AS device_key,
    CASE WHEN i.id_30 IS NOT NULL OR i.id_31 IS NOT NULL
      THEN substr(coalesce(i.id_30, 'unknown_os') || '|' || coalesce(i.id_31, 'unknown_browser'), 1, 200) END AS osb_key,
    CASE WHEN lower(i.id_23) NOT IN ('nan', 'notfound', '') THEN trim(i.id_23) END AS proxy_key
  FROM tx t LEFT JOIN ident i ON t.TransactionID = i.TransactionID)"""

# relationship type -> (key column above, node type, feature prefix)
SQL_RELS = {
    "USED_CARD": ("card_key", "Card", "card"),
    "PAYER_EMAIL": ("payer_key", "EmailDomain", "payer_email"),
    "RECIPIENT_EMAIL": ("recip_key", "EmailDomain", "recip_email"),
    "BILLED_TO": ("addr_key", "BillingAddress", "billing"),
    "USED_DEVICE": ("device_key", "Device", "device"),
    "HAS_OS_BROWSER": ("osb_key", "OSBrowser", "os_browser"),
    "VIA_PROXY": ("proxy_key", "ProxyType", "proxy"),
}
LINKS = "\nlinks AS (\n" + "\n  UNION ALL ".join(
    f"SELECT TransactionID AS transactionId, '{r}' AS rel_type, '{node}' AS node_type, {key} AS key,"
    f" TransactionDT AS dt, TransactionAmt AS amt, isFraud FROM keys WHERE {key} IS NOT NULL"
    for r, (key, node, _) in SQL_RELS.items()
) + ")"
STATS = """
stats AS (
  SELECT rel_type, key, count(*) AS tx_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
    CAST(sum(isFraud) AS DOUBLE) / count(*) AS fraud_rate
  FROM links GROUP BY rel_type, key)"""
CHAIN = f"""
near AS (
  SELECT TransactionID, card_key, TransactionDT, isFraud,
    lag(TransactionID) OVER w AS prev_id, lag(TransactionDT) OVER w AS prev_dt, lag(isFraud) OVER w AS prev_fraud
  FROM keys WHERE card_key IS NOT NULL
  WINDOW w AS (PARTITION BY card_key ORDER BY TransactionDT, TransactionID)),
chain AS (
  SELECT prev_id, TransactionID AS curr_id, TransactionDT - prev_dt AS dt_gap_seconds, card_key,
    prev_fraud AS prev_is_fraud, isFraud AS curr_is_fraud, prev_dt
  FROM near WHERE prev_id IS NOT NULL AND TransactionDT - prev_dt BETWEEN 0 AND {WINDOW})"""
EDGES = """
edges AS (
  SELECT 'Transaction:' || transactionId AS src, node_type || ':' || key AS dst, rel_type,
    CAST(NULL AS BIGINT) AS dt_gap_seconds FROM links),
chain_edges AS (
  SELECT 'Transaction:' || prev_id AS src, 'Transaction:' || curr_id AS dst, 'PREV_ON_CARD' AS rel_type,
    dt_gap_seconds FROM chain),
all_edges AS (SELECT * FROM edges UNION ALL SELECT * FROM chain_edges),
nodes AS (
  SELECT 'Transaction:' || TransactionID AS node_id, 'Transaction' AS node_type, CAST(TransactionID AS VARCHAR) AS key FROM tx
  UNION ALL SELECT DISTINCT node_type || ':' || key, node_type, key FROM links)"""
FEATURES = (
    "\nfeatures AS (SELECT k.TransactionID AS transactionId, "
    + ", ".join(
        f"CAST(coalesce(s_{p}.tx_count, 0) AS DOUBLE) AS {p}_tx_count,"
        f" CAST(coalesce(s_{p}.fraud_count, 0) AS DOUBLE) AS {p}_fraud_count,"
        f" coalesce(s_{p}.fraud_rate, -1.0) AS {p}_fraud_rate"
        for r, (_, _, p) in SQL_RELS.items()
        if p != "proxy"
    )
    + ", CASE WHEN s_proxy.key IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS is_proxy,"
    " coalesce(s_proxy.fraud_rate, -1.0) AS proxy_fraud_rate,"
    " CAST(coalesce(c.prev_is_fraud, 0) AS DOUBLE) AS prev_card_is_fraud,"
    " CAST(coalesce(c.dt_gap_seconds, -1) AS DOUBLE) AS prev_card_dt_gap FROM keys k "
    + " ".join(
        f"LEFT JOIN stats s_{p} ON s_{p}.rel_type = '{r}' AND s_{p}.key = k.{key}"
        for r, (key, _, p) in SQL_RELS.items()
    )
    + " LEFT JOIN chain c ON c.curr_id = k.TransactionID)"
)
PRED = """
pred AS (
  SELECT TransactionID, isFraud, (2 + 35 * isFraud + (TransactionID * 7919) % 61) / 100.0::DOUBLE AS proba FROM tx)"""
VECTORS = """
vectors AS (
  SELECT vec_id AS transactionId, embedding, CASE WHEN label = 0 THEN 1 ELSE 0 END AS isFraud FROM embeddings)"""

_PARTS = (
    ("features", FEATURES, ("keys", "stats", "chain")),
    ("all_edges", EDGES, ("links", "chain", "tx")),
    ("edges", EDGES, ("links", "chain", "tx")),
    ("chain_edges", EDGES, ("links", "chain", "tx")),
    ("nodes", EDGES, ("links", "chain", "tx")),
    ("chain", CHAIN, ("keys",)),
    ("near", CHAIN, ("keys",)),
    ("stats", STATS, ("links",)),
    ("links", LINKS, ("keys",)),
    ("keys", KEYS, ("tx",)),
    ("pred", PRED, ("tx",)),
    ("vectors", VECTORS, ()),
    ("tx", TX, ()),
    ("ident", TX, ()),
)
_ORDER = (TX, KEYS, LINKS, STATS, CHAIN, EDGES, FEATURES, PRED, VECTORS)


def over(*names: str, sql: str, recursive: bool = False, extra: str = "") -> str:
    """SQL with the shared views that `names` need; `extra` adds views of its own."""
    wanted, todo = set(), list(names)
    texts = {}
    needs = {}
    for name, text, deps in _PARTS:
        texts[name], needs[name] = text, deps
    while todo:
        name = todo.pop()
        wanted.add(texts[name])
        todo.extend(needs[name])
    views = [text for text in _ORDER if text in wanted]
    if extra:
        views.append(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(views) + "\n" + sql.strip()
