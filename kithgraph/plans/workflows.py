"""The three batch jobs: load the graph, derive features, train and compare."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators import binned as Bi
from kithgraph.operators import boost as Bo
from kithgraph.operators import components as C
from kithgraph.operators import edges as G
from kithgraph.operators import embed as X
from kithgraph.operators import encode as E
from kithgraph.operators import evaluate as V
from kithgraph.operators import features as Fe
from kithgraph.operators import stats as S
from kithgraph.operators import temporal as W
from kithgraph.operators import train as M
from kithgraph.sources import tables as T
from kithgraph.session import cut_lineage


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def graph_of(
    tx: DataFrame,
    identity: DataFrame | None,
    version: int = 2,
    window_hours: int = 24,
    unique_ids: bool = True,
    store: bool = True,
) -> Graph:
    """Nodes and edges of the first (5 types) or second (8 types) graph.

    Both come from the links, which are written once; the rest is not yet computed. The
    label, the identity table and columns of it may be missing. `unique_ids` off keeps one
    edge per pair when a transaction comes twice. `store` off leaves the links unwritten,
    for a reader that takes the edges once and no nodes.
    """
    rels = G.V1_RELS if version == 1 else G.V2_RELS
    found = G.links_of(tx, identity, rels, unique_ids)
    if store:
        found = cut_lineage(found)
    edges = G.to_edges(found)
    if version == 2:
        once = tx if unique_ids else tx.dropDuplicates(["TransactionID"])
        edges = G.union_edges(edges, G.chain_edges(W.prev_on_card(once, window_hours)))
    return Graph(G.build_nodes(tx, found), edges)


def load_graph(tx: DataFrame, identity: DataFrame | None, path: str, version: int = 2) -> DataFrame:
    """Write the graph tables and return the validation counts of what was written."""
    graph = graph_of(tx, identity, version)
    T.write_graph(graph.nodes, graph.edges, path)
    nodes, edges = T.read_graph(tx.sparkSession, path)
    return S.validate_graph(nodes, edges, tx)


def features(
    tx: DataFrame, identity: DataFrame | None, version: int = 2, **scope
) -> DataFrame:
    """Feature frame of the first or second layout under a label scope.

    The links are read several times, so they are written once. With the training scope
    the label of the transaction before on a card counts up to the split only, too.
    """
    ids = tx.select(F.col("TransactionID").cast("bigint").alias("transactionId"))
    if version == 1:
        found = cut_lineage(G.links_of(tx, identity, G.V1_RELS))
        parts = C.wcc(G.to_edges(found), G.build_nodes(tx, found))
        labels = tx.select(F.col("TransactionID").alias("transactionId"), "isFraud")
        return Fe.feature_frame_v1(ids, found, C.component_features(parts, labels), **scope)
    found = cut_lineage(G.links_of(tx, identity))
    chain = W.previous_on_card(tx)
    if scope.get("label_scope") == "train":
        known = F.col("prev_dt") <= scope["split_dt"]
        chain = chain.withColumn("prev_is_fraud", F.when(known, F.col("prev_is_fraud")))
    chain = W.prev_features(chain)
    return Fe.feature_frame_v2(ids, found, chain, **scope)


def embeddings(tx: DataFrame, identity: DataFrame | None, version: int = 2, **params) -> DataFrame:
    """(transactionId, embedding) over the chosen graph."""
    # The operator stores the edges itself, and only transactions are listed of the nodes.
    edges = graph_of(tx, identity, version, store=False).edges
    nodes = G.transaction_ids(tx).withColumn("node_type", F.lit(G.TRANSACTION))
    return X.transaction_embeddings(X.fastrp(edges, nodes, **params))


class Experiment(NamedTuple):
    predictions: DataFrame
    metrics: DataFrame
    importances: DataFrame


def run_experiment(
    dataset: DataFrame,
    kinds: tuple[str, ...],
    split_dt: int,
    tune_dt: int | None = None,
    stop_on_ap: bool = False,
    binned: bool = False,
    **params,
) -> Experiment:
    """Encode, assemble, train up to the split time, score and measure after it.

    The encoder sees training rows only. As published, early stopping and the threshold use
    the rows that are scored; with `tune_dt` they use the rows up to that time and the
    metrics the rows after it. `stop_on_ap` boosts in blocks and stops on average precision,
    as published, instead of on the loss; `block` and `patience` may be among `params` then.
    `binned` does so over rows that are binned once, for hundreds of trees over many rows.
    """
    train, _ = Fe.temporal_split(dataset, split_dt)
    cats = E.categories(dataset)
    coded = E.encode(dataset, E.fit_encoder(train, cats), cats) if cats else dataset
    if "has_identity" in coded.columns:
        coded = coded.withColumn("has_identity", F.col("has_identity").cast("int"))
    sets = {k: v for k, v in Fe.feature_sets(coded.dtypes).items() if k in kinds}
    inputs = [c for k in sets for c in sets[k]]
    matrix = E.feature_matrix(coded, inputs, keep=("TransactionID", "TransactionDT", "isFraud"))
    matrix = cut_lineage(matrix)
    fit, held = Fe.temporal_split(matrix, split_dt)
    tune, held = (held, held) if tune_dt is None else Fe.temporal_split(held, tune_dt)
    how, score = (M.train_gbt, M.score)
    if stop_on_ap:
        how, score = (Bi.boost, Bi.score_boosted) if binned else (Bo.boost, Bo.score_boosted)
    model = how(fit.drop("TransactionDT"), tune.drop("TransactionDT"), **params)
    scored = cut_lineage(score(model, held))
    tuned = None if tune_dt is None else score(model, tune)
    metrics = V.metrics_from(scored, tune=tuned)
    return Experiment(scored, metrics, M.importance_table(model, sets, dataset))


def train_and_compare(
    tx: DataFrame,
    identity: DataFrame | None,
    split_dt: int,
    label_scope: str = "train",
    dim: int = X.DIM,
    version: int = 2,
    scope: dict | None = None,
    **params,
) -> tuple[Experiment, Experiment, DataFrame]:
    """Tabular against graph-enhanced model on one temporal split.

    Entity rates count training labels only unless `label_scope` says otherwise; `scope`
    has what that scope needs besides (`exclude_self`, `lookback_s`). `version` chooses the
    layout of graph and features.
    """
    scope = {"label_scope": label_scope, **(scope or {})}
    if label_scope == "train":
        scope["split_dt"] = split_dt
    graph = features(tx, identity, version, **scope)
    emb = X.expand_embedding(embeddings(tx, identity, version, dim=dim), dim)
    dataset = cut_lineage(T.build_dataset(G.join_identity(tx, identity), graph, emb))
    base = run_experiment(dataset, ("tabular",), split_dt, **params)
    full = run_experiment(dataset, ("tabular", "graph", "embedding"), split_dt, **params)
    return base, full, V.compare(base.metrics, full.metrics)


def read_raw(spark: SparkSession, transaction_csv: str, identity_csv: str) -> tuple[DataFrame, DataFrame]:
    """The two raw CSV files with pinned types."""
    return T.read_table(spark, transaction_csv), T.read_table(spark, identity_csv)
