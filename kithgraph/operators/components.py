"""Connected components of the undirected graph.

The graph is first contracted twice. Where edges lie together, as the chain of a card does,
each task replaces them by one star a component, so a node keeps at most one edge a chunk.
Then every source keeps one representative (its smallest neighbour) and its other neighbours
link to that one. What remains are distinct pairs of star centres, on which alternating
large-star and small-star rounds (Kiveris et al. 2014) run until nothing changes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions import normalize as N
from kithgraph.operators.edges import TRANSACTION
from kithgraph.operators.skew import attach
from kithgraph.session import cut_lineage, cut_placed

MAX_ROUNDS = 40
FEW_EDGES = 1_000_000  # so few edges fit a handful of tasks whatever their keys
EDGES_PER_FILE = 100_000
CHUNK = 500_000  # edges a task holds at once


def _oriented(pairs: DataFrame) -> DataFrame:
    """Distinct (child, parent) with child > parent, loops dropped."""
    return pairs.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")
    ).distinct()


def _starred(near: DataFrame) -> DataFrame:
    """Distinct edges of (child, parent, least, moved) rows: both ends link to `least`."""
    changed = F.greatest(F.col("moved"), (F.col("parent") != F.col("least")).cast("int"))
    out = F.array(
        F.struct(F.col("child").alias("child"), F.col("least").alias("parent"), changed.alias("moved")),
        F.struct(F.col("parent").alias("child"), F.col("least").alias("parent"), changed.alias("moved")),
    )
    return (
        near.select(F.inline(out))
        .filter(F.col("child") != F.col("parent"))
        .groupBy("child", "parent")
        .agg(F.max("moved").alias("moved"))
    )


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; `moved` marks edges that changed."""
    # Large star: the larger neighbours of a node link to the smallest node around it.
    both = F.array(
        F.struct(F.col("parent").alias("node"), F.col("parent").alias("near"), F.lit(1).alias("up")),
        F.struct(F.col("child").alias("node"), F.col("parent").alias("near"), F.lit(0).alias("up")),
    )
    least = (
        edges.select(F.inline(both))
        .groupBy("node")
        .agg(F.min("near").alias("least"), F.sum("up").alias("n"))
        .filter("n > 0")
    )
    large = (
        attach(edges.withColumnRenamed("parent", "node"), least, ["node"], "n", "inner")
        .groupBy("child", F.col("least").alias("parent"))
        .agg(F.max((F.col("least") != F.col("node")).cast("int")).alias("moved"))
    )
    # Small star: a node and its smaller neighbours link to the smallest of them.
    least = large.groupBy("child").agg(F.min("parent").alias("least"), F.count(F.lit(1)).alias("n"))
    return _starred(attach(large, least, ["child"], "n", "inner"))


def _small_round(edges: DataFrame) -> DataFrame:
    """The same two steps for few edges: a window for each, so no joins and three shuffles."""
    both = F.array(
        F.struct(F.col("parent").alias("node"), F.col("child").alias("near")),
        F.struct(F.col("child").alias("node"), F.col("parent").alias("near")),
    )
    around = F.least("node", F.min("near").over(Window.partitionBy("node")))
    large = (
        edges.select(F.inline(both))
        .withColumn("least", around)
        .filter("near > node")
        .select(
            F.col("near").alias("child"),
            F.col("least").alias("parent"),
            (F.col("least") != F.col("node")).cast("int").alias("moved"),
        )
    )
    return _starred(large.withColumn("least", F.min("parent").over(Window.partitionBy("child"))))


def star_components(pairs: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(child, parent) with the smallest member of its component for every other node in `pairs`."""
    edges = cut_lineage(_oriented(pairs))
    count = edges.count()
    for _ in range(max_rounds):
        if count <= FEW_EDGES:  # a round does not add edges: keep small rounds in few files
            after = _small_round(edges.select("child", "parent")).coalesce(max(1, -(-count // EDGES_PER_FILE)))
        else:
            after = _round(edges.select("child", "parent"))
        edges = cut_lineage(after)
        count, moved = edges.agg(F.count(F.lit(1)), F.max("moved")).first()
        if not moved:
            return edges.select("child", "parent")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def stored_components(pairs: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """`star_components` of pairs that cost little to read again.

    Up to EDGES_PER_FILE of them, which a round would leave in one file, become stars in one
    task, without a round; the driver then has two jobs instead of some six for each round.
    """
    if pairs.count() > EDGES_PER_FILE:
        return star_components(pairs, max_rounds)
    edges = starred_in_tasks(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).coalesce(1))
    return cut_lineage(edges.filter("src <> dst").select(F.col("src").alias("child"), F.col("dst").alias("parent")))


def _stars(held: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    """(src, dst) for every node of the edges but the centres, dst the smallest id of its component.

    A node that links to itself only keeps that edge.
    """
    table = pa.Table.from_batches(held)
    ends = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    names = ends.dictionary.take(order)
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    a, b = np.split(rank[ends.indices.to_numpy()], 2)
    loops, label = a[a == b], np.arange(len(names))
    while len(a):
        # Centres hook to smaller ones, then every label goes on to its centre.
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    src = np.flatnonzero(label != np.arange(len(names)))
    alone = np.setdiff1d(loops, np.concatenate([src, label[src]]))
    src, dst = np.concatenate([src, alone]), np.concatenate([label[src], alone])
    return pa.RecordBatch.from_arrays([names.take(pa.array(x)) for x in (src, dst)], ["src", "dst"])


def starred_in_tasks(edges: DataFrame, rows: int = CHUNK) -> DataFrame:
    """(src, dst) edges with the same components, at most one for each node in `rows` edges of a task.

    Nothing is shuffled: components that lie together, such as chains from one window, are
    whole stars afterwards, and a hub has an edge for each chunk instead of one for each neighbour.
    """

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= rows:
                yield _stars(held)
                held, n = [], 0
        if n:
            yield _stars(held)

    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").mapInArrow(run, f"src {kind}, dst {kind}")


def wcc(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node_id, component_id) with the smallest member id as component id.

    Ids are strings. Nodes without edges, if given, form components of their own; ends of
    edges come out whether they are listed or not, so ids of nodes that have edges may be left out.
    """
    # One row a source, placed by source once. A source has an edge a chunk at most, so no
    # group is large. Stars point to smaller ids: `rep` < src but for nodes that stand alone.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starred = starred_in_tasks(edges)
    if nodes is not None:
        starred = starred.unionByName(nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")))
    # Stored before they are placed: what makes the edges keeps adaptive execution, so skewed joins are split.
    near = cut_lineage(starred).repartition(parts, "src").groupBy("src").agg(F.collect_set("dst").alias("near"))
    rep = F.array_min("near").alias("rep")
    more = F.array_except("near", F.array("src", F.array_min("near"))).alias("more")
    stars = cut_placed(near.select("src", rep, more).sortWithinPartitions("src"))
    # The other ends: those that are sources as well (as in a chain) must stay in the contracted graph.
    ends = stars.select(F.explode(F.array_append("more", F.col("rep"))).alias("src")).filter("src IS NOT NULL")
    ends = cut_lineage(ends.distinct().join(stars.select("src", "rep"), "src", "left"))
    pairs = stars.select(F.col("rep").alias("a"), F.explode("more").alias("b"))
    pairs = pairs.unionByName(ends.filter("rep < src").select(F.col("src").alias("a"), F.col("rep").alias("b")))
    parents = cut_lineage(star_components(pairs, max_rounds))
    # A component's smallest member has no smaller end, so it is an end itself or stands alone.
    sizes = stars.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    named = sizes.join(parents.withColumnRenamed("child", "rep"), "rep", "left").select(
        "rep", F.coalesce("parent", "rep").alias("component_id"), "n"
    )
    own = attach(stars.select("src", "rep"), named, ["rep"], "n", "inner").select(
        F.col("src").alias("node_id"), "component_id"
    )
    roots = ends.filter("rep IS NULL").select(F.col("src").alias("node_id"))
    roots = roots.join(parents.withColumnRenamed("child", "node_id"), "node_id", "left").select(
        "node_id", F.coalesce("parent", "node_id").alias("component_id")
    )
    return cut_lineage(own.unionByName(roots))


def transaction_components(components: DataFrame) -> DataFrame:
    """(transactionId, componentId) with the smallest transaction id as a numeric component id."""
    mark = f"{TRANSACTION}:"
    own = components.filter(F.col("node_id").startswith(mark)).select(
        F.substring("node_id", len(mark) + 1, 40).cast("bigint").alias("transactionId"), "component_id"
    )
    named = own.groupBy("component_id").agg(
        F.min("transactionId").alias("componentId"), F.count(F.lit(1)).alias("n")
    )
    return attach(own, named, ["component_id"], "n", "inner").select("transactionId", "componentId")


def component_stats(tx_components: DataFrame, labels: DataFrame) -> DataFrame:
    """Size in transactions, fraud count and fraud rate per component."""
    labelled = tx_components.join(labels.select("transactionId", "isFraud"), "transactionId", "left")
    return (
        labelled.groupBy("componentId")
        .agg(
            F.count(F.lit(1)).alias("component_size"),
            F.sum(N.is_fraud()).cast("bigint").alias("component_fraud_count"),
        )
        .withColumn(
            "component_fraud_rate", N.rate(F.col("component_fraud_count"), F.col("component_size"))
        )
    )


def attach_component_stats(tx_components: DataFrame, stats: DataFrame) -> DataFrame:
    """Each transaction with the stats of its component; one giant component is harmless."""
    return attach(tx_components, stats, ["componentId"], "component_size").select(
        "transactionId",
        "componentId",
        "component_size",
        "component_fraud_count",
        "component_fraud_rate",
    )


def component_features(components: DataFrame, labels: DataFrame) -> DataFrame:
    own = transaction_components(components)
    return attach_component_stats(own, component_stats(own, labels))
