"""Steps over placed edges: what is shuffled, and the same results by plain Python."""

import math
import random

from pyspark.sql import functions as F

from kithgraph.catalog import Given
from kithgraph.operators import components as C
from kithgraph.operators import embed as X
from kithgraph.operators import train as M
from kithgraph.operators.skew import hot_rows
from kithgraph.plans import workflows
from kithgraph.session import cut_lineage, cut_placed


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _graph(spark):
    pairs = [(f"Transaction:{t}", e) for t in range(60) for e in ("EmailDomain:x", f"Card:{t // 3}", f"Card:{t // 3}")]
    pairs += [(f"Transaction:{t}", f"Transaction:{t + 1}") for t in range(0, 60, 3)] + [("EmailDomain:x", "EmailDomain:y")] * 30
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(f"Transaction:{t}", "Transaction") for t in range(62)], "node_id string, node_type string")
    return pairs, edges, nodes


def test_placed_rows_join_and_group_without_a_shuffle(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("k"), "id")
    one, two = (cut_placed(ids.repartition(8, "k").sortWithinPartitions("k")) for _ in range(2))
    assert _exchanges(one.groupBy("k").count()) == 0
    assert _exchanges(one.hint("merge").join(two.withColumnRenamed("id", "n"), "k")) == 0


def test_an_embedding_step_shuffles_vectors_between_cool_nodes_only(spark, monkeypatch):
    monkeypatch.setattr(X, "hot_rows", lambda counts, n: hot_rows(counts, n, limit=20))
    _, edges, _ = _graph(spark)
    placed = X._placed(edges)
    assert {r.node_id for r in placed.hot.collect()} == {"EmailDomain:x", "EmailDomain:y"}
    few = X.start_vectors(placed.hot, 8, -1.0, 1).select("code", "vec")
    others, _ = X._neighbour_mean(placed, X.start_vectors(placed.home, 8, -1.0, 1), few, 8, None)
    assert _exchanges(others) == 1  # messages to their receivers; none for the sums or the hot node


def test_embedding_with_hot_nodes_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(X, "hot_rows", lambda counts, n: hot_rows(counts, n, limit=20))
    pairs, edges, nodes = _graph(spark)
    got = {r.node_id: list(r.embedding) for r in X.fastrp(edges, nodes, dim=20, weights=(0.5, 1.0, 2.0)).collect()}
    around = {}
    for a, b in pairs:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    degrees = spark.createDataFrame([(k, len(v)) for k, v in around.items()], "node_id string, n long")
    vec = {r.node_id: list(r.vec) for r in X.start_vectors(degrees, 20, X.NORM_STRENGTH, X.SEED).collect()}
    total = {f"Transaction:{t}": [0.0] * 20 for t in range(62)}
    for weight in (0.5, 1.0, 2.0):
        vec = {k: [sum(vec[o][i] for o in v) / len(v) for i in range(20)] for k, v in around.items()}
        for k in total.keys() & vec.keys():
            norm = math.sqrt(sum(x * x for x in vec[k]))
            total[k] = [t + weight * x / norm if norm else t for t, x in zip(total[k], vec[k], strict=True)]
    assert got.keys() == total.keys()
    assert all(abs(a - b) < 1e-5 for k in total for a, b in zip(got[k], total[k], strict=True))


def test_edges_that_lie_together_become_stars_in_their_task(spark):
    pairs = [(f"c{c}-{i:03}", f"c{c}-{i + 1:03}") for c in range(3) for i in range(100)] + [("z", "z"), ("c0-000", "c0-000")]
    rng = random.Random(4)
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    whole = {tuple(r) for r in C.starred_in_tasks(edges.coalesce(1)).collect()}
    assert whole == {(f"c{c}-{i:03}", f"c{c}-000") for c in range(3) for i in range(1, 101)} | {("z", "z")}
    for rows in (1, 7, 50):  # any cut gives the same components
        found = C.wcc(C.starred_in_tasks(edges.coalesce(1), rows=rows))
        assert {tuple(r) for r in found.collect()} == whole | {(f"c{c}-000", f"c{c}-000") for c in range(3)}


def test_chains_that_lie_together_need_no_rounds(spark):
    pairs = [(f"n{i:04}", f"n{i + 1:04}") for i in range(3000)]
    edges = spark.createDataFrame(pairs, "src string, dst string").coalesce(1)
    assert C.wcc(edges, max_rounds=1).filter("component_id <> 'n0000'").count() == 0


def test_training_rows_keep_their_share_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 10)
    rows = spark.range(1000).select(F.col("id").alias("TransactionID"))
    placed = cut_lineage(M.by_id(rows))
    assert placed.rdd.getNumPartitions() == 100
    assert max(placed.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 40


def test_nodes_with_edges_need_not_be_listed(spark):
    pairs = [("t2", "c"), ("t1", "c"), ("t3", "t2"), ("t4", "d"), ("t4", "t4")]
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(3)
    alone = spark.createDataFrame([("t1",), ("t9",), ("t9",)], "node_id string")
    found = [tuple(r) for r in C.wcc(edges, alone).collect()]
    assert sorted(found) == [("c", "c"), ("d", "d"), ("t1", "c"), ("t2", "c"), ("t3", "c"), ("t4", "d"), ("t9", "t9")]


def test_embeddings_do_not_store_the_links_besides_the_edges(spark, monkeypatch):
    g = Given(spark, "/root/testdata/sf0.001")
    want = {r.transactionId for r in g.tx.select(F.col("TransactionID").alias("transactionId")).collect()}
    monkeypatch.setattr(workflows, "cut_lineage", None)  # only the operator may store its edges
    got = workflows.embeddings(g.tx, g.identity, dim=2).collect()
    assert {r.transactionId for r in got} == want and len(got) == len(want)
