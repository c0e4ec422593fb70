"""Embedding steps over nodes placed by their leader: what is shuffled, what is left in the shared folder."""

from pathlib import Path

from pyspark.sql import functions as F

from kithgraph.operators import embed as X
from kithgraph.operators.skew import hot_rows
from kithgraph.session import cut_placed, shared_dir


def _edges(spark):
    """Cards of four transactions each, one after the other on the card; a bridge joins two cards."""
    pairs = [(f"Transaction:{t}", f"Card:{t // 4}") for t in range(40)]
    pairs += [(f"Transaction:{t}", f"Transaction:{t + 1}") for t in range(40) if t % 4 < 3] + [("Transaction:3", "Transaction:4")]
    return pairs, spark.createDataFrame(pairs, "src string, dst string")


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_nodes_lie_with_their_leader(spark, monkeypatch):
    monkeypatch.setattr(X, "hot_rows", lambda counts, n: hot_rows(counts, n, limit=2))  # none is hot
    pairs, edges = _edges(spark)
    home = X._placed(edges).home
    rows = {r.node_id: r for r in home.collect()}
    assert all(r.leader == (k if k.startswith("Card") else f"Card:{int(k.split(':')[1]) // 4}") for k, r in rows.items())
    heard = {k: sorted([*(r.close or []), *(f.id for f in r.far or [])]) for k, r in rows.items()}
    assert heard == {k: sorted([b for a, b in pairs if a == k] + [a for a, b in pairs if b == k]) for k in rows}
    assert {(k, f.leader, f.id) for k, r in rows.items() for f in r.far or []} == {
        ("Transaction:3", "Card:1", "Transaction:4"), ("Transaction:4", "Card:0", "Transaction:3"),
    }


def test_a_step_shuffles_vectors_between_leaders_only(spark, monkeypatch):
    monkeypatch.setattr(X, "hot_rows", lambda counts, n: hot_rows(counts, n, limit=2))
    placed = X._placed(_edges(spark)[1])
    vectors, _ = X._neighbour_mean(placed, X.start_vectors(placed.home, 8, -1.0, 1), None, 8, None)
    stored = cut_placed(vectors.sortWithinPartitions("leader", "node_id"))
    sent = placed.home.join(stored, ["leader", "node_id"])
    again, _ = X._neighbour_mean(placed, sent, None, 8, None)
    cut_placed(again)
    assert _exchanges(again) == 1  # of the vectors to nodes with another leader; the join needs none


def test_nothing_stays_but_what_the_result_reads(spark, monkeypatch):
    monkeypatch.setattr(X, "hot_rows", lambda counts, n: hot_rows(counts, n, limit=2))
    _, edges = _edges(spark)
    nodes = spark.range(41).select(F.concat(F.lit("Transaction:"), "id").alias("node_id"), F.lit("Transaction").alias("node_type"))
    folder = Path(shared_dir(spark).removeprefix("file:"))

    def stored():
        return {p for p in folder.glob("**/*") if p.is_dir() and (p.name.startswith(("rdd-", "edges-")))}

    before = stored()
    made = X.fastrp(edges, nodes, dim=4)
    assert len(stored() - before) == 2  # the placed edges, whose ids it reads, and the vectors
    rows = {r.node_id: r.embedding for r in made.collect()}
    assert len(rows) == 41 and rows["Transaction:40"] == [0.0] * 4 and any(rows["Transaction:0"])
