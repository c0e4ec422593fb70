"""Operators against brute force on small frames, and properties SQL cannot state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.catalog import Given
from kithgraph.operators import components as C
from kithgraph.operators import edges as G
from kithgraph.operators import embed as X
from kithgraph.operators import encode as E
from kithgraph.operators import evaluate as V
from kithgraph.operators import features as Fe
from kithgraph.operators import profile as D
from kithgraph.operators import sampling, skew
from kithgraph.operators import stats as S
from kithgraph.operators import temporal as W
from kithgraph.operators import train as M
from kithgraph.plans import questions as Q
from kithgraph.plans import workflows
from kithgraph.sources import tables as T

SF_DIR = "/root/testdata/sf0.001"
SLICED = {"rows": 20}  # most cards are longer


@pytest.fixture(scope="module")
def g(spark):
    return Given(spark, SF_DIR)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_sliced_windows_equal_plain_ones(g):
    assert rows(W.next_on_card(g.tx, **SLICED)) == rows(W.next_on_card(g.tx))
    assert rows(W.prev_on_card(g.tx, **SLICED)) == rows(W.prev_on_card(g.tx))
    assert rows(W.card_chain_rate(g.tx, 5, **SLICED)) == rows(W.card_chain_rate(g.tx, 5))
    week = 7 * 86_400
    assert rows(W.rolling_entity_rate(g.links, week, **SLICED)) == rows(W.rolling_entity_rate(g.links, week))


def test_slices_are_used_when_a_card_is_hot(g):
    times = W.card_times(g.tx)
    plain, sliced = skew.slice_big(times, ["card"], ["dt", "id"], **SLICED)
    assert plain.count() + sliced.count() == times.count()
    assert sliced.select("card", "_slice").distinct().count() > 10
    assert skew.slice_big(times, ["card"], ["dt", "id"])[1] is None


def test_ties_are_ordered_by_id(spark):
    tx = spark.createDataFrame(
        [(3, 100, 1, 7), (1, 100, 0, 7), (2, 100, 1, 7), (9, None, 0, 7), (8, 5, 0, None)],
        "TransactionID long, TransactionDT long, isFraud int, card1 long",
    )
    pairs = {(r.prev_id, r.curr_id, r.dt_gap_seconds) for r in W.prev_on_card(tx).collect()}
    assert pairs == {(1, 2, 0), (2, 3, 0)}
    assert rows(W.prev_on_card(tx, **SLICED)) == rows(W.prev_on_card(tx))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("limit", [2, 5, 1000])
def test_attach_equals_a_plain_join(spark, how, limit):
    rng = random.Random(limit)
    keys = [0] * 60 + [rng.randrange(20) for _ in range(100)]
    big = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    small = small.filter("k % 7 <> 3")
    for stay in (False, True):
        got = skew.attach(big, small, ["k"], "n", how, limit, stay)
        assert rows(got) == rows(big.join(small, "k", how))


def test_fewer_hot_keys_than_the_limit(spark):
    counts = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("n"))
    for limit in (5, 50, 900):
        hot = skew.hot_rows(counts, "n", limit)
        assert hot is None or hot.count() < limit


def test_running_sums_over_slices(spark):
    rng = random.Random(1)
    data = [(rng.randrange(3), rng.randrange(200), rng.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(data, "g long, t long, v long").withColumn("_s", F.floor(F.col("t") / 17))
    for descending in (False, True):
        got = skew.running_sums(df, ["g"], "_s", "t", {"run": "v"}, descending)
        for r in got.collect():
            want = sum(v for g_, t, v in data if g_ == r.g and (t >= r.t if descending else t <= r.t))
            assert r.run == want


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {(n, find(n)) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("few", [0, C.FEW_EDGES])
def test_components_against_union_find(spark, monkeypatch, seed, few):
    monkeypatch.setattr(C, "FEW_EDGES", few)
    rng = random.Random(seed)
    pairs = [(f"Transaction:{i}", f"Card:{rng.randrange(60)}") for i in range(0, 80, 2)]
    pairs += [(f"Transaction:{i}", f"Transaction:{i + rng.choice([1, 2])}") for i in range(80, 140, rng.choice([1, 3]))]
    pairs += [(f"A:{i}", f"A:{i + 1}") for i in range(10, 60)]  # a long path whose sources sort first
    nodes = sorted({n for p in pairs for n in p} | {"Transaction:999"})
    want = union_find(pairs, nodes)
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    found = C.wcc(edges, spark.createDataFrame([(n,) for n in nodes], "node_id string"))
    assert {tuple(r) for r in found.select("node_id", "component_id").collect()} == want


def test_components_raise_when_rounds_run_out(spark):
    pairs = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(200)], "a string, b string")
    with pytest.raises(RuntimeError):
        C.star_components(pairs, max_rounds=1)


@pytest.mark.parametrize("few", [50, C.EDGES_PER_FILE])
def test_stored_components(spark, monkeypatch, few):
    """The same components whether the pairs fit one task or go through rounds."""
    monkeypatch.setattr(C, "EDGES_PER_FILE", few)
    rng = random.Random(few)
    pairs = [(i, i + rng.choice([1, 2])) for i in range(-200, 200, 3)] + [(7, 7), (900, 300), (301, 300)] * 2
    nodes = sorted({n for p in pairs for n in p})
    found = C.stored_components(spark.createDataFrame(pairs, "a long, b long").repartition(4))
    assert found.columns == ["child", "parent"]
    assert {tuple(r) for r in found.collect()} == {(a, b) for a, b in union_find(pairs, nodes) if a != b}
    assert C.stored_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_properties(spark):
    pairs = [(f"Transaction:{i}", f"Card:{i % 5}") for i in range(30)]
    pairs += [(f"Transaction:{i}", f"Device:{i % 3}") for i in range(0, 30, 2)]
    nodes = spark.createDataFrame(
        [(n, n.split(":")[0]) for n in {p for pair in pairs for p in pair} | {"Transaction:99"}],
        "node_id string, node_type string",
    )
    edges = spark.createDataFrame(pairs, "src string, dst string")
    first = {r.node_id: list(r.embedding) for r in X.fastrp(edges, nodes, dim=16).collect()}
    again = X.fastrp(edges.repartition(7).orderBy(F.desc("dst")), nodes, dim=16)
    again = {r.node_id: list(r.embedding) for r in again.collect()}
    assert set(first) == {f"Transaction:{i}" for i in range(30)} | {"Transaction:99"}
    for node, vec in first.items():
        assert vec == pytest.approx(again[node], abs=1e-6)
        assert sum(x * x for x in vec) ** 0.5 <= 2.0 + 1e-5
    assert first["Transaction:99"] == [0.0] * 16
    assert first["Transaction:1"] == pytest.approx(first["Transaction:11"], abs=1e-6)
    assert first["Transaction:1"] != pytest.approx(first["Transaction:2"], abs=1e-3)
    other = X.fastrp(edges, nodes, dim=16, seed=7).filter("node_id = 'Transaction:1'").first().embedding
    assert list(other) != pytest.approx(first["Transaction:1"], abs=1e-3)


def test_train_scope_gives_minus_one_to_unseen_entities(spark):
    tx = [(1, 10, 1.0, 1, "USED_CARD", "a"), (2, 20, 1.0, 0, "USED_CARD", "a"), (3, 30, 1.0, 1, "USED_CARD", "b")]
    links = spark.createDataFrame(
        tx, "transactionId long, transactionDT long, transactionAmt double, isFraud int, rel_type string, key string"
    )
    ids = links.select("transactionId")

    def seen(**scope):
        out = Fe.combine_features([S.entity_features(links, "USED_CARD", **scope)], ids)
        return {r.transactionId: (r.card_tx_count, r.card_fraud_rate) for r in out.collect()}

    assert seen(label_scope="train", split_dt=25) == {1: (2.0, 0.5), 2: (2.0, 0.5), 3: (0.0, -1.0)}
    assert seen()[3] == (1.0, 1.0)
    assert seen(exclude_self=True) == {1: (1.0, 0.0), 2: (1.0, 1.0), 3: (0.0, -1.0)}
    assert seen(label_scope="rolling", lookback_s=15) == {1: (0.0, -1.0), 2: (1.0, 1.0), 3: (0.0, -1.0)}


def test_later_rows_do_not_change_rolling_rates(g):
    cut = 20 * 86_400
    early = g.links.filter(F.col("transactionDT") <= cut)
    full = W.rolling_entity_rate(g.links, 86_400).join(early.select("transactionId").distinct(), "transactionId")
    assert rows(full) == rows(W.rolling_entity_rate(early, 86_400).select(*full.columns))


def test_encoder_reserves_the_missing_code(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a")], "TransactionID long, c string")
    new = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None), (4, "b")], "TransactionID long, c string")
    encoder = E.fit_encoder(train, ["c"])
    assert {(r.value, r.code) for r in encoder.collect()} == {("__missing__", 0), ("a", 1), ("b", 2)}
    want = [(1, 1), (2, 0), (3, 0), (4, 2)]
    assert sorted(map(tuple, E.encode(new, encoder, ["c"]).collect())) == want
    assert sorted(map(tuple, E.encode(new, encoder, ["c"], max_codes=0).collect())) == want


def test_median(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, -1.0, 2.5, 2.5, 100.0], [0.0, 0.0, 7.0, 9.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        s, n = sorted(values), len(values)
        assert D.exact_median(df, "v").first()[0] == (s[(n - 1) // 2] + s[n // 2]) / 2


def test_metrics_without_positives_are_null(spark):
    pred = spark.createDataFrame([(1, 0, 0.3), (2, 0, 0.9)], "TransactionID long, isFraud int, proba double")
    assert V.roc_auc(pred).first()[0] is None
    assert V.average_precision(pred).first()[0] is None
    assert tuple(V.threshold_metrics(pred, 0.5).first()) == (0.0, 0.0, 0.0, 0.5)
    assert V.best_threshold(V.threshold_sweep(pred)).first().threshold == 0.5


def test_sweep_at_exact_thresholds(spark):
    data = [(i, int(i % 3 == 0), i / 100.0) for i in range(101)] + [(200, 1, 0.29), (201, 0, 0.57)]
    pred = spark.createDataFrame(data, "TransactionID long, isFraud int, proba double")
    for r in V.threshold_sweep(pred, 0, 101).collect():
        assert r.tp == sum(1 for _, y, p in data if y == 1 and p >= r.threshold)
        assert r.fp == sum(1 for _, y, p in data if y == 0 and p >= r.threshold)
        assert r.tp + r.fn == sum(y for _, y, _ in data)


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "key string, v int, version long")
    new = spark.createDataFrame([("b", None, 1), ("b", 5, 2), ("c", 3, 1)], "key string, v int, version long")
    once = T.upsert_nodes(old, new, "key", "version")
    assert {(r.key, r.v) for r in once.collect()} == {("a", 1), ("b", 5), ("c", 3)}
    assert rows(T.upsert_nodes(once, new, "key", "version")) == rows(once)
    e = spark.createDataFrame([("x", "y", "R", 7)], "src string, dst string, rel_type string, gap long")
    more = spark.createDataFrame(
        [("x", "y", "R", 1), ("x", "z", "R", 4), ("x", "z", "R", 3)], "src string, dst string, rel_type string, gap long"
    )
    done = T.upsert_edges(e, more, "gap")
    assert {tuple(r) for r in done.collect()} == {("x", "y", "R", 7), ("x", "z", "R", 3)}
    assert rows(T.upsert_edges(done, more, "gap")) == rows(done)


def test_csv_missing_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "TransactionID,isFraud,TransactionAmt,card1,ProductCD\n1,0,2.5,77.0,W\n2,NA,NaN,,null\n3,1,x, 5 ,  C \n"
    )
    got = T.read_table(spark, str(tmp_path / "t.csv")).orderBy("TransactionID").collect()
    assert [tuple(r) for r in got] == [(1, 0, 2.5, 77, "W"), (2, None, None, None, None), (3, 1, None, 5, "  C ")]


def test_graph_round_trip_prunes_types(spark, g, tmp_path):
    T.write_graph(g.nodes, g.edges, str(tmp_path / "graph"))
    nodes, edges = T.read_graph(spark, str(tmp_path / "graph"))
    assert rows(edges) == rows(g.edges) and nodes.count() == g.nodes.count()
    plan = edges.filter("rel_type = 'USED_CARD'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rel_type" in plan


def test_stored_links_get_their_payload_back(g):
    stored = g.links.select("transactionId", "rel_type", "key")
    assert rows(S.link(stored, g.tx)) == rows(g.links)
    joined = G.links(g.joined)
    assert rows(joined) == rows(g.links)
    twice = G.links(g.joined.unionByName(g.joined), unique_ids=False)
    assert twice.count() == joined.count()


def test_early_limit_of_chain_edges_is_ordered(g):
    all_rows = W.previous_on_card(g.tx).orderBy(F.col("card").cast("long"), "prev_dt", "prev_id").limit(7)
    assert rows(W.prev_on_card(g.tx, limit=7)) == rows(all_rows.select("prev_id", "curr_id", "dt_gap_seconds"))


def test_neighbourhood_counts_zero_without_an_entity(g):
    lonely = g.joined.filter("card1 IS NULL").agg(F.min("TransactionID")).first()[0]
    got = Q.neighbourhood(g.tx, g.links, lonely).first()
    assert got.transactions_on_same_card == 0


def test_model_beats_a_constant_and_repeats(spark):
    rng = random.Random(5)
    data = [(i, int(rng.random() < 0.2), rng.random()) for i in range(600)]
    data = [(i, y, x + 0.5 * y) for i, y, x in data]
    df = E.feature_matrix(spark.createDataFrame(data, "TransactionID long, isFraud int, x double"), ["x"])
    train, val = df.filter("TransactionID < 400"), df.filter("TransactionID >= 400")
    small = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3}
    one = M.score(M.train_gbt(train, val, **small), val)
    two = M.score(M.train_gbt(train.repartition(5), val, **small), val)
    base = val.agg(F.avg(F.col("isFraud").cast("double"))).first()[0]
    assert V.average_precision(one).first()[0] > 1.5 * base
    assert rows(one) == rows(two)
    model = M.train_gbt(train, val, **small)
    curve = {r.iteration: r.pr_auc for r in M.ap_by_iteration(model, val).collect()}
    assert sorted(curve) == list(range(1, len(model.trees) + 1))
    for k in (1, len(model.trees)):
        assert curve[k] == pytest.approx(V.average_precision(M.score(model, val, k)).first()[0])
    full = {r.TransactionID: r.proba for r in one.collect()}
    assert all(full[r.TransactionID] == pytest.approx(r.proba) for r in M.score(model, val, len(model.trees)).collect())
    best = M.best_iteration(M.ap_by_iteration(model, val))
    assert curve[best] == max(curve.values()) and all(curve[k] < curve[best] for k in range(1, best))


def test_sample_is_the_first_rows_by_hash(spark):
    import hashlib

    df = spark.range(5000).withColumnRenamed("id", "k")
    want = sorted(range(5000), key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())
    assert [r.k for r in sampling.seeded_sample(df, "k", 700).collect()] == want[:700]
    assert sampling.seeded_sample(df, "k", 9000).count() == 5000


def test_plans_stay_in_the_jvm_and_prune_columns(g):
    for df in (S.entity_stats(g.links), W.prev_on_card(g.tx), g.features, Q.compromised_cards(g.rel("USED_CARD"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = Q.compromised_cards(g.rel("USED_CARD"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3  # events, customer, nation: no identity join
    plan = Q.neighbourhood(g.tx, g.links, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    plan = Q.overview(g.tx)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "c_name" not in plan
    pushed = Q.lookup(g.tx, "TransactionID", 4)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_id,4)" in pushed


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TransactionID,card1,TransactionDT\n1,77,500\n")
    schema = T.pinned_schema(["TransactionDT", "TransactionID", "card1"])
    row = T.read_table(spark, str(tmp_path / "a.csv"), schema).first()
    assert (row.TransactionID, row.card1, row.TransactionDT) == (1, 77, 500)
    with pytest.raises(ValueError, match="addr1"):
        T.read_table(spark, str(tmp_path / "a.csv"), T.pinned_schema(["TransactionID", "addr1"]))
    (tmp_path / "b.csv").write_text("card1,TransactionID,TransactionDT\n9,2,600\n")
    with pytest.raises(Exception, match="(?i)header"):
        T.read_table(spark, str(tmp_path), schema).collect()


def test_upsert_edges_keeps_properties_without_order(spark):
    kind = "src string, dst string, rel_type string, gap int, at int"
    none = spark.createDataFrame([], kind)
    new = spark.createDataFrame([("a", "b", "R", 4, None), ("c", "d", "R", 2, 5), ("c", "d", "R", 1, None)], kind)
    assert sorted(map(tuple, T.upsert_edges(none, new, "at").collect())) == [("a", "b", "R", 4, None), ("c", "d", "R", 2, 5)]
    bare = new.select("src", "dst", "rel_type")
    assert T.upsert_edges(bare.limit(0), bare, "src").count() == 2


def test_encode_is_the_same_at_any_size(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (None, None), (2, "new")]
    df = spark.createDataFrame(rows, "TransactionID long, c string")
    encoder = E.fit_encoder(df.filter("c is null or c <> 'new'"), ["c"])
    want = sorted(map(repr, [(1, 1), (1, 2), (None, 3), (None, 0), (2, 0)]))
    for most in (10, 0):
        assert sorted(repr(tuple(r)) for r in E.encode(df, encoder, ["c"], max_codes=most).collect()) == want


def test_encoder_ranges_are_even(spark):
    df = spark.range(4000).selectExpr("concat('SM-A', lpad(cast(id as string), 6, '0')) AS c")
    codes = {r.value: r.code for r in E.fit_encoder(df, ["c"]).collect()}
    values = sorted(codes)
    assert [codes[v] for v in values] == list(range(4001))


def test_graph_without_labels_or_identity(spark):
    tx = spark.createDataFrame(
        [(1, 10, 5.0, 7, "a.com"), (2, 20, 6.0, 7, None), (2, 20, 6.0, 7, None)],
        "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, P_emaildomain string",
    )
    graph = workflows.graph_of(tx, None, unique_ids=False)
    edges = sorted((r.src, r.dst) for r in graph.edges.collect())
    assert edges == [
        ("Transaction:1", "Card:7"), ("Transaction:1", "EmailDomain:a.com"),
        ("Transaction:1", "Transaction:2"), ("Transaction:2", "Card:7"),
    ]
    assert workflows.features(tx.dropDuplicates(), None).count() == 2


def test_rolling_rate_of_a_hub_in_one_hour(spark):
    rng = random.Random(3)
    rows = [(i, "hub" if i % 3 else f"k{i % 7}", rng.randrange(3600), rng.randrange(2)) for i in range(3000)]
    links = spark.createDataFrame(rows, "transactionId long, key string, transactionDT long, isFraud int").selectExpr(
        "'R' AS rel_type", "*"
    )
    plain, by_second = (
        sorted(map(tuple, W.rolling_entity_rate(links, 600, window_rows=m).collect()), key=repr) for m in (10**9, 1)
    )
    assert plain == by_second
    seen = [x for x in rows if x[1] == "hub" and rows[1][2] - 600 <= x[2] <= rows[1][2] - 1]
    assert next(r for r in plain if r[0] == 1)[3:5] == (len(seen), sum(x[3] for x in seen))


def test_slices_have_equal_depth_whatever_the_times(spark):
    """One card with all rows in one second, one with rows a second apart, and short ones."""
    ids = spark.range(6000)
    card = F.when(F.col("id") < 3000, 1).when(F.col("id") < 5900, 2).otherwise(F.col("id"))
    times = ids.select(
        "id", card.cast("string").alias("card"), F.when(card == 1, 77).otherwise(F.col("id")).alias("dt"), F.lit(1).alias("is_fraud")
    )
    plain, sliced = skew.slice_big(times, ["card"], ["dt", "id"], rows=500)
    assert plain.count() == 100
    assert sliced.groupBy("card", "_slice").count().agg(F.max("count")).first()[0] <= 1000
    assert sliced.select("_slice").distinct().count() >= 8
    # Slices of a card follow (dt, id).
    spans = sliced.groupBy("card", "_slice").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("card", "a").collect()
    for x, y in zip(spans, spans[1:]):
        assert x.card != y.card or (x.b < y.a and x._slice < y._slice)


def test_all_rows_are_sliced_when_large_keys_are_too_many_to_broadcast(spark, monkeypatch, g):
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    plain, sliced = skew.slice_big(W.card_times(g.tx), ["card"], ["dt", "id"], rows=20)
    assert plain is None and sliced.count() == W.card_times(g.tx).count()
    got = rows(W.next_on_card(g.tx, rows=20)), rows(W.card_chain_rate(g.tx, rows=20))
    monkeypatch.undo()
    assert got == (rows(W.next_on_card(g.tx)), rows(W.card_chain_rate(g.tx)))


def test_rolling_rate_of_hubs_in_slices(spark):
    rng = random.Random(4)
    data = [("E", "hub", i, 500 if i % 2 else rng.randrange(2000), i % 3 == 0) for i in range(900)]
    data += [("E", f"e{i % 9}", 1000 + i, rng.randrange(2000), i % 4 == 0) for i in range(200)]
    links = spark.createDataFrame(
        [(r, k, i, t, int(f)) for r, k, i, t, f in data], "rel_type string, key string, transactionId long, transactionDT long, isFraud int"
    )
    found = W.rolling_entity_rate(links, 300, rows=300, window_rows=22)  # 22, 23 and 900 rows: all three ways
    got = {r.transactionId: r for r in found.collect()}
    assert len(got) == len(data)
    for _, k, i, t, _ in data:
        prior = [f for _, k2, _, t2, f in data if k2 == k and t - 300 <= t2 <= t - 1]
        r = got[i]
        assert (r.prior_tx_count, r.prior_fraud_count) == (len(prior), sum(prior))
        assert r.prior_fraud_rate == (sum(prior) / len(prior) if prior else None)


def test_median_and_curves_of_crowded_values(spark):
    tiny = spark.range(100_001).select((F.col("id") / 1e10).alias("x"), (F.col("id") % 2).cast("int").alias("isFraud"))
    assert D.exact_median(tiny, "x", rows=5_000).first()[0] == 50_000 / 1e10
    hist = tiny.groupBy((F.col("x") * 1e4).alias("proba")).agg(F.sum("isFraud").alias("pos"), F.sum(1 - F.col("isFraud")).alias("neg"))
    sliced, column = skew.equi_depth(hist, ["proba"], 5_000)
    depth = sliced.groupBy(column).count().agg(F.max("count"), F.count("*")).first()
    assert depth[0] <= 10_000 and depth[1] > 10
    curve = V.cumulative_counts(hist, rows=5_000)
    assert curve.filter("tp + fp = 50001").first().proba == pytest.approx(50_000 / 1e6)
    assert curve.agg(F.max("tp"), F.max("fp")).first() == (50_000, 50_001)


def relations(df):
    """Reads of a table in the plan."""
    return df._jdf.queryExecution().analyzed().toString().count("Relation [")


def test_features_read_their_tables_a_few_times(g, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 5)  # hot keys are there, and salted
    one_view = relations(g.tx)
    frames = S.entity_frames(g.links, Fe.V2_ENTITIES)
    # Stored long rows: only ids and the chain still read the view.
    assert relations(Fe.combine_features([*frames, W.prev_features(g.chain)], g.ids)) <= 2 * one_view <= 6
    for r in Fe.V2_ENTITIES:
        assert relations(skew.attach(g.rel(r), S.entity_stats(g.rel(r)), S.ENTITY, "tx_count", limit=5)) <= 6
    assert rows(frames[0]) == rows(S.entity_features(g.rel("USED_CARD"), "USED_CARD"))
    assert rows(frames[-1]) == rows(S.proxy_features(g.rel("VIA_PROXY")))


def test_hot_keys_are_dealt_over_salts(spark):
    big = spark.range(4000).select(F.col("id"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = skew.attach(big, small, ["k"], "n", limit=20)
    assert rows(got) == rows(big.join(small, "k", "left"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and plan.count("Range (") == 1


def test_covariance_against_numpy(spark):
    """Far from zero, in batches and tasks; odd vectors do not count; components follow from it."""
    x = np.random.default_rng(4).normal(size=(500, 6)) @ np.diag([3, 2, 1, 1, 0.5, 0.1]) + 1e6
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(900, None), (901, [1.0]), (902, [None] * 6)]
    emb = spark.createDataFrame(rows, "transactionId long, embedding array<double>").repartition(7)
    want, got = np.cov(x.T, bias=True), {(r.i, r.j): r for r in X.covariance(emb, 6).collect()}
    assert sorted(got) == [(i, j) for i in range(6) for j in range(i, 6)]
    assert all(r.n == 500 and abs(r.cov - want[k]) < 1e-6 for k, r in got.items())
    assert X.covariance(emb.limit(0), 6).count() == 0
    shown = X.pca_2d(emb.filter("transactionId < 500")).collect()
    pc = np.array([(r.pc1, r.pc2) for r in shown])
    spread = np.linalg.eigvalsh(want)[::-1]
    assert np.allclose(np.cov(pc.T, bias=True), np.diag(spread[:2]), atol=1e-4)
    assert np.allclose([shown[0].pc1_variance, shown[0].pc2_variance], spread[:2] / spread.sum())


def test_sketches_of_days_add_up(spark):
    """Values that come back on other days count once; nulls and columns without values do not."""
    rows = [(i % 5, f"v{i % 700}" if i % 10 else None, None) for i in range(7000)]
    df = spark.createDataFrame(rows, "day int, a string, b string")
    states = D.cardinality_sketches(df, ["a", "b"], "day")
    assert states.count() == 10
    late = D.cardinality_sketches(spark.createDataFrame([(9, "new", "one")], df.schema), ["a", "b"], "day")
    got = {r.column_name: r.distinct_values for r in D.merge_sketches(states.unionByName(late)).collect()}
    assert got["b"] == 1 and abs(got["a"] - 631) <= 5 * 0.01625 * 631
