"""Stored links and keyed tables: equal to the plain plans, and which files are read and written."""

import random

import pytest
from pyspark.sql import functions as F

from kithgraph.catalog import Given
from kithgraph.plans import questions as Q
from kithgraph.plans import stored
from kithgraph.sources import clustered, keyed
from kithgraph.sources import tables as T

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def g(spark):
    return Given(spark, SF_DIR)


@pytest.fixture(scope="module")
def path(g, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("links"))
    stored.write_links(g.links, g.tx, path, rows=50)  # hubs go over many blocks
    return path


def test_point_questions_equal_those_over_all_links(spark, g, path):
    ids = [r[0] for r in g.tx.orderBy(F.xxhash64("TransactionID")).select("TransactionID").limit(3).collect()]
    for tx_id in [*ids, -5]:  # -5 is no transaction
        assert rows(stored.neighbourhood(spark, path, tx_id)) == rows(Q.neighbourhood(g.tx, g.links, tx_id))
        assert rows(stored.explain_flag(spark, path, tx_id)) == rows(Q.explain_flag(g.links, tx_id))
    cards = [r.card for r in Q.compromised_cards(g.links, 1, 2).collect()]
    for card in [*cards, "no such card"]:
        assert rows(stored.card_cluster(spark, path, card, 3)) == rows(Q.card_cluster(g.links, card, 3))


def test_a_point_read_opens_few_files(spark, g, path):
    every = spark.read.parquet(f"{path}/by_entity/index")
    assert every.count() > 20 and every.agg(F.sum("rows")).first()[0] == g.links.count()
    own = stored.links_of_transactions(spark, path, [4])
    assert len(own.inputFiles()) == 1
    card = own.filter("rel_type = 'USED_CARD'").first().key
    found = stored.links_of_entities(spark, path, [("USED_CARD", card)])
    held = clustered.blocks_of(spark, f"{path}/by_entity", ["rel_type", "key"], [("USED_CARD", card)])
    assert len(found.inputFiles()) == len(held) <= found.count() // 25 + 3
    assert rows(found) == rows(g.links.filter((F.col("rel_type") == "USED_CARD") & (F.col("key") == card)))


def test_clustered_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "k int, first string")
    clustered.write_clustered(df, ["k"], f"{tmp_path}/t", rows=1)
    read = lambda *k: rows(clustered.read_clustered(spark, f"{tmp_path}/t", ["k"], [(x,) for x in k]))
    assert read(1) == [("a", 1), ("a", 1)]
    assert read(2, 3) == [(None, 2)]
    assert read() == read(7) == []
    clustered.write_clustered(df.limit(0), ["k"], f"{tmp_path}/none")
    none = clustered.read_clustered(spark, f"{tmp_path}/none", ["k"], [(1,)])
    assert none.columns == ["k", "first"] and none.count() == 0


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k long, v string, version long"
    spark.createDataFrame([(k, f"a{k}", 1) for k in range(400)], schema).write.parquet(f"{tmp_path}/in")
    keyed.create(spark.read.parquet(f"{tmp_path}/in"), ["k"], path, 16)
    before = set(keyed.read(spark, path).inputFiles())

    def upsert(old, new):
        return T.upsert_nodes(old, new, "k", "version")

    touched = keyed.merge(path, ["k"], spark.createDataFrame([(3, "b", 1), (3, "c", 2), (900, "d", 1)], schema), upsert)
    after = set(keyed.read(spark, path).inputFiles())
    assert 1 <= len(touched) <= 2
    same = {f for f in before if not any(f"_bucket={b}/" in f for b in touched)}
    assert same and same <= after and not (before - same) & after
    want = {k: f"a{k}" for k in range(400)} | {3: "c", 900: "d"}
    assert {r.k: r.v for r in keyed.read(spark, path).collect()} == want
    assert keyed.read(spark, path, 1).count() == 400  # the version before stays
    assert keyed.merge(path, ["k"], spark.createDataFrame([], schema), upsert) == []
    assert keyed.manifest(spark, path)[0] == 2
    with pytest.raises(ValueError, match="version 9"):
        keyed.read(spark, path, 9)


def test_many_merges_equal_one_upsert(spark, tmp_path):
    rng = random.Random(5)
    path, schema, ends = f"{tmp_path}/e", "src string, dst string, rel_type string, dt long", ["src", "dst", "rel_type"]
    key = lambda: rng.choice(["a", "b", "c", None])
    loads = [[(key() or "n", key() or "n", "R", rng.randrange(9)) for _ in range(20)] for _ in range(3)]
    keyed.create(spark.createDataFrame([], schema), ends, path, 4)
    assert keyed.read(spark, path).count() == 0
    want: dict[tuple, int] = {}
    for load in loads:
        keyed.merge(path, ends, spark.createDataFrame(load, schema), lambda old, new: T.upsert_edges(old, new, "dt"))
        first: dict[tuple, int] = {}
        for *k, dt in load:
            first[tuple(k)] = min(dt, first.get(tuple(k), dt))
        want = first | want
    assert {(r.src, r.dst, r.rel_type): r.dt for r in keyed.read(spark, path).collect()} == want


def test_null_keys_merge_like_others(spark, tmp_path):
    schema = "k long, v string, version long"
    keyed.create(spark.createDataFrame([(None, "old", 1), (1, "x", 1)], schema), ["k"], f"{tmp_path}/t", 8)
    new = spark.createDataFrame([(None, "new", 2)], schema)
    keyed.merge(f"{tmp_path}/t", ["k"], new, lambda old, add: T.upsert_nodes(old, add, "k", "version"))
    assert {(r.k, r.v) for r in keyed.read(spark, f"{tmp_path}/t").collect()} == {(None, "new"), (1, "x")}
