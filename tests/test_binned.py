"""Boosting over binned rows: trees by plain Python, exact judging, and who uses it."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kithgraph.catalog import CATALOG, model
from kithgraph.operators import binned as B
from kithgraph.operators import evaluate as V

SMALL = {"maxDepth": 3, "stepSize": 0.3, "maxBins": 16, "minInstancesPerNode": 5}
ALL = {**SMALL, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0"}


def _features(rows):
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).select("TransactionID", "isFraud", "features")


@pytest.fixture(scope="module")
def frames(spark):
    rows = spark.range(1200).select(
        F.col("id").alias("TransactionID"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("a"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)).cast("double").alias("b"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) < 4).alias("noise"),
    )
    made = _features(rows.withColumn("isFraud", (((F.col("a") > 0.7) & (F.col("b") < 4)) | F.col("noise")).cast("int")))
    return made.filter("TransactionID % 3 <> 0"), made.filter("TransactionID % 3 = 0")


def _plain_tree(x, slope, weight, depth, least):
    """Value of each row in the tree that always takes the split of the best gain."""
    out = np.full(len(x), (slope * weight).sum() / weight.sum())
    best = None
    for f in range(x.shape[1]) if depth else ():
        for border in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= border
            if min(left.sum(), (~left).sum()) >= least:
                gain = sum((slope * weight)[s].sum() ** 2 / weight[s].sum() for s in (left, ~left))
                if best is None or gain > best[0] + 1e-9:
                    best = gain, left
    if best is not None and best[0] > (slope * weight).sum() ** 2 / weight.sum() + 1e-9:
        for side in (best[1], ~best[1]):
            out[side] = _plain_tree(x[side], slope[side], weight[side], depth - 1, least)
    return out


def test_trees_equal_plain_python(spark, frames, monkeypatch):
    monkeypatch.setattr(B, "ROWS", 100)
    monkeypatch.setattr(B, "COMBINED", 2)
    train, held = frames
    train = train.filter("TransactionID % 5 > 0")
    got = B.boost(train, held, maxIter=2, block=2, **{**ALL, "maxBins": 256})
    rows = train.orderBy("TransactionID").collect()
    x, fraud = np.array([r.features.toArray() for r in rows]), np.array([r.isFraud == 1 for r in rows])
    y, weight = np.where(fraud, 1.0, -1.0), np.where(fraud, (~fraud).sum() / fraud.sum(), 1.0)
    margin = np.zeros(len(x))
    for share in (1.0, 0.3):
        margin += share * _plain_tree(x, 4 * y / (1 + np.exp(2 * y * margin)), weight, 3, 5)
    scored = {r.TransactionID: r.proba for r in B.score_boosted(got, train, 2).collect()}
    want = {r.TransactionID: 1 / (1 + np.exp(-2 * m)) for r, m in zip(rows, margin, strict=True)}
    assert scored == pytest.approx(want)


def test_going_on_equals_not_having_stopped_and_the_curve_is_exact(frames, monkeypatch):
    train, held = frames
    whole = B.boost(train, held, maxIter=6, block=3, **SMALL)
    monkeypatch.setattr(B, "CUT", 2)  # margins are written on the way
    monkeypatch.setattr(B, "JUDGED", 1)  # a tree at a time is judged
    begun = B.boost(train, held, maxIter=3, block=3, **SMALL)
    resumed = B.boost(train, held, start=begun, maxIter=6, block=3, **SMALL)
    assert resumed.shares == whole.shares == (1.0, *[0.3] * 5)
    assert resumed.curve == pytest.approx(whole.curve)
    for k in (1, 4, 6):
        assert whole.curve[k - 1] == pytest.approx(V.average_precision(B.score_boosted(resumed, held, k)).first()[0])
    assert sum(whole.importances()) == pytest.approx(1)


def test_stops_when_average_precision_no_longer_rises(frames):
    train, held = frames
    found = B.boost(train, held, maxIter=60, block=2, patience=4, **SMALL)
    assert len(found.trees) < 60 and len(found.trees) - found.best in (4, 5)


def test_rows_without_id_or_label(spark, frames):
    train, held = frames
    odd = train.withColumn("TransactionID", F.expr("nullif(TransactionID % 4, 1)")).withColumn(
        "isFraud", F.when(F.col("TransactionID") != 2, F.col("isFraud"))
    )
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = B.boost(odd, held.withColumn("isFraud", F.lit(None).cast("int")), maxIter=4, block=2, patience=1, **SMALL)
    assert found.best == 1 and set(found.curve) == {None}
    assert B.score_boosted(found, held).filter("proba between 0 and 1").count() == held.count()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= cached


def test_few_values_are_told_apart_and_many_go_by_quantiles(spark):
    rows = spark.range(5000).select(F.col("id").alias("TransactionID"), (F.col("id") == 7).cast("double").alias("a"), F.col("id").alias("b"))
    a, b = B.find_borders(_features(rows.withColumn("isFraud", F.lit(0))), 64)
    assert a.tolist() == [0.5] and len(b) == 63 and abs(np.diff(b) - 5000 / 64).max() < 3


@pytest.mark.parametrize("name", ["m4_train_gbt_published", "t2_top_features"])
def test_published_settings(name, monkeypatch):
    assert _settings(name, monkeypatch) == {"stop_on_ap": True, "binned": True}


def _settings(name, monkeypatch):
    """What a query asks of the training beyond the published settings."""
    asked = {}

    class Stop(Exception):
        pass

    def run_experiment(dataset, kinds, split_dt, **options):
        asked.update(options, kinds=kinds)
        raise Stop

    monkeypatch.setattr(model.workflows, "run_experiment", run_experiment)
    monkeypatch.setattr(model.workflows, "features", lambda *a, **k: None)
    monkeypatch.setattr(model.Fe, "attach_features", lambda *a: None)
    monkeypatch.setattr(model, "cut_lineage", lambda df: df)
    with pytest.raises(Stop):
        CATALOG[name].run(type("G", (), {"tx": None, "identity": None, "joined": None}))
    assert asked.pop("kinds") == ("tabular", "graph")
    return asked
