"""Boosting in blocks: going on equals not having stopped, and it stops on average precision."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kithgraph.operators import boost as B
from kithgraph.operators import evaluate as V

SMALL = {"maxDepth": 3, "stepSize": 0.3, "maxBins": 16, "minInstancesPerNode": 5}


@pytest.fixture(scope="module")
def frames(spark):
    ids = spark.range(1200).withColumn("a", F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0)
    ids = ids.withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100.0)
    noise = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) < 4
    rows = ids.select(F.col("id").alias("TransactionID"), "a", "b", (((F.col("a") > 0.7) & (F.col("b") < 0.5)) | noise).cast("int").alias("isFraud"))
    made = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).select("TransactionID", "isFraud", "features")
    return made.filter("TransactionID % 3 <> 0"), made.filter("TransactionID % 3 = 0")


def test_going_on_equals_not_having_stopped(frames):
    train, held = frames
    whole = B.boost(train, held, maxIter=6, block=3, **SMALL)
    begun = B.boost(train, held, maxIter=3, block=3, **SMALL)
    resumed = B.boost(train, held, start=begun, maxIter=6, block=3, **SMALL)
    assert len(begun.trees) == 3 and len(resumed.trees) == len(whole.trees) == 6
    assert resumed.shares == whole.shares == (1.0, *[0.3] * 5)
    assert resumed.curve == pytest.approx(whole.curve)
    a, b = (
        {r.TransactionID: r.proba for r in B.score_boosted(m, held, 6, block).collect()} for m, block in ((whole, 2), (resumed, 10))
    )
    assert len(a) == 400 and a == pytest.approx(b)
    # The curve is the average precision of the scores after as many trees.
    again = V.average_precision(B.score_boosted(whole, held, 4)).first()[0]
    assert whole.curve[3] == pytest.approx(again)
    assert sum(whole.importances()) == pytest.approx(1)


def test_stops_when_average_precision_no_longer_rises(frames):
    train, held = frames
    model = B.boost(train, held, maxIter=60, block=2, patience=4, **SMALL)
    assert len(model.trees) < 60 and len(model.trees) - model.best in (4, 5)
    share = held.agg(F.avg("isFraud")).first()[0]
    assert model.curve[model.best - 1] > 2 * share  # a constant score has the share of fraud


def test_no_positives_to_judge_by(frames):
    train, held = frames
    model = B.boost(train, held.filter("isFraud = 0"), maxIter=4, block=2, patience=1, **SMALL)
    assert model.best == 1 and len(model.trees) == 2 and set(model.curve) == {None}
