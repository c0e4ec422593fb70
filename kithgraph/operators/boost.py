"""Gradient boosting that can stop and go on: blocks of trees from carried margins.

The rows are stored with their margin, the sum of the tree outputs so far. A block fits
`block` regression trees in turn, each to the gradient of the logistic loss at the margin
before it, and stores the rows again with the margin after it, so no pass evaluates more
than one block of trees and no frame is longer than rows x block. After each block the
average precision on the validation rows is known for each of its trees; training ends
`patience` trees after the best one, long before the last tree that is allowed. A result
can be the `start` of another run, which goes on as if it had not ended.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.train import PARAMS, average_precisions, by_id, proba_of, with_class_weight
from kithgraph.session import cut_lineage

BLOCK = 10
PATIENCE = 50
_OWN = ("TransactionID", "features", "weight", "is_validation", "_y", "_margin")


class Boosted(NamedTuple):
    """Trees in order, the share of each in the margin, and validation AP after each."""

    trees: tuple
    shares: tuple[float, ...]
    curve: tuple[float | None, ...]

    @property
    def best(self) -> int:
        """How many trees have the best average precision, the first of equals; 1 if it is never known."""
        known = [(-ap, i) for i, ap in enumerate(self.curve, 1) if ap is not None]
        return min(known)[1] if known else 1

    def importances(self) -> np.ndarray:
        """Of the inputs, over the first `best` trees, each counting alike; they sum to 1."""
        total = sum(t.featureImportances.toArray() for t in self.trees[: self.best])
        return total / total.sum() if total.sum() else total


def _with_outputs(df: DataFrame, trees: Sequence, shares: Sequence[float], margins: bool = False) -> DataFrame:
    """Add the outputs of a block of trees to `_margin`; with `margins`, the margin after each as an array."""
    total, after, columns = F.col("_margin"), [], df.columns
    for i, (tree, share) in enumerate(zip(trees, shares, strict=True)):
        df = tree.setPredictionCol(f"_tree{i}").transform(df)
        total = total + F.col(f"_tree{i}") * F.lit(share)
        after.append(total)
    kept = [c for c in columns if c != "_margin"]
    extra = [F.array(*after).alias("_margins")] if margins else []
    return df.select(*kept, total.alias("_margin"), *extra)


def _carried(df: DataFrame, model: Boosted, trees: int, block: int) -> DataFrame:
    """`df` with `_margin` from the first `trees` trees, one block at a time."""
    df = df.withColumn("_margin", F.lit(0.0))
    for k in range(0, trees, block):
        stop = min(k + block, trees)
        df = cut_lineage(_with_outputs(df, model.trees[k:stop], model.shares[k:stop]))
    return df


def boost(
    train: DataFrame,
    validation: DataFrame,
    label: str = "isFraud",
    start: Boosted | None = None,
    block: int = BLOCK,
    patience: int = PATIENCE,
    **params,
) -> Boosted:
    """Fit trees to `train` until average precision on `validation` has not risen for `patience` trees.

    Both frames carry TransactionID, `features` and the label. `params` are those of
    `train.PARAMS`; `maxIter` bounds the trees, those of `start` included. Rows are
    partitioned and sorted by id, since row order feeds the sampling. Without a label a
    training row is not fraud and a validation row is left out.
    """
    used = {**PARAMS, **params}
    most, step, seed = used.pop("maxIter"), used.pop("stepSize"), used.pop("seed")
    rows = with_class_weight(train, label).withColumn("is_validation", F.lit(False)).unionByName(
        validation.filter(F.col(label).isNotNull()).withColumn("weight", F.lit(1.0)).withColumn("is_validation", F.lit(True))
    )
    rows = rows.withColumn("_y", F.when(F.col(label) == 1, 1.0).otherwise(-1.0))
    rows = by_id(rows)
    model = start or Boosted((), (), ())
    rows = cut_lineage(_carried(rows, model, len(model.trees), block).select(*_OWN))
    while len(model.trees) < most and not (model.trees and len(model.trees) - model.best >= patience):
        trees, shares = [], []
        # A tree passes over its rows several times: keep them with their margin, one more tree each.
        seen, former = rows.filter("not is_validation").persist(), None
        for i in range(len(model.trees), min(len(model.trees) + block, most)):
            if trees:
                former, seen = seen, _with_outputs(seen, trees[-1:], shares[-1:]).persist()
            slope = F.lit(4.0) * F.col("_y") / (F.lit(1.0) + F.exp(F.lit(2.0) * F.col("_y") * F.col("_margin")))
            one = RandomForestRegressor(
                featuresCol="features", labelCol="_slope", weightCol="weight", numTrees=1, bootstrap=False, seed=seed + i, **used
            )
            trees.append(one.fit(seen.withColumn("_slope", slope)).trees[0])
            shares.append(step if i else 1.0)
            if former is not None:  # `seen` is filled now
                former.unpersist()
        seen.unpersist()
        before = len(model.trees)
        after = cut_lineage(_with_outputs(rows, trees, shares, margins=True))
        judged = after.filter("is_validation").select("_y", F.posexplode("_margins").alias("i", "margin")).select(
            (F.col("i") + before + 1).alias("iteration"), (F.col("_y") > 0).cast("int").alias("isFraud"), proba_of(F.col("margin")).alias("proba")
        )
        aps = {r.iteration: r.pr_auc for r in average_precisions(judged).collect()}  # one row a tree
        curve = [aps.get(before + k) for k in range(1, len(trees) + 1)]
        model = Boosted((*model.trees, *trees), (*model.shares, *shares), (*model.curve, *curve))
        rows = after.select(*_OWN)
    return model


def score_boosted(model: Boosted, df: DataFrame, trees: int | None = None, block: int = BLOCK) -> DataFrame:
    """(TransactionID, isFraud, proba) from the first `trees` trees, by default the best number of them."""
    margins = _carried(df.select("TransactionID", "isFraud", "features"), model, trees or model.best, block)
    return margins.select("TransactionID", "isFraud", proba_of(F.col("_margin")).alias("proba"))
