"""Gradient-boosted trees on Spark ML: weighting, early stopping, scores, importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.normalize import is_fraud
from kithgraph.operators.skew import equi_depth, running_sums
from kithgraph.operators.stats import class_balance
from kithgraph.session import cut_lineage

# Published settings; 127 leaves are a depth of 7.
PARAMS = {
    "maxIter": 1000,
    "stepSize": 0.05,
    "maxDepth": 7,
    "subsamplingRate": 0.7,
    "featureSubsetStrategy": "0.7",
    "minInstancesPerNode": 20,
    "maxBins": 64,
    "seed": 42,
}
ROWS = 100_000  # rows a task reads in each pass over the training rows


def with_class_weight(train: DataFrame, label: str = "isFraud") -> DataFrame:
    """Add `weight`: negatives over positives for fraud rows, 1 for the others."""
    balance = class_balance(train, label).select("scale_pos_weight").scalar()
    weight = F.when(F.col(label) == 1, F.coalesce(balance, F.lit(1.0))).otherwise(F.lit(1.0))
    return train.withColumn("weight", weight)


def by_id(rows: DataFrame) -> DataFrame:
    """`rows` partitioned and sorted by id, about ROWS in a partition however many there are.

    Without a number adaptive execution merges partitions down to a few a core, and every
    pass over them reads a share that grows with the rows.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    return rows.repartition(parts, "TransactionID").sortWithinPartitions("TransactionID")


def train_gbt(
    train: DataFrame,
    validation: DataFrame,
    label: str = "isFraud",
    tolerance: float = 0.001,
    **params,
) -> GBTClassificationModel:
    """Fit on `train`, stop when the loss on `validation` no longer improves.

    Both frames carry `features` and the label. Row order and partitioning feed the
    sampling of rows, so the input is partitioned and sorted by id and written once.
    """
    marked = with_class_weight(train, label).withColumn("is_validation", F.lit(False)).unionByName(
        validation.withColumn("weight", F.lit(1.0)).withColumn("is_validation", F.lit(True))
    )
    marked = cut_lineage(by_id(marked.withColumn(label, F.col(label).cast("double"))))
    estimator = GBTClassifier(
        featuresCol="features",
        labelCol=label,
        weightCol="weight",
        validationIndicatorCol="is_validation",
        validationTol=tolerance,
        **{**PARAMS, **params},
    )
    return estimator.fit(marked)


def score(model: GBTClassificationModel, df: DataFrame, trees: int | None = None) -> DataFrame:
    """(TransactionID, isFraud, proba) with the probability of fraud, from the first `trees` trees."""
    if trees is None:
        proba = vector_to_array("probability")[1]
        return model.transform(df).select("TransactionID", "isFraud", proba.alias("proba"))
    margins = _margins(model, df, trees)
    return margins.select("TransactionID", "isFraud", proba_of(F.col("margins")[trees - 1]).alias("proba"))


def proba_of(margin):
    """Probability of fraud at a margin of the logistic loss."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _margins(model: GBTClassificationModel, df: DataFrame, trees: int) -> DataFrame:
    """(TransactionID, isFraud, margins): the sum of the tree outputs after each tree."""
    for i, tree in enumerate(model.trees[:trees]):
        df = tree.setPredictionCol(f"_tree{i}").transform(df)
    total, sums = None, []
    for i, weight in enumerate(model.treeWeights[:trees]):
        part = F.col(f"_tree{i}") * F.lit(float(weight))
        total = part if total is None else F.col(f"_sum{i - 1}") + part
        df = df.withColumn(f"_sum{i}", total)
        sums.append(f"_sum{i}")
    return df.select("TransactionID", "isFraud", F.array(*sums).alias("margins"))


def average_precisions(long: DataFrame) -> DataFrame:
    """(iteration, pr_auc) from rows (iteration, isFraud, proba)."""
    hist = long.groupBy("iteration", "proba").agg(
        F.sum(is_fraud()).cast("bigint").alias("pos"),
        F.sum(F.lit(1) - is_fraud()).cast("bigint").alias("neg"),
    )
    sliced, column = equi_depth(hist, ["iteration", "proba"])
    summed = running_sums(sliced, ["iteration"], column, "proba", {"tp": "pos", "fp": "neg"}, descending=True)
    gain = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return summed.groupBy("iteration").agg((gain / F.nullif(F.sum("pos"), F.lit(0))).alias("pr_auc"))


def ap_by_iteration(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    """(iteration, pr_auc): average precision after each tree, all iterations in one pass."""
    margins = _margins(model, df.filter(F.col("isFraud").isNotNull()), len(model.trees))
    return average_precisions(
        margins.select("isFraud", F.posexplode("margins").alias("i", "margin")).select(
            (F.col("i") + 1).alias("iteration"), "isFraud", proba_of(F.col("margin")).alias("proba")
        )
    )


def best_iteration(curve: DataFrame, patience: int = 50) -> int:
    """The iteration with the best average precision seen before `patience` rounds without a better one.

    The curve has one row per tree, so reading it to the driver is bounded by the model.
    """
    best, best_ap = 1, -1.0
    for row in curve.orderBy("iteration").collect():
        if row["iteration"] - best > patience:
            break
        if row["pr_auc"] is not None and row["pr_auc"] > best_ap:
            best, best_ap = row["iteration"], row["pr_auc"]
    return best


def importance_table(
    model: GBTClassificationModel, sets: dict[str, Sequence[str]], df: DataFrame
) -> DataFrame:
    """(feature, kind, importance) for every model input, in input order.

    The table is as long as the model is wide and comes from the model, not from the rows.
    """
    kinds = {"tabular": "Tabular", "graph": "Graph", "embedding": "Embedding"}
    names = [(c, kinds[kind]) for kind, columns in sets.items() for c in columns]
    weights = model.importances() if hasattr(model, "importances") else model.featureImportances.toArray()
    rows = [(c, kind, float(weights[i])) for i, (c, kind) in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string, importance double")


def top_features(importances: DataFrame, n: int = 25) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
