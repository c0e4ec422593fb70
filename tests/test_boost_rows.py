"""Rows of a block carry their margin: no tree is evaluated again for each later one."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kithgraph.operators import boost as B


def test_each_tree_is_evaluated_once_while_a_block_is_fitted(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").alias("TransactionID"), (F.col("id") % 7).alias("a"))
    rows = rows.withColumn("isFraud", (F.col("a") > 4).cast("int"))
    made = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows).select("TransactionID", "isFraud", "features")
    added, plain = [], B._with_outputs

    def counted(df, trees, shares, margins=False):
        if not margins:
            added.append(len(trees))
        return plain(df, trees, shares, margins)

    monkeypatch.setattr(B, "_with_outputs", counted)
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    model = B.boost(made, made, maxIter=4, block=4, maxDepth=2, maxBins=8, minInstancesPerNode=5)
    assert len(model.trees) == 4 and added == [1, 1, 1]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= cached  # nothing of a block stays cached
