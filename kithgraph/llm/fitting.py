"""Fitting a classifier on a bounded sample of labelled rows, inside one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.session import cut_lineage


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int, only: Column | None = None
) -> DataFrame:
    """(label, text) of at most `most` labelled rows, the first by a hash of doc_id.

    `most` bounds the broadcast of ids and the one task that fits the model.
    """
    labels = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    if only is not None:
        labels = labels.filter(only)
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(cut_lineage(chosen)), "doc_id")
    # A doc_id that several rows carry must not pass the bound.
    return texts.select("label", "text").orderBy(F.xxhash64("text"), "label").limit(most)


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What `fit` makes of the sample; the fit runs on an executor, the model comes back."""

    def run(batches):
        rows = list(batches)
        if rows:
            model = pickle.dumps(fit(pa.Table.from_batches(rows)))
            yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.binary())})

    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(made[0].model)) if made else None


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(
    x: np.ndarray, y: np.ndarray, weight: float, prior: np.ndarray | None = None, steps: int = 60
) -> np.ndarray:
    """Newton steps for a dense logistic regression, drawn towards `prior`; last one is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.zeros(x.shape[1]) if prior is None else prior
    ridge = np.full(x.shape[1], weight)
    ridge[-1] = 1e-3
    w = prior.astype(float).copy()
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w
