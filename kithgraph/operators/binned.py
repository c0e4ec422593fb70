"""Gradient boosting over binned rows: the published settings on tables of millions of rows.

Rows are binned once and kept as blocks: a byte an input, the label, a hash of the id and
the margin, some 50 bytes a row. A level of a tree is one pass over the blocks: each task
adds up the histograms of its rows (numpy) for the smaller child of every split, the larger
one is the parent's less that, and the driver compares all borders of all inputs. So a pass
sends 64 bins an input and node, however many rows there are. Margins gain one tree a pass.

As published, rows and inputs are drawn for each tree; a row is drawn by a hash of its id,
so a lost task draws the same ones. Trees fit the gradient of the logistic loss, as in `boost`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.boost import BLOCK, PATIENCE, Boosted
from kithgraph.operators.stats import class_balance
from kithgraph.operators.train import PARAMS, ROWS
from kithgraph.session import cut_lineage, drop_path, shared_dir

TASK_BLOCKS = 16  # blocks a task reads in each pass
CUT = 50  # trees after which the margins are written
JUDGED = 4_000_000  # scores of fraud rows that one pass of judging compares with
COMBINED = 32  # tasks whose sums the driver adds up itself
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Block(NamedTuple):
    """Rows of a block: bins (input x row), hash of the id, whether fraud, margin so far."""

    bins: np.ndarray
    ids: np.ndarray
    fraud: np.ndarray
    margin: np.ndarray


class Tree(NamedTuple):
    """A tree in heap order from node 1: rows with a bin above `border` of `feature` go right.

    A leaf above the last level sends all rows left, down to the node that holds its value.
    `gain` is what each input's splits gained.
    """

    depth: int
    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray
    gain: np.ndarray


class Binned(NamedTuple):
    """Borders of the inputs' bins; trees, share of each in the margin, validation AP after each."""

    borders: tuple[np.ndarray, ...]
    trees: tuple[Tree, ...]
    shares: tuple[float, ...]
    curve: tuple[float | None, ...]

    best = Boosted.best

    def importances(self) -> np.ndarray:
        """Of the inputs, over the first `best` trees, each counting alike; they sum to 1."""
        total = sum(t.gain / (t.gain.sum() or 1.0) for t in self.trees[: self.best])
        return total / total.sum() if total.sum() else total


def find_borders(rows: DataFrame, bins: int) -> tuple[np.ndarray, ...]:
    """Ascending borders of each input; a value belongs to the bin after all borders below it.

    With at most `bins` values an input has a border between any two of them, else at its quantiles.
    """
    values = rows.select(vector_to_array("features").alias("x"))
    width = values.select(F.max(F.size("x"))).first()[0] or 0
    if not width:
        raise ValueError("no rows to train on")
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = values.agg(
        *[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"q{i}") for i in range(width)],
        *[F.approx_count_distinct(F.col("x")[i]).alias(f"n{i}") for i in range(width)],
    ).first()
    few = [i for i in range(width) if found[f"n{i}"] <= 2 * bins]
    known = values.agg(F.lit(0), *[F.collect_set(F.col("x")[i]).alias(f"v{i}") for i in few]).first()
    borders = []
    for i in range(width):
        own = np.sort(known[f"v{i}"]) if i in few else ()
        if i in few and len(own) <= bins:
            borders.append((own[:-1] + own[1:]) / 2)
        else:
            borders.append(np.unique(found[f"q{i}"]))
    return tuple(borders)


def _binned(x: np.ndarray, borders: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (input x row) of the values `x` (row x input)."""
    return np.array([np.searchsorted(b, x[:, i], "left") for i, b in enumerate(borders)], np.uint8).reshape(len(borders), len(x))


def _features(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits that look random, one for each id (splitmix64)."""
    z = ids + _MIX[0]
    z = (z ^ (z >> np.uint64(30))) * _MIX[1]
    z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


def _blocks(rows: DataFrame, borders: Sequence[np.ndarray], label: str) -> RDD:
    """`rows` as blocks of about ROWS, stored, dealt evenly over the tasks; margins are zero."""
    spark, width, size = rows.sparkSession, len(borders), ROWS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, seen = [], 0, 0

        def block():
            data = [np.concatenate(p, axis=-1).tobytes() for p in zip(*kept, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([d], pa.binary()) for d in data]], ["n", "bins", "ids", "fraud"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id")
            # A row without an id is drawn by its place among the stored rows.
            place = pa.array(np.arange(seen, seen + batch.num_rows, dtype=np.int64))
            ids = pc.coalesce(ids, place).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            fraud = batch.column("y").to_numpy(zero_copy_only=False).astype(bool)
            kept.append((_binned(_features(batch, width), borders), _mixed(ids), fraud))
            n, seen = n + batch.num_rows, seen + batch.num_rows
            if n >= size:
                yield block()
                kept, n = [], 0
        if n:
            yield block()

    fraud = F.coalesce(F.col(label) == 1, F.lit(False)).alias("y")
    needed = rows.select(F.col("TransactionID").cast("bigint").alias("id"), fraud, vector_to_array("features").alias("x"))
    cores = spark.sparkContext.defaultParallelism
    made = cut_lineage(needed.mapInArrow(cut, "n long, bins binary, ids binary, fraud binary"))
    parts = max(cores, -(-made.count() // TASK_BLOCKS))

    def read(row) -> Block:
        bins = np.frombuffer(bytes(row.bins), np.uint8).reshape(width, row.n)
        return Block(bins, np.frombuffer(bytes(row.ids), np.uint64), np.frombuffer(bytes(row.fraud), bool), np.zeros(row.n))

    return made.repartition(parts).rdd.map(read)


def _leaves(bins: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    """The node of each row `depth` levels below the root."""
    n = bins.shape[1]
    flat, place = bins.reshape(-1), np.arange(n)
    start, node = tree.feature.astype(np.int64) * n, np.ones(n, np.int64)
    for _ in range(depth):
        node = 2 * node + (flat[start[node] + place] > tree.border[node])
    return node


def _output(bins: np.ndarray, tree: Tree, share: float) -> np.ndarray:
    return tree.value[_leaves(bins, tree, tree.depth)] * share


def _histograms(
    blocks: Iterable[Block], tree: Tree, depth: int, slots: np.ndarray, used: Sequence[int], bins: int, share: float, salt: int, fraud_weight: float
) -> np.ndarray:
    """(3, slot, input, bin): rows, fraud rows and weighted slopes of the drawn rows at the nodes with a slot."""
    many = int(slots.max()) + 1
    cells = many * bins
    out = np.zeros((3, len(used), cells))
    for b in blocks:
        at = slots[_leaves(b.bins, tree, depth)]
        if share < 1:
            at = np.where(_mixed(b.ids ^ np.uint64(salt)) < np.uint64(int(share * 2**64)), at, -1)
        kept = np.flatnonzero(at >= 0)
        fraud, first = b.fraud[kept], at[kept] * bins
        y = np.where(fraud, 1.0, -1.0)
        slope = np.where(fraud, fraud_weight, 1.0) * 4.0 * y / (1.0 + np.exp(2.0 * y * b.margin[kept]))
        hits = np.flatnonzero(fraud)
        for j, f in enumerate(used):
            cell = first + b.bins[f][kept]
            out[0, j] += np.bincount(cell, minlength=cells)
            out[1, j] += np.bincount(cell[hits], minlength=cells)
            out[2, j] += np.bincount(cell, weights=slope, minlength=cells)
    return out.reshape(3, len(used), many, bins).transpose(0, 2, 1, 3)


def _summed(parts: RDD) -> np.ndarray:
    if parts.getNumPartitions() > COMBINED:
        return parts.treeReduce(np.add, 2)
    return reduce(np.add, parts.collect())


def _best_splits(hist: np.ndarray, fraud_weight: float, least: int) -> tuple[np.ndarray, ...]:
    """(gain, input, border, rows left, value left, value right) of the best split of each slot; no gain: none."""
    n, hits, slope = np.cumsum(hist, -1)
    weight = n + (fraud_weight - 1.0) * hits
    total = weight[..., -1:], slope[..., -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        right = total[0] - weight, total[1] - slope
        gain = slope**2 / weight + right[1] ** 2 / right[0] - total[1] ** 2 / total[0]
        fits = (n >= least) & (n[..., -1:] - n >= least) & (weight > 0) & (right[0] > 0)
        gain = np.where(fits, gain, -np.inf).reshape(len(n), -1)
        at = gain.argmax(1)
        row, (f, border) = np.arange(len(n)), np.divmod(at, hist.shape[-1])
        values = slope[row, f, border] / weight[row, f, border], right[1][row, f, border] / right[0][row, f, border]
    return gain[row, at], f, border, n[row, f, border], *values


def _grow(blocks: RDD, width: int, depth: int, bins: int, share: float, of_inputs: float, least: int, seed: int, fraud_weight: float) -> Tree:
    """A tree fitted to the slopes of the rows at their margins."""
    rng = np.random.default_rng(seed)
    used = np.sort(rng.choice(width, max(1, int(np.ceil(of_inputs * width))), replace=False)).tolist()
    salt = int(rng.integers(2**63))
    size = 2 ** (depth + 1)
    tree = Tree(depth, np.zeros(size, np.int64), np.full(size, 255), np.zeros(size), np.zeros(width))
    wanted, parents = np.array([1]), None  # nodes to be counted; histograms of the level above
    for d in range(depth):
        slots = np.full(size, -1)
        slots[wanted] = np.arange(len(wanted))

        def run(part, tree=tree, d=d, slots=slots):
            yield _histograms(part, tree, d, slots, used, bins, share, salt, fraud_weight)

        counted = _summed(blocks.mapPartitions(run))
        if parents is None:
            level, nodes = counted, wanted
            n, hits, slope = counted[:, 0, 0].sum(-1)
            tree.value[1 << depth] = slope / (n + (fraud_weight - 1.0) * hits) if n else 0.0
        else:  # the other child of each split has what its parent has besides
            nodes = np.concatenate([wanted, wanted ^ 1])
            level = np.concatenate([counted, parents - counted], 1)
        gain, f, border, left, *values = _best_splits(level, fraud_weight, least)
        split = np.flatnonzero(gain > 1e-9 * (1.0 + np.abs(level[2, :, 0]).sum(-1)))
        if not len(split):
            break
        at = nodes[split]
        tree.feature[at], tree.border[at] = np.array(used)[f[split]], border[split]
        np.add.at(tree.gain, tree.feature[at], gain[split])
        for side, value in enumerate(values):
            tree.value[(2 * at + side) << (depth - d - 1)] = value[split]
        total = level[0, split, 0].sum(-1)
        wanted = 2 * at + (left[split] * 2 > total)
        parents = level[:, split]
    return tree


def _with_trees(blocks: RDD, trees: Sequence[Tree], shares: Sequence[float]) -> RDD:
    """The blocks with the outputs of the trees added to their margins, kept."""

    def add(b: Block) -> Block:
        margin = b.margin
        for tree, share in zip(trees, shares, strict=True):
            margin = margin + _output(b.bins, tree, share)
        return b._replace(margin=margin)

    return blocks.map(add).persist(StorageLevel.MEMORY_AND_DISK)


def _proba(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-2.0 * margin))


def _after_each(b: Block, trees: Sequence[Tree], shares: Sequence[float]) -> Iterator[np.ndarray]:
    """Probabilities of the block's rows after each of the trees."""
    margin = b.margin
    for tree, share in zip(trees, shares, strict=True):
        margin = margin + _output(b.bins, tree, share)
        yield _proba(margin)


def _judge(held: RDD, trees: Sequence[Tree], shares: Sequence[float]) -> list[float | None]:
    """Average precision on the held rows after each of the trees, exact.

    Only fraud rows raise it: their scores go to the tasks, which count the other rows at or above each.
    """

    def hits(part):
        found = [[p[b.fraud] for p in _after_each(b, trees, shares)] for b in part]
        yield [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0)] * len(trees)

    found = held.mapPartitions(hits).collect()
    scores = [np.unique(np.concatenate(x), return_counts=True) for x in zip(*found, strict=True)]
    if not scores or not len(scores[0][0]):
        return [None] * len(trees)

    def others(part):
        out = [np.zeros(len(s) + 1) for s, _ in scores]
        for b in part:
            for k, p in enumerate(_after_each(b, trees, shares)):
                out[k] += np.bincount(np.searchsorted(scores[k][0], p[~b.fraud], "right"), minlength=len(out[k]))
        yield np.concatenate(out)

    counts = np.split(_summed(held.mapPartitions(others)), np.cumsum([len(s) + 1 for s, _ in scores])[:-1])
    judged = []
    for (_, n), below in zip(scores, counts, strict=True):
        tp, fp = np.cumsum(n[::-1])[::-1], np.cumsum(below[::-1])[::-1][1:]
        judged.append(float((n * tp / (tp + fp)).sum() / n.sum()))
    return judged


def boost(
    train: DataFrame,
    validation: DataFrame,
    label: str = "isFraud",
    start: Binned | None = None,
    block: int = BLOCK,
    patience: int = PATIENCE,
    **params,
) -> Binned:
    """Fit trees to `train` until average precision on `validation` has not risen for `patience` trees.

    Parameters and frames are those of `boost.boost`; average precision is known after every
    `block` trees. Without a label a training row is not fraud and a validation row is left out.
    """
    used = {**PARAMS, **params}
    if not 2 <= used["maxBins"] <= 256:
        raise ValueError("a bin is a byte: maxBins is 2 to 256")
    spark = train.sparkSession
    shared_dir(spark)
    fraud_weight = class_balance(train, label).first()["scale_pos_weight"] or 1.0
    borders = start.borders if start else find_borders(train, used["maxBins"])
    model = start or Binned(borders, (), (), ())
    shape = (
        len(borders), used["maxDepth"], used["maxBins"], float(used["subsamplingRate"]),
        float(used["featureSubsetStrategy"]), used["minInstancesPerNode"],
    )
    fit = _blocks(train, borders, label)
    held = _blocks(validation.filter(F.col(label).isNotNull()), borders, label)
    fit, held = (_with_trees(x, model.trees, model.shares) for x in (fit, held))
    frauds = max(1, held.map(lambda b: int(b.fraud.sum())).sum())
    former, written = None, None
    while len(model.trees) < used["maxIter"] and not (model.trees and len(model.trees) - model.best >= patience):
        trees, shares, before = [], [], len(model.trees)
        for i in range(before, min(before + block, used["maxIter"])):
            trees.append(_grow(fit, *shape, used["seed"] + i, fraud_weight))
            shares.append(used["stepSize"] if i else 1.0)
            if former is not None:  # `fit` is filled now
                former.unpersist()
            if fit.isCheckpointed():
                if written:
                    drop_path(spark, written)
                written = fit.getCheckpointFile()
            former, fit = fit, _with_trees(fit, trees[-1:], shares[-1:])
            if (i + 1) % CUT == 0:  # or a lost task would go through all trees
                fit.checkpoint()
        curve, step = [], max(1, JUDGED // frauds)
        for k in range(0, len(trees), step):
            some = trees[k : k + step], shares[k : k + step]
            curve += _judge(held, *some)
            judged, held = held, _with_trees(held, *some)
            held.count()
            judged.unpersist()
        model = Binned(borders, (*model.trees, *trees), (*model.shares, *shares), (*model.curve, *curve))
    for rows in (former, fit, held):
        if rows is not None:
            rows.unpersist()
    if written:
        drop_path(spark, written)
    return model


def score_boosted(model: Binned, df: DataFrame, trees: int | None = None) -> DataFrame:
    """(TransactionID, isFraud, proba) from the first `trees` trees, by default the best number of them."""
    used = trees or model.best
    known = model._replace(trees=model.trees[:used], shares=model.shares[:used])
    width = len(model.borders)

    def run(batches):
        for batch in batches:
            bins = _binned(_features(batch, width), known.borders)
            margin = np.zeros(batch.num_rows)
            for tree, share in zip(known.trees, known.shares, strict=True):
                margin += _output(bins, tree, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_proba(margin))], ["TransactionID", "isFraud", "proba"])

    rows = df.select("TransactionID", "isFraud", vector_to_array("features").alias("x"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"TransactionID {kinds['TransactionID']}, isFraud {kinds['isFraud']}, proba double")
