"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network.

Tokens are runs of letters, of digits, or of one symbol, with their case. Each hashes to
one of `BINS` bins and has a sparse ternary index vector drawn from its hash; the vector
of a bin is the sum of the index vectors of the tokens up to `REACH` places beside it,
over all documents. The sums are whole numbers, added up by Spark, so neither order nor
partitioning matters. `BINS` x `DIM` bounds what is broadcast (4 MB), at any input size.

A document pools the unit vectors of its tokens: weighted mean (frequent tokens weigh
less), spread, likeness of neighbours, and length. The network is fitted on the pooled
rows of at most `SAMPLE` labelled documents (the documented bound), two thirds of them;
the other third sets the temperature that turns its output into a probability.

Defined cases: a null or empty text pools to zeros and gets the network's score for that;
without labelled rows of both kinds the score is 1; a null doc_id is in the fold of the
empty string and teaches nothing; equal rows get equal results; columns besides doc_id
and text are not read. A text above 2 MB is pooled in parts cut at blanks; neighbours do
not reach over such a cut, so the memory of a task does not grow with the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import textbytes as B
from kithgraph.llm.fitting import fit_in_task, labelled_sample, sigmoid

SAMPLE = 4_000
BINS, DIM = 1 << 15, 32
NONZERO = 4  # entries of an index vector
REACH = 2
RARE = 1e-3  # tokens with a larger share of all weigh less
HIDDEN, STEPS, RATE, RIDGE = 24, 400, 0.01, 1e-3
SEED = 20
FOLDS, HELD_OUT = 4, 2
POSITIVE_FROM = 0.7

CLASS = np.zeros(256, dtype=np.uint8)  # 0 blank, 1 letter, 2 digit, else the symbol itself
CLASS[33:127] = np.arange(33, 127)
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = 1
CLASS[48:58] = 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each token, first): text i has tokens first[i] to first[i + 1]."""
    kind = CLASS[data]
    border = np.ones(len(data) + 1, dtype=bool)
    border[1:-1] = kind[1:] != kind[:-1]
    border[offsets] = True
    at = np.flatnonzero(border)
    starts, ends = at[:-1], at[1:]
    worded = kind[starts] > 0 if len(starts) else np.zeros(0, dtype=bool)
    starts, ends = starts[worded], ends[worded]
    h = B.Hasher(data).spans(starts, ends)
    return (h & np.uint64(BINS - 1)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each bin's index vector."""
    draw = np.stack([B.mix(np.arange(BINS, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(k)) for k in range(NONZERO)], 1)
    return (draw % np.uint64(DIM)).astype(np.int64), 1 - 2 * (draw >> np.uint64(63)).astype(np.int64)


def add_contexts(total: np.ndarray, bins: np.ndarray, first: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to `total` (BINS x DIM) the index vectors of each token's neighbours in its text."""
    text = B.owner(first)
    for step in range(1, REACH + 1):
        if len(bins) <= step:
            break
        left = np.flatnonzero(text[:-step] == text[step:])
        for here, there in ((left, left + step), (left + step, left)):
            b, c = bins[here], bins[there]
            for k in range(NONZERO):
                total += np.bincount(b * DIM + places[c, k], signs[c, k], BINS * DIM).astype(np.int64).reshape(BINS, DIM)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, pooling weights) of all bins, from every text of `docs`."""
    names = [f"v{k}" for k in range(DIM)]

    def run(batches):
        places, signs = index_vectors()
        total, seen = np.zeros((BINS, DIM), dtype=np.int64), np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            data, offsets = B.flat(batch.column("text"))
            for _, part, at in B.blocks(data, offsets, B.BLANK):
                bins, first = tokens(part, at)
                add_contexts(total, bins, first, places, signs)
                seen += np.bincount(bins, minlength=BINS)
        held = np.flatnonzero(seen)
        for a in range(0, len(held), 4096):
            rows = held[a : a + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(seen[rows]), *[pa.array(total[rows, k]) for k in range(DIM)]], ["bin", "n", *names]
            )

    parts = docs.select("text").mapInArrow(run, "bin long, n long, " + ", ".join(f"{c} long" for c in names))
    sums = parts.groupBy("bin").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    made = sums.toArrow()  # at most BINS rows
    vectors, n = np.zeros((BINS, DIM)), np.zeros(BINS)
    rows = made.column("bin").to_numpy()
    n[rows] = made.column("n").to_numpy()
    for k, c in enumerate(names):
        vectors[rows, k] = made.column(c).to_numpy()
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32), (RARE / (RARE + n / max(n.sum(), 1))).astype(np.float32)


WIDTH = 2 * DIM + 3


def pooled(column: pa.Array, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    data, offsets = B.flat(column)
    sums = np.zeros((len(column), 3 * DIM + 3))
    for owner, part, at in B.blocks(data, offsets, B.BLANK):
        bins, first = tokens(part, at)
        if not len(bins):
            continue
        v, w = vectors[bins], weights[bins]
        beside = np.zeros(len(bins))
        beside[:-1] = np.einsum("ij,ij->i", v[:-1], v[1:])
        beside[first[1:][np.diff(first) > 0] - 1] = 0  # the last token of a text has none after it
        full = np.flatnonzero(np.diff(first))
        here = np.column_stack([v * w[:, None], v, v * v, w, beside, np.ones(len(bins))])
        np.add.at(sums, owner[full], np.add.reduceat(here, first[full], axis=0, dtype=np.float64))
    n = np.maximum(sums[:, -1:], 1)
    mean = sums[:, DIM : 2 * DIM] / n
    spread = np.sqrt(np.maximum(sums[:, 2 * DIM : 3 * DIM] / n - mean * mean, 0))
    return np.column_stack(
        [
            sums[:, :DIM] / np.maximum(sums[:, 3 * DIM : 3 * DIM + 1], 1e-9),
            spread,
            np.linalg.norm(mean, axis=1),
            sums[:, 3 * DIM + 1] / n[:, 0],
            np.log1p(sums[:, -1]),
        ]
    )


def forward(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh((x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"])
    return hidden, hidden @ model["w2"] + model["b2"]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of `z` with the least loss on rows the weights have not seen."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    p = np.clip(sigmoid(z[None, :] / grid[:, None]), 1e-12, 1 - 1e-12)
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(axis=1)
    return float(grid[int(loss.argmin())])


def fit_network(table: pa.Table) -> dict | None:
    x = np.array(table.column("x").to_pylist(), dtype=float).reshape(-1, WIDTH)
    y = table.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T[:4], y))  # the rows come in no fixed order
    x, y = x[order], y[order]
    if len(np.unique(y)) < 2:
        return None
    rng = np.random.default_rng(SEED)
    apart = rng.permutation(len(y)) % 3 == 2
    use = ~apart if len(np.unique(y[~apart])) == 2 else np.ones(len(y), dtype=bool)
    model = {"mean": x[use].mean(0), "scale": x[use].std(0) + 1e-3}
    model |= {"w1": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b1": np.zeros(HIDDEN)}
    model |= {"w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(())}
    learnt = ("w1", "b1", "w2", "b2")
    m, v = {k: np.zeros_like(model[k]) for k in learnt}, {k: np.zeros_like(model[k]) for k in learnt}
    inputs, target = x[use], y[use]
    units = (inputs - model["mean"]) / model["scale"]
    for step in range(1, STEPS + 1):
        hidden, z = forward(model, inputs)
        error = (sigmoid(z) - target) / len(target)
        back = np.outer(error, model["w2"]) * (1 - hidden * hidden)
        slope = {"w1": units.T @ back, "b1": back.sum(0), "w2": hidden.T @ error, "b2": error.sum()}
        for k in learnt:
            g = slope[k] + (RIDGE * model[k] if k in ("w1", "w2") else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            model[k] = model[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    judge = apart if len(np.unique(y[apart])) == 2 else use
    model["temperature"] = temperature(forward(model, x[judge])[1], y[judge])
    return model


def held_out(id_col: str = "doc_id"):
    key = F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")
    return F.pmod(F.crc32(key), F.lit(FOLDS)) == HELD_OUT


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) for each row of `docs`; labels of the held-out fold are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(word_vectors(docs))

    def pool(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                x = pooled(part.column("text"), *shared.value)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("label"), rows], ["label", "x"])

    rows = labelled_sample(docs, labels, label, sample, ~held_out())
    model = fit_in_task(rows.mapInArrow(pool, "label int, x array<double>"), fit_network)

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                p = np.ones(part.num_rows)
                if model is not None and part.num_rows:
                    z = forward(model, pooled(part.column("text"), *shared.value))[1]
                    p = sigmoid(z / model["temperature"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    predicted = (F.col("score") >= POSITIVE_FROM).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))
