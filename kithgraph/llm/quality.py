"""Quality rules: base counts, then a hashed n-gram logistic regression, in Arrow batches.

Features are words, pairs of equal neighbouring words, and runs of 2 to 4 characters,
hashed into 2**17 bins; each family is counted as shares of the text's items. The
weights are fitted by full-gradient steps on a bounded sample of labelled rows (`SAMPLE`
rows, the documented bound), two thirds of it; the other third calibrates the margin to
a probability. A document that passes the base rules is kept from `KEEP_FROM` on.

Defined cases: a null text has no words and fails the base rules, as does an empty one;
without labelled rows of both kinds the score is 1; equal rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kithgraph.llm import textbytes as B
from kithgraph.llm.fitting import fit_in_task, labelled_sample, logistic, sigmoid

SAMPLE = 2_000
BINS = 1 << 17
KEEP_FROM = 0.5
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
WINDOW = 8
SYMBOLS = B.table(b"#*$%&|<>")
CHAR_WIDTHS = (2, 3, 4)
STEPS = 60
RATE, RIDGE = 0.1, 1e-4
COMMON = 0.2  # shares far below this count little, so that rare n-grams do not decide


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and where each text begins among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    starts = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    return points, starts[offsets]


def families(data: np.ndarray, offsets: np.ndarray, word_hash: np.ndarray, first: np.ndarray):
    """(bins, first) for each kind of feature."""
    mask = np.uint64(BINS - 1)
    yield (word_hash & mask).astype(np.int32), first
    again = np.zeros(len(word_hash), dtype=np.int32)  # bins 0 and 1: another word, the same word
    if len(word_hash) > 1:
        again[:-1] = (word_hash[1:] == word_hash[:-1]) & B.within(first, 2)[:-1]
    yield again, first
    points, at = _characters(data, offsets)
    value = B.mix(points.astype(np.uint64) + np.uint64(77))
    for width in CHAR_WIDTHS:
        h = value[: max(0, len(value) - width + 1)].copy()
        for k in range(1, width):
            h = h * np.uint64(0xD1342543DE82EF95) + value[k : k + len(h)]
        bins = ((h ^ (h >> np.uint64(29))) & mask).astype(np.int32)
        yield bins, np.minimum(at, len(bins))  # the last few runs of a text reach into the next


def base_counts(data: np.ndarray, offsets: np.ndarray):
    """The counts of the base rules, and the words' hashes with their `first`."""
    starts, ends, first = B.words(data, offsets)
    hasher = B.Hasher(data)
    word_hash = hasher.spans(starts, ends)
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & B.NON_BLANK[data], out=lead[1:])
    symbols = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(SYMBOLS[data], out=symbols[1:])
    # Lines with a word, equal to an earlier line of the text.
    line_start, line_end = B.runs(data != 10, offsets)
    worded = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_start, line_end = line_start[worded], line_end[worded]
    line_first = np.searchsorted(line_start, offsets)
    text = B.owner(line_first).astype(np.uint64)
    line_key = hasher.spans(line_start, line_end) + B.mix(text + np.uint64(1))
    _, later = B.equal_to_another((line_key,))
    # Words in windows that the text holds twice or more.
    full = np.flatnonzero(B.within(first, WINDOW))
    windows = B.shingles(word_hash, WINDOW)[full] if len(full) else np.zeros(0, np.uint64)
    text = B.owner(first).astype(np.uint64)
    repeated, _ = B.equal_to_another((windows + B.mix(text[full] + np.uint64(1)),))
    covered = B.cover(len(word_hash), full[repeated], WINDOW)
    counts = {
        "n_words": np.diff(first),
        "word_chars": lead[offsets[1:]] - lead[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": B.sums_by(later, line_first),
        "n_repeat_words": B.sums_by(covered, first),
    }
    return counts, word_hash, first


def _frequencies(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The sample as sparse rows: row, feature, share, and the rows' labels."""
    rows, features, shares, labels, done = [], [], [], [], 0
    for batch in table.to_batches():
        for part in B.slices(batch, "text"):
            data, offsets = B.flat(part.column("text"))
            _, word_hash, first = base_counts(data, offsets)
            for k, (bins, at) in enumerate(families(data, offsets, word_hash, first)):
                row = B.owner(at)
                key = row * BINS + bins[: len(row)]
                key, n = np.unique(key, return_counts=True)
                size = np.maximum(np.diff(at), 1)
                rows.append((key // BINS + done).astype(np.int32))
                features.append((key % BINS + k * BINS).astype(np.int32))
                shares.append((n / size[key // BINS]).astype(np.float32))
            done += part.num_rows
            labels.append(part.column("label").to_numpy(zero_copy_only=False))
    return np.concatenate(rows), np.concatenate(features), np.concatenate(shares), np.concatenate(labels)


def fit(table: pa.Table) -> dict | None:
    """Weights per family and bin, and the calibration of the margin."""
    row, feature, share, y = _frequencies(table)
    if len(np.unique(y)) < 2:
        return None
    n, size = len(y), int(feature.max()) + 1
    apart = np.arange(n) % 3 == 2  # the calibration third
    scale = 1 / (np.sqrt(np.bincount(feature, share * share, size) / n) + COMMON)
    value = share * scale[feature].astype(np.float32)
    w, bias = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    use = ~apart
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[feature] * value, n) + bias
        error = np.where(use, sigmoid(z) - y, 0) / use.sum()
        g = np.append(np.bincount(feature, error[row] * value, size) + RIDGE * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    z = np.bincount(row, w[feature] * value, n) + bias
    a, b = logistic(z[apart][:, None], y[apart], 0.1, prior=np.array([1.0, 0.0]))
    weights = np.zeros(-(-size // BINS) * BINS, dtype=np.float32)
    weights[:size] = w * scale
    return {"weights": weights.reshape(-1, BINS), "bias": bias, "a": a, "b": b}


def score(model: dict | None, data: np.ndarray, offsets: np.ndarray, word_hash, first) -> np.ndarray:
    if model is None:
        return np.ones(len(offsets) - 1)
    z = np.full(len(offsets) - 1, model["bias"])
    for weights, (bins, at) in zip(model["weights"], families(data, offsets, word_hash, first), strict=False):
        z += B.sums_by(weights[bins].astype(np.float64), at) / np.maximum(np.diff(at), 1)
    return sigmoid(model["a"] * z + model["b"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for each row of `docs`."""
    model = fit_in_task(labelled_sample(docs, labels, "quality", sample), fit)

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                data, offsets = B.flat(part.column("text"))
                counts, word_hash, first = base_counts(data, offsets)
                n, repeated = counts["n_words"], counts["n_repeat_words"]
                failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
                p = score(model, data, offsets, word_hash, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                        pa.array(failed),
                        pa.array(p),
                        pa.array(~failed & (p >= keep_from)),
                    ],
                    ["doc_id", *COUNTS, "base_failed", "score", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "".join(f"{c} long, " for c in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {columns}base_failed boolean, score double, kept boolean"
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
