"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words get tags: insult (learned from labels: whole words and beginnings of words that set
toxic documents apart), threat, target, negation and reported speech (fixed lists). Each
of the five is a small transducer that reads tags and rewrites its own part of the clause
state; their composition reads a clause from left to right and puts out the kind of each
match: an insult plain, aimed at a target, negated or reported, a threat plain or aimed.
A document's features are the weights of its matched clauses by kind; a logistic
regression that starts from fixed weights of the kinds turns them into a score.

The lexicon and weights come from at most `SAMPLE` labelled rows outside the held-out
fifth. Only the text enters a score.

Defined cases: a null or empty text has no clause and gets the score of one without
matches; without labelled rows of both kinds the score is 0.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import textbytes as B
from kithgraph.llm.decontaminate import WORD_BYTES
from kithgraph.llm.fitting import fit_in_task, labelled_sample, logistic, sigmoid

SAMPLE = 6_000
FOLDS = 5
INSULT, THREAT, TARGET, NEGATION, REPORT = 1, 2, 3, 4, 5
# The closed word classes of the grammar.
WORDS = {
    THREAT: "kill hurt destroy beat punish töten schlagen tuer frapper matar golpear",
    TARGET: "you your yours u he she they them him her it this that these those du dich dein ihr sie er tu toi ton vous il elle tú te usted él ella",
    NEGATION: "not no never nobody nothing isn't aren't wasn't don't nicht kein keine nie pas jamais aucun ningún nunca nadie",
    REPORT: "said says say wrote claimed called told reported quote quoted sagte schrieb dit écrit dijo escribió",
}
PREFIXES = (3, 4, 5, 6, 7, 8)  # bytes
LEAST_DOCS = 5
LEAST_ODDS = 8.0  # a term is as many times as frequent in toxic documents
MOST_TERMS = 2_000
REACH = 3  # words that a negation governs
BREAKS = B.table(b".!?;:\n")
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat")
# Starting weights by kind, then for the strongest term; the last is the bias.
PRIOR = np.array([2.0, 3.0, 0.5, 0.5, 0.5, 1.5, 1.0, -3.0])


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the accented capitals À to Þ, two bytes each in UTF-8."""
    data = B.LOWERED[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    data[capital] += 0x20
    return data


def _word_hash(text: str) -> int:
    raw = lowered(np.frombuffer(text.encode(), dtype=np.uint8))
    return int(B.Hasher(raw).spans(np.array([0]), np.array([len(raw)]))[0])


def tokens(column: pa.Array):
    """(hasher, starts, ends, first, clause): words of each text and the clause they are in."""
    data, offsets = B.flat(column)
    data = lowered(data)
    inside = WORD_BYTES.copy()
    inside[ord("'")] = True
    starts, ends, first = B.words(data, offsets, inside)
    breaks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(BREAKS[data], out=breaks[1:])
    clause = breaks[starts] + B.owner(first)  # a new text is a new clause
    return B.Hasher(data), starts, ends, first, clause


def _terms(hasher: B.Hasher, starts: np.ndarray, ends: np.ndarray, sizes):
    """(size, words' indices, hash): the whole word (size 0) and its beginnings."""
    for size in sizes:
        if size == 0:
            yield 0, None, hasher.spans(starts, ends)
        else:
            long = np.flatnonzero(ends - starts > size)
            yield size, long, B.mix(hasher.spans(starts[long], starts[long] + size) + np.uint64(size))


class Lexicon:
    """Sorted term hashes by size with a tag and a weight each."""

    def __init__(self, terms: list[tuple[int, int, float]]):
        """terms: (size, hash, weight) of insults."""
        by_size: dict[int, dict[int, tuple[int, float]]] = defaultdict(dict)
        for tag, text in WORDS.items():
            for word in text.split():
                by_size[0][_word_hash(word)] = (tag, 0.0)
        for size, h, weight in terms:
            by_size[size][h] = (INSULT, weight)
        self.tables = {}
        for size, entries in by_size.items():
            keys = np.array(sorted(entries), dtype=np.uint64)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            tags = np.array([entries[int(k)][0] for k in keys], dtype=np.int8)
            weights = np.array([entries[int(k)][1] for k in keys])
            self.tables[size] = keys, seen, tags, weights

    def tag(self, hasher, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Tag and weight of every word; the heaviest insult term wins."""
        tags, weights = np.zeros(len(starts), dtype=np.int8), np.zeros(len(starts))
        for size, words, h in _terms(hasher, starts, ends, sorted(self.tables)):
            keys, seen, kinds, values = self.tables[size]
            maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            right = keys[at] == h[maybe]
            word = maybe[right] if words is None else words[maybe[right]]
            tag, weight = kinds[at[right]], values[at[right]]
            better = (tags[word] == 0) | (weight > weights[word])
            tags[word[better]], weights[word[better]] = tag[better], weight[better]
        return tags, weights


def _negation(state: tuple, tag: int) -> tuple:
    aimed, negated, reported = state
    return (aimed, REACH + 1 if tag == NEGATION else max(0, negated - 1), reported)


def _report(state: tuple, tag: int) -> tuple:
    return (state[0], state[1], state[2] or tag == REPORT)


def _target(state: tuple, tag: int) -> tuple:
    return (state[0] or tag == TARGET, state[1], state[2])


def _insult(state: tuple, tag: int) -> str | None:
    aimed, negated, reported = state
    if tag != INSULT:
        return None
    return "negated insult" if negated else "reported insult" if reported else "aimed insult" if aimed else "insult"


def _threat(state: tuple, tag: int) -> str | None:
    if tag != THREAT or state[1]:
        return None
    return "aimed threat" if state[0] else "threat"


START = (False, 0, False)  # aimed, words still negated, reported
STRAIGHT = (KINDS.index("insult"), KINDS.index("aimed insult"))


def _compose() -> tuple[dict, dict]:
    """The transition and output tables of the composed transducer."""
    moves, out = {}, {}
    todo = [START]
    while todo:
        state = todo.pop()
        for tag in range(6):
            after = _target(_report(_negation(state, tag), tag), tag)
            moves[state, tag] = after
            out[state, tag] = _insult(after, tag) or _threat(after, tag)
            if (after, 0) not in moves:
                todo.append(after)
    return moves, {k: KINDS.index(v) for k, v in out.items() if v}


MOVES, OUT = _compose()


def features(lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    """Per text: the summed match weight by kind (logarithmic), and the strongest term."""
    hasher, starts, ends, first, clause = tokens(column)
    tags, weights = lexicon.tag(hasher, starts, ends)
    x = np.zeros((len(first) - 1, len(KINDS) + 1))
    matched = np.flatnonzero((tags == INSULT) | (tags == THREAT))
    text_of = np.searchsorted(first, matched, side="right") - 1
    done = -1
    for m, text in zip(matched.tolist(), text_of.tolist(), strict=True):
        if clause[m] == done:
            continue
        done = clause[m]
        a = np.searchsorted(clause, done)
        b = np.searchsorted(clause, done, side="right")
        state = START
        for i, tag in enumerate(tags[a:b].tolist(), int(a)):
            kind = OUT.get((state, tag))
            state = MOVES[state, tag]
            if kind is not None:
                weight = weights[i] if tag == INSULT else 1.0
                x[text, kind] += weight
                if kind in STRAIGHT:
                    x[text, -1] = max(x[text, -1], weight)
    x[:, :-1] = np.log1p(x[:, :-1])
    return x


def learn_terms(table: pa.Table, y: np.ndarray) -> list[tuple[int, int, float]]:
    """Insult terms: few terms that cover the toxic documents and are rare in others.

    Terms are chosen one by one for the toxic documents not covered so far.
    """
    keys, docs, sizes, done = [], [], [], 0
    for batch in table.to_batches():
        for part in B.slices(batch, "text"):
            hasher, starts, ends, first, _ = tokens(part.column("text"))
            text = B.owner(first)
            for size, words, h in _terms(hasher, starts, ends, (0, *PREFIXES)):
                of = text if words is None else text[words]
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                keys.append(h[new])
                docs.append((of[new] + done).astype(np.int32))
                sizes.append(np.full(new.sum(), size, dtype=np.int8))
            done += part.num_rows
    keys, docs, sizes = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes)
    term, at = np.unique(keys, return_inverse=True)
    toxic = y[docs] == 1
    pos = np.bincount(at[toxic], minlength=len(term))
    neg = np.bincount(at[~toxic], minlength=len(term))
    p, n = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    odds = ((pos + 0.5) / (p + 1)) / ((neg + 0.5) / (n + 1))
    least = max(LEAST_DOCS, p // 200)
    good = np.flatnonzero((pos >= least) & (odds >= LEAST_ODDS))
    size_of = np.zeros(len(term), dtype=np.int8)
    size_of[at] = sizes
    hold = toxic & np.isin(at, good)
    rows: dict[int, set[int]] = defaultdict(set)
    for t, d in zip(at[hold].tolist(), docs[hold].tolist(), strict=True):
        rows[t].add(d)
    gain = {int(t): float(np.log(odds[t])) for t in good}
    chosen, open_docs = [], set(np.flatnonzero(y == 1).tolist())
    while rows and len(chosen) < MOST_TERMS:
        best = max(rows, key=lambda t: (len(rows[t] & open_docs) * gain[t], -size_of[t], t))
        cover = rows.pop(best) & open_docs
        if len(cover) < least:
            break
        chosen.append((int(size_of[best]), int(term[best]), gain[best]))
        open_docs -= cover
        rows = {t: left for t, r in rows.items() if len(left := r & open_docs) >= least}
    # What adds little cover of its own may still be as telling: equally pure whole words.
    have = {t for _, t, _ in chosen}
    pure = [t for t in good if size_of[t] == 0 and int(term[t]) not in have and pos[t] >= max(least, p // 20)]
    chosen += [(0, int(term[t]), gain[int(t)]) for t in pure[: MOST_TERMS - len(chosen)]]
    return chosen


def fit(table: pa.Table) -> dict | None:
    y = table.column("label").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    lexicon = Lexicon(learn_terms(table, y))
    x = np.concatenate([features(lexicon, p.column("text")) for b in table.to_batches() for p in B.slices(b, "text")])
    return {"lexicon": lexicon, "w": logistic(x, y, 0.5, prior=PRIOR)}


def score(model: dict | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    x = features(model["lexicon"], column)
    return sigmoid(x @ model["w"][:-1] + model["w"][-1])


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS)) == 0


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, score_col: str = "score") -> DataFrame:
    """`docs` (doc_id, text, ...) with a score, whatever the other columns."""
    model = fit_in_task(labelled_sample(docs, labels, "toxic", sample, ~held_out()), fit)

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                columns = [*part.columns, pa.array(score(model, part.column("text")))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{score_col}` double")


def remove_toxic(docs: DataFrame, labels: DataFrame, reject_from: float = 0.5) -> DataFrame:
    """The rows of `docs` that score less than `reject_from`."""
    mark = "_" + "_".join(docs.columns)  # a name that no column has
    return toxicity(docs, labels, score_col=mark).filter(F.col(mark) < reject_from).select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
