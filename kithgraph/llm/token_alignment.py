"""Cross-tokenizer alignment by products of token-byte incidence matrices in CSR form.

Two tokenizers cut the same bytes. Each has an incidence matrix, tokens x bytes, with a 1
for every byte that a token covers. Gustavson's row products give A.B^T: its entries are
the overlap links, their values the shared bytes. Offsets where both tokenizers end a
token cut the bytes into groups; tokens x groups incidence and the same product give the
shared-group links. Overlap links whose tokens end together are the end links.

Texts are cut into pieces before single spaces at which no token of either vocabulary can
reach over: both tokenizers end a token there, so groups and links lie inside pieces, and
the pieces of a text may be encoded one by one. Pieces are encoded and multiplied once
per worker while they are remembered (`CACHE_PIECES`, then forgotten all together), a
block of pieces at a time, so memory does not grow with a text.

How often an id pair is linked in the whole corpus is counted in two steps. Tasks write
chunks of about `CHUNK_BYTES` of text: the documents' pairs and the chunk's own pair
counts. Counts are summed by pair over the chunks, and each chunk gets back the figures of
its own pairs, so what moves is the pairs of chunks and not those of documents.

Defined cases: a null or empty text, or one whose joined tokens differ from space + text,
has no tokens: zeros, and '' for the digest; a null or repeated doc_id keeps its row; an
empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import textbytes as B
from kithgraph.session import scratch_path

CACHE_PIECES = 300_000  # per worker process
BLOCK_PIECES = 100_000
LONG_CHARS = 1 << 20  # such a text is read block by block
CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 20_000
B_IDS = 1 << 20  # more ids than a vocabulary has: a pair is a * B_IDS + b
# A piece begins at a single space with a character after it that no tokenizer takes for white space.
PIECE = re.compile(r"(?: (?=\S))?(?:[^ ]+| (?!\S)|(?<= ) )+")
KINDS = ("end", "overlap", "group")
NOTHING = (np.zeros(3, dtype=np.int64), b"", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Csr:
    """Rows of sorted column numbers with values."""

    def __init__(self, pointer: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.pointer, self.column, self.value = pointer, column, value

    @classmethod
    def of_spans(cls, length: np.ndarray) -> Csr:
        """tokens x bytes: each token covers the next `length` bytes."""
        pointer = np.concatenate([[0], np.cumsum(length)])
        return cls(pointer, np.arange(pointer[-1]), np.ones(pointer[-1], dtype=np.int64))

    @classmethod
    def of_column(cls, column: np.ndarray) -> Csr:
        """One entry a row."""
        return cls(np.arange(len(column) + 1), column, np.ones(len(column), dtype=np.int64))

    def transposed(self, columns: int) -> Csr:
        row = np.repeat(np.arange(len(self.pointer) - 1), np.diff(self.pointer))
        order = np.argsort(self.column, kind="stable")
        pointer = np.concatenate([[0], np.cumsum(np.bincount(self.column, minlength=columns))])
        return Csr(pointer, row[order], self.value[order])

    def times(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the product: row i adds up the rows of `other` that i names."""
        fan = np.diff(other.pointer)[self.column]
        row = np.repeat(np.arange(len(self.pointer) - 1), np.diff(self.pointer))
        take = np.repeat(other.pointer[self.column] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
        key = np.repeat(row, fan) * (int(other.column.max(initial=0)) + 1) + other.column[take]
        value = np.repeat(self.value, fan) * other.value[take]
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key = key[at]
        width = int(other.column.max(initial=0)) + 1
        return key // width, key % width, np.add.reduceat(value, at) if len(at) else value


def align(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """(group of each A token, group of each B token, token pairs by kind) over the same bytes."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    shared = end_a[end_b[np.searchsorted(end_b, end_a)] == end_a] if len(end_a) else end_a  # both end at the last byte
    group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
    size = int(end_a[-1]) if len(end_a) else 0
    i, j, _ = Csr.of_spans(length_a).times(Csr.of_spans(length_b).transposed(size))
    together = end_a[i] == end_b[j]
    g, h, _ = Csr.of_column(group_a).times(Csr.of_column(group_b).transposed(len(shared)))
    return group_a, group_b, {"overlap": (i, j), "end": (i[together], j[together]), "group": (g, h)}


class Aligner:
    """Both tokenizers of a worker, and the pieces met so far."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.kind = kind
        self.a = Tokenizer.from_file(vocabulary_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_b)
        letters = {}  # the printable letter that stands for each byte in A's entries
        for byte, letter in zip(_byte_order(), sorted(pre_tokenizers.ByteLevel.alphabet()), strict=True):
            letters[letter] = byte
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(letters[x] for x in entry) if all(x in letters for x in entry) else entry.encode()
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)
        ]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError(f"{vocabulary_b}: an entry goes on over a space; texts cannot be cut into pieces")
        ids = [*range(len(self.bytes_a)), *range(len(self.bytes_b))]
        marks = [b",|"] * len(self.bytes_a) + [b",;"] * len(self.bytes_b)
        self.marked = [b"%d%c" % (k, m) for k, pair in zip(ids, marks, strict=True) for m in pair]
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # the digest's text of a piece, None for one that does not round-trip
        self.counts = np.zeros((0, 3), dtype=np.int64)  # A tokens, B tokens, groups
        self.pointer = np.zeros(1, dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Encode and align pieces not met before."""
        ids_a = [e.ids for e in self.a.encode_batch(pieces, add_special_tokens=False)]
        ids_b = self.b.encode([p[1:] for p in pieces], num_threads=1)  # B puts the space back
        good = self.round_trips(pieces, ids_a, ids_b)
        for k in np.flatnonzero(~good).tolist():
            ids_a[k], ids_b[k] = [], []
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        first_a, first_b = (np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64))]) for ids in (ids_a, ids_b))
        group_a, group_b, links = align(self.length_a[a], self.length_b[b])
        # The digest's text: in each group A's ids, then B's, each with the mark that follows it.
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        n_groups = int(group_a[-1]) + 1 if len(a) else 0
        cut_a, cut_b = (np.searchsorted(g, np.arange(n_groups + 1)) for g in (group_a, group_b))
        marked = np.zeros(len(a) + len(b), dtype=np.int64)
        if len(a):
            marked[np.arange(len(a)) + cut_b[group_a]] = 2 * a + last_a
            marked[np.arange(len(b)) + cut_a[group_b + 1]] = 2 * (len(self.bytes_a) + b) + last_b
        texts = list(map(self.marked.__getitem__, marked.tolist()))
        cut = (first_a + first_b).tolist()
        size = len(self.groups)
        self.number.update(zip(pieces, range(size, size + len(pieces)), strict=True))
        self.groups += [b"".join(texts[x:y]) if ok else None for x, y, ok in zip(cut[:-1], cut[1:], good.tolist(), strict=True)]
        i, j = links[self.kind]
        first_g = np.concatenate([group_a, [n_groups]])[first_a]
        self.counts = np.vstack([self.counts, np.diff(np.stack([first_a, first_b, first_g], 1), axis=0)])
        self.pointer = np.append(self.pointer, np.searchsorted(i, first_a)[1:] + self.pointer[-1])
        self.pairs = np.append(self.pairs, a[i] * B_IDS + b[j])

    def round_trips(self, pieces: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> np.ndarray:
        """Whether both tokenizers' bytes are those of each piece."""
        both = ((self.bytes_a, ids_a), (self.bytes_b, ids_b))
        # Boundaries inside the joined bytes are compared by length, the bytes all at once.
        whole = [p.encode() for p in pieces]
        size = np.fromiter(map(len, whole), np.int64)
        raw, out = b"".join(whole), np.ones(len(pieces), dtype=bool)
        for table, ids in both:
            first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64))])
            parts = list(map(table.__getitem__, chain.from_iterable(ids)))
            at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64))])
            if b"".join(parts) != raw or (np.diff(at[first]) != size).any():
                out &= [b"".join(parts[x:y]) == w for x, y, w in zip(first[:-1].tolist(), first[1:].tolist(), whole, strict=True)]
        return out

    def know(self, blocks: list[list[str]]) -> None:
        """Learn the pieces of some blocks in one go; all of them are known then."""
        new = [p for p in dict.fromkeys(chain.from_iterable(blocks)) if p not in self.number]
        if new and len(self.number) + len(new) > CACHE_PIECES:
            self.forget()
            new = list(dict.fromkeys(chain.from_iterable(blocks)))
        if new:
            self.learn(new)

    def read_all(self, texts: list[str | None]) -> Iterator[tuple]:
        """What `read` gives for each of some texts of about `SLICE_BYTES` together."""
        if len(texts) == 1 and len(texts[0] or "") >= LONG_CHARS:
            yield self.read(self.known_blocks(texts[0]))
            return
        blocks = [PIECE.findall(" " + t) if t else None for t in texts]
        self.know([b for b in blocks if b])
        for block in blocks:
            yield self.read([block]) if block else NOTHING

    def known_blocks(self, text: str) -> Iterator[list[str]]:
        """The pieces of a long text, `BLOCK_PIECES` at a time, each block learnt when its turn comes."""
        held: list[str] = []
        for m in PIECE.finditer(" " + text):
            held.append(m.group())
            if len(held) == BLOCK_PIECES:
                self.know([held])
                yield held
                held = []
        if held:
            self.know([held])
            yield held

    def read(self, blocks: Iterable[list[str]]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
        """(A tokens, B tokens, groups), digest, distinct pairs and how often the text links each."""
        totals, digest, held = np.zeros(3, dtype=np.int64), hashlib.sha256(), []
        joint = b""
        for block in blocks:
            at = list(map(self.number.__getitem__, block))
            parts = [self.groups[k] for k in at]
            if None in parts:
                return NOTHING
            digest.update(joint)
            digest.update(b"".join(parts)[:-1])
            joint = b";"
            at = np.array(at)
            totals += self.counts[at].sum(axis=0)
            first, fan = self.pointer[at], self.pointer[at + 1] - self.pointer[at]
            pairs = self.pairs[np.repeat(first - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())]
            held.append(np.unique(pairs, return_counts=True))
        pairs, n = held[0] if len(held) == 1 else _sums(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return totals, digest.hexdigest().encode(), pairs, n


def _byte_order() -> list[int]:
    """Bytes in the order of the letters that stand for them: printable ones as themselves, the others after U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [*printable, *sorted(set(range(256)) - set(printable))]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) of a batch; a long text by itself, others by about a slice together."""
    for part in B.slices(batch, "text"):
        ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
        at = 0
        for k, text in enumerate(texts):
            if text and len(text) >= LONG_CHARS:
                if k > at:
                    yield ids[at:k], texts[at:k]
                yield ids[k : k + 1], texts[k : k + 1]
                at = k + 1
        if at < len(ids):
            yield ids[at:], texts[at:]


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(*of: str) -> Aligner:
    """One per worker process."""
    if of not in _ALIGNERS:
        _ALIGNERS[of] = Aligner(*of)
    return _ALIGNERS[of]


COUNTS = ("n_a", "n_b", "n_groups")
LISTS = pa.list_(pa.int64())


def write_chunks(docs: DataFrame, kind: str, vocabularies: tuple[str, str]) -> DataFrame:
    """Chunks of documents with their links, as a stored table.

    A row is a chunk: per document doc_id, counts, digest and number of distinct pairs
    (`n_pairs`); the pairs and their counts of all its documents on end (`doc_pair`,
    `doc_n`); the chunk's distinct pairs with counts (`pair`, `n`).
    """
    id_type = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "long"
    schema = pa.schema(
        [("chunk", pa.int64()), ("doc_id", pa.list_(pa.string() if id_type == "string" else pa.int64()))]
        + [(c, LISTS) for c in COUNTS]
        + [("digest", pa.list_(pa.string())), ("n_pairs", LISTS), ("doc_pair", LISTS), ("doc_n", LISTS), ("pair", LISTS), ("n", LISTS)]
    )

    def run(batches):
        made, rows, size, chunk = aligner(*vocabularies, kind), [], 0, 0
        part = TaskContext.get().partitionId()

        def close():
            pairs, n = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
            own, total = _sums(pairs, n)
            counts = np.stack([r[1] for r in rows])
            columns = [
                [(part << 32) + chunk],
                [[r[0] for r in rows]],
                *[[counts[:, k]] for k in range(3)],
                [[r[2].decode() for r in rows]],
                [[len(r[3]) for r in rows]],
                [pairs],
                [n],
                [own],
                [total],
            ]
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for ids, texts in _slices(batch):
                for doc_id, text, found in zip(ids, texts, made.read_all(texts), strict=True):
                    rows.append((doc_id, *found))
                    size += len(text or "")
                    if size >= CHUNK_BYTES or len(rows) == CHUNK_DOCS:
                        yield close()
                        rows, size, chunk = [], 0, chunk + 1
        if rows:
            yield close()

    lists = "".join(f"{c} array<long>, " for c in (*COUNTS,))
    columns = (
        f"chunk long, doc_id array<{id_type}>, {lists}digest array<string>, n_pairs array<long>, "
        "doc_pair array<long>, doc_n array<long>, pair array<long>, n array<long>"
    )
    path = scratch_path(docs.sparkSession, "chunks")
    docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text").mapInArrow(run, columns).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, total, best): links of each id pair in all documents; whether no pair of its B id has more."""
    own = chunks.select(F.explode(F.arrays_zip("pair", "n")).alias("p")).select("p.pair", "p.n")
    totals = own.groupBy("pair").agg(F.sum("n").alias("total"))
    b = F.col("pair") % B_IDS
    # At most one row for each A id: a B id has no more pairs than A has entries.
    top = totals.groupBy(b.alias("b")).agg(F.max("total").alias("top"))
    return totals.withColumn("b", b).join(top, "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def align_tokens(docs: DataFrame, kind: str = "end", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of `docs`.

    kind: which links are meant, 'end', 'overlap' or 'group'.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunks = write_chunks(docs, kind, vocabularies or default_vocabularies())
    path = scratch_path(docs.sparkSession, "pairs")
    pair_counts(chunks).write.parquet(path)
    totals = docs.sparkSession.read.parquet(path)
    asked = chunks.select("chunk", F.explode("pair").alias("pair"))
    # A chunk has no more pairs than its text has tokens.
    figures = asked.join(totals, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "total", "best")).alias("figures"))
    kept = chunks.drop("pair", "n").join(figures, "chunk", "left")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                known = row["figures"].values
                first = np.concatenate([[0], np.cumsum(row["n_pairs"].values.to_numpy())])
                links = best = count = np.zeros(len(first) - 1, dtype=np.int64)
                if known is not None and len(known):
                    pair = known.field("pair").to_numpy()
                    order = np.argsort(pair)
                    at = order[np.searchsorted(pair[order], row["doc_pair"].values.to_numpy())]
                    n = row["doc_n"].values.to_numpy()
                    sums = (n, n * known.field("best").to_numpy(zero_copy_only=False)[at], n * known.field("total").to_numpy()[at])
                    links, best, count = (np.diff(np.concatenate([[0], np.cumsum(s)])[first]) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_id"].values, *[row[c].values for c in COUNTS], *map(pa.array, (links, best, count)), row["digest"].values],
                    names,
                )

    names = ["doc_id", *COUNTS, "n_links", "n_best", "count_sum", "groups_sha256"]
    columns = "".join(f"{c} long, " for c in names[1:-1])
    stored = chunks.schema["doc_id"].dataType.elementType.simpleString()
    out = kept.mapInArrow(run, f"doc_id {stored}, {columns}groups_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
