"""Benchmark decontamination by a generalised suffix automaton over words.

The test items, normalised to words, make one automaton per block of items (`BLOCK_WORDS`
words at most, so what travels to the tasks is bounded; more items make more blocks, and
the documents pass through all of them in one scan). A document is streamed through the
automaton and the longest match ending at each word is tracked. Where it reaches a window
(10 words, or a whole shorter item) those words are hit. Words that no item contains end
every match, so only stretches of known words are walked.

Defined cases: null or empty texts have no words; a null item is no item, a null
item_id an empty one; equal items
both count; an empty benchmark hits nothing; an empty document table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import textbytes as B

WINDOW = 10
BLOCK_WORDS = 500_000
WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(column: pa.Array):
    """(hashes, starts, ends, first) of the lower-cased words of each text."""
    data, offsets = B.flat(column)
    data = B.LOWERED[data]
    starts, ends, first = B.words(data, offsets, WORD_BYTES)
    return B.Hasher(data).spans(starts, ends), starts, ends, first


class Automaton:
    """Generalised suffix automaton of items given as lists of word numbers.

    After `finish`, `whole[s]` has for state s the items whose window ends there: those
    that contain the last WINDOW words, by way of the state that holds just these words.
    `short[s]` has the items shorter than WINDOW that end there, as (length, item).
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.of: list[set[int]] = [set()]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.of.append(set())
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item has this prefix
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return new

    def add(self, item: list[int]) -> None:
        last = 0
        for c in item:
            last = self._extend(last, c)

    def finish(self, items: list[list[int]], window: int) -> None:
        """Fill `whole` and `short` once all items are in."""
        self.whole: list[tuple[int, ...]] = [()] * len(self.len)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        own: dict[int, list[tuple[int, int]]] = {}
        holder: dict[int, set[int]] = {}
        for i, item in enumerate(items):
            s = 0
            for n, c in enumerate(item, 1):
                s = self.next[s][c]
                if n >= window:
                    holder.setdefault(self.at_length(s, window), set()).add(i)
            if 0 < len(item) < window:
                own.setdefault(s, []).append((len(item), i))
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            up = self.short[self.link[s]] if s else ()
            self.short[s] = up + tuple(own.get(s, ()))
            if self.len[s] >= window:
                self.whole[s] = tuple(holder.get(self.at_length(s, window), ()))

    def at_length(self, s: int, length: int) -> int:
        """The state of the last `length` words of what s holds."""
        while s > 0 and self.len[self.link[s]] >= length:
            s = self.link[s]
        return s


class Block:
    """One automaton with what is needed to stream documents through it."""

    def __init__(self, ids: list[str], hashes: list[np.ndarray], window: int):
        self.window, self.ids = window, ids
        known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        items = [np.searchsorted(known, h).tolist() for h in hashes]
        self.known = known
        self.least = min((min(len(x), window) for x in items if x), default=0)
        self.automaton = Automaton()
        for item in items:
            self.automaton.add(item)
        self.automaton.finish(items, window)

    def walk(self, word_ids: list[int], hit: np.ndarray, found: set[int]) -> None:
        """Mark in `hit` the words of one stretch that lie in a window, collect the items."""
        a, window = self.automaton, self.window
        s = length = 0
        for i, c in enumerate(word_ids):
            while s and c not in a.next[s]:
                s = a.link[s]
                length = a.len[s]
            if c in a.next[s]:
                s = a.next[s][c]
                length += 1
            if length >= window and a.whole[a.at_length(s, window)]:
                hit[i + 1 - window : i + 1] = True
                found.update(a.whole[a.at_length(s, window)])
            for n, item in a.short[s]:
                if n <= length:
                    hit[i + 1 - n : i + 1] = True
                    found.add(item)

    def scan(self, h: np.ndarray, first: np.ndarray, hit: np.ndarray, found: list[set[str]]) -> None:
        """Add this block's hits and items for all texts of a slice."""
        if not len(self.known) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        inside = self.known[at] == h
        starts, ends = B.runs(inside, first)
        long_enough = ends - starts >= self.least
        starts, ends = starts[long_enough], ends[long_enough]
        text = np.searchsorted(first, starts, side="right") - 1
        for a, b, t in zip(starts.tolist(), ends.tolist(), text.tolist(), strict=True):
            items: set[int] = set()
            self.walk(at[a:b].tolist(), hit[a:b], items)
            found[t].update(self.ids[i] for i in items)


def blocks_of(benchmark: DataFrame, window: int, most: int = BLOCK_WORDS) -> list[Block]:
    """Automata over all items, each of about `most` words or one item."""
    spark = benchmark.sparkSession
    count = F.regexp_count(F.lower("text"), F.lit(WORD_PATTERN))
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    n = max(1, -(-total * 2 // most))  # half full on average, as items fall into blocks by hash
    out = []
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        rows = part.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").orderBy("item_id").collect()
        if rows:
            h, _, _, first = normal_words(pa.array([r.text for r in rows], pa.string()))
            hashes = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            out.append(spark.sparkContext.broadcast(Block([r.item_id for r in rows], hashes, window)))
    return out


def spans(hit: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.ndarray):
    """For each text the byte ranges of its hit words, as flat [start, end, ...]."""
    a, b = B.runs(hit, first)
    text = np.searchsorted(first, a, side="right") - 1
    flat = np.stack([starts[a] - base[text], ends[b - 1] - base[text]], axis=1).reshape(-1)
    at = np.searchsorted(a, first) * 2
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int64)))


def scan_slice(column: pa.Array, blocks: list):
    """(n_words, n_hit, item ids, hit byte ranges) of each text."""
    h, starts, ends, first = normal_words(column)
    hit = np.zeros(len(h), dtype=bool)
    found: list[set[str]] = [set() for _ in range(len(column))]
    for block in blocks:
        block.value.scan(h, first, hit, found)
    _, offsets = B.flat(column)
    return np.diff(first), B.sums_by(hit, first), found, spans(hit, first, starts, ends, offsets)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs' doc_id and text with n_words, n_hit, items (sorted ids) and hit byte ranges."""
    blocks = blocks_of(benchmark, window)
    docs = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                n_words, n_hit, found, hits = scan_slice(part.column("text"), blocks)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(n_words),
                        pa.array(n_hit),
                        pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                        hits,
                    ],
                    [*part.schema.names, "n_words", "n_hit", "items", "hits"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, n_words long, n_hit long, items array<string>, hits array<long>")


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_hit: float = 0.5
) -> DataFrame:
    """`docs` without their hit stretches; documents hit in more than `most_hit` of their words go.

    What is left on both sides of a cut is joined by a line break. Documents without hits
    stay as they are; `n_chars`, if there is one, follows the text where it was cut.
    """
    blocks = blocks_of(benchmark, window)
    names = docs.columns

    def cut(text: str, edges: list[int]) -> str:
        raw = text.encode()
        edges = [0, *edges, len(raw)]
        parts = [raw[a:b].decode().strip() for a, b in zip(edges[::2], edges[1::2], strict=True)]
        return "\n".join(x for x in parts if x)

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                n_words, n_hit, _, hits = scan_slice(part.column("text"), blocks)
                stay = np.flatnonzero((n_hit == 0) | (n_hit <= most_hit * n_words))
                part, changed = part.take(pa.array(stay)), np.flatnonzero(n_hit[stay] > 0).tolist()
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                if changed:
                    texts = part.column("text").to_pylist()
                    edges = hits.take(pa.array(stay)).to_pylist()
                    sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
                    for i in changed:
                        texts[i] = cut(texts[i], edges[i])
                        if sizes:
                            sizes[i] = len(texts[i])
                    columns["text"] = pa.array(texts, columns["text"].type)
                    if sizes:
                        columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.mapInArrow(run, docs.schema)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), i AS (
  SELECT item_id::varchar AS item, w, least({WINDOW}, len(w)) AS m
  FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS gram
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM i)
), o AS (
  SELECT r, k, m, array_to_string(w[k:k + m - 1], ' ') AS gram
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM g))
), f AS (
  SELECT r, k, m, item FROM o JOIN g USING (m, gram)
), h AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + m)) AS p FROM f) GROUP BY r
), t AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
