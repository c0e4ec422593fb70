"""Ranked lexical search: best-first document intervals bounded by range-maximum tables.

Documents are indexed in segments of at most `SEGMENT_DOCS` rows or about
`SEGMENT_POSTINGS` postings, each a row of a stored table: its documents in ascending
doc_id order and, per term, a posting list of places and frequencies. Only terms that a
query may hold are kept; a bitmap of fixed size tells them apart, and what its collisions
let through meets no query. Corpus figures (documents, terms, document frequencies) are
sums over the segments.

A segment answers queries with a sparse table of range maxima over its posting lists: the
sum of a query's maxima in an interval of documents bounds every score there. The best
intervals are split first, at the document of the largest impact, which is scored exactly;
the bounds of both halves follow from the same tables. An interval goes when its bound
cannot reach the k-th best score found so far, equal scores by doc_id. Two rounds of this
over all segments give every query a score that k documents reach; the full search
starts from it, so the more documents there are, the fewer intervals a segment opens.

Queries come in blocks of about `BLOCK_TERMS` terms, one search over the stored segments
each; only a block and its thresholds are broadcast. Terms are compared by 64-bit hashes.

Defined cases: a null or empty text has no terms; a query without terms, or whose terms
no document has, gets no rows; the rows of one item id are one query of all their terms,
and a null id is an id; every row of `docs` is a document, so a repeated row may fill
several ranks; a null doc_id comes last among equals; empty tables give no rows; columns
besides the ids and texts are not read. A text above 2 MB is read in parts cut between
terms, so the memory of a task does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.llm import textbytes as B
from kithgraph.session import scratch_path

SEGMENT_DOCS = 4096
SEGMENT_POSTINGS = 400_000
BITMAP_BITS = 24
BLOCK_TERMS = 200_000
QUERIES_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 20  # (interval, term) pairs in the arrays of one step
SEED_ROUNDS = 2
LAST = np.iinfo(np.int64).max  # stands for a null doc_id
INSIDE = ~B.table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first): text i has terms first[i] to first[i + 1]."""
    low = B.LOWERED[data]
    starts, ends, first = B.words(low, offsets, INSIDE)
    return B.Hasher(low).spans(starts, ends), first


def counted(column: pa.Array, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats, then text, term and frequency of the wanted terms)."""
    data, offsets = B.flat(column)
    total, held = np.zeros(len(column), dtype=np.int64), []
    for owner, part, at in B.blocks(data, offsets, ~INSIDE):
        h, first = terms(part, at)
        np.add.at(total, owner, np.diff(first))
        text = owner[B.owner(first)]
        if wanted is not None:
            keep = wanted[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
            h, text = h[keep], text[keep]
        held.append(summed(text, h, np.ones(len(h), dtype=np.int64)))
    if not held:
        return total, *(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64))
    return total, *summed(*(np.concatenate([x[k] for x in held]) for k in range(3)))


def summed(text: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) by term, then text, with the sums of n."""
    order = np.lexsort((text, term))
    text, term, n = text[order], term[order], n[order]
    if not len(n):
        return text, term, n
    at = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (term[1:] != term[:-1])]))
    return text[at], term[at], np.add.reduceat(n, at)


def query_terms(items: DataFrame, id_col: str) -> DataFrame:
    """Distinct (id, term) of the queries."""

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                _, text, term, _ = counted(part.column("text"), None)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(text)), pa.array(term.view(np.int64))], ["id", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, term long").distinct()


def bitmap(queries: DataFrame) -> np.ndarray:
    """True at the leading bits of a queried term; 2**BITMAP_BITS entries whatever the queries."""
    bit = F.shiftrightunsigned("term", 64 - BITMAP_BITS)
    words = queries.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - BITMAP_BITS}) & 63 as int))")).alias("bits")
    )
    made = words.toArrow()
    held = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    held[made.column("word").to_numpy()] = made.column("bits").to_numpy()
    return np.unpackbits(held.view(np.uint8), bitorder="little").astype(bool)


def write_segments(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The index as a stored table, a row for each segment."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        want = np.unpackbits(shared.value).astype(bool)
        held: list[tuple] = []
        for batch in batches:
            for part in B.slices(batch, "text"):
                total, text, term, n = counted(part.column("text"), want)
                held.append((part.column("doc_id"), total, text, term, n))
                if sum(len(x[1]) for x in held) >= SEGMENT_DOCS or sum(len(x[2]) for x in held) >= SEGMENT_POSTINGS:
                    yield segment(held)
                    held = []
        if held:
            yield segment(held)

    path = scratch_path(spark, "segments")
    columns = "n_docs long, n_terms long, doc_id array<long>, size array<long>, term array<long>, df array<long>, place array<int>, tf array<long>"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, columns).write.parquet(path)
    shared.unpersist()
    return spark.read.parquet(path)


def segment(held: list[tuple]) -> pa.RecordBatch:
    """One row from slices of documents: places are ranks in ascending doc_id order, of documents with postings."""
    start = np.cumsum([0, *(len(x[1]) for x in held)])
    size = np.concatenate([x[1] for x in held])
    ids = pa.concat_arrays([x[0] for x in held])
    text = np.concatenate([x[2] + s for x, s in zip(held, start[:-1], strict=True)])
    term, n = (np.concatenate([x[k] for x in held]) for k in (3, 4))
    used = np.unique(text)
    known = ids.fill_null(LAST).to_numpy()[used]
    order = np.lexsort((used, known))
    place = np.zeros(len(size), dtype=np.int64)
    place[used[order]] = np.arange(len(used))
    at, term, n = summed(place[text], term, n)
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    row = {
        "n_docs": [int((size > 0).sum())],
        "n_terms": [int(size.sum())],
        "doc_id": [ids.take(pa.array(used[order]))],
        "size": [size[used[order]]],
        "term": [term[first].view(np.int64)],
        "df": [np.diff(np.append(first, len(term)))],
        "place": [at.astype(np.int32)],
        "tf": [n],
    }
    types = {"n_docs": pa.int64(), "n_terms": pa.int64(), "place": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(v, type=types.get(k, pa.list_(pa.int64()))) for k, v in row.items()], list(row))


class Block:
    """A block of queries: ids, sorted distinct terms with weights, and each query's terms as numbers of those."""

    def __init__(self, made: pa.Table, documents: int, length: int):
        ids, self.documents, self.length = made.column("id").combine_chunks(), documents, length
        self.ids = ids.unique()
        query = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        self.terms, number = np.unique(made.column("term").to_numpy().view(np.uint64), return_inverse=True)
        df = np.zeros(len(self.terms), dtype=np.int64)
        df[number] = made.column("df").to_numpy()
        self.weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        order = np.argsort(query, kind="stable")
        self.number = number[order]
        self.first = np.searchsorted(query[order], np.arange(len(self.ids) + 1))


class Segment:
    """Posting lists of the terms that a block asks for, with impacts and range maxima."""

    def __init__(self, row: dict, block: Block):
        term = row["term"].values.to_numpy().view(np.uint64)
        df = row["df"].values.to_numpy()
        number = np.searchsorted(block.terms, term)
        asked = block.terms[np.minimum(number, len(block.terms) - 1)] == term
        posting = np.repeat(asked, df)
        self.place = row["place"].values.to_numpy()[posting].astype(np.int64)
        tf = row["tf"].values.to_numpy()[posting]
        ids = row["doc_id"].values
        self.ids = ids.fill_null(LAST).to_numpy()
        size = row["size"].values.to_numpy()
        if len(size) and int(size.max()) * 90 * block.documents > LAST:
            size = size.astype(object)
        m = (10 + 90 * size * block.documents // max(block.length, 1)).astype(np.int64)
        self.number, df = number[asked], df[asked]
        self.impact = np.repeat(block.weights[self.number], df) * (10**9 * tf // (1000 * tf + 8 * m[self.place]))
        self.width = len(self.ids) + 1
        self.key = np.repeat(np.arange(len(df)), df) * self.width + self.place
        levels = max(int(df.max(initial=1)).bit_length(), 1)
        self.best = np.zeros((levels, len(self.place)), dtype=np.int32)  # place of the maximum of 2**level postings
        self.best[0] = np.arange(len(self.place))
        for j in range(1, levels):
            half = 1 << (j - 1)
            left, right = self.best[j - 1, :-half], self.best[j - 1, half:]
            self.best[j, :-half] = np.where(self.impact[right] > self.impact[left], right, left)
            self.best[j, -half:] = self.best[j - 1, -half:]

    def lists_of(self, block: Block, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posting lists, first) of the given queries here."""
        local = np.full(len(block.terms), -1)
        local[self.number] = np.arange(len(self.number))
        fan = block.first[queries + 1] - block.first[queries]
        lists = local[block.number[_ranges(block.first[queries], fan)]]
        query = np.repeat(np.arange(len(queries)), fan)[lists >= 0]
        return lists[lists >= 0], np.searchsorted(query, np.arange(len(queries) + 1))

    def maxima(self, a: np.ndarray, b: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(bound, document of the largest impact) of n intervals from their postings [a, b); `of` ascends."""
        full = b > a
        a, b, of = a[full], b[full], of[full]
        bound, split = np.zeros(n, dtype=np.int64), np.full(n, -1)
        if len(a):
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            left, right = self.best[level, a], self.best[level, b - (1 << level)]
            at = np.where(self.impact[right] > self.impact[left], right, left)
            value = self.impact[at]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            bound[of[first]] = np.add.reduceat(value, first)
            top = np.zeros(n, dtype=np.int64)
            top[of[first]] = np.maximum.reduceat(value, first)
            hit = np.flatnonzero(value == top[of])
            split[of[hit[::-1]]] = self.place[at[hit[::-1]]]  # the first hit of each is written last
        return bound, split

    def search(self, block: Block, queries: np.ndarray, best: Best, rounds: int | None) -> None:
        """Offer `best` the documents of this segment that may be among the queries' best."""
        lists, first = self.lists_of(block, queries)
        n = len(queries)
        of = np.repeat(np.arange(n), np.diff(first))
        low = np.zeros(n, dtype=np.int64)
        bound, split = self.maxima(
            np.searchsorted(self.key, lists * self.width), np.searchsorted(self.key, (lists + 1) * self.width), of, n
        )
        work = np.stack([np.arange(n), low, low + self.width - 1, bound, split])
        while True:
            work = work[:, work[3] > 0]
            work = work[:, best.may_enter(queries[work[0]], work[3], self.ids[work[1]])]
            if not work.shape[1] or rounds == 0:
                return
            rounds = None if rounds is None else rounds - 1
            work = work[:, np.lexsort((work[1], -work[3], work[0]))]
            start = np.searchsorted(work[0], np.arange(n + 1))
            rank = np.arange(work.shape[1]) - start[work[0]]
            now = rank < np.maximum(4, (np.diff(start) // 4)[work[0]])
            fan = np.cumsum(np.diff(first)[work[0]] * now)
            now &= (fan <= PAIRS_AT_ONCE) | (np.cumsum(now) == 1)
            work, later = work[:, now], work[:, ~now]
            halves = self.split(work, lists, first, queries, best)
            work = np.concatenate([later, *halves], axis=1)

    def split(self, work: np.ndarray, lists: np.ndarray, first: np.ndarray, queries: np.ndarray, best: Best):
        """Score the splitting documents exactly; the intervals before and after them with their bounds."""
        query, low, high, _, doc = work
        fan = np.diff(first)[query]
        of = np.repeat(np.arange(len(query)), fan)
        base = lists[_ranges(first[query], fan)] * self.width
        a, b = np.searchsorted(self.key, base + low[of]), np.searchsorted(self.key, base + high[of])
        p = np.searchsorted(self.key, base + doc[of])
        here = self.key[np.minimum(p, len(self.key) - 1)] == base + doc[of]
        total = np.concatenate([[0], np.cumsum(np.where(here, self.impact[np.minimum(p, len(self.key) - 1)], 0))])
        ends = np.cumsum(fan)
        best.offer(queries[query], total[ends] - total[ends - fan], self.ids[doc])
        for from_, to, x, y in ((a, p, low, doc), (p + here, b, doc + 1, high)):
            bound, split = self.maxima(from_, to, of, len(query))
            yield np.stack([query, x, y, bound, split])[:, bound > 0]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


class Best:
    """The k best (score, doc_id) of each query so far, and what a document has to reach."""

    def __init__(self, n: int, k: int, floor: tuple[np.ndarray, np.ndarray]):
        self.n, self.k = n, k
        self.query = self.score = self.id = np.zeros(0, dtype=np.int64)
        self.least, self.least_id = (x.copy() for x in floor)

    def may_enter(self, query: np.ndarray, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        least = self.least[query]
        return (bound > least) | ((bound == least) & (first_id <= self.least_id[query]))

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = self.may_enter(query, score, ids)
        query, score, ids = (np.concatenate([x, y[good]]) for x, y in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        kth = np.flatnonzero(rank == self.k - 1)
        q, s, i = query[kth], score[kth], ids[kth]
        better = (s > self.least[q]) | ((s == self.least[q]) & (i < self.least_id[q]))
        self.least[q[better]], self.least_id[q[better]] = s[better], i[better]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Best k of each item, found in two steps so that no window holds more than a share of an item's rows."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    share = F.pmod(F.xxhash64("doc_id", "score", "task"), F.lit(64))
    some = found.withColumn("_share", share).withColumn("_r", F.row_number().over(Window.partitionBy("id", "_share").orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return some.filter(F.col("_r") <= k).select("id", "doc_id", "score").withColumn("rank", rank).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, id_col: str = "item_id", k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item id, rank, doc_id, score): the k best rows of `docs` (doc_id, text) for each id of `items` (id, text)."""
    spark = docs.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    path = scratch_path(spark, "queries")
    query_terms(items, id_col).write.parquet(path)
    queries = spark.read.parquet(path)
    segments = write_segments(docs, bitmap(queries))
    figures = segments.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    path = scratch_path(spark, "results")
    columns = f"id {kind}, doc_id long, score long, task int"
    if figures.n:
        df = segments.select(F.explode(F.arrays_zip("term", "df")).alias("t")).groupBy("t.term").agg(F.sum("t.df").alias("df"))
        stored = scratch_path(spark, "asked")
        queries.join(df, "term").write.parquet(stored)
        asked = spark.read.parquet(stored)
        blocks = -(-asked.count() // block_terms)
        for b in range(blocks):
            part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "term", "df").toArrow()
            if not part.num_rows:
                continue
            block = spark.sparkContext.broadcast(Block(part, figures.n, figures.l))
            n = len(block.value.ids)
            floor = np.ones(n, dtype=np.int64), np.full(n, LAST)
            seeds = ranked(search_segments(segments, block, floor, k, SEED_ROUNDS, columns, by_number=True), k)
            for row in seeds.filter(F.col("rank") == k).collect():  # one row a query of the block
                floor[0][row.id], floor[1][row.id] = row.score, LAST if row.doc_id is None else row.doc_id
            search_segments(segments, block, floor, k, None, columns).write.mode("append").parquet(path)
            block.unpersist()
        found = spark.read.schema(columns).parquet(path) if blocks else spark.createDataFrame([], columns)
    else:
        found = spark.createDataFrame([], columns)
    return ranked(found, k).select(F.col("id").alias(id_col), "rank", "doc_id", "score")


def search_segments(segments: DataFrame, block, floor, k: int, rounds: int | None, columns: str, by_number: bool = False) -> DataFrame:
    """Each task's k best documents for the queries of a block; queries by number or by id."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        asked = block.value
        best = Best(len(asked.ids), k, floor)
        for batch in batches:
            for row in range(batch.num_rows):
                seg = Segment({c: batch.column(c)[row] for c in batch.schema.names}, asked)
                if not len(seg.key):
                    continue
                for a in range(0, len(asked.ids), QUERIES_AT_ONCE):
                    seg.search(asked, np.arange(a, min(a + QUERIES_AT_ONCE, len(asked.ids))), best, rounds)
        name = pa.array(best.query) if by_number else asked.ids.take(pa.array(best.query))
        ids = pa.array(best.id, mask=best.id == LAST)
        task = pa.array(np.full(len(best.id), TaskContext.get().partitionId(), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([name, ids, pa.array(best.score), task], ["id", "doc_id", "score", "task"])

    out = columns if not by_number else "id long, doc_id long, score long, task int"
    return segments.drop("n_docs", "n_terms").mapInArrow(run, out)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, translate(text, '{UPPER}', '{LOWER}') AS text FROM documents),
words AS (SELECT r, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM words GROUP BY r, term),
size AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf CROSS JOIN total WHERE term IN (SELECT term FROM asked) GROUP BY term
),
impact AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS x
  FROM tf JOIN weight USING (term) JOIN size USING (r) CROSS JOIN total
),
scored AS (
  SELECT item_id, r, sum(x)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY item_id, r HAVING sum(x) > 0
),
placed AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank
  FROM scored JOIN docs USING (r)
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
