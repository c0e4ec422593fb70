"""Suffix-array dedup: bytes covered by a 400-byte string that also begins elsewhere go.

One suffix array of everything cannot be held, so the work is cut into shards that can
miss no match:

1. Anchors. In each stretch of `LENGTH` bytes the gram of `GRAM` bytes with the smallest
   hash (the leftmost of equals) is its anchor. Two places that hold the same string
   choose the same anchor in it, so all matches of a string lie among the contexts of
   one anchor, where a context is what the strings that chose this place cover. A string
   is in one context only.
2. Anchors seen once are dropped. Contexts that are equal as a whole are repeated as a
   whole: one of them stands for all. Only anchors with different contexts go on.
3. Shards of about `SHARD_BYTES` take whole anchors. Contexts of one text that overlap
   become one piece, pieces are joined by a byte that UTF-8 does not have, the suffix
   array is made by induced sorting (`suffix_array`), and its permuted common prefixes
   tell which places begin a repeated string.
4. An anchor with more than `HOT` different contexts would make a shard too large. Its
   strings are counted by anchor, place and 64-bit hash instead, in a plain aggregation over all of them.
5. Every context hands its removed stretches to the places it stands for, they are
   united per text, and the text is cut.

Nothing is keyed by a text's id but by the hash of the text, so copies share one result;
joins back to a frequent text or context split under adaptive execution.

Defined cases: a null text is empty; texts shorter than 400 bytes stay whole; equal rows
of 400 bytes or more remove each other; the bytes kept need not be valid UTF-8, hence
`kept` is binary; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import textbytes as B
from kithgraph.llm.suffix_array import repeated_starts
from kithgraph.session import scratch_path

LENGTH = 400
GRAM = 32
SHARD_BYTES = 1_500_000
HOT = 6_000
JOINT = 0xFF  # in no UTF-8 text


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, place, hash, low, high) of the anchors of all texts, and the buffer's hasher.

    The strings of `length` bytes that have this anchor begin from low and end at high.
    """
    hasher = B.Hasher(data)
    h = hasher.windows(gram)
    width = length - gram + 1
    if len(h) < width:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, np.uint64), none, none, hasher
    # Hash and place in one number: the smallest is the leftmost of the smallest hashes.
    mark = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    rows = np.full(-(-len(h) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    rows[: len(h)] = mark
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    best = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    end = np.repeat(offsets[1:], np.diff(offsets))[:n]
    starts = np.flatnonzero(np.arange(n) + length <= end)
    place = (best[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    low, high = starts[new], starts[np.append(new[1:], True)[: len(new)]] + length
    place = place[new]
    return np.searchsorted(offsets, place, side="right") - 1, place, h[place], low, high, hasher


def anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(t1, t2, p, a, c, l, r): anchor a at byte p of a text, c the hash of its context,
    which has l bytes before p and r from p on."""

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                data, offsets = B.flat(part.column("text"))
                text, place, a, low, high, hasher = find_anchors(data, offsets, length, gram)
                c = B.mix(hasher.spans(low, high) + B.mix((place - low).astype(np.uint64) + np.uint64(1)))
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("t1").take(rows),
                        part.column("t2").take(rows),
                        pa.array((place - offsets[text]).astype(np.int32)),
                        pa.array(a.view(np.int64)),
                        pa.array(c.view(np.int64)),
                        pa.array((place - low).astype(np.int16)),
                        pa.array((high - place).astype(np.int16)),
                    ],
                    ["t1", "t2", "p", "a", "c", "l", "r"],
                )

    schema = "t1 long, t2 long, p int, a long, c long, l short, r short"
    return texts.select("t1", "t2", "text").mapInArrow(run, schema)


def cut_contexts(texts: DataFrame) -> DataFrame:
    """(t1, t2, p, a, c, l, hot, bytes) from texts with an array `spots` of their contexts."""

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                data, offsets = B.flat(part.column("text"))
                spots = part.column("spots")
                lists = spots.flatten()
                text = np.repeat(np.arange(part.num_rows), np.diff(spots.offsets.to_numpy()))
                place = lists.field("p").to_numpy() + offsets[text]
                low = place - lists.field("l").to_numpy()
                high = place + lists.field("r").to_numpy()
                raw = data.tobytes()
                cut = [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("t1").take(rows),
                        part.column("t2").take(rows),
                        lists.field("p"),
                        lists.field("a"),
                        lists.field("c"),
                        lists.field("l"),
                        lists.field("hot"),
                        pa.array(cut, pa.binary()),
                    ],
                    ["t1", "t2", "p", "a", "c", "l", "hot", "bytes"],
                )

    schema = "t1 long, t2 long, p int, a long, c long, l short, hot boolean, bytes binary"
    return texts.select("t1", "t2", "text", "spots").mapInArrow(run, schema)


def _stretches(starts: np.ndarray, length: int) -> list[int]:
    """Merged [from, to, ...] of the strings that begin at the sorted `starts`."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    low = starts[np.append(0, gap + 1)]
    high = starts[np.append(gap, len(starts) - 1)] + length
    return np.stack([low, high], axis=1).ravel().tolist()


def sort_shard(length: int):
    """Over the contexts of a shard: (a, c, cut), the stretches each loses, relative to its anchor."""

    def run(table: pa.Table) -> pa.Table:
        t1, t2 = table.column("t1").to_numpy(), table.column("t2").to_numpy()
        low = table.column("p").to_numpy().astype(np.int64) - table.column("l").to_numpy()
        parts = table.column("bytes").to_pylist()
        size = np.array([len(x) for x in parts], dtype=np.int64)
        order = np.lexsort((low, t2, t1))
        # Overlapping contexts of a text are one piece; `base` is where a context is in the shard.
        base = np.zeros(len(parts), dtype=np.int64)
        pieces: list[bytes] = []
        at = 0
        here, reach = None, 0
        for i in order.tolist():
            key = (t1[i], t2[i])
            if key == here and low[i] <= reach:
                base[i] = start + low[i] - begin
                new = parts[i][reach - low[i] :]
            else:
                pieces.append(bytes([JOINT]))
                at += 1
                here, begin, start, reach = key, low[i], at, low[i]
                base[i] = at
                new = parts[i]
            if new:
                pieces.append(new)
                at += len(new)
                reach = low[i] + size[i]
        found = np.flatnonzero(repeated_starts(np.frombuffer(b"".join(pieces), dtype=np.uint8), length))
        before = table.column("l").to_numpy().astype(np.int64)
        first = np.searchsorted(found, base)
        last = np.searchsorted(found, base + size - length, side="right")
        cuts = [
            _stretches(found[a:b] - base[i] - before[i], length) if b > a else []
            for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True))
        ]
        return pa.table(
            {"a": table.column("a"), "c": table.column("c"), "cut": pa.array(cuts, pa.list_(pa.int32()))}
        )

    return run


def hash_strings(contexts: DataFrame, length: int) -> DataFrame:
    """(a, c, s, w): every string of `length` bytes in a context by hash, s its start relative
    to the anchor, which is the same wherever the string is."""

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "bytes", B.SLICE_BYTES // 8):
                raw = part.column("bytes")
                text = pa.Array.from_buffers(pa.string(), len(raw), [None, *raw.buffers()[1:]], offset=raw.offset)
                data, offsets = B.flat(text)
                strings = B.Hasher(data).windows(length)
                owner = np.repeat(np.arange(len(raw)), np.diff(offsets))[: len(strings)]
                before = part.column("l").to_numpy().astype(np.int64)
                place = np.arange(len(strings))
                start = place - offsets[owner]
                ok = np.flatnonzero(place + length <= offsets[owner + 1])
                rows = pa.array(owner[ok])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("a").take(rows),
                        part.column("c").take(rows),
                        pa.array((start[ok] - before[owner[ok]]).astype(np.int16)),
                        pa.array(strings[ok].view(np.int64)),
                    ],
                    ["a", "c", "s", "w"],
                )

    return contexts.select("a", "c", "l", "bytes").mapInArrow(run, "a long, c long, s short, w long")


def _count_strings(contexts: DataFrame, length: int) -> DataFrame:
    """The same as sort_shard for the contexts of hot anchors, by hash."""
    strings = hash_strings(contexts, length)
    twice = strings.groupBy("a", "s", "w").count().filter("count > 1").select("a", "s", "w")
    starts = strings.join(twice, ["a", "s", "w"]).groupBy("a", "c").agg(F.array_sort(F.collect_set("s")).alias("s"))

    def run(batches):
        for batch in batches:
            cuts = [_stretches(np.array(x, dtype=np.int64), length) for x in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("c"), pa.array(cuts, pa.list_(pa.int32()))], ["a", "c", "cut"]
            )

    return starts.mapInArrow(run, "a long, c long, cut array<int>")


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(t1, t2, spans): per text the stretches [from, to, ...] to remove, not yet united.

    `texts` has t1, t2 (hash of the text), doc and text.
    """
    spark = texts.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    found = stored(anchors(texts, length, gram), "anchors")
    # Stored, so that the join below has two plain sides and a frequent anchor is split.
    shared = stored(
        found.groupBy("a")
        .agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        .filter("n > 1")
        .select("a", (F.col("c0") != F.col("c1")).alias("differ")),
        "anchors-shared",
    )
    hits = stored(found.join(shared, "a"), "anchor-hits")
    contexts = stored(
        hits.groupBy("a", "c").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("t1", "t2", "p")).alias("at"),
            F.first("l").alias("l"),
            F.first("r").alias("r"),
            F.first("differ").alias("differ"),
        ),
        "contexts",
    )
    open_ones = contexts.filter(F.col("differ"))
    sizes = open_ones.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot).select("a")
    sizes = sizes.withColumn("hot", F.lit(True))
    spots = (
        open_ones.join(sizes, "a", "left")
        .select("at.t1", "at.t2", F.struct("at.p", "l", "r", "a", "c", F.coalesce("hot", F.lit(False)).alias("hot")).alias("spot"))
        .groupBy("t1", "t2")
        .agg(F.collect_list("spot").alias("spots"))
    )
    # One document for each text, so that a frequent text is cut once.
    one = texts.groupBy("t1", "t2").agg(F.min("doc").alias("doc"))
    pieces = stored(cut_contexts(texts.join(spots.join(one, ["t1", "t2"]), ["t1", "t2", "doc"])), "pieces")
    total, any_hot = pieces.agg(
        F.coalesce(F.sum(F.when(~F.col("hot"), F.length("bytes"))), F.lit(0)), F.max("hot")
    ).first()
    shards = max(1, -(-total // shard_bytes))
    cold = pieces.filter(~F.col("hot")).withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
    cuts = cold.groupBy("shard").applyInArrow(sort_shard(length), "a long, c long, cut array<int>")
    if any_hot:
        cuts = cuts.unionByName(_count_strings(pieces.filter("hot"), length))
    whole = F.array((-F.col("l")).cast("int"), F.col("r").cast("int"))
    cuts = (
        contexts.select("a", "c", "n", "l", "r")
        .join(cuts, ["a", "c"], "left")
        .withColumn("cut", F.when(F.col("n") > 1, whole).otherwise(F.col("cut")))
        .filter(F.size("cut") > 0)
        .groupBy("a", "c")
        .agg(F.first("cut").alias("cut"))
    )
    cuts = stored(cuts, "anchor-cuts")  # again so that the join has two plain sides
    placed = hits.select("t1", "t2", "p", "a", "c").join(cuts, ["a", "c"])
    moved = F.transform("cut", lambda x: x + F.col("p"))
    return placed.groupBy("t1", "t2").agg(F.flatten(F.collect_set(moved)).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """(doc_id, kept as binary, n_bytes, n_removed, n_spans) for each row of `docs` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(
        "doc_id",
        text.alias("text"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"),
    )
    spans = repeated_spans(texts.drop("doc_id"), length, **limits)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                data, offsets = B.flat(part.column("text"))
                kept, removed, n_spans = [], [], []
                for i, edges in enumerate(part.column("spans")):
                    own = data[offsets[i] : offsets[i + 1]]
                    edges = edges.values
                    if edges is None or not len(edges):
                        kept.append(own.tobytes())
                        removed.append(0)
                        n_spans.append(0)
                        continue
                    e = edges.to_numpy().reshape(-1, 2)
                    step = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(step, e[:, 0], 1)
                    np.add.at(step, e[:, 1], -1)
                    gone = np.cumsum(step)[:-1] > 0
                    kept.append(own[~gone].tobytes())
                    removed.append(int(gone.sum()))
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(kept, pa.binary()),
                        pa.array(np.diff(offsets)),
                        pa.array(removed, pa.int64()),
                        pa.array(n_spans, pa.int64()),
                    ],
                    ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
                )

    return (
        texts.join(spans, ["t1", "t2"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
