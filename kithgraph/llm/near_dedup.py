"""MinHash near-dedup with an LSH forest: sorted signature orders, neighbours as candidates.

1. Every text becomes its set of word shingles (64-bit hashes), a MinHash signature of
   `TREES` x `DEPTH` numbers and a sketch of two bits of each. Equal sets collapse to one
   representative (128-bit hash of the set), so a group of copies of any size is one row.
2. Each tree orders the representatives by its `DEPTH` numbers. Neighbours in a sorted
   order share the longest prefixes, so a row is compared with the rows next to it as long
   as they share `LEAST_PREFIX` numbers: in a sparse region that reaches back to short
   prefixes, in a dense one only to long ones. The sort is by range with the id as last
   key, so no key, however frequent, sits in one task; rows at the borders of partitions
   go out as well and are paired in a second, small sort.
3. Candidates whose sizes cannot reach the threshold or whose sketches are far from it
   are left out. The rest is confirmed on the full sets, in two rounds: first the best
   partner of each row, then whatever still lies between different components.
4. A row whose window ends while the next row still shares `LEAST_PREFIX` numbers is in a
   dense region; what the windows may have left there is settled exactly. Shingles are put
   in one order, rare ones first, and two rows of different components become a pair if
   they meet in the first shingles, of which sets that reach the threshold share one, and
   if enough shingles follow on both sides. These pairs are confirmed on the full sets, too.
5. Components by stars within one task for few links, by alternating large-star and
   small-star rounds for more.

Defined cases: a text without words has an empty set and is linked to nothing; fewer
words than a shingle has make one shingle of the whole sequence; a null doc_id ranks after all others
(its component_id is null if nothing smaller is reachable). Rows are linked by a node, the
64-bit hash of doc_id and text, so different texts under one doc_id, or under none, are
separate; ids come in again with the result. Of rows with the smallest doc_id of a group
the one with the smallest node is kept. Equal rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.llm import textbytes as B
from kithgraph.operators.components import stored_components
from kithgraph.operators.skew import attach
from kithgraph.session import cut_lineage, scratch_path

WIDTH = 5
THRESHOLD = 80  # per cent
TREES, DEPTH = 16, 8
LEAST_PREFIX = 2
NEIGHBOURS = 3  # rows on each side of a row in each order
PAIRS_PER_FILE = 4_000
ORDER_ROWS = 4_000  # rows that the order of the shingles is taken from; any order gives the same links
ORDER_SHINGLES = 100_000
SALTED = 50_000  # a shingle of more rows is met in several tasks
MOST_SALTS = 16
SHORT_RUN = 32
SLICE_BYTES = B.SLICE_BYTES // 4  # of texts in hand at once; their hashes take some 40 times as much
SLACK = 0.19  # of the sketches' estimate, some five standard deviations at 0.8
LAST_ID = 2**63 - 1
SET = ["n_shingles", "s1", "s2"]  # what tells the sets of two texts apart
_MULTIPLIERS = (B.mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (B.mix(np.arange(1001, TREES * DEPTH + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
DENSE = -1.0
BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each text, sorted within the text."""
    data, offsets = B.flat(column)
    data = B.LOWERED[data]
    starts, ends, first = B.words(data, offsets)
    h = B.Hasher(data).spans(starts, ends)
    n = np.diff(first)
    full = np.flatnonzero(B.within(first, width))
    windows = B.shingles(h, width)[full] if len(full) else np.zeros(0, np.uint64)
    text = B.owner(first)[full]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):  # the whole sequence as one shingle, told apart by its length
        whole = np.zeros(len(few), dtype=np.uint64)
        for k in range(width - 1):
            has = n[few] > k
            whole[has] = B.mix(whole[has] * B.BASE + h[first[few[has]] + k])
        windows = np.concatenate([windows, B.mix(whole + n[few].astype(np.uint64))])
        text = np.concatenate([text, few])
    order = np.lexsort((windows, text))
    windows, text = windows[order], text[order]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (windows[1:] != windows[:-1]) | (text[1:] != text[:-1])
    windows, text = windows[new], text[new]
    return windows, np.searchsorted(text, np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, TREES * DEPTH) minima as big-endian 32-bit numbers; texts must not be empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.empty((len(first) - 1, TREES * DEPTH), dtype=">u4")
    step = 1 << 15  # texts are taken in runs that stay in cache
    cuts = np.unique(np.searchsorted(first, np.arange(0, len(low) + step, step)).clip(0, len(first) - 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part, at = low[first[a] : first[b]], first[a:b] - first[a]
        for k in range(TREES * DEPTH):
            v = part * _MULTIPLIERS[k] + _ADDENDS[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(13)
            out[a:b, k] = np.minimum.reduceat(v, at)
    return out


def _sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each number, packed."""
    low = sig.astype(np.uint32)
    return np.packbits(np.stack([low & 1, low >> 1 & 1], axis=2).reshape(len(sig), 2 * TREES * DEPTH).astype(np.uint8), axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a byte matrix."""
    width = rows.shape[1] * rows.dtype.itemsize
    raw = np.ascontiguousarray(rows).tobytes()
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(raw)]
    )


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """The inverse of `_binary` for a column without nulls."""
    start = column.offset * width
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[start : start + len(column) * width].reshape(-1, width)


def node_of(id_col: str) -> Column:
    """What a row is linked by; the null marks keep (1, null) and (null, ...) apart from other rows."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(id_col).isNull(), "text", F.col("text").isNull())


def summaries(docs: DataFrame, width: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, node, n_shingles, s1, s2, sig, sketch); texts without words have no sig."""

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text", SLICE_BYTES):
                hashes, first = shingle_sets(part.column("text"), width)
                n = np.diff(first)
                total = B.sums_by(hashes.view(np.int64), first)  # wraps, as is meant
                other = B.sums_by(B.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64), first)
                filled = np.flatnonzero(n > 0)
                sig = signatures(hashes, np.append(first[filled], len(hashes)))
                place = np.full(len(n), -1)
                place[filled] = np.arange(len(filled))
                take = pa.array(place, mask=place < 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("node"),
                        pa.array(n.astype(np.int64)),
                        pa.array(total),
                        pa.array(other),
                        _binary(sig.view(np.uint8).reshape(len(filled), 4 * TREES * DEPTH)).take(take),
                        _binary(_sketches(sig)).take(take),
                    ],
                    ["doc_id", "node", "n_shingles", "s1", "s2", "sig", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), node_of(id_col).alias("node"), "text")
    return rows.mapInArrow(run, "doc_id long, node long, n_shingles long, s1 long, s2 long, sig binary, sketch binary")


def _pairs(tree, key, node, size, sketch, threshold: int, neighbours: int, fresh: int = 0):
    """Candidates among rows in sorted order, of which those before `fresh` were paired before."""
    out = []
    n = len(node)
    for gap in range(1, neighbours + 1):
        a = np.arange(max(0, fresh - gap), n - gap) if n > gap else np.zeros(0, np.int64)
        if not len(a):
            continue
        b = a + gap
        same = (tree[a] == tree[b]) & (key[a, : 4 * LEAST_PREFIX] == key[b, : 4 * LEAST_PREFIX]).all(axis=1)
        same &= np.minimum(size[a], size[b]) * 100 >= threshold * np.maximum(size[a], size[b])
        a, b = a[same], b[same]
        differ = sketch[a] ^ sketch[b]
        either = (np.unpackbits(differ, axis=1).reshape(len(a), TREES * DEPTH, 2).any(axis=2)).sum(axis=1)
        estimate = 1 - either / (TREES * DEPTH) * 4 / 3
        near = estimate >= threshold / 100 - SLACK
        out.append((node[a[near]], node[b[near]], estimate[near]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dense(tree, key, node, neighbours: int) -> np.ndarray:
    """The nodes in stretches of more rows with one prefix than `neighbours` reach over."""
    gap = neighbours + 1
    a = np.arange(max(0, len(node) - gap))
    same = (tree[a] == tree[a + gap]) & (key[a, : 4 * LEAST_PREFIX] == key[a + gap, : 4 * LEAST_PREFIX]).all(axis=1)
    return np.unique(node[B.cover(len(node), a[same], gap + 1)])


def _sweep(threshold: int, neighbours: int, edges: bool):
    """Over rows in sorted order: candidate pairs, and with `edges` the first and last rows.

    A row of a dense region is a pair with itself and the estimate `DENSE`. Without `edges`
    the rows are those from the borders, where all of two borders are paired.
    """
    reach = neighbours + 1 if edges else 2 * (neighbours + 1)

    def rows_of(batch: pa.RecordBatch):
        return (
            batch.column("tree").to_numpy(),
            _bytes(batch.column("key"), 4 * DEPTH),
            batch.column("node").to_numpy(),
            batch.column("size").to_numpy(),
            _bytes(batch.column("sketch"), TREES * DEPTH // 4),
        )

    def result(a, b, estimate, border=None):
        m, k = len(a), 0 if border is None else len(border[0])
        pad = lambda x, kind: pa.concat_arrays([x, pa.nulls(k, kind)])
        tail = lambda x, kind: pa.concat_arrays([pa.nulls(m, kind), x]) if k else pa.nulls(m, kind)
        tree, key, node, size, sketch = border if k else (None,) * 5
        return pa.RecordBatch.from_arrays(
            [
                pad(pa.array(np.minimum(a, b)), pa.int64()),
                pad(pa.array(np.maximum(a, b)), pa.int64()),
                pad(pa.array(estimate, pa.float64()), pa.float64()),
                tail(pa.array(tree, pa.int32()) if k else None, pa.int32()),
                tail(_binary(key) if k else None, pa.binary()),
                tail(pa.array(node, pa.int64()) if k else None, pa.int64()),
                tail(pa.array(size, pa.int64()) if k else None, pa.int64()),
                tail(_binary(sketch) if k else None, pa.binary()),
            ],
            ["a", "b", "estimate", "tree", "key", "node", "size", "sketch"],
        )

    def run(batches):
        kept, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            now = rows_of(batch)
            rows = now if kept is None else tuple(np.concatenate([x, y]) for x, y in zip(kept, now, strict=True))
            fresh = 0 if kept is None else len(kept[0])
            head = tuple(x[:reach] for x in now) if edges and not begun else None
            begun = True
            a, b, estimate = _pairs(*rows, threshold, neighbours if edges else reach, fresh)
            many = _dense(*rows[:3], neighbours)
            marks = np.full(len(many), DENSE)
            yield result(np.concatenate([a, many]), np.concatenate([b, many]), np.concatenate([estimate, marks]), head)
            kept = tuple(x[-reach:].copy() for x in rows)
        if edges and kept is not None:
            none = np.zeros(0, np.int64)
            yield result(none, none, np.zeros(0), kept)

    return run


_SWEPT = "a long, b long, estimate double, tree int, key binary, node long, size long, sketch binary"


def candidates(
    reps: DataFrame, threshold: int = THRESHOLD, neighbours: int = NEIGHBOURS
) -> tuple[DataFrame, DataFrame]:
    """(a, b, estimate), a < b: rows that are neighbours in one of the sorted orders; (node): rows of dense regions."""
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    rows = reps.select(
        F.explode(trees).alias("tree"), "sig", "node", F.col("n_shingles").alias("size"), "sketch"
    ).select("tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("key"), "node", "size", "sketch")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "key", "node"]
    swept = (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_sweep(threshold, neighbours, True), _SWEPT)
    )
    path = scratch_path(reps.sparkSession, "forest")
    swept.write.parquet(path)
    swept = reps.sparkSession.read.parquet(path)
    # A few rows from each border of a partition: their number follows the partitions, not the rows.
    border = swept.filter("node is not null").select(*order, "size", "sketch").distinct()
    across = (
        border.repartitionByRange(max(1, min(TREES, parts // 64)), "tree")
        .sortWithinPartitions(*order)
        .mapInArrow(_sweep(threshold, neighbours, False), _SWEPT)
        .select("a", "b", "estimate")
    )
    both = swept.filter("a is not null").select("a", "b", "estimate").unionByName(cut_lineage(across))
    pairs = both.filter("a <> b").groupBy("a", "b").agg(F.max("estimate").alias("estimate"))
    return pairs, both.filter(F.col("estimate") == DENSE).select(F.col("a").alias("node")).distinct()


def stored_texts(docs: DataFrame, pairs: DataFrame, dense: DataFrame) -> DataFrame:
    """(node, text, paired, crowded) of the nodes in `pairs` and `dense`, written once.

    All later steps read these rows, so the texts of all documents are shuffled once only.
    """
    none, yes = F.lit(False), F.lit(True)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), yes.alias("paired"), none.alias("crowded"))
    wanted = ends.unionByName(dense.select("node", none.alias("paired"), yes.alias("crowded")))
    wanted = wanted.groupBy("node").agg(F.max("paired").alias("paired"), F.max("crowded").alias("crowded"))
    path = scratch_path(docs.sparkSession, "texts")
    docs.join(wanted.hint("merge"), "node").dropDuplicates(["node"]).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the whole sets of the texts."""

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text", SLICE_BYTES):
                hashes, first = shingle_sets(part.column("text"), width)
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), sets], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    union = F.size("x") + F.size("y") - F.col("common")
    return joined.filter(100 * F.col("common") >= threshold * union).select("a", "b")


def _ranked(hashes: np.ndarray, first: np.ndarray, often: np.ndarray, times: np.ndarray):
    """(shingles, counts): the sets with rare shingles first."""
    if len(often):
        at = np.searchsorted(often, hashes).clip(0, len(often) - 1)
        count = np.where(often[at] == hashes, times[at], 0)
    else:
        count = np.zeros(len(hashes), np.int64)
    order = np.lexsort((hashes, count, B.owner(first)))
    return hashes[order], count[order]


_PREFIXES = "token long, salt int, node long, root long, size long, rest long"


def _prefixes(width: int, threshold: int, often: np.ndarray, times: np.ndarray):
    """The first shingles of each set, of which two sets that reach the threshold share one.

    `rest` counts the shingles from this one on. Of two such sets the smaller one has enough
    of them for a partner of its own size (`_first_of_two`); only these rows are salted.
    """

    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text", SLICE_BYTES):
                hashes, first = shingle_sets(part.column("text"), width)
                token, count = _ranked(hashes.view(np.int64), first, often, times)
                text, n = B.owner(first), np.diff(first)
                size = n[text]
                rest = size - (np.arange(len(token)) - first[text])
                early = np.flatnonzero(rest >= -(-threshold * size // 100))
                token, text, size, rest, count = token[early], text[early], size[early], rest[early], count[early]
                node, root = part.column("node").to_numpy()[text], part.column("root").to_numpy()[text]
                salts = np.clip(-(-count // SALTED), 1, MOST_SALTS)
                own = (B.mix(node.view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64)
                copies = np.repeat(np.arange(len(token)), salts)
                salt = np.arange(len(copies)) - np.repeat(np.cumsum(salts) - salts, salts)
                # In the other salts a row is met but looks for no partner: its sign says so.
                signed = np.where(salt == own[copies], rest[copies], -rest[copies])
                columns = [token[copies], salt.astype(np.int32), node[copies], root[copies], size[copies], signed]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "salt", "node", "root", "size", "rest"])

    return run


def _may_reach(size_a, rest_a, size_b, rest_b, threshold: int):
    return np.minimum(rest_a, rest_b) * (100 + threshold) >= threshold * (size_a + size_b)


def _first_of_two(size, rest, threshold: int):
    """A pair that may reach the threshold has such a row: with none, the smaller rest is too small."""
    return _may_reach(size, rest, size, rest, threshold)


def _crossing(node, root, size, rest, threshold: int):
    """Pairs of different roots in one long run of a shingle."""
    looks, rest = (rest > 0) & _first_of_two(size, rest, threshold), np.abs(rest)
    names, of = np.unique(root, return_inverse=True)
    main = of == np.bincount(of, minlength=len(names)).argmax()
    for left, right in (
        (np.flatnonzero(looks & main), np.flatnonzero(~main)),
        (np.flatnonzero(looks & ~main), np.arange(len(node))),
    ):
        step = max(1, (1 << 20) // max(1, len(right)))
        for k in range(0, len(left), step):
            x, y = left[k : k + step, None], right[None, :]
            i, j = np.nonzero((root[x] != root[y]) & _may_reach(size[x], rest[x], size[y], rest[y], threshold))
            yield left[k + i], right[j]


def _meet(threshold: int):
    """Over rows sorted by shingle and salt: pairs of different roots that may reach the threshold."""

    def pairs(token, salt, node, root, size, rest):
        n = len(token)
        starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
        length = np.diff(np.append(starts, n))
        mixed = (np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)) & (length > 1)
        run = np.repeat(np.arange(len(starts)), length)
        rows = np.flatnonzero((mixed & (length <= SHORT_RUN))[run])
        found = []
        for gap in range(1, SHORT_RUN):
            a = rows[:-gap] if len(rows) > gap else rows[:0]
            b = rows[gap:][: len(a)]
            together = run[a] == run[b]
            if not together.any():
                break
            a, b = a[together], b[together]
            good = (root[a] != root[b]) & ((rest[a] > 0) | (rest[b] > 0))
            good &= _may_reach(size[a], np.abs(rest[a]), size[b], np.abs(rest[b]), threshold)
            found.append((a[good], b[good]))
        for r in np.flatnonzero(mixed & (length > SHORT_RUN)).tolist():
            s, e = starts[r], starts[r] + length[r]
            found += [(s + i, s + j) for i, j in _crossing(node[s:e], root[s:e], size[s:e], rest[s:e], threshold)]
        for i, j in found:
            if len(i):
                both = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy() for c in batch.columns]
            # The last run may go on in the next batch.
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if held and (cut or (held[-1][0][-1], held[-1][1][-1]) != (now[0][0], now[1][0])):
                whole = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in now], strict=True)]
                yield from pairs(*whole)
                held = []
            elif cut:
                yield from pairs(*[c[:cut] for c in now])
            held.append([c[cut:].copy() for c in now])
        if held:
            yield from pairs(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def settle_dense(texts: DataFrame, parents: DataFrame, width: int, threshold: int) -> DataFrame | None:
    """(a, b): all links between the `crowded` texts that are in different components so far."""
    texts = texts.filter("crowded")
    count = texts.count()
    if count < 2:
        return None
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, count // ORDER_ROWS)
    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)
    common = full_sets(some, width).select(F.explode("shingles").alias("token")).groupBy("token").count()
    top = common.filter("count > 1").orderBy(F.desc("count"), "token").limit(ORDER_SHINGLES).toPandas().sort_values("token")
    often, times = top["token"].to_numpy(np.int64), top["count"].to_numpy(np.int64) * every
    up = parents.select(F.col("child").alias("node"), "parent")
    met = (
        texts.join(up.hint("merge"), "node", "left")
        .select("node", F.coalesce("parent", "node").alias("root"), "text")
        .mapInArrow(_prefixes(width, threshold, often, times), _PREFIXES)
        .repartition(parts, "token", "salt")
        .sortWithinPartitions("token", "salt")
        .mapInArrow(_meet(threshold), "a long, b long")
    )
    pairs = cut_lineage(met.distinct())
    found = pairs.count()
    if not found:
        return None
    files = max(1, min(parts, -(-found // PAIRS_PER_FILE)))
    pairs = pairs.coalesce(files)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut_lineage(full_sets(texts.join(ends.hint("merge"), "node", "left_semi"), width))
    links = cut_lineage(confirm(pairs, sets, threshold).coalesce(files))
    return None if links.isEmpty() else links


def components_of(docs: DataFrame, reps: DataFrame, width: int, threshold: int, neighbours: int) -> DataFrame:
    """(child, parent): the smallest linked representative of every other one that has links."""
    pairs, dense = candidates(reps, threshold, neighbours)
    pairs, dense = cut_lineage(pairs), cut_lineage(dense)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, min(parts, -(-pairs.count() // PAIRS_PER_FILE)))  # small tables in few files
    pairs = pairs.coalesce(files)
    texts = stored_texts(docs, pairs, dense)
    sets = cut_lineage(full_sets(texts.filter("paired"), width))
    # First the most alike partner of each row: these links join nearly all groups.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
    sure = cut_lineage(confirm(best.select("a", "b"), sets, threshold).coalesce(files))
    parents = stored_components(sure)
    # Then what is left between different components.
    up = parents.select(F.col("child").alias("node"), "parent")

    def rooted(rows: DataFrame, of: str) -> DataFrame:
        named = up.select(F.col("node").alias(of), F.col("parent").alias(f"root_{of}"))
        return rows.join(named, of, "left").withColumn(f"root_{of}", F.coalesce(f"root_{of}", of))

    tried = best.select("a", "b")
    open_pairs = rooted(rooted(pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"), "a"), "b")
    open_pairs = open_pairs.filter(F.col("root_a") != F.col("root_b")).select("a", "b")
    open_pairs = cut_lineage(open_pairs.coalesce(files))
    more = cut_lineage(confirm(open_pairs, sets, threshold).coalesce(files))
    for links in (lambda: None if more.isEmpty() else more, lambda: settle_dense(texts, parents, width, threshold)):
        if (found := links()) is not None:
            known = parents.select(F.col("child").alias("a"), F.col("parent").alias("b"))
            parents = stored_components(known.unionByName(found))
    return parents


def summed_up(
    docs: DataFrame, width: int, threshold: int, neighbours: int = NEIGHBOURS, id_col: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """(the stored `summaries` of `docs`; one row for each set, with its component and its `first` id and node)."""
    path = scratch_path(docs.sparkSession, "shingles")
    summaries(docs, width, id_col).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    full = rows.filter("n_shingles > 0")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "node"))
    groups = full.groupBy(*SET).agg(F.min("node").alias("node"), first.alias("first"))
    reps = full.join(groups.select(*SET, "node"), [*SET, "node"], "left_semi").dropDuplicates(["node", "s1", "s2"])
    # A repeated row, equal in id and text, is one node and one text.
    named = docs.select(node_of(id_col).alias("node"), "text")
    parents = components_of(named, reps, width, threshold, neighbours)
    return rows, groups.join(parents.withColumnRenamed("child", "node"), "node", "left").select(
        *SET, F.coalesce("parent", "node").alias("component"), "first"
    )


def kept_nodes(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """(node): the first node of each group; a text without words is a group of its own."""
    rows, groups = summed_up(docs, width, threshold)
    least = groups.groupBy("component").agg(F.min("first").alias("least")).select("least.node")
    return least.unionByName(rows.filter("n_shingles = 0").select("node")).distinct()


def near_groups(
    docs: DataFrame,
    width: int = WIDTH,
    threshold: int = THRESHOLD,
    neighbours: int = NEIGHBOURS,
    id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs` (doc_id, text)."""
    rows, groups = summed_up(docs, width, threshold, neighbours, id_col)
    full, groups = rows.filter("n_shingles > 0"), cut_lineage(groups)
    least = groups.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = attach(groups.drop("first"), least, ["component"], "n", "inner").select(*SET, "least")
    out = full.select("doc_id", "node", *SET).join(groups, SET).select("doc_id", "node", "n_shingles", "least")
    alone = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "node")
    empty = rows.filter("n_shingles = 0").select("doc_id", "node", "n_shingles", alone.alias("least"))
    return out.unionByName(empty).select(
        "doc_id",
        "n_shingles",
        F.nullif("least.id", F.lit(LAST_ID)).alias("component_id"),
        (F.col("node") == F.col("least.node")).alias("kept"),
    )


def remove_near_copies(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row of `docs` for each group: that with the smallest doc_id, of several the smallest node."""
    kept = kept_nodes(docs.select("doc_id", "text"), width, threshold)
    name = "_" + "_".join(docs.columns)  # a name that no column has
    marked = docs.withColumn(name, node_of("doc_id"))
    # Only rows equal in id and text meet here, and all but one of a task stay behind before the shuffle.
    one = Window.partitionBy(name).orderBy(F.xxhash64(*docs.columns))
    rank = name + "_"
    stay = marked.join(kept.withColumnRenamed("node", name), name, "left_semi").withColumn(rank, F.row_number().over(one))
    return stay.filter(F.col(rank) == 1).select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    groups = near_groups(docs, width=3, threshold=85)
    # By the contract, of several rows with the smallest id all are kept; a row without id as the operator says.
    return groups.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), "kept"))
