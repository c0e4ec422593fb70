"""Ranked search, token alignment and the quality network against plain Python."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kithgraph.llm import quality_network as Q
from kithgraph.llm import ranked_search as R
from kithgraph.llm import token_alignment as A

SMALL = "/root/testdata/sf0.001"


# --- ranked search ---------------------------------------------------------------------------------------------


def brute_search(docs, items, k):
    term = re.compile(R.TERM)
    low = str.maketrans(R.UPPER, R.LOWER)
    read = [(d, Counter(term.findall((t or "").translate(low)))) for d, t in docs]
    n_docs = sum(1 for _, c in read if c)
    length = sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(term.findall((t or "").translate(low)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in read:
            if not c:
                continue
            m = 10 + (90 * sum(c.values()) * n_docs) // length
            score = 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scored)[:k], 1):
            out.append((i, rank, d, -score))
    return sorted(out, key=repr)


DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(700)]
    docs += [(rng.randint(0, 5), docs[3][1]) for _ in range(150)]  # copies that tie, with repeated ids
    docs += [(None, docs[3][1])] * 3 + [(801, None), (802, ""), (803, "!? ."), (804, "ÉÀ w1 W1 wÜ")]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(25)]
    items += [(1, "w1 w2"), (None, docs[3][1]), (90, "nowhere"), (91, None), (92, "éà ÉÀ wÜ")]
    monkeypatch.setattr(R, "SEGMENT_DOCS", 40)
    got = R.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), k=7, block_terms=60)
    assert found(got) == brute_search(docs, items, 7)


def test_search_does_not_depend_on_partitions_or_other_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = found(R.search(docs.coalesce(1), items))
    many = docs.withColumnsRenamed({"lang": "term", "source": "df"}).repartition(13)
    assert found(R.search(many, items.withColumnRenamed("item_id", "id"), "id").withColumnRenamed("id", "item_id")) == one


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert R.search(docs.limit(0), items).collect() == []
    assert R.search(docs, items.limit(0)).collect() == []
    assert R.search(spark.createDataFrame([(1, None)], DOCS), items).collect() == []
    assert found(R.search(docs, items))[0][:3] == (1, 1, 1)


def test_search_reads_long_texts_in_parts(spark):
    text = "alpha beta " * 450_000 + "gamma"
    docs = [(1, text), (2, "gamma beta"), (3, "delta " + "x" * 3_000_000)]
    items = [(1, "gamma alpha"), (2, "x" * 3_000_000)]
    got = R.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert found(got) == brute_search(docs, items, 10)


def test_intervals_are_bounded_by_range_maxima():
    rng = np.random.default_rng(3)
    docs = [" ".join(f"t{x}" for x in rng.zipf(1.3, 30) if x < 60) for _ in range(300)]
    import pyarrow as pa

    _, text, term, n = R.counted(pa.array(docs), None)
    total = R.counted(pa.array(docs), None)[0]
    row = R.segment([(pa.array(range(300)), total, text, term, n)])
    made = pa.table({"id": [0] * 3, "term": R.terms(*R.B.flat(pa.array(["t1 t2 t7"])))[0].view(np.int64), "df": [200, 100, 20]})
    block = R.Block(made, 300, int(total.sum()))
    seg = R.Segment({c: row.column(c)[0] for c in row.schema.names}, block)
    scores = np.bincount(seg.place, seg.impact, len(seg.ids))
    lists, _ = seg.lists_of(block, np.array([0]))
    for low, high in [(0, 300), (10, 11), (37, 120), (250, 299)]:
        a, b = (np.searchsorted(seg.key, lists * seg.width + x) for x in (low, high))
        bound, split = seg.maxima(a, b, np.zeros(len(lists), dtype=int), 1)
        maxima = [seg.impact[x:y].max() for x, y in zip(a, b, strict=True) if y > x]
        assert bound[0] == sum(maxima) >= scores[low:high].max()
        if maxima:
            assert max(maxima) in seg.impact[seg.place == split[0]]
    best = R.Best(1, 5, (np.ones(1, dtype=np.int64), np.full(1, R.LAST)))
    seg.search(block, np.array([0]), best, None)
    assert best.score.tolist() == sorted(scores.astype(int).tolist(), reverse=True)[:5]


# --- token alignment -------------------------------------------------------------------------------------------


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    name_a, name_b = A.default_vocabularies()
    a = Tokenizer.from_file(name_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=name_b)
    letter = dict(zip(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), A._byte_order(), strict=False))
    spare = (x for x in range(256, 512))
    letter |= {chr(next(spare)): x for x in range(256) if x not in letter.values()}
    entry = {k: bytes(letter[c] for c in t) for t, k in a.get_vocab().items() if k < 50256}
    out, count = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        ids_a = a.encode(raw.decode(), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [entry[k] for k in ids_a]
        bytes_b = [
            bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b
        ]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        end_a, end_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        shared = sorted(set(end_a) & set(end_b))
        links = _ended(ids_a, end_a, ids_b, end_b)
        count.update(links)
        groups_a, groups_b = [[] for _ in shared], [[] for _ in shared]
        for ids, ends, groups in ((ids_a, end_a, groups_a), (ids_b, end_b, groups_b)):
            for k, e in zip(ids, ends):
                groups[bisect.bisect_left(shared, e)].append(k)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(groups_a, groups_b))
        out.append((doc_id, len(ids_a), len(ids_b), len(shared), links, hashlib.sha256(text.encode()).hexdigest()))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        ((d, x, y, g, len(l), sum(count[p] == best[p[1]] for p in l), sum(count[p] for p in l), h) for d, x, y, g, l, h in out), key=repr
    )


def _ended(ids_a, end_a, ids_b, end_b):
    at_b = dict(zip(end_b, ids_b))
    return [(x, at_b[e]) for x, e in zip(ids_a, end_a) if e in at_b]


ODD = [
    (1, "a  b\n c\xa0 d ﬁ ①  "), (2, ""), (3, None), (4, "<|endoftext|> <s> x </s> <0x41>"), (5, "\x00 a"), (6, " a "),
    (7, "▁x"), (8, "é é  x   y z \n\n  w\t\tq"), (None, "it's 's  'll"), (9, "   "), (9, "\n"),
    (10, "x" * 300 + " y \x1c z \x85 q  \x1d  　 r   s"), (11, "日本語 текст 🙂 é"), (12, "a  b"), (12, "a  b"),
]


def aligned(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_alignment_of_odd_texts(spark):
    got = A.align_tokens(spark.createDataFrame(ODD, DOCS).repartition(3))
    assert aligned(got) == brute_alignment(ODD)


def test_alignment_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert aligned(A.op12_token_alignment(spark, SMALL)) == brute_alignment(rows)


def test_alignment_forgets_and_reads_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(5000)]
    rows = [(k, " ".join(rng.choices(words, k=400))) for k in range(20)] + [(99, "  ".join(rng.choices(words, k=230_000)))]
    made = A.Aligner(*A.default_vocabularies(), "end")
    monkeypatch.setattr(A, "CACHE_PIECES", 1500)
    monkeypatch.setattr(A, "BLOCK_PIECES", 900)
    for texts in ([t for _, t in rows[:20]], [rows[20][1]]):
        whole = brute_alignment([(0, t) for t in texts])
        got = [(int(c[0]), int(c[1]), int(c[2]), int(n.sum()), d.decode()) for c, d, _, n in made.read_all(texts)]
        assert sorted(got) == sorted((w[1], w[2], w[3], w[4], w[7]) for w in whole)


def test_incidence_products():
    rng = np.random.default_rng(1)
    for _ in range(20):
        size = int(rng.integers(1, 60))
        cuts = [np.unique(np.append(rng.integers(1, size + 1, rng.integers(1, 20)), size)) for _ in range(2)]
        a, b = (np.diff(np.concatenate([[0], c])) for c in cuts)
        covers = [np.repeat(np.eye(len(x), dtype=int), x, axis=1) for x in (a, b)]
        i, j, n = A.Csr.of_spans(a).times(A.Csr.of_spans(b).transposed(size))
        dense = np.zeros((len(a), len(b)), dtype=int)
        dense[i, j] = n
        assert (dense == covers[0] @ covers[1].T).all()
        group_a, group_b, links = A.align(a, b)
        assert set(zip(*map(np.ndarray.tolist, links["overlap"]))) == set(zip(*map(np.ndarray.tolist, np.nonzero(dense))))
        assert set(zip(*map(np.ndarray.tolist, links["group"]))) == {
            (x, y) for x in range(len(a)) for y in range(len(b)) if group_a[x] == group_b[y]
        }
        ends = [set(c.tolist()) for c in cuts]
        assert len(links["end"][0]) == len(ends[0] & ends[1])


def test_kinds_of_links_nest(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    end, overlap, group = (A.align_tokens(docs, k).agg({"n_links": "sum"}).first()[0] for k in A.KINDS)
    assert end <= overlap <= group
    with pytest.raises(ValueError):
        A.align_tokens(docs, "none")


def test_alignment_of_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, pair long")
    assert A.align_tokens(docs.limit(0)).collect() == []
    assert aligned(A.align_tokens(docs)) == brute_alignment([(1, "a b")])


# --- quality network -------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in Q.op13_quality_classifier(spark, SF).collect()}


def test_network_on_held_out_rows(spark, scored):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in scored.values() if r.held_out and r.doc_id in labels]
    assert {d for d in scored if zlib.crc32(str(d).encode()) % 4 == 2} == {d for d, r in scored.items() if r.held_out}
    right = sum(r.predicted == labels[r.doc_id] for r in held) / len(held)
    assert len(held) > 80 and right > 0.95
    low = [r.score for r in held if labels[r.doc_id] == 0]
    high = [r.score for r in held if labels[r.doc_id] == 1]
    assert sum(x < y for x in low for y in high) / len(low) / len(high) > 0.97
    # calibrated: the mean score is near the share of good rows
    assert abs(sum(low + high) / len(held) - len(high) / len(held)) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.values())


def test_network_never_reads_held_out_labels(spark, scored):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    noisy = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")).repartition(7)
    again = {r.doc_id: r.score for r in Q.quality_scores(noisy, turned).collect()}
    assert again == pytest.approx({d: r.score for d, r in scored.items()}, abs=1e-6)


def test_network_on_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "fine words here", 1.0), (None, None, 2.0), (2, "", 3.0), (2, "fine words here", 4.0), (3, "x " * 1_500_000, 5.0)],
        "doc_id long, text string, score double",
    )
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.quality_scores(docs, none).collect()} == {1.0}
    one_kind = spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in Q.quality_scores(docs, one_kind).collect()} == {1.0}
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    made = docs.union(spark.createDataFrame([(k, ("good text " if k % 2 else "### $$$ ") * k, 0.0) for k in range(4, 40)], docs.schema))
    rows = Q.quality_scores(made, labels).collect()
    assert len(rows) == 41 and all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id in (1, 2)]
    assert len(same) == 3 and len(set(same)) == 2  # the empty text differs from the two equal ones
    assert Q.quality_scores(docs.limit(0), labels).collect() == []


def test_context_vectors_add_up():
    import pyarrow as pa

    places, signs = Q.index_vectors()
    data, offsets = Q.B.flat(pa.array(["one two three two", "two"]))
    bins, first = Q.tokens(data, offsets)
    total = np.zeros((Q.BINS, Q.DIM), dtype=np.int64)
    Q.add_contexts(total, bins, first, places, signs)
    want = np.zeros_like(total)
    for i, t in ((0, (1, 2)), (1, (0, 2, 3)), (2, (0, 1, 3)), (3, (1, 2))):
        for j in t:
            for k in range(Q.NONZERO):
                want[bins[i], places[bins[j], k]] += signs[bins[j], k]
    assert (total == want).all()
    assert first.tolist() == [0, 4, 5]
