"""Operators of kithgraph.llm against plain Python, on given tables and on odd ones."""

import os
import random
import re
import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import brute  # noqa: E402
from compare import compare, duck  # noqa: E402
from kithgraph.llm import (  # noqa: E402
    catalog,
    decontaminate,
    html_extract,
    line_dedup,
    mixing,
    near_dedup,
    quality,
    substring_dedup,
    suffix_array,
    textbytes,
    token_files,
    toxicity,
    url_filter,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choices("abcdefgéß", k=rng.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


LONG = prose(3000)
PASSAGE = prose(120)
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "one two"), (6, LONG), (6, LONG), (7, LONG + " tail"),
    (8, prose(50) + "\n" + PASSAGE + "\n" + prose(40)), (9, prose(60) + "\n" + PASSAGE), (None, PASSAGE), (10, PASSAGE),
    (11, "ab " * 900), (12, "Same line here!\n\nsame LINE here!\nother\n"), (13, "  same line here!  \nOTHER"),
    (14, "\n\n\n"), (15, "a # b $ c | d\n" * 5), (16, "Ünïcödé " * 30), (17, "x" * 1500), (18, "one two"), (19, "\x1c\x85 odd blanks <|endoftext|> z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en", rng.choice(["a", "b", None]), len(t or "")) for d, t in ODD]
    extra = "k string, size string, bin long, score string, n_words int, row int, _id int, batch int, tree int"
    clash = ("x", "y", 1, "z", 2, 3, 4, 5, 6)
    return spark.createDataFrame([r + clash for r in rows], f"{DOCS}, {extra}").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), duck(SF), catalog.ORACLES[name]) is None


# Line dedup


def lines_want(docs):
    rank = lambda d: 2**63 - 1 if d is None else d
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(rank(d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == rank(d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return by_text(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(odd, batches):
    got = line_dedup.dedup_lines(odd, batches=batches)
    rows = got.select("row.doc_id", "text", "n_lines", "n_dropped").collect()
    assert by_text(tuple(r) for r in rows) == lines_want(pairs(odd))
    assert any(r.n_dropped for r in rows)


def test_line_dedup_native_and_empty(none, given):
    out = line_dedup.dedup_lines(none)
    assert out.count() == 0
    plan = line_dedup.dedup_lines(given)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# Quality rules


def test_quality_counts(odd, labels):
    got = quality.quality_rules(odd, labels).collect()
    want = [(d, *brute.base_counts(t)) for d, t in pairs(odd)]
    assert by_text(tuple(r)[:6] for r in got) == by_text(want)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert 0 <= r.score <= 1 and r.kept == (not r.base_failed and r.score >= 0.5)


def test_quality_without_labels(none, odd, labels):
    assert quality.quality_rules(none, labels).count() == 0
    one = quality.quality_rules(odd, labels.filter("doc_id < 0")).collect()
    assert all(r.kept == (not r.base_failed) for r in one)


def test_quality_held_out():
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")
    rows = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").merge(docs, on="doc_id")
    train, test = rows[:1500], rows[2000:3000]
    table = pa.table({"label": pa.array(train.quality, pa.int32()), "text": pa.array(train.text, pa.string())})
    model = quality.fit(table)
    data, offsets = textbytes.flat(pa.array(test.text, pa.string()))
    _, h, first = quality.base_counts(data, offsets)
    p = quality.score(model, data, offsets, h, first)
    assert ((p >= 0.5) == (test.quality == 1)).mean() > 0.98
    assert abs(p.mean() - test.quality.mean()) < 0.05  # calibrated


# URL filters

URLS = [
    None, "", "no scheme", "http://", "https://net/x", "http://A.B.NET", "http://www.example.net/en/1?q#f", "http://example.net/EN/",
    "http://example.netx/en/", "http://x.example.com/de/", "http://example.com/den", "ftp://org/fr/", "http://a.org?x", "http://a.org/fr/#net/",
    "http://internet/", "http://a.net:80/", "://net/", "http://.net/", "http://a..net/en/", "http://org/fr/" + "y" * 5000,
]


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(brute.LOWER)
    fits = [
        (len(h) + len(p), len(h), a == "block", h + p, a)
        for a, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_url_filter(spark):
    rules = [*url_filter.RULES, ("allow", "a.b.net", "/"), ("block", "b.net", ""), ("allow", "org", "/fr/y")]
    urls = [(i % 7, u) for i, u in enumerate(URLS * 30)]
    pages = spark.createDataFrame([(*u, "x") for u in urls], "page_id long, url string, bin string").repartition(4)
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "action string, host string, path string"))
    assert by_text(tuple(r) for r in got.collect()) == by_text((i, *verdict(u, rules)) for i, u in urls)
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(rules, "action string, host string, path string")).count() == 0


# Near-dedup


@pytest.mark.parametrize("source", ["odd", "given"])
def test_near_dedup(request, source):
    docs = request.getfixturevalue(source).filter("doc_id is not null")
    got = near_dedup.near_groups(docs, width=3, threshold=85).collect()
    assert by_text(tuple(r)[:3] for r in got) == by_text(brute.components(pairs(docs)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_large_group_of_near_copies(spark):
    base = prose(400).split()
    rows = []
    for i in range(1500):
        w = list(base)
        w[rng.randrange(400)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(5000 + i, prose(100)) for i in range(200)] + [(9000, None), (9001, "")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    groups = {r.doc_id: r.component_id for r in got.collect()}
    assert all(groups[i] == 0 for i in range(1500))
    assert all(groups[i] == i for i in [*range(5000, 5200), 9000, 9001])


def test_near_dedup_pairs_in_dense_regions(spark):
    """Long shared passages: all others are 77 % alike, two documents of each region 86 %."""
    own = iter(range(10**9))
    text = lambda common, n: common + " " + " ".join(f"o{next(own)}" for _ in range(n))
    rows = []
    for region in range(8):
        common = " ".join(f"c{region}x{i}" for i in range(402))
        rows += [(1000 * region + i, text(common, 32 if i in (40, 90) else 60)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, width=3, threshold=85).collect()}
    assert got == {d: d - 50 if d % 1000 == 90 else d for d, _ in rows}


def test_near_dedup_meets_in_runs():
    """The same pairs whether a run of a shingle is short, long, cut by batches or salted."""
    n, gen = 200, np.random.default_rng(3)
    node, root, size = np.arange(n), gen.integers(0, 40, n), gen.integers(80, 120, n)
    rest = size - gen.integers(0, 12, n)
    want = {
        (a, b) for a in range(n) for b in range(a + 1, n)
        if root[a] != root[b] and min(rest[a], rest[b]) * 180 >= 80 * (size[a] + size[b])
    }
    table = pa.table({"token": np.full(n, 7), "salt": np.zeros(n, np.int32), "node": node, "root": root, "size": size, "rest": rest})
    for rows in (n, 7):
        got = [p for out in near_dedup._meet(80)(table.to_batches(rows)) for p in zip(*out.to_pydict().values(), strict=True)]
        assert set(got) == want
    got = [p for i, j in near_dedup._crossing(node, root, size, rest, 80) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert {(min(p), max(p)) for p in got} == want


def test_near_dedup_nulls_and_empty(spark, none):
    docs = spark.createDataFrame([(None, PASSAGE), (3, PASSAGE), (None, None)], "doc_id long, text string")
    got = by_text((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect())
    assert got == by_text([(None, 3, False), (3, 3, True), (None, None, True)])
    assert near_dedup.near_groups(none).count() == 0


def test_near_dedup_ids_do_not_link(spark):
    """Unrelated texts under no id, or under one id, link neither each other nor what is near them."""
    one, two, three, four, five = (prose(100) for _ in range(5))
    rows = [(None, one), (5, one + " tail"), (None, two), (9, two + " tail"), (None, three), (7, four), (7, five), (8, five + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_text(tuple(r) for r in near_dedup.remove_near_copies(docs).select("doc_id", "text").collect())
    assert got == by_text([rows[1], rows[3], rows[4], rows[5], rows[6]])
    groups = by_text((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect())
    want = [(None, 5, False), (5, 5, True), (None, 9, False), (9, 9, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 7, False)]
    assert groups == by_text(want)


def test_near_dedup_few_jobs(spark, request):
    """Few links take no rounds, and copies go without a join of all rows with their groups."""
    base = prose(300).split()
    rows = [(i, " ".join([*base[: 3 * i], *(f"own{k}" for k in range(3 * i)), *base[3 * i :]])) for i in range(30)]
    docs = spark.createDataFrame(rows + [(100 + i, prose(60)) for i in range(30)] + [(200, None), (201, "")], "doc_id long, text string")
    context = spark.sparkContext
    context.setJobGroup(request.node.name, "")
    try:
        got = {r.doc_id for r in near_dedup.remove_near_copies(docs).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == {r.doc_id for r in near_dedup.near_groups(docs).filter("kept").collect()}
    assert len(got) < len(rows) + 32
    assert len(context.statusTracker().getJobIdsForGroup(request.node.name)) <= 80


def test_near_dedup_query_keeps_every_row_of_the_smallest_id(spark, tmp_path):
    text = prose(100)
    rows = [(7, text), (7, text + " tail"), (8, text), (None, prose(90))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = by_text((r.doc_id, r.component_id, r.kept) for r in near_dedup.op4_near_dedup(spark, str(tmp_path)).collect())
    assert got == by_text([(7, 7, True), (7, 7, True), (8, 7, False), (None, None, True)])


# Token files


def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    want, start = [], 0
    ordered = sorted(pairs(odd), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in ordered:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert by_text(tuple(r) for r in token_files.token_files(odd).collect()) == by_text(want)


def test_unseen_words_share_their_pieces(monkeypatch):
    from tokenizers import Tokenizer

    def refuse(self, text):
        raise AssertionError(f"not cut into pieces: {text}")

    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    monkeypatch.setattr(token_files, "CACHE_WORDS", 6)
    texts = ["It's Größe, größe; ''s don't-'s 10.5 <b>", "", "a (größe) ÷", "xİ, İ a\u0301b x² <|endoftext|> größe"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = token_files.Encoder(token_files.default_vocabulary())
    assert encoder.encode_all([t.encode() for t in texts]) == want
    monkeypatch.setattr(token_files.Encoder, "_whole", refuse)
    encoder = token_files.Encoder(token_files.default_vocabulary())
    assert encoder.encode_all([t.encode() for t in texts[:2]]) == want[:2]


def test_token_shard_access(tmp_path, none):
    path = tmp_path / "shard"
    docs = [(i * 3, np.arange(i * 50, dtype="<u4").tobytes() + b"\1\0\0\0") for i in range(40)]
    with open(path, "wb") as f:
        writer = token_files.ShardWriter(f, frame_ids=500)
        for d, ids in docs:
            writer.add(d, ids)
        writer.close()
    reader = token_files.open_shard(str(path))
    assert len(reader.frames) > 5 and list(reader.documents()) == docs
    assert all(reader.document(reader.find(d)[0]) == ids for d, ids in docs)
    raw = bytearray(path.read_bytes())
    raw[int(reader.begin[2]) + 10] ^= 1
    path.write_bytes(raw)
    broken = token_files.open_shard(str(path))
    assert broken.frame(1)
    with pytest.raises(Exception):  # noqa: B017
        broken.frame(2)
    assert token_files.token_files(none).count() == 0


# Mixing


def test_mixing(given, odd, none):
    for docs in (given, odd):
        got = mixing.mix_sources(docs).collect()
        assert by_text((r.doc_id, r.size) for r in got) == by_text((d, len(brute.words(t))) for d, t in pairs(docs))
        taken = {}
        for r in got:
            taken.setdefault((r.source, r.target, r.source_size), []).append(r.copies * r.size)
            assert 0 <= r.copies <= 3
        total = sum(s for _, _, s in taken)
        assert abs(sum(t for _, t, _ in taken) - total) < 1e-6 * total
        # Nothing overshoots, and what is open is less than the smallest document left over.
        for (source, t, _), x in taken.items():
            gap = t - sum(x)
            least = min((r.size for r in got if r.source == source and r.size and r.copies * r.source_size < t), default=0)
            assert -1e-6 < gap and (gap < least or not least)
        again = mixing.mix_sources(docs.repartition(7)).collect()
        assert by_text((r.doc_id, r.copies * r.size) for r in got) == by_text((r.doc_id, r.copies * r.size) for r in again)
    assert mixing.mix_sources(none).count() == 0


def test_mixing_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a weighs 5 and stops at 30; b 2; c 1 and has nothing; the null source weighs 5 and stops at 15
    assert got == {"a": 30.0, "b": 970.0, "c": 0.0, None: 15.0}


def test_repeat_to_targets(odd, none):
    out = mixing.repeat_to_targets(odd)
    assert out.columns == odd.columns
    want = sum(r.copies * r.size for r in mixing.mix_sources(odd).collect())
    assert sum(len(brute.words(t)) for _, t in pairs(out)) == want
    assert mixing.repeat_to_targets(none).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# HTML extraction

FRAME = (
    '<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href="/x>y">menu</a></nav>'
    '<div class="cookie-notice">We use cookies</div>%s<aside>aside</aside><form><p>Name <input></p></form>'
    '<div id="comments"><p>nice!</p></div><script>if (a<b) "</p>";</script><footer>foot</footer></body></html>'
)


def test_extract_article():
    page = FRAME % "<article><h1>Head &amp; tail</h1><p>One <b>two</b>\n three<p>four<br>five<ul><li>six<li>seven</ul><!-- no --></article>"
    assert html_extract.extract(page, None) == "Head & tail One two three four five six seven"
    for odd_page, text in ((None, ""), ("", ""), ("just text", "just text"), ("<article>a<p>b", "a b"), ("<p>x</p", "x"), ("a < b", "a < b")):
        assert html_extract.extract(odd_page, None) == text


def test_wrapper_without_article():
    def page(i):
        return f"<body><div class='top'>Welcome to us</div><div class='main-text'><h2>Title {i}</h2><p>{prose(40)}</p><p>{prose(30)}</p></div><div class='box'>All rights</div></body>"

    pages = [page(i) for i in range(6)]
    wrapper = html_extract.induce(pages)
    assert wrapper["container"].endswith("div.main.text")
    for p in [*pages, page(9)]:
        text = re.sub("<[^>]*>", " ", p[p.index("<h2>") : p.index("<div class='box'")])
        assert html_extract.extract(p, wrapper) == " ".join(text.split())


def test_extract_hidden_and_class_words():
    main = "<article><h1>H</h1><p>main text</p></article>"
    for page in (
        f'<body style="overflow:hidden">{main}</body>',
        f'<body><div title="A hidden gem" aria-hidden="false">{main}</div></body>',
        f'<body><div class="layout has-sidebar">{main}<div class="sidebar">other</div></div></body>',
        f'<body><div class="widget">{main}</div><div class="ads">other</div></body>',
        '<body><div class="layout widget"><h1>H</h1><p>main text</p></div><div class="ad">x</div></body>',
        '<body><article><div class="post-header"><h1>H</h1></div><p>main text</p></article></body>',
        "<body hidden><h1>H</h1><p>main text</p></body>",
    ):
        assert html_extract.extract(page, None) == "H main text", page
    assert html_extract.extract(f'<body>{main}<div hidden>other</div><div class="x ad">other</div></body>', None) == "H main text"
    assert html_extract.extract("<body><p>main text</p><p hidden>other and much longer than that</p></body>", None) == "main text"
    assert html_extract.extract("<body><nav>menu</nav></body>", None) == ""
    assert html_extract.extract("<div class='ad'>x</div>" + "<div>" * 3000 + "deep text", None) == "deep text"


def test_extract_pages(spark):
    body = FRAME % "<article><h1>H</h1><p>text &copy; x</p></article>"
    rows = [(1, "http://a.b/1", body), (2, None, body), (3, "http://a.b/2", None), (4, "http://a.b/1", body), (5, "x", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = by_text((r.page_id, r.text) for r in html_extract.extract_pages(pages).collect())
    assert got == by_text([(1, "H text © x"), (2, "H text © x"), (3, ""), (4, "H text © x"), (5, "")])
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_extract_given(spark):
    rows = catalog.QUERIES["op7_html_extract"](spark, SF).collect()
    text = {r.page_id: r.text for r in rows}
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        assert text[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())


# Decontamination

ITEMS = [(1, " ".join(PASSAGE.split()[10:40])), (2, "short item"), (3, None), (4, ""), (10, " ".join(PASSAGE.split()[30:60])), (11, "ONE")]


@pytest.mark.parametrize("most", [500_000, 60])
def test_decontaminate(spark, odd, most, monkeypatch):
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", (most,))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find_contamination(odd, items)
    rows = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.n_hit > 0) for r in got.collect()]
    assert by_text(rows) == by_text(brute.contamination(pairs(odd), ITEMS))
    clean = decontaminate.remove_contamination(odd, items)
    assert clean.columns == odd.columns
    left = decontaminate.find_contamination(clean, items)
    assert left.filter("n_hit > 0").count() == 0
    before = dict(p for p in pairs(odd) if p[0])
    untouched = {r[0] for r in rows if r[0] and r[2] == 0}
    assert all(dict(pairs(clean))[d] == before[d] for d in untouched)


def test_decontaminate_given(spark, given):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = decontaminate.op8_decontaminate(spark, SF).collect()
    want = brute.contamination(pairs(given), [(r.item_id, r.text) for r in items.collect()])
    assert by_text(tuple(r) for r in got) == by_text(want)


def test_decontaminate_nothing(none, odd, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_contamination(none, items).count() == 0
    assert decontaminate.find_contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0


# Toxicity


def test_toxicity_held_out():
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")
    rows = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").merge(docs, on="doc_id")
    train, test = rows[:2500], rows[2500:]
    model = toxicity.fit(pa.table({"label": pa.array(train.toxic, pa.int32()), "text": pa.array(train.text, pa.string())}))
    p = toxicity.score(model, pa.array(test.text, pa.string()))
    hit = p >= 0.5
    assert hit[test.toxic == 1].mean() > 0.85 and hit[test.toxic == 0].mean() < 0.02


def test_toxicity_grammar():
    lexicon = toxicity.Lexicon([(0, toxicity._word_hash("fool"), 3.0)])

    def kinds(text):
        x = toxicity.features(lexicon, pa.array([text]))[0]
        return {k for k, v in zip(toxicity.KINDS, x) if v}

    assert kinds("A fool, certainly.") == {"insult"}
    assert kinds("You are a FOOL") == {"aimed insult"}
    assert kinds("You are not a fool.") == {"negated insult"}
    assert kinds("They said you are a fool") == {"reported insult"}
    assert kinds("I will hurt you") == {"threat"} and kinds("you, I hurt") == {"aimed threat"}
    assert kinds("You. Fool") == {"insult"} and kinds("") == set()


def test_toxicity_edge(odd, none, labels):
    scored = toxicity.toxicity(odd, labels, score_col="p")
    assert scored.columns == [*odd.columns, "p"] and scored.filter("p between 0 and 1").count() == len(ODD)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd.drop("score"), labels.limit(0)).filter("score = 0").count() == len(ODD)


# Suffix-array dedup


def test_suffix_array():
    for t in range(300):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 26])
        s = bytes(rng.randrange(k) + 97 for _ in range(n)) * (3 if t % 5 == 0 else 1)
        a = np.frombuffer(s, np.uint8)
        assert suffix_array.suffix_array(a).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        length = rng.randint(1, 6)
        want = [i + length <= len(s) and sum(s[j : j + length] == s[i : i + length] for j in range(len(s))) > 1 for i in range(len(s))]
        assert suffix_array.repeated_starts(a, length).tolist() == want


@pytest.mark.parametrize("source,limits", [("odd", {}), ("given", {}), ("given", {"hot": 2, "shard_bytes": 5000})])
def test_substring_dedup(request, source, limits):
    docs = request.getfixturevalue(source).filter("doc_id is not null")
    got = substring_dedup.remove_repeats(docs, **limits).withColumn("sha", F.sha2("kept", 256))
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got.collect()]
    assert by_text(rows) == by_text(brute.repeats(pairs(docs)))
    assert any(r[2] for r in rows)


def test_substring_dedup_empty(none):
    assert substring_dedup.remove_repeats(none).count() == 0


# Pipeline


def test_pipeline(spark, given, labels, monkeypatch):
    import corpus_pipeline as C

    docs, held = given, {}
    for name, stage in C.STAGES:
        held[name] = docs
        docs = stage(spark, docs, SF)
        if name != C.STAGES[-1][0]:
            assert docs.columns == given.columns
    before = held["minhash near-dedup"]
    after = held["benchmark decontamination"]
    groups = near_dedup.near_groups(before)
    assert after.count() == groups.select("component_id").distinct().count()
    mixed = held["token files"]
    assert docs.count() == mixed.count()
    assert before.count() <= given.count() and os.path.exists(SF)


def test_pipeline_odd(spark, odd, none):
    import corpus_pipeline as C

    for start in (odd, none):
        docs = start
        for _, stage in C.STAGES:
            docs = stage(spark, docs, SF)
        docs.count()
