"""Plain Python versions of what the operators of kithgraph.llm compute."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return BLANK.findall(text or "")


def normal_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    repeated = set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            repeated.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def contamination(docs, items, window=10):
    """docs, items: (id, text). Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    grams = defaultdict(set)
    for i, text in items:
        w = normal_words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if m else ():
            grams[tuple(w[k : k + m])].add(str(i))
    sizes = {len(g) for g in grams}
    out = []
    for d, text in docs:
        w, hit, found = normal_words(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in grams:
                    hit.update(range(k, k + m))
                    found |= grams[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)))


def components(docs):
    """{row number: (n_shingles, component)} with links at 100 * common >= 85 * union."""
    sets = [(d, shingle_set(t)) for d, t in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, (_, s) in enumerate(sets):
        common = Counter(j for g in s for j in holders[g] if j < i)
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j][1]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s), low[root(i)]) for i, (d, s) in enumerate(sets))


def repeats(docs, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for (doc_id, text)."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    n = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)
