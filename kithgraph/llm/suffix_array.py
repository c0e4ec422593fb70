"""Suffix arrays of byte strings by induced sorting, with whole-array numpy steps.

Suffixes are S (smaller than the next one) or L. The leftmost-smaller (LMS) substrings
are sorted by one induction, named, and the suffixes that begin there ranked on the
string of names; a second induction then places every suffix in linear time. A bucket of
equal first bytes is filled by rounds, each of which takes all suffixes that the last one
placed, so the number of Python steps follows the alphabet and the longest run of one
byte, not the length.
"""

from __future__ import annotations

import numpy as np

from kithgraph.llm.textbytes import Hasher


def classify(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type; the end of the string is smaller than any byte."""
    n = len(s)
    falls = np.empty(n, dtype=bool)  # at the last position of each run: is the next byte larger?
    last = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)
    rises = np.append(s[last[:-1]] < s[last[:-1] + 1], False)
    lengths = np.diff(np.append(-1, last))
    falls = np.repeat(rises, lengths)
    return falls


def _split(items: np.ndarray, chars: np.ndarray, parts: list[list[np.ndarray]]) -> None:
    """Append `items` to the lists of their bytes, in order."""
    if not len(items):
        return
    order = np.argsort(chars, kind="stable")
    items, chars = items[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for part, c in zip(np.split(items, cuts), chars[np.append(0, cuts)].tolist(), strict=True):
        parts[c].append(part)


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order."""
    n = len(s)
    by_byte: list[list[np.ndarray]] = [[] for _ in range(256)]
    _split(lms, s[lms], by_byte)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[s[n - 1]].append(np.array([n - 1], dtype=np.int32))  # from the end of the string

    def before(items: np.ndarray, want_small: bool) -> np.ndarray:
        prev = items[items > 0] - 1
        return prev[small[prev] == want_small]

    for c in range(256):  # L-type suffixes, bytes rising
        done = 0
        while done < len(large[c]):
            front = large[c][done:]
            done = len(large[c])
            prev = before(np.concatenate(front), False)
            _split(prev, s[prev], large)
        if by_byte[c]:
            prev = before(np.concatenate(by_byte[c]), False)
            _split(prev, s[prev], large)
    smalls: list[list[np.ndarray]] = [[] for _ in range(256)]  # each in falling order
    for c in range(255, -1, -1):  # S-type suffixes, bytes falling
        done = 0
        while done < len(smalls[c]):
            front = smalls[c][done:]
            done = len(smalls[c])
            prev = before(np.concatenate(front), True)
            _split(prev, s[prev], smalls)
        if large[c]:
            prev = before(np.concatenate(large[c])[::-1], True)
            _split(prev, s[prev], smalls)
    out = []
    for c in range(256):
        out += large[c]
        out += [x[::-1] for x in smalls[c][::-1]]
    return np.concatenate(out)


def _rank_names(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of the string of names, by doubling.

    A rank is the place where its group of equal suffixes begins; each step sorts only the
    members of groups that are still open. It ends when none is, or at `depth` names.
    """
    m, k = len(names), 1
    order = np.argsort(names, kind="stable")
    rank = np.empty(m, dtype=np.int64)
    in_order = names[order]
    new = np.append(True, in_order[1:] != in_order[:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots) and k < m and (depth is None or k < depth):
        members = order[slots]
        after = members + k
        second = np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        key = rank[members] * (m + 1) + second
        by_key = np.argsort(key)
        members, key = members[by_key], key[by_key]
        order[slots] = members
        new = np.append(True, key[1:] != key[:-1])
        rank[members] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        k *= 2
    return order


def suffix_array(s: np.ndarray, hasher: Hasher | None = None, depth: int | None = None) -> np.ndarray:
    """Start positions of all suffixes of the byte string in ascending order.

    With `depth`, suffixes that share that many bytes may stand in any order.
    """
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = classify(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        first = induce(s, small, lms)  # sorts the LMS substrings
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        in_order = first[is_lms[first]]
        end = np.append(lms[1:] + 1, n)  # an LMS substring reaches to the next one and into it
        place = np.zeros(n, dtype=np.int32)
        place[lms] = np.arange(len(lms))
        h = (hasher or Hasher(s)).spans(lms, end)
        size = end - lms
        at = place[in_order]
        differ = (h[at[1:]] != h[at[:-1]]) | (size[at[1:]] != size[at[:-1]])
        names = np.zeros(len(lms), dtype=np.int64)
        names[at] = np.concatenate([[0], np.cumsum(differ)])
        lms = in_order if names.max() == len(lms) - 1 else lms[_rank_names(names, depth)]
    return induce(s, small, lms)


def long_common_prefixes(order: np.ndarray, hasher: Hasher, length: int) -> np.ndarray:
    """In text order: whether a suffix shares `length` bytes with its neighbour before it in
    the array, the permuted form of `LCP >= length`."""
    n = len(order)
    phi = np.full(n, -1, dtype=np.int64)
    phi[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=bool)
    window = hasher.windows(length)
    i = np.flatnonzero((phi >= 0) & (np.arange(n) < len(window)))
    i = i[phi[i] < len(window)]
    out[i] = window[i] == window[phi[i]]
    return out


def repeated_starts(s: np.ndarray, length: int) -> np.ndarray:
    """True at each position whose next `length` bytes also begin elsewhere in `s`."""
    out = np.zeros(len(s), dtype=bool)
    if len(s) <= length:
        return out
    hasher = Hasher(s)
    order = suffix_array(s, hasher, length)
    with_before = long_common_prefixes(order, hasher, length)
    out |= with_before
    # A suffix whose successor matches it is repeated as well.
    follower = np.flatnonzero(with_before[order])
    out[order[follower - 1]] = True
    return out
