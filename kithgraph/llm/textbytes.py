"""Words, lines and hashes of UTF-8 texts as whole numpy arrays, for code inside tasks.

An Arrow string column is one byte buffer with offsets. Everything here works on that
buffer: no text becomes a Python object. Slices of a batch are kept small (`slices`), so
the arrays of one slice stay within some tens of megabytes unless one text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U64 = np.uint64
_MASK = (1 << 64) - 1


def _odd_inverse(x: int) -> int:
    """Inverse modulo 2**64."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) & _MASK
    return y


INVERSE = np.uint64(_odd_inverse(int(BASE)))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the largest n so far."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        up, down = (np.full(size, x, dtype=np.uint64) for x in (BASE, INVERSE))
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.cumprod(up), np.cumprod(down))
        if size > 16 * SLICE_BYTES:
            _POWERS.clear()  # do not keep what one very long text needed
    return have


class Hasher:
    """Hashes of any substring [s, e) of a byte buffer, equal for equal bytes."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        """The hash of the `length` bytes from each position."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of `batch` with about `limit` bytes in `column`, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // limit
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(lengths)]])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def blocks(
    data: np.ndarray, offsets: np.ndarray, cut: np.ndarray, limit: int = SLICE_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, data, offsets) pieces of about `limit` bytes; owner is the text each part is from.

    A text above `limit` is cut before bytes of the 256-entry table `cut`, so what lies
    between two such bytes stays whole and the arrays made of a piece stay bounded however
    long the text is.
    """
    starts, owner = offsets[:-1], np.arange(len(offsets) - 1)
    more, of = [], []
    for t in np.flatnonzero(np.diff(offsets) > limit).tolist():
        end, at = int(offsets[t + 1]), int(offsets[t]) + limit
        while at < end:
            hit = np.flatnonzero(cut[data[at : min(at + (1 << 16), end)]])
            if not len(hit):
                at += 1 << 16
                continue
            more.append(at + int(hit[0]))
            of.append(t)
            at = more[-1] + limit
    if more:
        starts, owner = np.concatenate([starts, more]), np.concatenate([owner, of])
        order = np.lexsort((owner, starts))
        starts, owner = starts[order], owner[order]
    if not len(starts):
        return
    edges = np.append(starts, offsets[-1])
    part = edges[1:] // limit
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield owner[a:b], data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def table(members: bytes) -> np.ndarray:
    """A 256-entry table that is true at the given bytes."""
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


BLANK = table(b" \t\n\x0b\x0c\r")
NON_BLANK = ~BLANK
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches where `mask` holds, cut at the texts' borders."""
    n = len(mask)
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = mask
    before[offsets] = False
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = mask
    after[offsets] = False
    starts = np.flatnonzero(mask & ~before[:n])
    ends = np.flatnonzero(mask & ~after[1:]) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NON_BLANK):
    """(starts, ends, first): words of all texts; text i has words first[i] to first[i + 1]."""
    starts, ends = runs(inside[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def owner(first: np.ndarray) -> np.ndarray:
    """For each item the number of the text it is in, from the items' `first`."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` neighbouring items, as many as there are full windows."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out = mix(out * _U64(0xD1342543DE82EF95) + h[k : k + n])
    return out


def within(first: np.ndarray, width: int) -> np.ndarray:
    """True at the items from which `width` items lie in the same text."""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + width <= last


def cover(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """True at the items that one of the stretches [start, start + width) covers."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step)[:n] > 0


def equal_to_another(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, later): rows whose keys some other row has; those after the first of them."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    same = np.zeros(n + 1, dtype=bool)
    if n > 1:
        alike = np.ones(n - 1, dtype=bool)
        for k in keys:
            s = k[order]
            alike &= s[1:] == s[:-1]
        same[1:n] = alike
    repeated, later = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    repeated[order] = same[:n] | same[1:]
    later[order] = same[:n]
    return repeated, later
