"""Vectorised words and n-gram hashes of whole Arrow text columns (numpy, inside Spark tasks).

A text column is read as one byte buffer.  Words are maximal runs of word bytes (a table of
256 flags decides), found with array operations; a word's 64-bit hash comes from prefix sums
of a polynomial over its bytes, so no Python string is made per word.  Texts are handled in
slices of about ``SLICE_BYTES`` (a longer text is a slice of its own), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)

_powers = {"pw": np.ones(1, _U), "inv": np.ones(1, _U)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["pw"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("pw", _MULT), ("inv", _INV)):
            t = np.full(size, base, _U)
            t[0] = 1
            _powers[name] = np.cumprod(t, dtype=_U)
    return _powers["pw"][:n], _powers["inv"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice); a bijection for every seed."""
    z = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U) * _U(0xD1342543DE82EF95), 7)


def byte_table(separators: str | bytes) -> np.ndarray:
    """Flags of word bytes: every byte but the given ASCII separators."""
    t = np.ones(256, bool)
    t[list(separators.encode() if isinstance(separators, str) else separators)] = False
    return t


#: Words ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case: digits, a-z and all that is not ASCII.
ALNUM_WORDS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


@dataclass
class Words:
    """The words of the rows ``first .. first + len(counts) - 1`` of a column, in order."""

    first: int
    counts: np.ndarray  # words of each row
    hashes: np.ndarray  # of all words
    starts: np.ndarray  # byte offsets in ``data``
    ends: np.ndarray
    data: np.ndarray  # bytes, lower-cased if asked for
    row_bytes: np.ndarray  # offsets of the rows in ``data``

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64, count=len(col) + 1 + col.offset)[col.offset:] if len(col) else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off


def words_of(col: pa.Array, table: np.ndarray = SPACE_WORDS, lower: bool = True) -> Iterator[Words]:
    """Slices of the column's words; every row comes in one slice whole."""
    data, off = column_bytes(col)
    n = len(off) - 1
    fold = LOWER if lower else SAME
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        rows = off[i:j + 1] - off[i]
        raw = fold[data[off[i]:off[j]]]
        yield _slice(i, raw, rows, table)
        i = j


def _slice(first: int, raw: np.ndarray, rows: np.ndarray, table: np.ndarray) -> Words:
    size = len(raw)
    if not size:
        e, c = np.zeros(0, np.int64), np.zeros(len(rows) - 1, np.int64)
        return Words(first, c, np.zeros(0, _U), e, e, raw, rows)
    is_word = table[raw]
    cut = rows[1:-1]
    cut = cut[(cut > 0) & (cut < size)]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    begins[cut] = is_word[cut]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    ends[cut - 1] = is_word[cut - 1]
    s = np.flatnonzero(begins)
    e = np.flatnonzero(ends) + 1
    pw, inv = _power_tables(size + 1)
    h = np.zeros(size + 1, _U)
    np.cumsum(_BYTE[raw] * pw[:size], dtype=_U, out=h[1:])
    hashes = mix((h[e] - h[s]) * inv[s] + (e - s).astype(_U))
    counts = np.diff(np.searchsorted(s, rows))
    return Words(first, counts, hashes, s, e, raw, rows)


def ngrams(w: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of the k-word windows, in order.  ``short``: a row of fewer words,
    but not none, has one window of all its words."""
    h = w.hashes
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    n = len(h) - k + 1
    if n > 0:
        g = h[:n].copy()
        for j in range(1, k):
            g = g * _U(0xA0761D6478BD642F) + h[j:j + n]
        ok = row[:n] == row[k - 1:]
        g, r = mix(g[ok], k), row[:n][ok]
    else:
        g, r = np.zeros(0, _U), np.zeros(0, np.int64)
    if short:
        at = np.flatnonzero((w.counts > 0) & (w.counts < k))
        if len(at):
            off = w.offsets
            extra = np.empty(len(at), _U)
            for x, i in enumerate(at):
                v = h[off[i]:off[i + 1]]
                a = v[:1].copy()
                for j in range(1, len(v)):
                    a = a * _U(0xA0761D6478BD642F) + v[j:j + 1]
                extra[x] = mix(a, 100 + len(v))[0]
            g, r = np.concatenate([g, extra]), np.concatenate([r, at])
            order = np.argsort(r, kind="stable")
            g, r = g[order], r[order]
    return g, r


def prefix_hashes(w: Words, k: int) -> np.ndarray:
    """Hash of the first k bytes of every word (of fewer bytes: whatever follows; check the size)."""
    size = len(w.data)
    pw, inv = _power_tables(size + 1)
    h = np.zeros(size + 1, _U)
    np.cumsum(_BYTE[w.data] * pw[:size], dtype=_U, out=h[1:])
    return (h[np.minimum(w.starts + k, size)] - h[w.starts]) * inv[w.starts]


def row_sets(g: np.ndarray, r: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending, and the row offsets; ``r`` must not fall."""
    off = np.searchsorted(r, np.arange(n_rows + 1))
    g = g.copy()
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        if j - i > 1:
            g[i:j].sort()
    if len(g):
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, r = g[keep], r[keep]
        off = np.searchsorted(r, np.arange(n_rows + 1))
    return g, off


def distinct_sorted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs (by sorting)."""
    g = np.sort(g)
    if not len(g):
        return g, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.diff(np.append(first, len(g)))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
