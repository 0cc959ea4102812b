"""Words and shingles of Arrow string columns as numpy arrays, without Python strings.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. The hash of a word of SHORT bytes at most is a
polynomial over random 64-bit letters modulo 2**64 with an odd base, so it comes from a running sum; a mixer spreads it. Such a
polynomial says little about long regular strings (it is 0 for differences like the Thue-Morse word of 1024 letters), so longer words,
which are rare, are hashed one by one with a keyed BLAKE2. Equal words have equal hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_LETTERS = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_LETTERS[65:91] = _LETTERS[97:123]
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words whose hash is a polynomial.
SHORT = 32
_KEY = b"words"
#: Bytes that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), U)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 2**64))
        k += m
    return out[:n]


class _Powers:
    up = powers(_BASE, CHUNK + 1)
    down = powers(_INVERSE, CHUNK + 1)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        return (cls.up, cls.down) if n <= len(cls.up) else (powers(_BASE, n), powers(_INVERSE, n))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about so many bytes."""
    raw, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each row and the end) for rows that start at `at`. Rows never share a word."""
    n = len(raw)
    inside = _IS_WORD[raw]
    starts = np.empty(n, bool)
    if n:
        starts[0] = inside[0]
        np.logical_and(inside[1:], ~inside[:-1], out=starts[1:])
        cut = at[1:-1][(at[1:-1] < n) & (at[1:-1] > 0)]
        starts[cut] = inside[cut]
    begin = np.flatnonzero(starts)
    up, down = _Powers.of(n + 1)
    total = np.zeros(n + 1, U)
    letter = _LETTERS[raw]
    letter *= up[:n]
    letter[~inside] = 0
    np.cumsum(letter, out=total[1:])
    # a word's letters are all up to the next word's start
    end = np.append(begin[1:], n)
    h = mix((total[end] - total[begin]) * down[begin])
    if len(begin) and n > SHORT:
        stops = np.zeros(n, bool)
        stops[-1] = inside[-1]
        np.logical_and(inside[:-1], ~inside[1:] | starts[1:], out=stops[:-1])
        last = np.flatnonzero(stops) + 1
        for i in np.flatnonzero(last - begin > SHORT).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : last[i]].tobytes().lower(), digest_size=8, key=_KEY).digest(), "little")
    return h, np.searchsorted(begin, at)


def normalised(text: bytes) -> bytes:
    """Words of a text, A-Z as a-z, with a blank between: equal for equal sequences of words only."""
    return b" ".join(text.lower().split())


def real_shingles(text: bytes, k: int) -> set:
    """The shingles themselves, as tuples of words."""
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each row and the end) of k-word shingles; a row with fewer words has its whole sequence as one, an empty row none."""
    n, rows = len(h), len(first) - 1
    count = np.diff(first)
    if n == 0:
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    roll = h.copy()
    for j in range(1, k):
        roll *= U(_STEP)
        roll[: max(n - j, 0)] += h[j:]
    short = np.flatnonzero((count > 0) & (count < k))
    out_n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(out_n)])
    # places of shingles: all words but the last k-1 of each row
    take = np.ones(n, bool)
    for j in range(1, k):
        last = first[1:][count >= j] - j
        take[last] = False
    take[first[:-1][short]] = True
    out = mix(roll)
    for i in short:
        x = 0
        for v in h[first[i] : first[i + 1]]:
            x = (x * _STEP + int(v)) % 2**64
        out[first[i]] = mix(np.array([(x + 0xABCDEF * int(count[i])) % 2**64], U))[0]
    return out[take], ends


def row_sets(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and where rows end."""
    parts, size = [], np.zeros(len(ends), np.int64)
    for i in range(len(ends) - 1):
        v = np.sort(values[ends[i] : ends[i + 1]])
        if len(v) > 1:
            v = v[np.concatenate([[True], v[1:] != v[:-1]])]
        parts.append(v)
        size[i + 1] = len(v)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.cumsum(size)
