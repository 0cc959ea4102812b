"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's rule, in numpy."""

from __future__ import annotations

import numpy as np

from ._words import U

#: A suffix array's text has at most so many bytes, so that two ranks and a place fit one word.
PLACE_BITS = 21
MOST = (1 << PLACE_BITS) - 1
_FIRST = 8


def _eights(raw: np.ndarray, n: int, kind: str) -> np.ndarray:
    """The eight bytes from each of n places on as one number; zeros follow the text."""
    padded = np.zeros(n + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(n, kind, padded, strides=(1,)).astype(U)


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank): suffixes ordered by at least their first `depth` bytes. rank is the first place of a suffix's group, so it is equal for equal prefixes.

    Prefixes of 8 bytes are sorted first. Then only groups of more than one suffix are refined, by the ranks of what follows them,
    and the sorted length doubles. A pair of ranks and a place are one 64-bit key, so each refinement is one sort of plain integers;
    suffixes to refine are kept in the order of the text, so their ranks are read one after another.
    """
    n = len(raw)
    if n > MOST:
        raise ValueError("text too long for one suffix array")
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = U(MOST)
    key = _eights(raw, n, ">u8")
    at = np.argsort(key)
    key = key[at]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    waits = np.ones(n, bool)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(head, n))
    rank[at] = np.repeat(head.astype(np.int32), size)
    waits[at[head[size == 1]]] = False
    active, done = np.flatnonzero(waits), _FIRST
    while len(active) and done < depth:
        follow = rank[np.minimum(active + done, n)] + 1
        key = (rank[active].astype(U) << U(2 * PLACE_BITS)) | (follow.astype(U) << U(PLACE_BITS)) | active.astype(U)
        key.sort()
        pair = key >> U(PLACE_BITS)
        head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        old = (pair[head] >> U(PLACE_BITS)).astype(np.int64)
        # a group's ranks go on from its own by how far its pairs stand from its first
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), head, 0))
        size = np.diff(np.append(head, len(key)))
        at = (key & mask).view(np.int64)
        rank[at] = np.repeat((old + head - group).astype(np.int32), size)
        waits[at[head[size == 1]]] = False
        active = active[waits[active]]
        done *= 2
    key = (rank[:n].astype(U) << U(PLACE_BITS)) | np.arange(n, dtype=U)
    key.sort()
    return (key & mask).view(np.int64), rank[:n]


def common_prefixes(raw: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int, chain: int = 64, wanted: np.ndarray | None = None) -> np.ndarray:
    """lcp[r] = common prefix of suffixes sa[r - 1] and sa[r], up to `most` (lcp[0] = 0).

    Kasai: the suffix one place on in the text has at least one less. Chains of `chain` places run side by side, eight bytes a step.
    sa need only be sorted to a depth of `most`: neighbours of equal rank have `most`, and as their order says nothing about the
    suffixes one place on, those start anew. Suffixes that `wanted` leaves out are not measured and have 0, or `most` where tied.
    """
    n = len(raw)
    lcp = np.zeros(n, np.int32)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    word = _eights(raw, n + most + 8, "<u8")
    own = np.zeros(n, np.int32)
    heads = np.arange(0, n, chain)
    length = np.zeros(len(heads), np.int64)
    for t in range(chain):
        i = heads + t
        i = i[i < n]
        # a place that is not measured passes on what is known of it, less one a place
        length = np.maximum(length[: len(i)] - 1, 0)
        b = before[i].astype(np.int64)
        tied = (b >= 0) & (rank[i] == rank[b])
        length[(b < 0) | tied] = 0
        live = (b >= 0) & ~tied
        if wanted is not None:
            live &= wanted[i]
        live = here = np.flatnonzero(live)
        while len(live):
            x, y, k = i[live], b[live], length[live]
            room = np.minimum(n - np.maximum(x, y), most) - k
            differ = word[x + k] ^ word[y + k]
            low = differ & (~differ + U(1))
            step = np.where(differ == 0, 8, np.bitwise_count(low - U(1)) >> 3).astype(np.int64)
            length[live] = k + np.minimum(step, np.maximum(room, 0))
            live = live[(step == 8) & (room > 8)]
        own[i[here]] = length[here]
        own[i[tied]] = np.minimum(most, n - np.maximum(i, b)[tied])
    lcp[1:] = own[sa[1:]]
    return lcp
