"""Rolling byte fingerprints and winnowed anchors of byte arrays."""

from __future__ import annotations

import numpy as np

from ._words import U, _Powers, mix

_rng = np.random.default_rng(77)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


class Rolling:
    """Fingerprints of substrings of one byte array, from one running sum. Equal bytes have equal fingerprints, wherever they stand."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.n = n
        up, self.down = _Powers.of(n + 1)
        self.total = np.zeros(n + 1, U)
        letters = _BYTES[raw]
        letters *= up[:n]
        np.cumsum(letters, out=self.total[1:])

    def grams(self, k: int) -> np.ndarray:
        """Of every k bytes, by start."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, U)
        x = self.total[k:] - self.total[:m]
        x *= self.down[:m]
        return mix(x)

    def at(self, start: np.ndarray, k: int) -> np.ndarray:
        return mix((self.total[start + k] - self.total[start]) * self.down[start])


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by start, in log2(w) passes."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (w - size)], out[w - size :]) if w > size else out


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of grams that are least in some run of `window` grams: any two equal stretches of window + k - 1 bytes share one."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    least = window_least(grams, window)
    # a gram is an anchor if the least of some window around it equals it
    padded = np.concatenate([np.zeros(window - 1, U), least, np.zeros(window - 1, U)])
    most = ~window_least(~padded, window)
    return np.flatnonzero(most[: len(grams)] == grams)
