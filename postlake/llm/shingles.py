"""Word-shingle hashing of many texts at once, on NumPy arrays."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for name, base in (("p", _P), ("i", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every word of the UTF-8 texts; start and end count bytes within the text.

    A word is a run of bytes other than ASCII white space; with lower, A-Z count as a-z.
    """
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white)).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    p, inverse = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * p[: len(data)], dtype=np.uint64)))
    h = mix((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner = np.searchsorted(starts, first, side="right") - 1
    return h, owner, first - starts[owner], end - starts[owner]


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive words; of all words as one where there are fewer; none without words."""
    if len(h) == 0:
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + h[i : len(h) - k + 1 + i])
    return out


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, owner, _, _ = word_hashes(texts)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(shingle_hashes(h[a:b], n)) for a, b in zip(at[:-1], at[1:])]
