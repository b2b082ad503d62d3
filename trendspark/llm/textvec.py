"""Word and gram hashes of whole batches of texts in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_TABLE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
CHUNK = 2_000_000

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For classifiers: letters, digits and all bytes of longer characters make words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer with good high and low bits; works on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and its inverse modulo 2**64 for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        up, down = np.full(size, _P), np.full(size, _PINV)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[e] - c[s] = the hash of data[s:e] times _P**s."""
    up, _ = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(c))
    return mix((c[end] - c[start]) * down[start])


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """By sorting, which is several times as fast as numpy's hash table on batches of this size."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Slices of the list with about limit bytes, one text at least."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """Words of texts: hash, doc (index of its text), start and end in data; offsets: where each text starts."""

    def __init__(self, texts: list[bytes], gaps: np.ndarray = SPACES, lower: bool = False):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = LOWER[data] if lower else data
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        gap = gaps[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]  # data ends with a gap
        self.hash = span_hash(prefix_hash(self.data), self.start, self.end)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))


def encoded(series) -> list[bytes]:
    """Texts of a pandas column as UTF-8; null is empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else bytes(x) if isinstance(x, (bytes, bytearray)) else b"" for x in series]
