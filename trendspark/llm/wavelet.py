"""A wavelet matrix in one compressed byte string: access, counting and occurrence lookup.

Symbols are numbered by falling count, so that the high planes are nearly empty and pack well. A
plane holds one bit of every symbol's number, highest bit first; below each plane the symbols with a 0
come before those with a 1, in stable order. Planes are cut into blocks of BLOCK bits; a block
is deflated where that makes it smaller, and the directory holds the ones before each block and
where it ends. A lookup opens one block a plane.

Layout, little-endian: magic, n, number of symbols, of planes; symbols (u4); directory of each
plane: zeros (u8), ones before each block (u4), end of each block (u4); then the blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"WVM1"
BLOCK = 1 << 16
_HEAD = struct.Struct("<4sQIB")
#: Deflating pays where so few bits are set (or unset).
SPARSE = 0.2


class Plane:
    """Bits with rank and select; opens a block when it is asked for."""

    def __init__(self, n: int, zeros: int, before: np.ndarray, ends: np.ndarray, data: memoryview):
        self.n, self.zeros, self.before, self.ends, self.data = n, zeros, before, ends, data
        self._open: dict[int, np.ndarray] = {}

    def bits(self, block: int) -> np.ndarray:
        """0 and 1 of one block."""
        got = self._open.get(block)
        if got is None:
            size = min(BLOCK, self.n - block * BLOCK)
            raw = self.data[int(self.ends[block - 1]) if block else 0 : int(self.ends[block])]
            raw = raw if len(raw) == (size + 7) // 8 else zlib.decompress(raw)
            got = np.unpackbits(np.frombuffer(raw, np.uint8), count=size)
            self._open = {block: got}  # the last one only: a scan of positions stays in it
        return got

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        block, rest = divmod(i, BLOCK)
        if block == len(self.ends):
            return self.n - self.zeros
        return int(self.before[block]) + int(self.bits(block)[:rest].sum(dtype=np.int64))

    def select(self, bit: int, ks: np.ndarray) -> np.ndarray:
        """Positions of the ks-th (from 0, ascending) bits of this kind."""
        before = self.before.astype(np.int64)
        before = before if bit else np.arange(len(before), dtype=np.int64) * BLOCK - before
        home = np.searchsorted(before, ks, side="right") - 1
        out = np.empty(len(ks), np.int64)
        edges = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True]) if len(ks) else [0]
        for s, e in zip(edges[:-1], edges[1:]):
            block = int(home[s])
            out[s:e] = np.flatnonzero(self.bits(block) == bit)[ks[s:e] - before[block]] + block * BLOCK
        return out


class WaveletMatrix:
    def __init__(self, n: int, symbols: np.ndarray, planes: list[Plane]):
        self.n, self.symbols, self.planes = n, symbols, planes
        self._number = None

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        """The byte string of a sequence of ids (unsigned, under 2**32)."""
        ids = np.asarray(ids, np.uint32)
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        symbols = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint32)
        levels = max(1, int(len(symbols) - 1).bit_length()) if len(symbols) else 0
        number = np.zeros(len(counts), np.uint16 if levels <= 16 else np.uint32)
        number[symbols] = np.arange(len(symbols), dtype=number.dtype)
        codes = number[ids]
        tables, blocks = [], []
        for level in reversed(range(levels)):
            bit = (codes & (1 << level)).astype(bool)
            zeros = len(ids) - int(np.count_nonzero(bit))
            below = np.empty_like(codes)
            before, ends, at, ones = [], [], 0, 0
            for start in range(0, len(ids), BLOCK):
                own, code = bit[start : start + BLOCK], codes[start : start + BLOCK]
                one = np.flatnonzero(own)  # taking by places is several times as fast as by masks
                part = np.packbits(own).tobytes()
                if min(len(one), len(own) - len(one)) < SPARSE * len(own):
                    small = zlib.compress(part, 1)
                    part = small if len(small) < len(part) else part
                at += len(part)
                before.append(ones)
                ends.append(at)
                blocks.append(part)
                below[start - ones : start - ones + len(own) - len(one)] = code[np.flatnonzero(~own)]
                below[zeros + ones : zeros + ones + len(one)] = code[one]
                ones += len(one)
            tables.append(struct.pack("<Q", zeros) + np.array(before, "<u4").tobytes() + np.array(ends, "<u4").tobytes())
            codes = below
        return b"".join([_HEAD.pack(MAGIC, len(ids), len(symbols), levels), symbols.astype("<u4").tobytes(), *tables, *blocks])

    @classmethod
    def load(cls, data: bytes) -> WaveletMatrix:
        magic, n, many, levels = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        view, at = memoryview(data), _HEAD.size
        symbols = np.frombuffer(view, "<u4", many, at)
        at += 4 * many
        count = -(-n // BLOCK)
        heads = []
        for _ in range(levels):
            (zeros,) = struct.unpack_from("<Q", data, at)
            heads.append((zeros, np.frombuffer(view, "<u4", count, at + 8), np.frombuffer(view, "<u4", count, at + 8 + 4 * count)))
            at += 8 + 8 * count
        planes = []
        for zeros, before, ends in heads:
            size = int(ends[-1]) if count else 0
            planes.append(Plane(n, zeros, before, ends, view[at : at + size]))
            at += size
        return cls(n, symbols, planes)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane says which of its two halves a symbol came from."""
        codes = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            up = np.empty_like(codes)
            for block, ones in enumerate(plane.before.tolist()):
                own, start = plane.bits(block).view(bool), block * BLOCK
                into, one, zero = up[start : start + BLOCK], np.flatnonzero(own), np.flatnonzero(~own)
                into[zero] = codes[start - ones : start - ones + len(zero)]
                into[one] = codes[plane.zeros + ones : plane.zeros + ones + len(one)] | codes.dtype.type(1 << level)
            codes = up
        return self.symbols[codes] if self.n else np.zeros(0, np.uint32)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for plane in self.planes:
            bit = int(plane.bits(i // BLOCK)[i % BLOCK])
            ones = plane.rank1(i)
            i = plane.zeros + ones if bit else i - ones
            code = 2 * code + bit
        return int(self.symbols[code])

    def _range(self, symbol: int, end: int) -> tuple[int, int, int] | None:
        """(code, start, end) of the symbol's occurrences before position `end`, in the order below the last plane."""
        if self._number is None:
            self._number = {int(x): k for k, x in enumerate(self.symbols)}
        code = self._number.get(symbol)
        if code is None:
            return None
        start = 0
        for level, plane in zip(reversed(range(len(self.planes))), self.planes):
            a, b = plane.rank1(start), plane.rank1(end)
            start, end = (plane.zeros + a, plane.zeros + b) if code >> level & 1 else (start - a, end - b)
        return code, start, end

    def rank(self, symbol: int, i: int | None = None) -> int:
        """Occurrences of an id before position i (in all)."""
        got = self._range(symbol, self.n if i is None else max(0, min(i, self.n)))
        return got[2] - got[1] if got else 0

    def select(self, symbol: int, ks: np.ndarray | None = None) -> np.ndarray:
        """Positions of the ks-th occurrences (from 0, ascending; all of them by default)."""
        got = self._range(symbol, self.n)
        if not got:
            return np.zeros(0, np.int64)
        code, start, end = got
        at = np.arange(start, end, dtype=np.int64) if ks is None else start + np.asarray(ks, np.int64)
        if len(at) and (at[-1] >= end or at[0] < start):
            raise IndexError("fewer occurrences")
        for level, plane in enumerate(reversed(self.planes)):
            at = plane.select(1, at - plane.zeros) if code >> level & 1 else plane.select(0, at)
        return at
