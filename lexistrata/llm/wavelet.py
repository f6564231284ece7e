"""Wavelet matrix of token ids in one compressed file.

File: magic, then compressed blocks, then a JSON directory, its length (8 bytes,
little-endian) and the magic again. Plane k holds bit k (from the top) of all
ids, stably partitioned by the bits before it; planes are cut into blocks of
``BLOCK`` bits, each compressed by itself, and the directory has the ones before
each block. So access, rank, select and counting decompress a few blocks only.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

MAGIC = b"LXWAVE1\n"
BLOCK = 1 << 18


def planes(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes from the top bit down, and the zeros of each."""
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    out, zeros = [], []
    for k in range(bits - 1, -1, -1):
        one = (x & x.dtype.type(1 << k)) != 0
        out.append(np.packbits(one, bitorder="little"))
        low = np.compress(~one, x)  # far faster than a boolean index
        zeros.append(len(low))
        x = np.concatenate([low, np.compress(one, x)])
    return out, zeros


def unplane(packed: list[np.ndarray], zeros: list[int], n: int) -> np.ndarray:
    """All ids again, from the last plane up."""
    bits = len(packed)
    kind = np.uint16 if bits <= 16 else np.uint32
    cur = np.zeros(n, kind)
    for level in range(bits - 1, -1, -1):
        one = np.unpackbits(packed[level], count=n, bitorder="little").view(bool)
        before = np.empty(n, kind)
        z = zeros[level]
        before[np.flatnonzero(~one)] = cur[:z]
        before[np.flatnonzero(one)] = cur[z:] | kind(1 << (bits - 1 - level))
        cur = before
    return cur


def encode_file(ids: np.ndarray, bits: int, extra: dict, tail: bytes) -> bytes:
    """The whole file; ``extra`` goes into the directory, ``tail`` is a blob of its own."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    packed, zeros = planes(ids, bits)
    parts, at, blocks = [MAGIC], len(MAGIC), []
    for plane in packed:
        row, ones = [], 0
        for a in range(0, len(plane), BLOCK // 8):
            piece = plane[a : a + BLOCK // 8]
            data = squeeze(piece.tobytes())
            row.append([at, len(data), ones])
            ones += int(np.bitwise_count(piece).sum())
            parts.append(data)
            at += len(data)
        blocks.append(row)
    data = squeeze(tail)
    parts.append(data)
    directory = {"n": len(ids), "bits": bits, "zeros": zeros, "blocks": blocks, "tail": [at, len(data)], **extra}
    text = zlib.compress(json.dumps(directory).encode(), 1)
    parts += [text, struct.pack("<Q", len(text)), MAGIC]
    return b"".join(parts)


class WaveletFile:
    """Reader over a seekable file object."""

    def __init__(self, f, size: int):
        import zstandard

        self.f = f
        self._expand = zstandard.ZstdDecompressor().decompress
        f.seek(size - 16)
        end = f.read(16)
        if end[8:] != MAGIC:
            raise ValueError("not a wavelet file")
        length = struct.unpack("<Q", end[:8])[0]
        f.seek(size - 16 - length)
        self.dir = json.loads(zlib.decompress(f.read(length)))
        self.n, self.bits = self.dir["n"], self.dir["bits"]
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _bytes(self, at: int, length: int) -> bytes:
        self.f.seek(at)
        return self._expand(self.f.read(length))

    def tail(self) -> bytes:
        return self._bytes(*self.dir["tail"])

    def all(self) -> np.ndarray:
        packed = [np.frombuffer(b"".join(self._bytes(a, n) for a, n, _ in row), np.uint8) for row in self.dir["blocks"]]
        return unplane(packed, self.dir["zeros"], self.n)

    def _block(self, level: int, k: int) -> np.ndarray:
        key = level, k
        if key not in self._held:
            if len(self._held) >= 64:
                self._held.clear()
            at, length, _ = self.dir["blocks"][level][k]
            self._held[key] = np.unpackbits(np.frombuffer(self._bytes(at, length), np.uint8), bitorder="little")
        return self._held[key]

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        if i >= self.n:
            return self.n - self.dir["zeros"][level]
        k, r = divmod(i, BLOCK)
        return self.dir["blocks"][level][k][2] + int(self._block(level, k)[:r].sum())

    def access(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            ones = self._rank1(level, i)
            i = self.dir["zeros"][level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where occurrences of ``token`` before position i begin and end after the last plane."""
        a = 0
        for level in range(self.bits):
            x, y = self._rank1(level, a), self._rank1(level, i)
            if token >> (self.bits - 1 - level) & 1:
                a, i = self.dir["zeros"][level] + x, self.dir["zeros"][level] + y
            else:
                a, i = a - x, i - y
        return a, i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position i."""
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k (from 0)."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError("no such occurrence")
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.dir["zeros"][level] if bit else i)
        return i

    def _select(self, level: int, bit: int, k: int) -> int:
        row = self.dir["blocks"][level]
        before = [r[2] if bit else j * BLOCK - r[2] for j, r in enumerate(row)]
        j = int(np.searchsorted(before, k, "right")) - 1
        return j * BLOCK + int(np.flatnonzero(self._block(level, j) == bit)[k - before[j]])

    def locate(self, token: int) -> list[int]:
        """All positions of ``token``."""
        return [self.select(token, k) for k in range(self.count(token))]
