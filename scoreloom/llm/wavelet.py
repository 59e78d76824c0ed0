"""A wavelet matrix in one compressed file.

Layout: magic, header length (uint32), JSON header, then zstd blocks. Each bit plane is
stored in blocks of BLOCK_BITS bits, each compressed alone; the header keeps, per plane, its
number of zeros, and per block its place and the ones before it. So a single token, a count
or an occurrence costs one or two blocks per plane, not the file. The documents' ids and
lengths are one more block.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"SLWM1\n"
BLOCK_BITS = 1 << 18


def build(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, bits: int | None = None) -> bytes:
    """File content for the ids of some documents, one after another."""
    n, pack = len(ids), zstandard.ZstdCompressor(level=1).compress
    bits = bits or max(1, int(ids.max()).bit_length() if n else 1)
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, blocks, at = [], [], 0

    def put(raw: bytes) -> list[int]:
        nonlocal at
        blocks.append(pack(raw))
        at += len(blocks[-1])
        return [at - len(blocks[-1]), len(blocks[-1])]

    for b in range(bits - 1, -1, -1):
        bit = (cur >> b & 1).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        step = BLOCK_BITS // 8
        parts = [packed[i : i + step] for i in range(0, len(packed), step)]
        ones = np.cumsum([0] + [int(np.bitwise_count(p).sum()) for p in parts]).tolist()
        planes.append({"zeros": n - ones[-1], "ones": ones, "at": [put(p.tobytes()) for p in parts]})
        cur = np.concatenate((cur[np.flatnonzero(~bit)], cur[np.flatnonzero(bit)]))
    docs = put(json.dumps(doc_ids).encode() + b"\n" + np.asarray(lengths, "<i8").tobytes())
    head = json.dumps({"n": n, "bits": bits, "planes": planes, "docs": docs, "n_docs": len(doc_ids)}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(blocks)


class WaveletMatrix:
    """Random access, counting and occurrence lookup over the bytes of one file."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", data[len(MAGIC) : len(MAGIC) + 4])
        self.head = json.loads(bytes(data[len(MAGIC) + 4 : len(MAGIC) + 4 + size]))
        self.body = data[len(MAGIC) + 4 + size :]
        self.n, self.bits, self.planes = self.head["n"], self.head["bits"], self.head["planes"]
        self._block = lru_cache(maxsize=4 * self.bits)(self._read_block)

    def _raw(self, place: list[int]) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.body[place[0] : place[0] + place[1]])

    def _read_block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        bit = np.unpackbits(np.frombuffer(self._raw(self.planes[plane]["at"][block]), np.uint8), bitorder="little")
        return bit, np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before position i."""
        p, (block, rest) = self.planes[plane], divmod(i, BLOCK_BITS)
        if not rest:
            return p["ones"][block]
        return p["ones"][block] + int(self._block(plane, block)[1][rest])

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        before = np.asarray(self.planes[plane]["ones"])
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK_BITS, self.n) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        values = self._block(plane, block)[0]
        return block * BLOCK_BITS + int(np.flatnonzero(values == bit)[k - before[block]])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, p in enumerate(self.planes):
            bit = int(self._block(k, i // BLOCK_BITS)[0][i % BLOCK_BITS])
            one = self._rank1(k, i)
            i = p["zeros"] + one if bit else i - one
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for k, p in enumerate(self.planes):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (p["zeros"] + a, p["zeros"] + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """How often the token stands before position `end`."""
        if token >> self.bits:
            return 0
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        if token >> self.bits or not 0 <= k < self.rank(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self._select(plane, bit, i - self.planes[plane]["zeros"] if bit else i)
        return i

    def documents(self) -> tuple[list, np.ndarray]:
        doc_ids, _, lengths = self._raw(self.head["docs"]).partition(b"\n")
        return json.loads(doc_ids), np.frombuffer(lengths, "<i8")

    def all_ids(self) -> np.ndarray:
        """Every id in order: the stable partitions undone from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            raw = b"".join(self._raw(x) for x in self.planes[k]["at"])
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").astype(bool)
            up, zeros = np.empty_like(cur), self.planes[k]["zeros"]
            up[np.flatnonzero(~bit)] = cur[:zeros]
            up[np.flatnonzero(bit)] = cur[zeros:] | kind(1 << (self.bits - 1 - k))
            cur = up
        return cur.astype(np.uint32, copy=False)
