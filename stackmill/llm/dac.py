"""Directly addressable codes: ids split into byte-wide levels with continuation bitmaps and rank directories.

Level k holds the k-th lowest byte of every id that has one. A bitmap of level k says whether the id goes on in level
k + 1; its place there is the number of set bits before it, found from a directory that holds the count before every
512 bits and the set bits of one block. So any id is read in one step a level, without decoding what lies before it.

Layout, little-endian: magic ``DAC1``, number of levels (uint32), ids (uint64); then for every level its number of bytes
(uint64), the bytes, the bitmap (padded to whole 64-byte blocks) and the directory (uint64 for each block). The last
level has neither bitmap nor directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK_BITS = 512


def encode(ids: np.ndarray) -> bytes:
    """ids: unsigned, at most 64 bits; an empty array is stored as no levels."""
    rest = np.ascontiguousarray(ids, np.uint64)
    levels = []
    while len(rest):
        low, rest = (rest & np.uint64(0xFF)).astype(np.uint8), rest >> np.uint64(8)
        more = rest > 0
        levels.append((low, more))
        rest = rest[more]
    out = [MAGIC, struct.pack("<IQ", len(levels), len(ids))]
    for k, (low, more) in enumerate(levels):
        out += [struct.pack("<Q", len(low)), low.tobytes()]
        if k + 1 < len(levels):
            bits = np.packbits(np.pad(more, (0, -len(more) % BLOCK_BITS)), bitorder="little")
            counts = np.bitwise_count(bits.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.uint64)
            out += [bits.tobytes(), (np.cumsum(counts, dtype=np.uint64) - counts).astype("<u8").tobytes()]
    return b"".join(out)


class Codes:
    """Random access to an encoded sequence; the buffer is viewed, not copied."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC block")
        count, self.size = struct.unpack_from("<IQ", data, 4)
        at, self.levels = 16, []
        for k in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            low = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if k + 1 < count:
                blocks = -(-n // BLOCK_BITS)
                bits = np.frombuffer(data, np.uint8, blocks * BLOCK_BITS // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u8", blocks, at)
                at += blocks * 8
            self.levels.append((low, bits, ranks))

    def __len__(self) -> int:
        return self.size

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's count, then the bytes of the block before the place, then its byte."""
        block = at // BLOCK_BITS
        inside = np.bitwise_count(bits.reshape(-1, BLOCK_BITS // 8)[block])
        byte = (at % BLOCK_BITS) // 8
        whole = np.where(np.arange(BLOCK_BITS // 8) < byte[:, None], inside, 0).sum(axis=1, dtype=np.int64)
        last = np.bitwise_count(bits[at // 8] & ((1 << (at % 8)) - 1).astype(np.uint8))
        return ranks[block].astype(np.int64) + whole + last

    def take(self, places) -> np.ndarray:
        """The ids at any places, in any order, each found by itself."""
        at = np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.size):
            raise IndexError("no such place")
        out, index = np.zeros(len(at), np.uint64), np.arange(len(at))
        for k, (low, bits, ranks) in enumerate(self.levels):
            out[index] |= low[at].astype(np.uint64) << np.uint64(8 * k)
            if bits is None:
                break
            more = (bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 > 0
            at, index = self._rank(bits, ranks, at[more]), index[more]
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end: a run stays a run in every level, so one rank a level is enough."""
        n = end - start
        if not 0 <= start <= end <= self.size:
            raise IndexError("no such run")
        out, index = np.zeros(n, np.uint64), np.arange(n)
        for k, (low, bits, ranks) in enumerate(self.levels):
            if not n:
                break
            out[index] |= low[start : start + n].astype(np.uint64) << np.uint64(8 * k)
            if bits is None:
                break
            first = start // 8
            more = np.unpackbits(bits[first : -(-(start + n) // 8)], bitorder="little")[start - first * 8 :][:n] > 0
            start, index = int(self._rank(bits, ranks, np.array([start]))[0]), index[more]
            n = len(index)
        return out
