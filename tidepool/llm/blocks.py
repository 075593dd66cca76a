"""Vectorised work on blocks of whole texts, as UTF-8 bytes.

A block holds the texts of several rows end to end, at most ``limit`` bytes unless a single text is
longer, so a worker's memory follows the block and the longest text, never the partition. Bytes of
multi-byte characters are 0x80 and above, so ASCII classes decide word limits exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
#: Odd multipliers, invertible modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def byte_class(members: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of text whose A-Z are lower-cased.
PLAIN = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Block:
    """Texts end to end: ``data`` (uint8) and ``offsets`` (rows + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(held, dtype=np.uint8)[ends[0] : ends[-1]] if held is not None and len(held) else np.zeros(0, np.uint8)
        return cls(data, ends - ends[0])

    def lowered(self) -> Block:
        return Block(LOWER[self.data], self.offsets)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each code point (its bytes), and the index of each row's first among them (rows + 1)."""
        starts = np.flatnonzero((self.data & 0xC0) != 0x80)
        if len(starts) == len(self.data):
            return self.data.astype(np.uint32), self.offsets
        out = self.data[starts].astype(np.uint32)
        sizes = np.diff(np.append(starts, len(self.data)))
        for k in (1, 2, 3):
            more = np.flatnonzero(sizes > k)
            out[more] |= self.data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
        return out, np.searchsorted(starts, self.offsets)

    def total(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array for each row."""
        run = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the index of each row's first word (rows + 1)."""
        inside = table[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def joined(self, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Words end to end, each followed by a space, and where each begins (words + 1)."""
        at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        out = np.full(int(at[-1]), 0x20, np.uint8)
        if len(starts):
            edges = np.zeros(len(self.data) + 1, np.int8)
            edges[starts] += 1
            np.subtract.at(edges, ends, 1)
            where = np.flatnonzero(np.cumsum(edges[:-1], dtype=np.int8))
            out[where + np.repeat(at[:-1] - starts, ends - starts)] = self.data[where]
        return out.tobytes(), at

    def rolling(self) -> np.ndarray:
        """Prefix sums of a polynomial hash; see ``span_hash``."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(len(self.data))[0], out=out[1:])
        return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    both = []
    for factor in (BASE, inverse):
        line = np.full(size, factor, np.uint64)
        line[0] = 1
        both.append(np.cumprod(line, dtype=np.uint64))
    return both[0], both[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def span_hash(rolling: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes between starts and ends, alike for equal bytes in any block."""
    down = powers(len(rolling))[1]
    return mixed((rolling[ends] - rolling[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chained(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of n consecutive words that stay in a row, and the word each begins with."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.repeat(first[1:], np.diff(first))  # end of the row of each word
    at = np.flatnonzero(np.arange(len(hashes)) + n <= last)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = (h + hashes[at + k]) * BASE
    return mixed(h), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key stands at least twice."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.zeros(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def split(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Cuts record batches so that the texts of each piece stay under the limit, or are a single one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), limit, side="right")
            to = min(batch.num_rows, at + max(1, int(room)))
            piece = batch.slice(at, to - at)
            yield piece, Block.of(piece.column(column))
            at = to
