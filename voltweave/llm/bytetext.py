"""Vectorised work on the UTF-8 bytes of many documents at once.

A Block holds the bytes of some whole documents back to back. Words, lines and windows are found with
numpy over the whole block and never cross a document's end. Strings are identified by 64-bit
fingerprints: a polynomial over the bytes, finished by an avalanche mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of one block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(m, base, U64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums from which fingerprint() takes any range; a leading zero included."""
    up, _ = _power(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=out[1:])
    return out


def fingerprint(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each range of what prefix() has summed; equal contents give equal values."""
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


#: A second, unrelated value for each byte; prints from it fail independently of the first.
SECOND = np.random.Generator(np.random.PCG64(29)).integers(1, 1 << 63, 256).astype(np.uint64)


def bytes_prefix(buf: np.ndarray, second: bool = False) -> np.ndarray:
    return prefix(SECOND[buf] if second else buf.astype(U64) + U64(1))


@dataclass
class Block:
    """ids: an Arrow array, one entry a document; buf: all bytes; at: where each document starts, and the end."""

    ids: pa.Array
    buf: np.ndarray
    at: np.ndarray
    first: int
    batch: pa.RecordBatch

    def __len__(self) -> int:
        return len(self.at) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name).slice(self.first, len(self))

    def documents(self, where: np.ndarray) -> np.ndarray:
        """The document of each byte position."""
        return np.searchsorted(self.at, where, side="right") - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its entries; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, key: str = "doc_id", text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    if not batch.num_rows:
        return
    buf, at = text_bytes(batch.column(text))
    ids, first = batch.column(key), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, batch.num_rows)
        yield Block(ids.slice(first, last - first), buf[at[first] : at[last]], at[first : last + 1] - at[first], first, batch)
        first = last


@dataclass
class Words:
    """start, end: byte ranges; at: the first word of each document, and the end; doc: the document of each word."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def words(block: Block, separator: np.ndarray = SPACE) -> Words:
    inside = np.zeros(len(block.buf) + 1, bool)
    np.logical_not(separator[block.buf], out=inside[:-1])
    before = np.zeros(len(block.buf) + 1, bool)
    before[1:] = inside[:-1]
    cut = block.at[(block.at > 0) & (block.at < len(block.buf))]
    begins = inside & ~before
    begins[cut] = inside[cut]
    ends = before & ~inside
    ends[cut] |= before[cut]
    start = np.flatnonzero(begins[:-1])
    return Words(start, np.flatnonzero(ends), np.searchsorted(start, block.at))


def word_hashes(block: Block, found: Words, lower: bool = False, second: bool = False) -> np.ndarray:
    return fingerprint(bytes_prefix(LOWER[block.buf] if lower else block.buf, second), found.start, found.end)


def windows(found: Words, size: int) -> np.ndarray:
    """Every word at which a window of so many words of one document starts."""
    last = np.repeat(found.at[1:], np.diff(found.at))
    return np.flatnonzero(np.arange(len(found)) + size <= last)


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in at least one range."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    d = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def per_document(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1 ... for length[0] entries, then the next, in one array."""
    total = int(length.sum())
    skip = np.cumsum(length) - length
    return np.repeat(start - skip, length) + np.arange(total)
