"""Words and n-grams of whole Arrow batches as NumPy arrays over the UTF-8 bytes.

A batch is cut into blocks of a few megabytes, so memory follows the block and not the batch; a text
longer than that is a block of its own. All classes used here are decided by single bytes: the word
patterns name ASCII characters only, and every byte of a longer UTF-8 sequence is above them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 4 << 20

_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (
    _U(0x9E3779B185EBCA87),
    _U(0xC2B2AE3D27D4EB4F),
    _U(0x165667B19E3779F9),
    _U(0x85EBCA77C2B2AE63),
    _U(0x27D4EB2F165667C5),
)


def byte_class(members: bytes, negate: bool = False) -> np.ndarray:
    """A lookup table over bytes: True for ``members``, or for all others."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return ~table if negate else table


#: Everything but ASCII blanks.
NOT_BLANK = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d", negate=True)
#: Letters, digits and everything outside ASCII, once A-Z are lower case.
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), negate=True)
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Block:
    """The texts of rows ``lo`` to ``hi`` of a batch, one after the other."""

    lo: int
    hi: int
    data: np.ndarray
    #: Where each text starts, and the end of the last.
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


@dataclass
class Words:
    #: First byte and length of each word, and the row of the block that it belongs to.
    starts: np.ndarray
    lengths: np.ndarray
    row: np.ndarray
    #: Index of the first word of each row, and the number of all words.
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    raw, at = text_column(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def words(block: Block, data: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of the class ``inside``; a word never crosses texts."""
    mask = inside[data]
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    edges = block.offsets[:-1][np.diff(block.offsets) > 0]
    begin[edges] = mask[edges]
    last = edges[1:] - 1
    end[last] = mask[last]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, block.offsets)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    return Words(starts, np.flatnonzero(end) + 1 - starts, row, first)


def spaced(data: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words joined by one space each, and where each starts. A run of words is one slice."""
    total = int(found.lengths.sum())
    out = np.full(total + len(found.starts), 0x20, dtype=np.uint8)
    before = np.cumsum(found.lengths) - found.lengths
    source = np.arange(total) + np.repeat(found.starts - before, found.lengths)
    number = np.arange(len(found.starts))
    out[np.arange(total) + np.repeat(number, found.lengths)] = data[source]
    return out, before + number


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of ``data``.

    Short slices, nearly all there are, go through the algorithm side by side, one group for each
    length; slices of 32 bytes and more go through the library one by one.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    size = np.minimum(lengths, 32).astype(np.uint8)
    order = np.argsort(size, kind="stable")
    bounds = np.searchsorted(size[order], np.arange(34))
    for length in range(32):
        picked = order[bounds[length] : bounds[length + 1]]
        if not len(picked):
            continue
        at = starts[picked]
        h = np.full(len(picked), (seed + int(_P5) + length) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        done = 0
        while length - done >= 8:
            h ^= _rotl(eight[at + done] * _P2, 31) * _P1
            h = _rotl(h, 27) * _P1 + _P4
            done += 8
        if length - done >= 4:
            h ^= four[at + done].astype(np.uint64) * _P1
            h = _rotl(h, 23) * _P2 + _P3
            done += 4
        while done < length:
            h ^= padded[at + done].astype(np.uint64) * _P5
            h = _rotl(h, 11) * _P1
            done += 1
        h ^= h >> _U(33)
        h *= _P2
        h ^= h >> _U(29)
        h *= _P3
        out[picked] = h ^ (h >> _U(32))
    long = order[bounds[32] :]
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        one = xxhash.xxh64_intdigest
        ends = (starts[long] + lengths[long]).tolist()
        out[long] = [one(view[a:b], seed) for a, b in zip(starts[long].tolist(), ends)]
    return out


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; 0 where a row has none."""
    out = np.zeros(len(first) - 1, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], dtype=out.dtype)
    return out
