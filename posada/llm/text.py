"""Vectorised text kernels over Arrow string columns.

Texts are handled as their UTF-8 bytes: a word is a run of ``[^\\x20\\x09-\\x0D]``, so
byte positions are enough to find words, lines and their hashes without building one
Python object for each. Every kernel takes whole texts; a batch is cut between texts into
blocks of about ``BLOCK`` bytes, so that temporaries stay a few tens of megabytes
whatever the batch holds (a single longer text makes a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
ROWS = 1 << 12  # texts that a block holds at most

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64 by rule."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP) + np.uint64(seed))


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # keeps the first k bytes of eight


def part_hash(eights: np.ndarray, number: np.ndarray) -> np.ndarray:
    """What the eight bytes of each number (from 1) in their span add to its hash."""
    return mix(eights ^ mix(number.astype(np.uint64) * np.uint64(STEP) + np.uint64(17)))


@dataclass
class Block:
    """Some whole texts of a batch: their bytes, where each begins, and their rows."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """The number of set bytes in each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def take(self, rows: np.ndarray) -> Block:
        """A block of the given texts only."""
        if len(rows) == self.rows:
            return self
        size = self.offsets[rows + 1] - self.offsets[rows]
        at = np.concatenate(([0], np.cumsum(size)))
        return Block(self.data[np.repeat(self.offsets[rows] - at[:-1], size) + np.arange(at[-1])], at, self.first_row)

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        """The text (counted within the block) that each byte position is in."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def eights(self, lower: bool = False) -> np.ndarray:
        """At each byte the eight bytes from there on as one number (with zeros past the end), optionally with A-Z taken as a-z."""
        n = len(self.data)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = LOWER.take(self.data) if lower else self.data
        return np.ndarray((n + 1,), np.dtype("<u8"), padded.data, 0, (1,))

    @staticmethod
    def head_hash(eights: np.ndarray, size: int) -> np.ndarray:
        """``span_hash`` of the first ``size`` bytes (eight at most) of each of the given eights."""
        return mix((eights & MASK[size]) ^ np.uint64(size * STEP % (1 << 64)))

    def span_hash(self, eights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand.

        A span's hash mixes its length and its first eight bytes; each further eight bytes are mixed with
        their number in the span before they are added, so no arithmetic relation between spans carries over.
        """
        length = end - start
        value = mix((eights[start] & MASK[np.minimum(length, 8)]) ^ length.astype(np.uint64) * np.uint64(STEP))
        more = np.flatnonzero(length > 8)
        if len(more):
            count = (length[more] - 1) // 8
            first = np.cumsum(count) - count
            number = np.arange(first[-1] + count[-1]) - np.repeat(first, count) + 1
            at = np.repeat(start[more], count) + 8 * number
            part = eights[at] & MASK[np.minimum(np.repeat(end[more], count) - at, 8)]
            part = part_hash(part, number)
            value[more] = mix(value[more] + np.add.reduceat(part, first))
        return value


def differ(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the first ``size`` bytes of eight (all of them if size is larger) differ."""
    return (a ^ b) & MASK[np.minimum(size, 8)] != 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, limit: int | None = None) -> Iterator[Block]:
    """The column's texts in blocks of whole texts."""
    data, at = text_bytes(column)
    i, n, limit = 0, len(at) - 1, limit or BLOCK
    while i < n:
        j = int(np.searchsorted(at, at[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + ROWS)
        yield Block(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


@dataclass
class Words:
    """Words of a block: byte span, row within the block, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def spans(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set bytes that don't cross from one text into the next."""
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = block.offsets[:-1] < block.offsets[1:]
    heads, tails = block.offsets[:-1][full], block.offsets[1:][full] - 1
    begins[heads], ends[tails] = inside[heads], inside[tails]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(block: Block, lower: bool = False) -> Words:
    """All words of a block in order, optionally with A-Z taken as a-z."""
    start, end = spans(block, IS_WORD[block.data])
    return Words(start, end, block.row_of(start), block.span_hash(block.eights(lower), start, end))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` successive words within a text, and each run's first word."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(w.row[:n] == w.row[size - 1 :])
    value = np.full(n, np.uint64(size), np.uint64)
    for k, factor in enumerate(seeded(size, 29) | np.uint64(1)):
        value += w.hash[k : k + n] * factor
    return mix(value)[first], first


def word_counts(block: Block, w: Words) -> np.ndarray:
    return np.bincount(w.row, minlength=block.rows).astype(np.int64)


def sorted_sets(rows: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, laid end to end, with offsets by row."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(rows):
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[keep], values[keep]
    return values, np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=count)))).astype(np.int64)


def packed_sets(rows: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``sorted_sets``, for hashes of which 52 bits are enough: row and value sort as one number. ``count`` is ROWS at most."""
    key = np.sort((rows.astype(np.uint64) << np.uint64(52)) | (values >> np.uint64(12)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    size = np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=count)
    return key & np.uint64((1 << 52) - 1), np.concatenate(([0], np.cumsum(size))).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 bits as int64, which is what Spark's long holds."""
    return x.view(np.int64)
