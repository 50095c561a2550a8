"""Array code for the words of many texts at once.

A word is a maximal run of bytes other than space, tab, newline, vertical
tab, form feed and carriage return: the pattern ``[^\\x20\\x09-\\x0D]+``.  All
functions work on one Arrow batch, so their memory is bounded by the batch.
Hashes are polynomials modulo 2**64 over random byte values, mixed at the
end; ``stream`` picks one of several independent hash functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

# Random byte values and odd multipliers of three independent hash streams.
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, size=(3, 256), dtype=U64)
_MULTIPLIER = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)]
_ROLL = [U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)]

#: Texts are hashed in pieces of about so many bytes: bounds the work arrays.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


@dataclass
class Texts:
    """The UTF-8 bytes of a column of texts; null texts are empty."""

    data: np.ndarray      # uint8
    offsets: np.ndarray   # int64, one more than there are texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def pieces(self, limit: int = PIECE_BYTES) -> Iterator[tuple[int, "Texts"]]:
        """Consecutive texts of about ``limit`` bytes, with their first index."""
        n, first = len(self), 0
        while first < n:
            last = int(np.searchsorted(self.offsets, self.offsets[first] + limit, "right")) - 1
            last = min(n, max(last, first + 1))
            offsets = self.offsets[first:last + 1]
            yield first, Texts(self.data[offsets[0]:offsets[-1]], offsets - offsets[0])
            first = last


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0]:offsets[-1]], offsets - offsets[0])


@dataclass
class Words:
    """Words in text order: their text, and first and end byte in ``Texts.data``."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def runs(t: Texts, inside: np.ndarray) -> Words:
    """Maximal runs of the marked bytes that lie in one text."""
    n = len(t.data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = t.offsets[:-1]
    before[edges[edges < n]] = False
    edges = t.offsets[1:]
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(np.searchsorted(t.offsets, start, "right") - 1, start, end)


def words(t: Texts) -> Words:
    return runs(t, ~SEPARATOR[t.data])


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, stream: int = 0,
               upto: int | None = None) -> np.ndarray:
    """A hash of each byte span; the spans are in order and don't overlap.
    ``upto`` hashes only so many leading bytes of each span."""
    if not len(start):
        return np.zeros(0, U64)
    stop = end if upto is None else np.minimum(end, start + upto)
    size = stop - start
    span = np.repeat(np.arange(len(start)), size)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(len(span)) - first[span]
    powers = np.multiply.accumulate(np.full(int(size.max()) + 1, _MULTIPLIER[stream], U64))
    value = _BYTE_VALUES[stream][data[at + start[span]]]
    value *= powers[at]
    return mix(np.add.reduceat(value, first) + size.astype(U64))


def word_hashes(t: Texts, streams: tuple[int, ...] = (0,)) -> tuple[np.ndarray, list[np.ndarray]]:
    """The text of each word, and its hash in each stream."""
    owner, hashed = [np.zeros(0, np.int64)], [[np.zeros(0, U64)] for _ in streams]
    for first, piece in t.pieces():
        w = words(piece)
        owner.append(w.text + first)
        for out, stream in zip(hashed, streams, strict=True):
            out.append(hash_spans(piece.data, w.start, w.end, stream))
    return np.concatenate(owner), [np.concatenate(x) for x in hashed]


def window_hashes(word: np.ndarray, length: int, stream: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` consecutive words, by first word."""
    n = len(word) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(length):
        out *= _ROLL[stream]
        out += word[k:k + n]
    return mix(out)


def whole_windows(owner: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each position lies in one text."""
    n = len(owner) - length + 1
    return owner[:n] == owner[length - 1:] if n > 0 else np.zeros(0, bool)


def covered(hit: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window whose first word is marked."""
    depth = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + length, -1)
    return np.cumsum(depth[:n]) > 0
