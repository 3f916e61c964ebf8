"""Vectorised word and shingle hashing over Arrow string columns.

A batch of texts is one byte buffer with document offsets. Words are maximal
runs of bytes outside space and 0x09-0x0D; they never cross a document
boundary. Every word gets a 64-bit polynomial hash taken from prefix sums, so
the cost is a few numpy passes over the bytes and no Python loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MULT = 0x9E3779B97F4A7C15            # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULT, -1, 1 << 64)
#: Bytes hashed at a time; a chunk is stretched to the end of its last word.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))


#: Value of each byte in a word hash; in FOLDED, A-Z count as a-z.
PLAIN = _byte_values()
FOLDED = PLAIN.copy()
FOLDED[65:91] = FOLDED[97:123]

_POWERS = np.zeros(0, dtype=np.uint64)
_INVERSES = np.zeros(0, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, kept for reuse."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        m = max(n, CHUNK + (1 << 16))
        with np.errstate(over="ignore"):
            base = np.full(m, _MULT, dtype=np.uint64)
            base[0] = 1
            _POWERS = np.cumprod(base, dtype=np.uint64)
            base = np.full(m, _INVERSE, dtype=np.uint64)
            base[0] = 1
            _INVERSES = np.cumprod(base, dtype=np.uint64)
    return _POWERS[:n], _INVERSES[:n]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]],
            offsets - offsets[0])


@dataclass
class Words:
    """Words of a batch: byte spans, hashes, and per document its first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray                 # n_documents + 1 positions into the words

    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Byte spans of all words and the first word of each document."""
    n = len(buf)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    gap = space[buf]
    edge = np.ones(n + 1, dtype=bool)   # edge[i]: a word may not run from i - 1 into i
    edge[1:n] = gap[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[:n] = gap
    edge[offsets] = True
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               values: np.ndarray = PLAIN) -> np.ndarray:
    """64-bit hash of the bytes of each span (ascending, not overlapping)."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, low + CHUNK, side="right")))
            piece = buf[low:int(ends[j - 1])]
            powers, inverses = _powers(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(values[piece] * powers[:-1], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[e] - sums[s]) * inverses[s]
            out[i:j] += (e - s).astype(np.uint64)
            i = j
    return mix(out)


def words_of(buf: np.ndarray, offsets: np.ndarray, values: np.ndarray = PLAIN) -> Words:
    starts, ends, firsts = word_spans(buf, offsets)
    return Words(starts, ends, hash_spans(buf, starts, ends, values), firsts)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (document bounds ignored)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out *= np.uint64(_MULT)
            out += hashes[k:k + n]
        return mix(out)


def shingles_by_document(words: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document.

    A document with fewer than ``size`` words, but at least one, has one
    shingle: its whole word sequence. Without words it has none.
    """
    whole = window_hashes(words.hashes, size)
    out = []
    for a, b in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist()):
        if b - a >= size:
            own = np.sort(whole[a:b - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            out.append(own)
        elif b > a:
            out.append(window_hashes(words.hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
