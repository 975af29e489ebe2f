"""Arrow batches of texts as flat NumPy arrays: bytes, words and shingles of many documents at once.

The bytes of a text are its UTF-8 form, so a class of ASCII bytes plus "all bytes from 0x80" is the same
class of characters. Work goes in blocks of at most BLOCK_BYTES of text (one longer text is a block of its
own), which bounds the memory of a task whatever the batch size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _SHIFT)
    x = x * _MIX[0]
    x ^= x >> _SHIFT
    x *= _MIX[1]
    x ^= x >> _SHIFT
    return x


def byte_class(*, exclude: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans: False on the given inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in exclude:
        table[low : high + 1] = False
    return table


#: Words of `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
SPACED = byte_class(exclude=[(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = byte_class(exclude=[(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of their texts and n+1 offsets into them; null counts as empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        n = len(texts)
        if not n:
            continue
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(int(np.searchsorted(ends, ends[first] + limit, "right")) - 1, first + 1)
            last = min(last, n, first + 4096)
            yield batch.slice(first, last - first), data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
            first = last


#: Low bytes of a 64-bit value, by how many.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Chunks:
    """Byte strings in pieces of 8 bytes, the last one filled up with zeros; an empty string has one piece."""

    values: np.ndarray  # the pieces as little-endian numbers
    first: np.ndarray  # of each string: its first piece
    counts: np.ndarray  # of each string: its number of pieces

    @staticmethod
    def of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Chunks:
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray(len(data) + 1, "<u8", buffer=padded.data, strides=(1,))
        sizes = ends - starts
        counts = np.maximum((sizes + 7) >> 3, 1)
        first = np.cumsum(counts) - counts
        at = 8 * (np.arange(int(counts.sum())) - np.repeat(first, counts))
        left = np.minimum(np.repeat(sizes, counts) - at, 8)
        return Chunks(eight[np.repeat(starts, counts) + at] & _LOW[left], first, counts)

    def take(self, which: np.ndarray) -> np.ndarray:
        """The pieces of some of the strings, one string after the other."""
        counts = self.counts[which]
        stops = np.cumsum(counts)
        return self.values[np.repeat(self.first[which] - (stops - counts), counts) + np.arange(int(counts.sum()))]


#: The words that the state of the hash starts as, and the rotations of its round.
_STATE = np.array([0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573], np.uint64)
_ROTATE = (13, 16, 21, 17)
#: Strings hashed at once, so that their states stay in the processor's cache; pieces from which on a string is hashed by itself.
_AT_ONCE, _LONG = 16_384, 64


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(v: list[np.ndarray]) -> None:
    """One round of SipHash over many states."""
    a, b, c, d = v
    a = a + b
    b = _turned(b, _ROTATE[0]) ^ a
    a = _turned(a, 32)
    c = c + d
    d = _turned(d, _ROTATE[1]) ^ c
    a = a + d
    d = _turned(d, _ROTATE[2]) ^ a
    c = c + b
    b = _turned(b, _ROTATE[3]) ^ c
    v[:] = a, b, _turned(c, 32), d


class Hasher:
    """64-bit hashes of byte strings and of runs of such hashes, the same in every process.

    A string is taken in by 8-byte pieces in their order, into a state of 256 bits, by SipHash with one round a piece and three at the end; one of more than _LONG
    pieces by BLAKE2. Neither can be solved for a piece, so nobody can write two words of one hash but by trying
    about 2**32 of them; of n distinct words, about n**2 / 2**65 pairs meet by chance.
    """

    @staticmethod
    def of_chunks(chunks: Chunks, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.uint64)
        for at in range(0, len(sizes), _AT_ONCE):
            some = slice(at, min(at + _AT_ONCE, len(sizes)))
            first, counts, size = chunks.first[some], chunks.counts[some], sizes[some].astype(np.uint64)
            state = [np.full(len(first), x) for x in _STATE]
            Hasher._take(state, chunks.values[first])
            for k in range(1, min(int(counts.max()), _LONG)):
                more = np.flatnonzero(counts > k)
                longer = [x[more] for x in state]
                Hasher._take(longer, chunks.values[first[more] + k])
                for x, y in zip(state, longer):
                    x[more] = y
            state[2] = state[2] ^ (size * _ODD)
            for _ in range(3):
                _round(state)
            out[some] = state[0] ^ state[1] ^ state[2] ^ state[3]
        for k in np.flatnonzero(chunks.counts > _LONG).tolist():
            whole = chunks.values[chunks.first[k] : chunks.first[k] + chunks.counts[k]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(whole, digest_size=8, salt=int(sizes[k]).to_bytes(8, "little")).digest(), "little")
        return out

    @staticmethod
    def _take(state: list[np.ndarray], pieces: np.ndarray) -> None:
        state[3] = state[3] ^ pieces
        _round(state)
        state[0] = state[0] ^ pieces

    @staticmethod
    def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return Hasher.of_chunks(Chunks.of(data, starts, ends), ends - starts)

    @staticmethod
    def runs(hashes: np.ndarray, width: int) -> np.ndarray:
        """The hash of the width values from each place of the last axis on; the last width-1 places have none."""
        n = hashes.shape[-1] - width + 1
        if n <= 0:
            return np.zeros((*hashes.shape[:-1], 0), np.uint64)
        out = hashes[..., :n].copy()
        for k in range(1, width):
            out *= _ODD
            out ^= out >> _SHIFT
            out += hashes[..., k : k + n]
        return mix(out + np.uint64(width))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a block, and n+1 offsets of the documents into these."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets).astype(np.int64)


def per_document(offsets: np.ndarray) -> np.ndarray:
    """The document number of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
