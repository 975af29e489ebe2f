"""Token ids of whole texts by a public tokenizer file, remembered by word within a Python worker."""

from __future__ import annotations

import functools
import os

import numpy as np

from .blocks import Chunks, Hasher

#: Words that a worker remembers, at about 100 bytes each; at this many it forgets those that it met in one block only.
REMEMBERED = 500_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
#: Last bytes, and bytes before these, of the characters from U+0080 on that are white space.
_WIDE_LAST, _WIDE_BEFORE = np.zeros(256, bool), np.zeros(256, bool)
_WIDE_LAST[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
_WIDE_BEFORE[[0xC2, 0x9A, 0x80, 0x81]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def parts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the parts of a block's texts that can be encoded apart, and the block's end.

    Byte-level pre-tokenization always cuts between a character that is no white space and white space after it;
    a part starts at such a blank or newline, or at the start of a text.
    """
    begins = (data == 0x20) | (data == 0x0A)
    begins[1:] &= ~_BLANK[data[:-1]]
    begins[2:] &= ~(_WIDE_LAST[data[1:-1]] & _WIDE_BEFORE[data[:-2]])
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.append(np.flatnonzero(begins), len(data))


class Encoder:
    """Byte-level BPE ids of texts. The strings of special tokens in a text are ordinary text.

    Words recur, so the ids of each are kept under its 64-bit hash together with its bytes; a word whose bytes differ from those kept
    under its hash is encoded anew, so no id rests on a hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Of each known word, in the order of hashes: its ids' place in the pool and number, bytes, first chunk, and whether it was met again.
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.chunks, self.chunked = np.zeros(1 << 16, np.uint64), 0

    def _forget(self) -> None:
        """Keeps the words that were met again, and none if these alone are more than half of what may be kept."""
        keep = np.flatnonzero(self.again) if 2 * self.again.sum() <= REMEMBERED else np.zeros(0, np.int64)
        self.known, self.size, self.bytes = self.known[keep], self.size[keep], self.bytes[keep]
        counts = np.maximum((self.bytes + 7) >> 3, 1)
        self.pool, self.chunks = _taken(self.pool, self.first[keep], self.size), _taken(self.chunks, self.at[keep], counts)
        self.filled, self.chunked = len(self.pool), len(self.chunks)
        self.first, self.at = np.cumsum(self.size) - self.size, np.cumsum(counts) - counts
        self.again = np.zeros(len(keep), bool)

    @functools.cached_property
    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for: each character of a byte-level token is one byte."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            out[k] = len(token)
        return out

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one word after the other, and n+1 offsets: words that start with white space and don't end with it are
        encoded as one text."""
        joined = _BLANK[data[starts]] & (data[ends - 1] < 0x80) & ~_BLANK[data[ends - 1]]
        got, sizes, order = [], [], []
        together = np.flatnonzero(joined)
        for k in range(0, len(together), 20_000):
            some = together[k : k + 20_000]
            text = b"".join([data[a:b].tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist())])
            ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.searchsorted(np.cumsum(self.byte_lengths[ids]), np.cumsum(ends[some] - starts[some])) + 1
            got.append(ids)
            sizes.append(np.diff(marks, prepend=0))
            order.append(some)
        apart = np.flatnonzero(~joined)
        if len(apart):
            texts = [data[a:b].tobytes().decode() for a, b in zip(starts[apart].tolist(), ends[apart].tolist())]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            got.append(np.array([x for e in found for x in e.ids], np.uint32))
            sizes.append(np.array([len(e.ids) for e in found]))
            order.append(apart)
        ids, sizes, order = np.concatenate(got), np.concatenate(sizes).astype(np.int64), np.concatenate(order)
        back = np.argsort(order)
        return _taken(ids, (np.cumsum(sizes) - sizes)[back], sizes[back]), np.append(0, np.cumsum(sizes[back]))

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        """Keeps new words of distinct hashes: their ids, bytes and chunks."""
        ids, marks = self._encode(data, starts, ends)
        self.pool, self.filled, first = _kept(self.pool, self.filled, ids, marks[:-1])
        self.chunks, self.chunked, at = _kept(self.chunks, self.chunked, values, np.cumsum(counts) - counts)
        by = np.argsort(hashes)
        places = np.searchsorted(self.known, hashes[by])
        for name, more in (("known", hashes), ("first", first), ("size", np.diff(marks)), ("bytes", ends - starts), ("at", at), ("again", np.zeros(len(by), bool))):
            setattr(self, name, np.insert(getattr(self, name), places, more[by]))

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts, and n+1 offsets of the texts into these."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.known) > REMEMBERED:
            self._forget()
        bounds = parts(data, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        chunks = Chunks.of(data, starts, ends)
        hashes, example, which = np.unique(Hasher.of_chunks(chunks, ends - starts), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] != hashes
        self.again[at[~new]] = True
        if new.any():
            some = example[new]
            self._learn(hashes[new], data, starts[some], ends[some], chunks.take(some), chunks.counts[some])
            at = np.searchsorted(self.known, hashes)
        word = at[which]
        same = self.bytes[word] == ends - starts
        kept = _taken(self.chunks, self.at[word], np.where(same, chunks.counts, 0))
        equal = kept == chunks.take(np.flatnonzero(same))
        if not equal.all():
            same[np.flatnonzero(same)[np.repeat(np.arange(same.sum()), chunks.counts[same])[~equal]]] = False
        first, size, pool = self.first[word], self.size[word], self.pool
        other = np.flatnonzero(~same)
        if len(other):
            ids, marks = self._encode(data, starts[other], ends[other])
            first[other], size[other] = self.filled + marks[:-1], np.diff(marks)
            pool = np.concatenate([pool[: self.filled], ids])
        stops = np.cumsum(size)
        return _taken(pool, first, size), np.append(0, stops)[np.searchsorted(starts, offsets)]


def _taken(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of so many values of the pool, one after the other."""
    stops = np.cumsum(sizes)
    return pool[np.repeat(first - (stops - sizes), sizes) + np.arange(int(sizes.sum()))]


def _kept(pool: np.ndarray, filled: int, more: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The pool with more values behind the filled part, the new filled size, and where runs that start at `first` of the new values now are."""
    if filled + len(more) > len(pool):
        pool = np.concatenate([pool[:filled], np.zeros(filled + 2 * len(more), pool.dtype)])
    pool[filled : filled + len(more)] = more
    return pool, filled + len(more), filled + first


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file. Encoding uses the task's own core only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
