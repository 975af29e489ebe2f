"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .blocks import text_blocks


class BestFit:
    """Bounded-space online best fit: at most `open_bins` bins are open, kept by free space in a bitset.

    An item goes to the open bin with the least free space that holds it. When none does and all places are taken,
    the fullest open bin closes (as `closed` counts) and a new one opens. A full bin closes by itself. Without places
    (`open_bins` 0) every item gets a bin of its own.
    """

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.open, self.closed = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.next_id = first_id

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        """The bin of an item of 1 to `capacity`, and the item's offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            to = self._take(free)
        else:
            if self.bits and self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, to = self.capacity, self.next_id
            self.next_id += 1
        left = free - length
        if left and self.open_bins:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(to)
            self.open += 1
        return to, self.capacity - free


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a sequence: a longer one than `capacity` starts with what is left over."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def tokenize_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str, end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece of each document's ids and end id: id, piece, start, length, ids_crc32 (and ids)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(tokenizer), np.uint32(end_id).tobytes()
        for some, data, offsets in text_blocks(batches, "text"):
            ids, marks = encoder.encode_block(data, offsets)
            ids, marks = ids.astype("<u4", copy=False), marks.tolist()
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k in range(len(marks) - 1):
                own = ids[marks[k] : marks[k + 1]].tobytes() + end
                for j, (a, n) in enumerate(cut(len(own) // 4, capacity)):
                    part = own[4 * a : 4 * (a + n)]
                    row.append(k), piece.append(j), start.append(a), length.append(n), crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4"))
            out = {
                "id": some.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
            if keep_ids:
                out["ids"] = pa.array(kept, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def runs_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of `size` (the last one may be shorter), however they come."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < size:
            continue
        whole = pa.concat_batches(held)
        for at in range(0, rows - size + 1, size):
            yield whole.slice(at, size)
        held, rows = [whole.slice(rows - rows % size)], rows % size
    if rows:
        yield pa.concat_batches(held)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, open_bins: int = 64, lookahead: int = 256,
    tokenizer: str | None = None, end_id: int = 0, keep_ids: bool = False,
) -> DataFrame:
    """Packs every document's token ids into sequences of at most `capacity`.

    Each text is encoded once; the pieces, a few dozen bytes each (with `keep_ids`, their ids too), are dealt
    evenly to tasks, of which adaptive execution chooses the number. A task packs its pieces online in the order of a hash, by best fit
    into at most `open_bins` open bins: what fits none of these closes the fullest. Of each `lookahead` pieces the longest are placed first
    (1: strictly online). A recomputed task gives the same sequences. The bins still open when a task ends, `open_bins` at most, stay short.
    Sequence ids are the task's number times 2**40 plus a count.

    Null text is an empty document, of the end id alone. Repeated rows, also those with the same id, are packed
    each. A null id is kept. An empty table gives no rows. Other columns are not read.

    Returns the id column, piece, start, length, ids_crc32, sequence_id, offset (and ids).
    """
    pieces = tokenize_pieces(docs, id_col, text_col, capacity, tokenizer or tokens.default_path(), end_id, keep_ids)
    dealt = pieces.hint("rebalance").sortWithinPartitions(F.xxhash64("id", "piece"), "id", "piece", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in runs_of(batches, lookahead):
            lengths = batch.column("length").to_numpy()
            to, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for k in np.argsort(-lengths, kind="stable").tolist():
                to[k], offset[k] = bins.place(int(lengths[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
