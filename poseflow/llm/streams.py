"""Groups of any size read in order, row by row, by one task that holds none of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces that are joined before they go to their group's task.
CHUNK = 4_096


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows dealt by keys, each group in order (nulls first). Spark sorts on disk what memory does not hold."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def digests(rows: DataFrame, keys: list[str], order: str, piece: Column, separator: str) -> DataFrame:
    """keys and sha256, the lower-case hex SHA-256 of each group's pieces (strings) in order, joined by the separator.

    Pieces are joined to chunks where range partitions by keys and order hold them, so that the task of a large group reads few rows; it
    feeds the hash chunk by chunk. A hash of one string is a chain, so a group's bytes pass one task. Null pieces count as empty; pieces of
    equal order come in any order; an empty table gives no rows."""
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    first_type = rows.schema[order].dataType.simpleString()
    text = F.coalesce(piece.cast("string"), F.lit("")).alias("__piece")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held = None, None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            done: list[tuple] = []
            for *key, at, value in zip(*columns):
                if key != now or len(held) == CHUNK:
                    if held:
                        done.append((*now, first, separator.join(held)))
                    now, first, held = key, at, []
                held.append(value)
            yield _batch(done, batch.schema)
            schema = batch.schema
        if held:
            yield _batch([(*now, first, separator.join(held))], schema)

    ranged = rows.select(*keys, F.col(order).alias("__first"), text).repartitionByRange(*keys, "__first").sortWithinPartitions(*keys, "__first")
    joined = ranged.mapInArrow(chunks, f"{types}, __first {first_type}, __piece string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = [*keys, "sha256"]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            done = []
            schema = pa.schema([*(batch.schema.field(k) for k in range(len(keys))), pa.field("sha256", pa.string())])
            for *key, _, value in zip(*columns):
                if state is None or key != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(value.encode())
                else:
                    state.update((separator + value).encode())
            yield _batch(done, schema).rename_columns(names)
        if state is not None:
            yield _batch([(*now, state.hexdigest())], schema).rename_columns(names)

    return in_order(joined, keys, ["__first"]).mapInArrow(run, f"{types}, sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
