"""Passages of benchmark items in documents, found by a prefix-filtered join of word windows."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ALPHANUMERIC, LOWER, Hasher, per_document, text_blocks, words
from ..tables import Scratch

#: Words of a window, and of the shingles that a window is a sequence of.
WINDOW, SHINGLE = 10, 3
#: Windows that a task holds at once, at about 200 bytes each; a larger benchmark is joined in blocks of this many.
BLOCK_WINDOWS = 500_000
#: Shingles that are counted in one scan of the documents, at 16 bytes each.
COUNTED = 8_000_000
#: Bits of the table that is asked first whether a shingle can be a prefix.
FILTER_BITS = 22


@dataclass
class Words:
    """The words of a block of documents: their hashes, n+1 offsets of the documents into them, and where their bytes are."""

    hashes: np.ndarray
    marks: np.ndarray
    lower: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Words:
        lower = LOWER[data]
        starts, ends, marks = words(lower, offsets, ALPHANUMERIC)
        return Words(Hasher.spans(lower, starts, ends), marks, lower, starts, ends)

    def text(self, at: int, n: int) -> bytes:
        """n words from a place on, with a blank between them, which no word holds."""
        return b" ".join(self.lower[a:b].tobytes() for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist()))


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window, words, shingles): every run of WINDOW words of an item, the whole item where it has fewer; no row for none.

    window is the text, words are 64-bit hashes of the words, as longs; shingles those of the runs of SHINGLE words, or of all of fewer.
    """
    item_type = benchmark.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, data, offsets in text_blocks(batches, "text"):
            block = Words.of(data, offsets)
            row, texts, out, grams = [], [], [], []
            for k in range(len(block.marks) - 1):
                begin, own = int(block.marks[k]), block.hashes[block.marks[k] : block.marks[k + 1]]
                runs = Hasher.runs(own, min(SHINGLE, len(own))).view(np.int64) if len(own) else own
                for at in range(max(1, len(own) - WINDOW + 1) if len(own) else 0):
                    row.append(k), texts.append(block.text(begin + at, min(WINDOW, len(own))).decode())
                    out.append(own[at : at + WINDOW].view(np.int64)), grams.append(runs[at : at + WINDOW - SHINGLE + 1])
            lists = lambda x: pa.array(x, pa.list_(pa.int64()))
            of_item = some.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_pydict({"item": of_item, "window": pa.array(texts, pa.string()), "words": lists(out), "shingles": lists(grams)})

    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item {item_type}, window string, words array<long>, shingles array<long>")


class Lookup:
    """Places in a sorted array of distinct keys, asking a bitset first."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the values that are keys, and the keys' numbers."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[key] == values[at]
        return at[same], key[same]


def shingle_counts(docs: DataFrame, keys: np.ndarray, text_col: str) -> DataFrame:
    """(shingle, n): how often each of the given shingles occurs in all documents, counted within tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        counts = np.zeros(len(lookup.keys), np.int64)
        for _, data, offsets in text_blocks(batches, "text"):
            block = Words.of(data, offsets)
            for width in range(1, SHINGLE + 1):
                at, key = lookup.find(Hasher.runs(block.hashes, width))
                inside = np.searchsorted(block.marks, at, "right") == np.searchsorted(block.marks, at + width - 1, "right")
                counts += np.bincount(key[inside], minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(lookup.keys[found].view(np.int64)), "n": pa.array(counts[found])})

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def indexed(docs: DataFrame, distinct: DataFrame, text_col: str, scratch: Scratch, counted: int = COUNTED) -> DataFrame:
    """The distinct windows (window, words, shingles, items) with prefix and shift: their rarest shingle and its place in the window.

    A shingle's rarity is its count in all documents; of equally rare ones the smaller hash is taken, and of equal ones the first place.
    Shingles are counted in one scan of the documents, or, where the benchmark has more than `counted`, in as few as hold them.
    """
    keys = distinct.select(F.explode("shingles").alias("shingle")).distinct()
    scans = max(1, math.ceil(keys.count() / counted))
    counts = []
    for k in range(scans):
        own = keys.where(F.pmod(F.xxhash64("shingle"), F.lit(scans)) == k).toArrow().column(0).to_numpy()
        counts.append(scratch.save(shingle_counts(docs, np.sort(own.view(np.uint64)), text_col), f"counts{k}"))
    rows = distinct.select("window", F.posexplode("shingles").alias("shift", "shingle")).join(functools.reduce(DataFrame.union, counts), "shingle", "left")
    rarest = rows.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "shift")).alias("k"))
    return distinct.join(rarest, "window").select("window", "words", "items", F.col("k.shingle").alias("prefix"), F.col("k.shift").alias("shift"))


@dataclass
class Index:
    """Distinct windows by their prefix, the rarest shingle. A window must hold all its shingles to occur, so one is
    a sufficient prefix."""

    prefixes: Lookup  # distinct prefix shingles
    first: np.ndarray  # n+1 offsets of the prefixes into the windows
    shift: np.ndarray  # of each window: where its prefix stands in it
    length: np.ndarray  # of each window, in words
    words: np.ndarray  # of each window, the hashes, filled up with zeros
    texts: pa.Array  # of each window
    items: np.ndarray  # item numbers of each window
    items_first: np.ndarray  # n+1 offsets of the windows into these
    names: pa.Array  # item ids by number
    widths: list[int]  # of the prefixes

    @staticmethod
    def build(table: pa.Table) -> Index:
        """From rows (window, words, items, prefix, shift)."""
        lists = table.column("words").combine_chunks()
        length = np.diff(lists.offsets.to_numpy())
        filled = np.zeros((len(length), WINDOW), np.uint64)
        filled[np.arange(WINDOW) < length[:, None]] = lists.flatten().to_numpy().view(np.uint64)
        prefix = table.column("prefix").to_numpy().view(np.uint64)
        order = np.argsort(prefix, kind="stable")
        unique, first = np.unique(prefix[order], return_index=True)
        items = table.column("items").combine_chunks().take(pa.array(order))
        flat = items.flatten().dictionary_encode()
        return Index(
            Lookup(unique), np.append(first, len(order)), table.column("shift").to_numpy()[order].astype(np.int64), length[order].astype(np.int64), filled[order],
            table.column("window").combine_chunks().cast(pa.large_binary()).take(pa.array(order)),
            np.asarray(flat.indices, np.int64), np.append(0, np.cumsum(pc.list_value_length(items).to_numpy())), flat.dictionary, sorted(set(np.minimum(length, SHINGLE).tolist())),
        )

    def occurrences(self, block: Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts, as word places, and windows of all occurrences in a block's documents: equal hashes first, then equal words."""
        hashes, marks = block.hashes, block.marks
        begins, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in self.widths:
            at, prefix = self.prefixes.find(Hasher.runs(hashes, width))
            n = self.first[prefix + 1] - self.first[prefix]
            at = np.repeat(at, n)
            window = np.repeat(self.first[prefix] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = at - self.shift[window]
            document = np.searchsorted(marks, at, "right") - 1
            # The window must have as many words left in the document before and after its prefix as it has itself.
            possible = (start >= marks[document]) & (start + self.length[window] <= marks[document + 1]) & (np.minimum(self.length[window], SHINGLE) == width)
            start, window = start[possible], window[possible]
            same = np.ones(len(start), bool)
            for k in range(WINDOW):
                inside = self.length[window] > k
                same &= ~inside | (hashes[np.minimum(start + k, len(hashes) - 1)] == self.words[window, k])
            start, window = start[same], window[same]
            texts = self.texts.take(pa.array(window)).to_pylist()
            equal = np.array([block.text(at, n) == text for at, n, text in zip(start.tolist(), self.length[window].tolist(), texts)], bool)
            begins.append(start[equal]), which.append(window[equal])
        return np.concatenate(begins), np.concatenate(which)


_FOUND = "struct<n_words: long, spans: array<long>, items: array<{item}>>"


def prober(index: Broadcast, item_type: pa.DataType):
    """An Arrow function from texts to their number of words, the spans [start, end, start, end ...) of the words
    hit, and the ids of the items with an occurring window."""
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(item_type))])

    def of_block(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
        table: Index = index.value
        block = Words.of(data, offsets)
        hashes, marks = block.hashes, block.marks
        n = len(marks) - 1
        spans, span_marks, items, item_marks = np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        if len(hashes):
            start, window = table.occurrences(block)
            edges = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(edges, start, 1)
            np.add.at(edges, start + table.length[window], -1)
            hit = np.cumsum(edges[:-1]) > 0
            of = per_document(marks)
            fresh = np.append(True, of[1:] != of[:-1])
            begin = np.flatnonzero(hit & (fresh | ~np.append(False, hit[:-1])))
            end = np.flatnonzero(hit & (np.append(fresh[1:], True) | ~np.append(hit[1:], False)))
            spans = np.stack([begin - marks[of[begin]], end + 1 - marks[of[begin]]], 1).reshape(-1)
            span_marks[1:] = 2 * np.cumsum(np.bincount(of[begin], minlength=n))
            pairs = np.unique(np.stack([of[start], window], 1), axis=0)
            sizes = np.diff(table.items_first)[pairs[:, 1]]
            number = table.items[np.repeat(table.items_first[pairs[:, 1]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            pairs = np.unique(np.stack([np.repeat(pairs[:, 0], sizes), number], 1), axis=0)
            items = pairs[:, 1]
            item_marks[1:] = np.cumsum(np.bincount(pairs[:, 0], minlength=n))
        return pa.StructArray.from_arrays([
            pa.array(np.diff(marks)), pa.ListArray.from_arrays(pa.array(span_marks, pa.int32()), pa.array(spans)),
            pa.ListArray.from_arrays(pa.array(item_marks, pa.int32()), table.names.take(pa.array(items)).cast(item_type)),
        ], fields=list(kind))

    def probe(texts: pa.Array) -> pa.Array:
        blocks = text_blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text")
        return pa.concat_arrays([of_block(data, offsets) for _, data, offsets in blocks]) if len(texts) else pa.array([], kind)

    return probe


def merged(lists: Column) -> Column:
    """The union of lists [start, end, start, end ...] of disjoint spans, in JVM expressions."""

    def pairs(c: Column) -> Column:
        at = F.sequence(F.lit(0), (F.size(c) / 2 - 1).cast("int"))
        listed = F.transform(at, lambda k: F.struct(F.get(c, (2 * k).cast("int")).alias("a"), F.get(c, (2 * k + 1).cast("int")).alias("b")))
        return F.when(F.size(c) > 0, listed).otherwise(F.array().cast("array<struct<a: bigint, b: bigint>>"))

    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    closed = lambda acc: F.when(acc["a"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["a"], acc["b"])))

    def step(acc: Column, x: Column) -> Column:
        longer = F.struct(acc["out"].alias("out"), acc["a"].alias("a"), F.greatest(acc["b"], x["b"]).alias("b"))
        return F.when(x["a"] <= acc["b"], longer).otherwise(F.struct(closed(acc).alias("out"), x["a"].alias("a"), x["b"].alias("b")))

    return F.aggregate(F.array_sort(F.flatten(F.transform(lists, pairs))), start, step, closed)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """docs with n_words, n_hit, spans, items and contaminated.

    A document word is hit if it lies in an occurrence of a window (see `windows`); spans are the hit words as
    [start, end, ...) word numbers, items the ids of the items with an occurring window, in ascending order.

    The shingles of all windows are counted in all documents; each window is indexed under its rarest one. Documents
    are joined to that index within the scan: prefix, then length and position, then all words. The index of at most
    `block_windows` windows is broadcast. A benchmark with more is joined block by block: the documents are written once
    with a row number, each block's finds (of the documents that have any) are saved, merged by row and joined to the documents.

    Null and empty texts have no words. Items that repeat an id count once; the windows of an item without an id hit words, but such
    an item cannot be listed. Repeated documents are rows of their own. An empty benchmark hits nothing. Columns of docs with the five
    names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    item_type = benchmark.schema[item_col].dataType.simpleString()
    grouped = windows(benchmark, item_col, item_text_col).groupBy("window").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))
    distinct = scratch.save(grouped, "windows")
    index = scratch.save(indexed(docs, distinct, text_col, scratch), "index")
    blocks = max(1, math.ceil(index.count() / block_windows))
    text = F.col(text_col).cast("string")

    def found(k: int) -> Column:
        table = index.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).toArrow()
        arrow_item = table.schema.field("items").type.value_type
        return F.arrow_udf(prober(docs.sparkSession.sparkContext.broadcast(Index.build(table)), arrow_item), _FOUND.format(item=item_type))(text)

    if blocks == 1:
        out = docs.withColumn("__found", found(0))
    else:
        rows = scratch.save(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        finds = [scratch.save(rows.select("__row", found(k).alias("k")).where(F.lit(k == 0) | (F.size("k.spans") > 0)), f"block{k}") for k in range(blocks)]
        by_row = functools.reduce(DataFrame.union, finds).groupBy("__row").agg(F.max("k.n_words").alias("n_words"), F.collect_list("k.spans").alias("spans"), F.collect_list("k.items").alias("items"))
        joined = by_row.select("__row", F.struct("n_words", merged(F.col("spans")).alias("spans"), F.array_distinct(F.flatten("items")).alias("items")).alias("__found"))
        out = rows.join(joined, "__row").drop("__row")
    odd = F.transform("__found.spans", lambda x, k: F.when(k % 2 == 0, -x).otherwise(x))
    n_hit = F.aggregate(odd, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({"n_words": F.col("__found.n_words"), "n_hit": n_hit, "spans": F.col("__found.spans"), "items": F.array_sort("__found.items")})
    return out.drop("__found").withColumn("contaminated", F.col("n_hit") > 0)


def digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)
