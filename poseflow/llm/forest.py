"""Near duplicates among embeddings: a forest of random-projection trees, leaves compared in blocks, links verified and united."""

from __future__ import annotations

import contextlib
import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..tables import Scratch
from .neighbours import usable

#: Trees, the vectors that a leaf may hold where they can be split, and the rows of a block that is compared at once.
TREES, LEAF, BLOCK = 4, 512, 1_024
#: Half the width of a split's overlap, in standard deviations of the projected distance of two vectors that just link.
SPILL = 0.4
#: Quantiles of a node among which a split is placed, from LOW to HIGH, where the fewest vectors fall into the overlap; a split that would
#: copy more than MOST of the node is not made.
STEPS, LOW, HIGH, MOST = 32, 10, 22, 0.3
#: Pairs whose leaves are compared at once, and pairs of blocks that a task holds at once.
PAIRS, BATCH = 100_000, 8


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, digest (128 bits of the vector's values) and unit, the vector of length 1 as bytes, of usable vectors with an id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, prints, units = [], [], []
            for v in batch.column("v"):
                v = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
                prints.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest())
                v = v / np.abs(v).max()
                units.append((v / math.sqrt(float(v @ v))).tobytes())
                dims.append(len(v))
            arrays = [batch.column("id"), pa.array(dims, pa.int32()), pa.array(prints, pa.binary()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "dim", "digest", "unit"])

    return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).mapInArrow(run, "id long, dim int, digest binary, unit binary")


def directions(tree: int, levels: int, dim: int, seed: int) -> np.ndarray:
    """A random direction per level of a tree, the same in every task."""
    out = np.random.default_rng([seed, tree, dim]).normal(size=(levels, dim))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def projections(distinct: DataFrame, levels: int, trees: int, seed: int) -> DataFrame:
    """(dim, tree, node, rid, at): of each vector and tree the root, and its places on the directions of all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = pa.array(np.flatnonzero(dims == dim))
                units = np.frombuffer(b"".join(batch.column("unit").take(own).to_pylist())).reshape(-1, dim)
                for tree in range(trees):
                    if (tree, dim) not in known:
                        known[tree, dim] = directions(tree, levels, dim, seed)
                    at, n = (units @ known[tree, dim].T).astype(np.float32), len(units)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * levels, pa.int32()), pa.array(at.reshape(-1)))
                    columns = [pa.array([dim] * n, pa.int32()), pa.array([tree] * n, pa.int32()), pa.array([1] * n, pa.int64()), batch.column("rid").take(own), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "tree", "node", "rid", "at"])

    return distinct.select("dim", "rid", "unit").mapInArrow(run, "dim int, tree int, node long, rid long, at array<float>")


def grow(rows: DataFrame, levels: int, leaf: int, spill: float, scratch: Scratch) -> DataFrame:
    """(dim, tree, node, rid) of all leaves. Level by level, each node with more than `leaf` vectors is cut on the level's direction, at
    a quantile of all its vectors where few fall within the overlap, which go to both sides. A node that cannot be cut with a small overlap
    waits for the next level; what cannot be cut at any is a leaf. Cuts are a table that the rows join, broadcast only if Spark finds it small."""
    done, live = [], rows
    for level in range(levels):
        at = F.get("at", F.lit(level)).cast("double")
        quantiles = F.percentile_approx(at, [k / STEPS for k in range(STEPS + 1)], 2_000)
        nodes = live.groupBy("dim", "tree", "node").agg(F.count("*").alias("n"), F.min(at).alias("low"), quantiles.alias("q"))
        width = F.lit(spill) / F.sqrt("dim")
        # The share of the node's vectors within the overlap of a cut at a quantile, and half a step where all quantiles are outside.
        inside = lambda c: F.size(F.filter("q", lambda x: F.abs(x - c) <= width)) / F.lit(float(STEPS))
        tried = F.transform(F.slice("q", LOW + 1, HIGH - LOW + 1), lambda c: F.struct(inside(c).alias("share"), F.abs(c - F.get("q", F.lit(STEPS // 2))).alias("off"), c.alias("cut")))
        nodes = nodes.withColumn("best", F.array_min(tried))
        cut = F.when((F.col("n") > leaf) & (F.col("best.share") <= MOST) & (F.col("low") < F.col("best.cut")), F.col("best.cut"))
        nodes = scratch.save(nodes.select("dim", "tree", "node", (F.col("n") <= leaf).alias("small"), cut.alias("cut"), width.alias("width")), f"nodes{level}")
        if nodes.where("not small").isEmpty():
            break
        joined = live.join(nodes, ["dim", "tree", "node"])
        left, right = (F.when(x, 2 * F.col("node") + k) for k, x in enumerate((at < F.col("cut") + F.col("width"), at >= F.col("cut") - F.col("width"))))
        children = F.when(F.col("cut").isNull(), F.array(F.col("node"))).otherwise(F.array_compact(F.array(left, right)))
        grown = scratch.save(joined.select("dim", "tree", "rid", "at", "small", F.explode(children).alias("node")), f"level{level}")
        done.append(grown.where("small").select("dim", "tree", "node", "rid"))
        live = grown.where("not small").drop("small")
    return reduce(DataFrame.union, done, live.select("dim", "tree", "node", "rid"))


def blocks(leaves: DataFrame, distinct: DataFrame, trees: int, scratch: Scratch) -> DataFrame:
    """(leaf, parts, deal, rows): each leaf's vectors dealt by hash to blocks of about BLOCK, with all the leaves that each is in."""
    leaf = (F.col("node") * trees + F.col("tree")).alias("leaf")
    placed = leaves.select("dim", leaf, "rid")
    sizes = placed.groupBy("dim", "leaf").agg(F.count("*").alias("n")).where("n > 1")
    lists = placed.groupBy("rid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    known = scratch.save(distinct.select("rid", "w", "unit").join(lists, "rid"), "known")
    parts = F.expr(f"cast(n div {BLOCK} + 1 as int)")
    rows = placed.join(sizes, ["dim", "leaf"]).select("dim", "leaf", "rid", parts.alias("parts")).join(known, "rid")
    deal = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("deal")
    gathered = rows.groupBy("dim", "leaf", "parts", deal).agg(F.collect_list(F.struct("rid", "w", "leaves", "unit")).alias("rows"))
    return scratch.save(gathered, "blocks")


class _Block:
    def __init__(self, rows: pa.StructScalar, dim: int):
        flat = rows.values
        self.rid, self.w = (flat.field(c).to_numpy() for c in ("rid", "w"))
        self.unit = np.frombuffer(b"".join(flat.field("unit").to_pylist())).reshape(-1, dim)
        lists = flat.field("leaves")
        sizes = np.diff(lists.offsets.to_numpy())
        self.leaves = np.full((len(sizes), int(sizes.max())), -1, np.int64)
        self.leaves[np.arange(self.leaves.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each row of a that the same row of b has too; -1 is none."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for x in range(a.shape[1]):
        for y in range(b.shape[1]):
            same = (a[:, x] == b[:, y]) & (a[:, x] >= 0)
            out[same] = np.minimum(out[same], a[same, x])
    return out


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place of each place's component, given links i-j."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, Spark hands so many rows at a time to Python: rows that are blocks are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def compare(pairs: DataFrame, least: float) -> DataFrame:
    """(rid, links, mate) of pairs of blocks (dim, leaf, a, b; b null for a block with itself): of each vector with a link, the weights of the
    vectors linked, and one vector of the same component. A pair counts in the first of all leaves that both its vectors are in, so
    it counts once; its links stay numbers in arrays and become no rows."""

    def of_pair(dim: int, leaf: int, a: _Block, b: _Block | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        other = a if b is None else b
        close = a.unit @ other.unit.T >= least
        i, j = np.nonzero(np.triu(close, 1) if b is None else close)
        ids, weights = (a.rid, a.w) if b is None else (np.concatenate([a.rid, b.rid]), np.concatenate([a.w, b.w]))
        shift = 0 if b is None else len(a.rid)
        counted = np.zeros(len(i), bool)
        for at in range(0, len(i), PAIRS):
            some = slice(at, at + PAIRS)
            counted[some] = _first_common(a.leaves[i[some]], other.leaves[j[some]]) == leaf
        links, n = np.zeros(len(ids), np.int64), len(ids)
        for x, y in ((i, j + shift), (j + shift, i)):
            links += np.bincount(x[counted], weights[y[counted]], n).astype(np.int64)
        linked = np.unique(np.concatenate([i, j + shift]))
        return ids[linked], links[linked], ids[_labels(i, j + shift, n)[linked]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, leaves = (batch.column(c).to_pylist() for c in ("dim", "leaf"))
            for k in range(batch.num_rows):
                a, b = batch.column("a")[k], batch.column("b")[k]
                found = of_pair(dims[k], leaves[k], _Block(a, dims[k]), _Block(b, dims[k]) if b.is_valid else None)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["rid", "links", "mate"])

    return pairs.select("dim", "leaf", "a", "b").mapInArrow(run, "rid long, links long, mate long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, trees: int = TREES, leaf: int = LEAF, seed: int = 13,
) -> DataFrame:
    """id, n_links, component_id and kept of every row: vectors link if their cosine, in double precision, is `cosine` or more.

    Equal vectors are one, with a weight. Each tree cuts them by random directions, one per level, so that near ones stay together or in the
    overlap of a cut (see `grow`); all pairs of a leaf are compared, as products of blocks, and a pair that no leaf of any tree holds is
    missed (README has the recall). A large group of near copies cannot be cut and is one leaf of many blocks, whose pairs are dealt to
    tasks; no row is made for a link. n_links: other rows linked with the row; component_id: the smallest id that links lead to; kept: is that its own?

    Vectors that are null or zero or hold null or non-finite components have no links, nor have rows without an id, whose component_id is null
    and which are kept. Vectors of unequal lengths do not link. Repeated rows are linked rows like others. An empty table gives no rows. Other
    columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "forest")
    rows = scratch.save(unit_rows(vectors, id_col, vector_col), "rows")
    grouped = rows.groupBy("dim", "digest").agg(F.count("*").alias("w"), F.min("id").alias("least"), F.first("unit").alias("unit"))
    distinct = scratch.save(grouped.withColumn("rid", F.monotonically_increasing_id()), "distinct")
    n = distinct.count()
    # A cut leaves at most about two thirds of a node on a side.
    levels = min(56, max(1, math.ceil(math.log(max(n / leaf, 1)) / math.log(1.5))) + 4)
    width = SPILL * math.sqrt(2 - 2 * cosine)
    leaves = grow(projections(distinct, levels, trees, seed), levels, leaf, width, scratch)
    held = blocks(scratch.save(leaves, "leaves"), distinct, trees, scratch)
    alone = held.select("dim", "leaf", F.col("rows").alias("a"), F.lit(None).cast(held.schema["rows"].dataType).alias("b"))
    large = held.where("parts > 1")
    side = lambda x: large.select("dim", "leaf", F.col("deal").alias(f"deal_{x}"), F.col("rows").alias(x))
    across = side("a").join(side("b"), ["dim", "leaf"]).where("deal_a < deal_b").select("dim", "leaf", "a", "b")
    with rows_per_batch(vectors.sparkSession, BATCH):
        found = scratch.save(compare(alone.union(across), cosine), "found")

    roots = connected_components(found.select(F.col("rid").alias("a"), F.col("mate").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    placed = distinct.select("rid", "dim", "digest", "w", "least").join(roots.withColumnRenamed("node", "rid"), "rid", "left").join(counts, "rid", "left")
    placed = scratch.save(placed.withColumns({"root": F.coalesce("root", "rid"), "n_links": F.coalesce("links", F.lit(0).cast("long")) + F.col("w") - 1}), "placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(smallest, "root").select("dim", "digest", "n_links", "component_id")
    linked = rows.select("id", "dim", "digest").join(known, ["dim", "digest"]).select("id", "n_links", "component_id")
    rest = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rest = rest.where(~(F.col("id").isNotNull() & usable(F.col("v")))).select("id", F.lit(0).cast("long"), F.col("id"))
    out = linked.union(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
