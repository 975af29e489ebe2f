"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..tables import Scratch

#: A partitioner is fitted on at most this many vectors, those with the smallest hashes of their ids, with at least FEW of them to a part.
SAMPLE, FEW = 16_384, 64
#: Parts are as many as hold about PART_ROWS rows each, LEAST_PARTS at least; a partitioner has FAN at most, and parts its own partitioner beyond.
PART_ROWS, LEAST_PARTS, FAN = 4_096, 32, SAMPLE // FEW
#: Vectors that are scored together, and of a part's rows those that are gathered into blocks by one task, and searched by one task.
BLOCK, DEALT, SEARCHED = 1_024, 256, 16_384


def usable(vector: Column) -> Column:
    """False for null and zero vectors and those with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def graph_of(vectors: np.ndarray, degree: int) -> np.ndarray:
    """The `degree` nearest others of each vector, by inner product."""
    out = np.zeros((len(vectors), degree), np.int64)
    for a in range(0, len(vectors), 1024):
        scores = vectors[a : a + 1024] @ vectors.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        out[a : a + 1024] = np.argpartition(-scores, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(graph: np.ndarray, parts: int, passes: int = 6, slack: float = 1.05, seed: int = 0) -> np.ndarray:
    """A part of each node, none larger than `slack` times the mean: nodes stream by in random order and go to the
    part that holds most of their neighbours, weighted by its room; later passes stream again over the whole."""
    n = len(graph)
    order = np.random.default_rng(seed).permutation(n)
    both = [list(x) for x in graph.tolist()]
    for a, near in enumerate(graph.tolist()):
        for b in near:
            both[b].append(a)
    both = [np.array(x) for x in both]
    part, room = np.full(n, -1), np.full(parts, int(np.ceil(slack * n / parts)))
    total = room[0]
    for _ in range(passes):
        for k in order.tolist():
            if part[k] >= 0:
                room[part[k]] += 1
            near = part[both[k]]
            votes = np.bincount(near[near >= 0], minlength=parts) + 1e-3
            votes = votes * (room / total)
            part[k] = int(votes.argmax())
            room[part[k]] -= 1
    return part


@dataclass
class Router:
    """A classifier with one hidden layer from vectors to the probability of each part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.log_odds(x)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    @staticmethod
    def fit(x: np.ndarray, targets: np.ndarray, hidden: int = 128, epochs: int = 30, rate: float = 2e-3, decay: float = 1e-4, seed: int = 0) -> Router:
        """Cross entropy against the shares of each vector's neighbours in the parts, by Adam."""
        rng = np.random.default_rng(seed)
        d, parts = x.shape[1], targets.shape[1]
        weights = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                some = order[at : at + 256]
                inside = np.maximum(x[some] @ weights[0] + weights[1], 0)
                z = inside @ weights[2] + weights[3]
                z = np.exp(z - z.max(1, keepdims=True))
                out = (z / z.sum(1, keepdims=True) - targets[some]) / len(some)
                back = (out @ weights[2].T) * (inside > 0)
                slopes = [x[some].T @ back, back.sum(0), inside.T @ out, out.sum(0)]
                step += 1
                for w, g, m, v in zip(weights, slopes, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (1 - epoch / epochs) * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * w)
        return Router(*weights)


@dataclass
class Partitioner:
    router: Router
    scale: float  # vectors are divided by this before the classifier
    parts: int

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return self.router.probabilities(vectors / self.scale)

    @staticmethod
    def fit(sample: np.ndarray, k: int, wanted: int, seed: int = 0) -> Partitioner:
        """The neighbour graph of the sample, its balanced parts, and the classifier that learns where neighbours are. There are `wanted` parts,
        or fewer so that FEW vectors of the sample go to each: fewer than twice FEW are one part, and a search of it is exact."""
        n = len(sample)
        scale = float(np.sqrt((sample**2).sum(1).mean())) / np.sqrt(sample.shape[1])
        parts = int(np.clip(n // FEW, 1, wanted))
        if parts == 1:
            return Partitioner(Router(np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), scale, 1)
        graph = graph_of(sample, min(k, n - 1))
        part = balanced_parts(graph, parts, seed=seed)
        targets = np.zeros((n, parts))
        np.add.at(targets, (np.repeat(np.arange(n), graph.shape[1]), part[graph].reshape(-1)), 1 / graph.shape[1])
        return Partitioner(Router.fit(sample / scale, targets, seed=seed), scale, parts)


class Hierarchy:
    """A partitioner, and one for each of its parts, whose parts are the leaves."""

    def __init__(self, top: Partitioner, below: dict[int, Partitioner] | None = None):
        self.top, self.below = top, below or {}
        sizes = [self.below[p].parts if p in self.below else 1 for p in range(top.parts)]
        self.first = np.append(0, np.cumsum(sizes))
        self.leaves = int(self.first[-1])

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the most probable part's most probable part."""
        part = self.top.probabilities(vectors).argmax(1)
        out = self.first[part]
        for p in np.intersect1d(part, list(self.below)):
            own = np.flatnonzero(part == p)
            out[own] += self.below[p].probabilities(vectors[own]).argmax(1)
        return out

    def route(self, vectors: np.ndarray, sizes: np.ndarray, mass: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) places: each vector's most probable leaves until they hold `mass` of the probability and `least` rows, given the
        leaves' sizes; of the parts above, those until half of what is left out has gone, and `least` rows."""
        p = self.top.probabilities(vectors)
        row, part = np.nonzero(_until(p, np.add.reduceat(sizes, self.first[:-1]), (1 + mass) / 2, least))
        rows, leaves, odds = [], [], []
        for k in np.unique(part).tolist():
            own = row[part == k]
            inner = self.below[k].probabilities(vectors[own]) if k in self.below else np.ones((len(own), 1))
            n = inner.shape[1]
            rows.append(np.repeat(own, n)), leaves.append(np.tile(self.first[k] + np.arange(n), len(own))), odds.append((inner * p[own, k][:, None]).reshape(-1))
        rows, leaves, odds = (np.concatenate(x) for x in (rows, leaves, odds))
        order = np.lexsort((leaves, -odds, rows))
        rows, leaves, odds = rows[order], leaves[order], odds[order]
        start = np.searchsorted(rows, rows, "left")
        so_far = lambda x: (np.cumsum(x) - x) - (np.cumsum(x) - x)[start]
        go = (so_far(odds) < mass) | (so_far(sizes[leaves]) < least) | (mass >= 1)
        return rows[go], leaves[go]


def _until(p: np.ndarray, sizes: np.ndarray, mass: float, least: int) -> np.ndarray:
    """Of each row, the most probable places until these hold `mass` and `least` rows."""
    order = np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, 1)
    go = (np.cumsum(ranked, axis=1) - ranked < mass) | (np.cumsum(sizes[order], axis=1) - sizes[order] < least) | (mass >= 1)
    out = np.zeros(p.shape, bool)
    np.put_along_axis(out, order, go, axis=1)
    return out


def fitted(rows: DataFrame, dimension: int, n: int, k: int, part_rows: int, fan: int) -> Hierarchy:
    """Partitioners for n rows (id, v): that of a sample of all rows; where more than `fan` parts are wanted, also that of a sample of each
    part's rows. A sample has SAMPLE vectors at most and is fitted in one task, where Spark gives linear algebra the task's own core only."""
    wanted = max(LEAST_PARTS, -(-n // part_rows))
    first = wanted if wanted <= fan else int(np.ceil(np.sqrt(wanted)))

    def of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.concatenate([_matrix(x) for x in batches if x.num_rows] or [np.zeros((0, dimension))])
        if len(vectors):
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(Partitioner.fit(vectors, k, first))], pa.binary())})

    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").coalesce(1)
    top = pickle.loads(drawn.mapInArrow(of_sample, "model binary").first()[0])
    if wanted <= fan:
        return Hierarchy(top)
    each = min(fan, -(-wanted // top.parts))
    # The share of each part's rows that makes its sample, by hash; a part's task then cuts what chance has put over SAMPLE.
    shared = rows.sparkSession.sparkContext.broadcast(Hierarchy(top))
    placed = assigned(rows, shared)
    rate = min(1.0, SAMPLE * top.parts / n)
    some = placed.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def of_part(key: tuple, table: pa.Table) -> pa.Table:
        vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dimension)[:SAMPLE]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(Partitioner.fit(vectors, k, each))], pa.binary())})

    models = some.groupBy("part").applyInArrow(of_part, "part int, model binary").collect()
    return Hierarchy(top, {r.part: pickle.loads(r.model) for r in models})


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


class _Blocks:
    """Rows gathered by part into blocks of vectors, each a row with its ids and values as bytes."""

    def __init__(self, size: int):
        self.size, self.held, self.count = size, {}, 0

    def add(self, part: int, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        own = self.held.setdefault(part, [[], [], 0])
        own[0].append(ids), own[1].append(vectors)
        own[2] += len(ids)
        self.count += len(ids)
        if own[2] >= self.size:
            yield from self.flush(part)

    def flush(self, part: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, vectors, n = self.held.pop(part)
        self.count -= n
        ids, vectors = np.concatenate(ids), np.concatenate(vectors)
        for at in range(0, n, self.size):
            yield part, ids[at : at + self.size], vectors[at : at + self.size]

    def largest(self) -> int:
        return max(self.held, key=lambda k: self.held[k][2])


def _rows(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "part": pa.array([p for p, _, _ in blocks], pa.int32()), "ids": pa.array([i.astype("<i8").tobytes() for _, i, _ in blocks], pa.binary()),
        "vectors": pa.array([v.astype("<f8").tobytes() for _, _, v in blocks], pa.binary()),
    })


_BLOCK_SCHEMA = "part int, ids binary, vectors binary"


def assigned(rows: DataFrame, hierarchy: Broadcast) -> DataFrame:
    """rows (id, v) with part, their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                part = hierarchy.value.leaf(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(part.astype(np.int32))], names=["id", "v", "part"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, part int")


def blocks_by_part(rows: DataFrame, size: int, route=None) -> DataFrame:
    """Blocks of the rows (id, v): each row in its column part, or with `route` in all parts that this gives for the vectors. A
    task holds at most 64 blocks' worth of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Blocks(size)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids, vectors = batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch)
                row, part = (np.arange(len(ids)), batch.column("part").to_numpy()) if route is None else route(vectors)
                for k in np.unique(part).tolist():
                    some = row[part == k]
                    if full := list(held.add(k, ids[some], vectors[some])):
                        yield _rows(full)
                while held.count > 64 * size:
                    yield _rows(list(held.flush(held.largest())))
        for k in list(held.held):
            yield _rows(list(held.flush(k)))

    return rows.mapInArrow(run, _BLOCK_SCHEMA)


def _best_of_block(qi: np.ndarray, qv: np.ndarray, ci: np.ndarray, cv: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, ids and exact scores of each query's k nearest candidates of a block."""
    rough = qv @ cv.T
    rough[qi[:, None] == ci[None, :]] = -np.inf
    # Sums in another order may differ in the last bits, and equal vectors must tie: what is near the k-th is scored anew.
    least = np.partition(rough, len(ci) - k, axis=1)[:, len(ci) - k] if len(ci) > k else np.full(len(qi), -np.inf)
    row, place = np.nonzero((rough >= (least - 1e-9 * np.maximum(1.0, np.abs(least)))[:, None]) & (rough > -np.inf))
    return row, ci[place], (qv[row] * cv[place]).sum(1)


def search_blocks(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each block of queries and part, each query's k nearest there but itself. Pairs of one
    block of queries follow each other, and are merged before they leave the task."""

    def first(row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        start = np.searchsorted(row, row, "left")
        keep = np.arange(len(row)) - start < k
        return row[keep], ids[keep], scores[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = None, None

        def out() -> pa.RecordBatch:
            row, ids, scores = best
            return pa.RecordBatch.from_pydict({"query_id": held[row], "vec_id": ids, "score": scores})

        for batch in batches:
            for j in range(batch.num_rows):
                qi, qv, ci, cv = (np.frombuffer(batch.column(c)[j].as_buffer(), t) for c, t in (("qi", "<i8"), ("qv", "<f8"), ("ci", "<i8"), ("cv", "<f8")))
                found = _best_of_block(qi, qv.reshape(len(qi), -1), ci, cv.reshape(len(ci), -1), k)
                if held is None or not np.array_equal(held, qi):
                    if held is not None:
                        yield out()
                    held, best = qi.copy(), tuple(x[:0] for x in found)
                best = first(*[np.concatenate(x) for x in zip(best, found)])
        if held is not None:
            yield out()

    return pairs.select("qi", "qv", "ci", "cv").mapInArrow(run, "query_id long, vec_id long, score double")


def search(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, mass: float = 0.95,
    part_rows: int = PART_ROWS, fan: int = FAN,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found nearest to each row for which `queries` holds.

    Nearness is the largest inner product in double precision, computed on the original vectors; ties go to the smaller id. A
    query is no neighbour of its own id.

    A partitioner is fitted on a bounded sample (SAMPLE): a balanced partition of the sample's neighbour graph, and a classifier of where a
    vector's neighbours lie. Parts grow in number with the rows, to about `part_rows` rows each; beyond `fan` parts, each part has its own
    partitioner below (see `fitted`). Every row is indexed in its most probable part. A query
    goes to its most probable parts until these hold `mass` of the probability, and k + 1 rows at least; there all
    rows are scored. The recall is about `mass`; 1.0 searches all.

    A part's rows are dealt to tasks by hash, so none gathers a large part, and gathered into blocks. These are scored against blocks of
    queries of the same part: a join by part and deal, of which a part has one for SEARCHED rows, and to each of which its query blocks are copied.
    Unusable vectors (null, zero, with null or non-finite components) and null ids take no part, nor do vectors of
    another length than the most frequent one (the longest of equally frequent). Repeated rows are found each; a query row that is repeated is asked
    once. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == lengths["d"])
    shared = spark.sparkContext.broadcast(fitted(rows, lengths["d"], lengths["n"], k, part_rows, fan))
    placed = scratch.save(assigned(rows, shared), "placed")
    counts = scratch.save(placed.groupBy("part").agg(F.count("*").alias("n")), "counts")
    sizes = np.zeros(shared.value.leaves, np.int64)
    for part, n in counts.collect():
        sizes[part] = n
    dealt = placed.join(counts, "part").withColumn("deal", F.pmod(F.xxhash64("id"), F.expr(f"n div {DEALT} + 1")))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "deal")
    index = scratch.save(blocks_by_part(dealt.select("id", "v", "part"), BLOCK), "index")

    def route(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return shared.value.route(v, sizes, mass, k + 1)

    asked = scratch.save(blocks_by_part(rows.where("q").select("id", "v").dropDuplicates(), 256, route), "asked")
    deals = F.expr(f"n div {SEARCHED} + 1")
    index = index.join(counts, "part").select("part", F.pmod(F.xxhash64("ids"), deals).alias("deal"), F.col("ids").alias("ci"), F.col("vectors").alias("cv"))
    asked = asked.join(counts, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)).alias("deal"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    found = search_blocks(asked.join(index, ["part", "deal"]), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
