"""Queries over whole tables against plain loops."""

import math

import numpy as np
import pytest

from poseflow.operators import graphs, ordered, scoring, splits, waters
from poseflow.plans import queries
from poseflow.plans.views import table

SF = "/root/testdata/sf0.001"


def test_bonds(spark):
    by = {}
    for r in table(spark, SF, "embeddings").orderBy("vec_id").collect():
        by.setdefault(r.label, []).append(r.vec_id)
    near = {(k, a[i], a[j]) for k, a in by.items() for i in range(len(a)) for j in range(max(i - 2, 0), min(i + 3, len(a))) if i != j}
    assert {(r.k, r.src, r.dst) for r in queries.QUERIES["bond_neighbours"](spark, SF).collect()} == near
    rings = {(k, x, y) for k, a in by.items() for s in range(0, len(a), 6) for x in a[s : s + 6] for y in a[s : s + 6]}
    mask = {(r.k, r.src, r.dst) for r in queries.QUERIES["flex_mask"](spark, SF).collect()}
    assert mask == near | rings | {(k, x, x) for k, a in by.items() for x in a if len(a) > 1}


def test_labels(spark):
    by = {}
    for r in table(spark, SF, "lineitem").collect():
        by.setdefault(r.l_orderkey, set()).add(r.l_linenumber)
    every = {(c, i, j, int((c + i * j) % 4 == 0)) for c, own in by.items() for i in own for j in own}
    assert {(r.complex, r.i, r.j, r.label) for r in queries.QUERIES["label_matrix"](spark, SF).collect()} == every
    assert {(r.complex, r.i, r.j) for r in queries.QUERIES["negatives"](spark, SF).collect()} == {x[:3] for x in every if not x[3]}


def merged_greedily(points, names, distance, method):
    """Clusters by merging the closest two at a time, ties to the smaller names."""
    held = {n: [k] for k, n in enumerate(names)}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    while True:
        best = None
        ordered_names = sorted(held)
        for i, a in enumerate(ordered_names):
            for b in ordered_names[i + 1 :]:
                x = d[np.ix_(held[a], held[b])]
                x = x.max() if method == "complete" else x.mean()
                if x <= distance and (best is None or (x, a, b) < best):
                    best = x, a, b
        if best is None:
            return {names[k]: a for a, own in held.items() for k in own}
        held[best[1]] += held.pop(best[2])


@pytest.mark.parametrize("method", ["complete", "average"])
def test_linkage_brute_force(spark, method):
    rng = np.random.default_rng(3)
    points = rng.uniform(0, 4, size=(40, 3))
    rows = [(f"p{k % 4}", k, *map(float, p), "c") for k, p in enumerate(points)]
    names = [f"{r[0]}/{r[1]}" for r in rows]
    df = spark.createDataFrame([*rows, ("q", 1, None, 0.0, 0.0, "c"), rows[5]], "protein string, water_id long, x double, y double, z double, dist string")
    got = [(f"{r.protein}/{r.water_id}", r.cluster, r.dist) for r in waters.cluster_waters(df, 2.0, method).collect()]
    want = merged_greedily(points, names, 2.0, method)
    assert len(got) == 42 and {n: c for n, c, _ in got} == want | {"q/1": "q/1"} and all(x == "c" for _, _, x in got)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 1.0])
def test_similar_pairs_brute_force(spark, threshold):
    """Of two words, with hot bits, single bits and an empty set."""
    rng = np.random.default_rng(int(10 * threshold))
    sets = [set(rng.choice(128, size=rng.integers(1, 6), replace=False).tolist()) | ({0} if rng.random() < 0.5 else set()) for _ in range(60)]
    sets += [set(s) | {int(rng.integers(128))} for s in sets[:30]] + [set(), {7}, {7}]
    word = lambda s, k: sum(1 << (b - 64 * k) for b in s if 64 * k <= b < 64 * k + 64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, [signed(word(s, 0)), signed(word(s, 1))]) for k, s in enumerate(sets)], "id long, words array<long>")
    got = {(r.a, r.b): r.similarity for r in splits.similar_pairs(df, "id", "words", threshold).collect()}
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a | b and len(a & b) / len(a | b) >= threshold}
    assert got == want


def test_knn_with_far_points_and_small_structures(spark):
    rng = np.random.default_rng(2)
    rows = [("a", k, *map(float, p)) for k, p in enumerate(rng.normal(size=(60, 3)))] + [("a", 60, 500.0, 0.0, 0.0), ("b", 0, 0.0, 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0), ("c", 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double, z double")
    got = {}
    for r in graphs.knn_graph(df, ["k"], 4).collect():
        got.setdefault((r.k, r.src), set()).add(r.dst)
    for key, own, *p in rows:
        others = sorted((math.dist(p, q), o) for other, o, *q in rows if other == key and o != own)
        assert got.get((key, own), set()) == {o for _, o in others[:4]}


def test_order_statistics(spark):
    rng = np.random.default_rng(5)
    rows = [(("a", "b", None)[k % 3], float(v), int(v * 10)) for k, v in enumerate(rng.permutation(300))]
    df = spark.createDataFrame(rows, "k string, v double, n long").repartition(7)
    sums = {r.v: r.before for r in ordered.sums_before(df, ["k"], ["v"], "n", "before").collect()}
    assert sums == {v: sum(m for x, w, m in rows if x == k and w < v) for k, v, _ in rows}
    one = ordered.quantiles(df, "v", {"q": 0.3, "m": 0.5}, {"low": 0.5, "first": 0.0}).first()
    values = sorted(v for _, v, _ in rows)
    assert (one.q, one.m) == tuple(np.quantile(values, [0.3, 0.5])) and (one.low, one.first) == (149.0, 0.0)
    none = ordered.quantiles(df.where("false"), "v", {"q": 0.3}, {"low": 0.5}).first()
    assert none.q is None and none.low is None
    assert ordered.sums_before(df.where("false"), [], ["v"], "n", "before").count() == 0


def test_bootstrap_means_brute_force(spark):
    import hashlib

    rows = [(f"id{k}", float(k % 17)) for k in range(200)]
    df = spark.createDataFrame([*rows, ("null", None)], "id string, v double")
    got = {r.r: r.m for r in scoring.bootstrap_means(df.repartition(5), "v", "id", 30, 2).collect()}
    for r in range(1, 31):
        weights = []
        for name, _ in rows:
            u = pow(int(hashlib.md5(name.encode()).hexdigest()[:7], 16) + 69621 * r + 40503 * 2, 5, (1 << 31) - 1) / ((1 << 31) - 1)
            weights.append(sum(u >= p for p in scoring.POISSON))
        assert got[r] == pytest.approx(sum(w * v for w, (_, v) in zip(weights, rows)) / sum(weights))
    assert abs(np.mean(list(got.values())) - np.mean([v for _, v in rows])) < 0.5
    assert {r.m for r in scoring.bootstrap_means(df.where("false"), "v", "id", 3).collect()} <= {None}
