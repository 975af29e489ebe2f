"""Neighbours without a radius, sites with many copies, kernels cut off and hot values: results against brute force, and how many rows they take."""

import functools
import math

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseflow.operators import graphs, ordered, space, spatial, waters

from test_whole_tables import merged_greedily


def shape(name, n, seed=0):
    """n points in a cube, a plane, a line, two distant clusters, one dense and one thin region, or few places with many copies."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(size=(n, 3))
    if name == "plane":
        p[:, 2] = 0.25
    elif name == "line":
        p[:, 1:] = 7
    elif name == "clusters":
        p[n // 2 :] += 1e5
    elif name == "densities":
        p[: n // 2] *= 1e-3
    elif name == "copies":
        p = p[rng.integers(0, n // 40, n)]
    return p


def frame(spark, points, key="s"):
    return spark.createDataFrame([(key, k, *map(float, p)) for k, p in enumerate(points)], "k string, id long, x double, y double, z double")


def brute_nearest(a, b, k, same):
    """(src, dst) of the k nearest of each, ties to the smaller id."""
    out = set()
    for i, p in enumerate(a):
        d = np.sqrt(((b[:, 0] - p[0]) * (b[:, 0] - p[0])) + (b[:, 1] - p[1]) * (b[:, 1] - p[1]) + (b[:, 2] - p[2]) * (b[:, 2] - p[2]))
        order = [j for j in np.lexsort((np.arange(len(b)), d)).tolist() if not (same and j == i)]
        out |= {(i, j) for j in order[:k]}
    return out


SHAPES = ["cube", "plane", "line", "clusters", "densities", "copies"]


def test_nearest_of_any_shape(spark):
    points = {name: shape(name, 400) for name in SHAPES}
    df = functools.reduce(DataFrame.union, [frame(spark, p, name) for name, p in points.items()])
    got = {}
    for r in graphs.knn_graph(df, ["k"], 7).collect():
        got.setdefault(r.k, set()).add((r.src, r.dst))
    assert got == {name: brute_nearest(p, p, 7, True) for name, p in points.items()}


def test_nearest_of_other_points(spark):
    """Queries inside and far outside of the points' cube, and in empty parts of it."""
    rng = np.random.default_rng(5)
    b = {name: shape(name, 300) for name in ("cube", "plane", "clusters")}
    far = np.concatenate([rng.uniform(-3, 4, size=(60, 3)), [[1e6, 0, 0], [-1e9, 1e9, 3], [5e4, 5e4, 5e4]]])
    a = {name: np.concatenate([p[:30] + 1e-3, far]) for name, p in b.items()}
    both = [functools.reduce(DataFrame.union, [frame(spark, p, name) for name, p in x.items()]) for x in (a, b)]
    got = {}
    for r in space.nearest_k(*both, ["k"], 3).collect():
        got.setdefault(r.k, set()).add((r.src, r.dst))
    assert got == {name: brute_nearest(a[name], b[name], 3, False) for name in b}


def test_nearest_edges(spark):
    rows = [("a", 1, 0.0, 0.0, 0.0), ("a", 2, 0.0, 0.0, 0.0), ("a", 3, 1.0, 0.0, 0.0), ("b", 1, 5.0, 5.0, 5.0), (None, 9, 0.0, 0.0, 0.0), ("a", 7, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double, z double").withColumns({"s": F.lit(1), "level": F.lit("x"), "dist": F.lit(2)})
    got = sorted((r.k, r.src, r.dst, r.dist, r["rank"]) for r in space.nearest_k(df, df, ["k"], 5, exclude_same=True).collect())
    assert got == [("a", 1, 2, 0.0, 1), ("a", 1, 3, 1.0, 2), ("a", 2, 1, 0.0, 1), ("a", 2, 3, 1.0, 2), ("a", 3, 1, 1.0, 1), ("a", 3, 2, 1.0, 2)]
    assert space.nearest_k(df.where("false"), df, ["k"], 1).count() == 0 and space.nearest_k(df, df.where("false"), ["k"], 1).count() == 0


def test_work_does_not_depend_on_the_shape(spark, monkeypatch):
    """Rows joined for any shape: at most twice those for a cube."""
    made, compared = {}, space._compared

    def counted(asked, points, exclude_same):
        out = compared(asked, points, exclude_same)
        for r in out.groupBy("s.k").count().collect():
            made[r.k] = made.get(r.k, 0) + r["count"]
        return out

    monkeypatch.setattr(space, "_compared", counted)
    df = functools.reduce(DataFrame.union, [frame(spark, shape(name, 3000), name) for name in SHAPES])
    space.nearest_k(df, df, ["k"], 10, exclude_same=True)
    assert max(made.values()) <= 2 * made["cube"] and made["cube"] < 3000 * 10 * 30


def test_chains_near_a_flat_ligand(spark):
    rng = np.random.default_rng(2)
    receptor = [("a", "ABC"[k % 3], float(x), float(y), 50.0, False) for k, (x, y) in enumerate(rng.uniform(size=(300, 2)))]
    ligand = frame(spark, rng.uniform(size=(40, 3)) * [1, 1, 0], "a")
    rec = spark.createDataFrame(receptor, "k string, chain string, x double, y double, z double, is_water boolean")
    want = min((math.dist(r[2:5], (p.x, p.y, p.z)), r[1]) for r in receptor for p in ligand.collect())
    got = spatial.chains_near_ligand(rec, ligand, ["k"], 3.0).collect()
    assert [(r.chain, pytest.approx(r.min_dist)) for r in got] == [(want[1], want[0])]


def sites(rng, n_sites, copies, spread):
    centres = np.stack(np.meshgrid(*[np.arange(4) * 2.6] * 3), -1).reshape(-1, 3)[:n_sites]
    points = (centres[:, None] + rng.uniform(-spread, spread, size=(n_sites, copies, 3))).reshape(-1, 3)
    return [(f"p{k % copies}", k, *map(float, p)) for k, p in enumerate(points)], points


WATER = "protein string, water_id long, x double, y double, z double"


@pytest.mark.parametrize("method", ["complete", "average"])
def test_linkage_of_superposed_sites(spark, method):
    """Tight sites, sites that nearly touch and sites that overlap, far from each other."""
    rows, want = [], set()
    parts = lambda m: {frozenset(k for k in m if m[k] == c) for c in m.values()}
    for k, spread in enumerate((0.2, 0.5, 1.1)):
        own, points = sites(np.random.default_rng(k), 8, 6, spread)
        own = [(p, 1000 * k + w, x + 500.0 * k, y, z) for p, w, x, y, z in own]
        rows += own
        want |= parts(merged_greedily(points, [f"{r[0]}/{r[1]}" for r in own], 2.0, method))
    got = {f"{r.protein}/{r.water_id}": r.cluster for r in waters.cluster_waters(spark.createDataFrame(rows, WATER), 2.0, method).collect()}
    assert parts(got) == want


@pytest.mark.parametrize("method", ["complete", "average"])
def test_superposed_sites_take_rows_in_proportion(spark, monkeypatch, method):
    """Fifteen times the copies of each site: rows follow them, not their pairs."""
    kept, save = {}, waters.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name.startswith(("pairs", "tight")):
            kept[copies] = max(kept.get(copies, 0), out.count())
        return out

    monkeypatch.setattr(waters.Scratch, "save", counted)
    for copies in (20, 300) if method == "complete" else (300,):
        rows, _ = sites(np.random.default_rng(1), 10, copies, 0.3)
        clusters = waters.cluster_waters(spark.createDataFrame(rows, WATER), 2.0, method)
        assert clusters.groupBy("cluster").count().where(f"count = {copies}").count() == 10
    assert kept[300] <= 10 * 300 and kept.get(20, 0) <= 10 * 20 + 200


@pytest.mark.parametrize("epsilon", [1e-12, 1.0])
def test_clash_is_within_its_bound(spark, epsilon):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 12, size=(60, 3)), rng.uniform(0, 12, size=(300, 3))
    d2 = ((a[:, None] - b[None]) ** 2).sum(-1)
    whole = 1.5 * np.exp(-0.2 * d2 * np.maximum(4 * d2 - 8, 1)).sum()
    got = spatial.clash_score(frame(spark, a), frame(spark, b), ["k"], 0.5, epsilon).first().clash
    assert whole - 1.5 * epsilon - 1e-9 <= got <= whole + 1e-9
    sigma, surface = 25.0, 10.0
    g = lambda axis: np.maximum(surface + sigma * np.log(1e-3 + np.exp(-d2 / sigma).sum(axis)), 0).mean()
    got = spatial.surface_clash(frame(spark, a), frame(spark, b), ["k"], epsilon=epsilon).first().clash
    assert g(0) + g(1) - 2 * epsilon - 1e-9 <= got <= g(0) + g(1) + 1e-9


def test_clash_of_points_far_apart_makes_no_pairs(spark, monkeypatch):
    made, join = [], spatial.grid_join

    def counted(*args, **named):
        out = join(*args, **named)
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, "grid_join", counted)
    points = np.arange(900).reshape(300, 3) * 60.0
    assert spatial.clash_score(frame(spark, points), frame(spark, points + 30), ["k"]).first().clash == 0.0
    assert spatial.surface_clash(frame(spark, points), frame(spark, points + 30), ["k"]).first().clash == 0.0 and made == [0, 0]


def test_first_shell_brute_force(spark):
    rng = np.random.default_rng(6)
    sides, want = ([], []), {}
    for k, (n, m, spread) in enumerate(((30, 40, 30.0), (30, 40, 2.0), (1, 3, 5.0), (1, 1, 1.0), (2, 2, 400.0))):
        a, b = rng.uniform(0, spread, size=(n, 3)), rng.uniform(0, spread, size=(m, 3))
        d = np.sort(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).reshape(-1))
        cut = 1.0
        while len(d) >= 4 and (d < cut).sum() < 4:
            cut += 0.5
        want[f"s{k}"] = int((d < cut).sum() if len(d) >= 4 else len(d))
        for side, p in zip(sides, (a, b)):
            side.append(frame(spark, p, f"s{k}"))
    both = [functools.reduce(DataFrame.union, side) for side in sides]
    found = spatial.pocket_points(*both, ["k"], 1.0, "radius_based").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in found} == want


def test_quantiles_of_a_hot_value(spark):
    values = [3.0] * 900 + [float(k) for k in range(100)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    known = np.array([v for v in values if v is not None])
    got = ordered.quantiles(df, "v", {"a": 0.02, "b": 0.5, "c": 0.999}, {"d": 0.95})
    row = got.first()
    assert (row.a, row.b, row.c) == tuple(np.quantile(known, [0.02, 0.5, 0.999])) and row.d == np.sort(known)[949]
