"""Distance joins, graphs, waters and splits against brute force and hand-made cases."""

import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from poseflow.functions import vectors as V
from poseflow.operators import graphs, residues, spatial, splits, waters
from poseflow.operators.components import connected_components


def points(spark, rows):
    return spark.createDataFrame([(k, i, float(x), float(y), float(z)) for k, i, x, y, z in rows], "k string, id int, x double, y double, z double")


@pytest.fixture(scope="module")
def cloud():
    rng = random.Random(7)
    return [(rng.choice("ab"), i, *(rng.uniform(-5, 5) for _ in range(3))) for i in range(150)]


@pytest.mark.parametrize("cutoff", [0.7, 2.5, 20.0])
def test_grid_join_is_cross_join(spark, cloud, cutoff):
    df = points(spark, cloud)
    got = {(r.k, r.a_id, r.b_id) for r in spatial.grid_join(df, df, cutoff, ["k"]).collect()}
    assert got == {(p[0], p[1], q[1]) for p in cloud for q in cloud if p[0] == q[0] and math.dist(p[2:], q[2:]) < cutoff}


@pytest.mark.parametrize("inclusive", [False, True])
def test_half_shell_is_the_whole_join_in_half_the_rows(spark, cloud, inclusive):
    df = points(spark, [*cloud, ("a", 500, 1, 1, 1), ("a", 501, 1, 1, 1), ("a", 502, 1, 1, 2.5)])
    show = lambda rows: sorted((r.k, r.a_id, r.b_id, r.a_x, r.b_z, r.dist) for r in rows.collect())
    assert show(spatial.grid_self_join(df, 1.5, ["k"], inclusive)) == show(spatial.grid_join(df, df, 1.5, ["k"], inclusive))
    met = spatial._half_shell(df, 1.5, ["k"])
    own, ahead = (met.where(w).count() for w in ("not __ahead", "__ahead"))
    cells = {}
    for r in df.collect():
        c = (r.k, *(math.floor(v / 1.5) for v in (r.x, r.y, r.z)))
        cells[c] = cells.get(c, 0) + 1
    whole = sum(n * cells.get((k, x + i, y + j, z + m), 0) for (k, x, y, z), n in cells.items() for i, j, m in itertools.product((-1, 0, 1), repeat=3))
    assert own == sum(n * n for n in cells.values()) and own + 2 * ahead == whole


def test_grid_join_edges(spark):
    df = points(spark, [("a", 1, 0, 0, 0), ("a", 2, 1, 0, 0), ("b", 3, 0, 0, 0)])
    bad = spark.createDataFrame([("a", 4, None, 0.0, 0.0), (None, 5, 0.0, 0.0, 0.0)], df.schema)
    df = df.unionByName(bad)
    assert spatial.grid_join(df, df, 1.0, ["k"]).count() == 3 and spatial.grid_join(df, df, 1.0, ["k"], inclusive=True).count() == 5
    assert spatial.grid_join(df.where("false"), df, 1.0, ["k"]).count() == 0


def test_nearest_falls_back(spark, cloud):
    df = points(spark, cloud)
    a, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = {r.a_id: r.b_id for r in spatial.nearest(a, b, ["k"], "id").collect()}
    want = {p[1]: min((q for q in cloud if q[0] == p[0] and q[1] % 2), key=lambda q: (math.dist(p[2:], q[2:]), q[1]))[1] for p in cloud if p[1] % 2 == 0}
    assert got == want


def test_graph_rules(spark):
    line = [("a", i, i * 0.1, 0, 0) for i in range(13)] + [("a", 50, 9, 9, 9)]
    edges = graphs.radius_knn_graph(points(spark, line), ["k"], 1.0, 10).collect()
    by = {}
    for e in edges:
        by.setdefault(e.src, []).append(e.dst)
    assert len(by[6]) == 10 and by[50] == [12] and 50 not in by[12]
    assert sorted(by[0]) == list(range(1, 10))
    capped = graphs.limited_edges(points(spark, line), ["k"], 1.0, 5)
    assert capped.count() == 14  # 14 loops tie at zero
    done = graphs.finish_graph(points(spark, line), graphs.radius_graph(points(spark, line), ["k"], 0.15).where("src < dst"), ["k"]).collect()
    assert (50, None) in {(r.src, r.dst) for r in done} and len(done) == 25


def test_pocket_fallbacks(spark):
    near = [("a", i, i * 0.1, 0, 0) for i in range(3)] + [("a", i, 100 + i, 0, 0) for i in range(3, 150)]
    got = spatial.nodes_in_pocket(points(spark, near), points(spark, [("a", 0, 0, 0, 0)]), ["k"])
    assert sorted(r.id for r in got.collect()) == list(range(100))
    rec = spark.createDataFrame([("a", c, x, 0.0, 0.0, w) for c, x, w in (("A", 30.0, False), ("B", 20.0, False), ("W", 0.5, True))], "k string, chain string, x double, y double, z double, is_water boolean")
    lig = points(spark, [("a", 0, 0, 0, 0)])
    assert [r.chain for r in spatial.chains_near_ligand(rec, lig, ["k"], 10.0).collect()] == ["B"]
    assert spatial.chains_near_ligand(rec, lig, ["k"], 10.0, fallback=False).collect() == []
    assert {r.chain for r in spatial.chains_near_ligand(rec, lig, ["k"], 40.0).collect()} == {"A", "B"}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges + [(1, None), (7, 7)], "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_torsion_of_butane(spark):
    atoms = points(spark, [("m", 1, 0, 1, 0), ("m", 2, 0, 0, 0), ("m", 3, 1, 0, 0), ("m", 4, 1, 0, 1)])
    bonds = spark.createDataFrame([("m", 1, 2, False), ("m", 2, 3, True), ("m", 3, 4, False)], "k string, src int, dst int, rotatable boolean")
    assert abs(abs(graphs.torsion_angles(bonds, atoms, ["k"]).first().torsion) - 90) < 1e-9


def test_polar_hydrogens(spark):
    atoms = spark.createDataFrame([("m", 1, "C"), ("m", 2, "H"), ("m", 3, "O"), ("m", 4, "H")], "k string, id int, element string")
    bonds = spark.createDataFrame([("m", 1, 2), ("m", 1, 3), ("m", 3, 4)], "k string, src int, dst int")
    assert sorted(r.id for r in graphs.polar_hydrogens_only(atoms, bonds, ["k"]).collect()) == [1, 3, 4]


def test_rigid_motion_and_dihedral(spark):
    df = points(spark, [("a", i, i, i * i, -i) for i in range(4)])
    moved = df.select("id", V.vec("x", "y", "z").alias("v"), V.rotate_translate(V.vec("x", "y", "z"), V.rotation(5, "k"), V.vec(F.lit(1), F.lit(2), F.lit(3)), V.vec(F.lit(0), F.lit(0), F.lit(0))).alias("w"))
    rows = moved.orderBy("id").collect()
    for p, q in itertools.combinations(rows, 2):
        assert math.dist(p.v, q.v) == pytest.approx(math.dist(p.w, q.w))
    at = lambda *p: V.vec(*[F.lit(float(x)) for x in p])
    assert spark.range(1).select(V.dihedral(at(0, 1, 0), at(0, 0, 0), at(1, 0, 0), at(1, -1, 0))).first()[0] == pytest.approx(180)


def test_half_sphere_and_sidechain(spark):
    rows = [("p", 1, "ALA", n, str(k), *p) for k, (n, p) in enumerate([("N", (1, 0, 0)), ("CA", (0, 0, 0)), ("C", (0, 1, 0)), ("O", (0, 2, 0)), ("CB", (0, 0, 1))])]
    rows += [("p", 2, "GLY", n, str(k + 10), *p) for k, (n, p) in enumerate([("N", (1, 0, 4)), ("CA", (0, 0, 4)), ("C", (0, 1, 4)), ("O", (0, 2, 4))])]
    atoms = spark.createDataFrame([(a, b, c, d, e, float(x), float(y), float(z)) for a, b, c, d, e, x, y, z in rows], "pdb_name string, residue int, resname string, atom_name string, aid string, x double, y double, z double")
    from poseflow.operators import features

    vectors = features.sidechain_vectors(atoms, ["pdb_name", "residue"])
    similar = spatial.residue_similarity(atoms, ["pdb_name"], "residue")
    got = {r.residue: r.hsaac for r in features.half_sphere_composition(similar, vectors, ["pdb_name"], "residue").collect()}
    up, down = got[1][:21], got[1][21:]
    letters = [*residues.LETTERS.values(), "X"]
    assert up[letters.index("G")] == pytest.approx(1 / 3) and up[letters.index("A")] == pytest.approx(1 / 3) and down[letters.index("A")] == pytest.approx(2 / 3)


def test_water_conservation(spark):
    rows = [("q", 1, 0, 0, 0), ("a", 1, 0.5, 0, 0), ("b", 1, 0.2, 0, 0), ("b", 2, 0.3, 0, 0), ("q", 2, 50, 0, 0), ("a", 2, 50.1, 0, 0), ("b", 3, 50.2, 0, 0), ("a", 9, 90, 0, 0)]
    df = spark.createDataFrame([(p, i, float(x), float(y), float(z)) for p, i, x, y, z in rows], "protein string, water_id int, x double, y double, z double")
    got = waters.water_conservation(df, "q", probability=0.7).collect()
    assert [(r.water_id, r.n_proteins) for r in got] == [(2, 3)]
    conserved = waters.water_conservation(df, "q", probability=0.6)
    got = conserved.orderBy("water_id").collect()
    assert [(r.water_id, r.n_proteins) for r in got] == [(1, 2), (2, 3)] and [tuple(x) for x in got[0].proteins] == [("a", "1"), ("q", "1")]
    assert [(r.cluster, r.protein, r.water_id) for r in waters.without_water(conserved, df).collect()] == [("a/1", "b", "NoWater")]
    line = spark.createDataFrame([(str(k), k, k * 1.5, 0.0, 0.0) for k in range(6)], "protein string, water_id int, x double, y double, z double")
    assert waters.cluster_waters(line, 2.0, "single").select("cluster").distinct().count() == 1


def test_splits(spark):
    df = spark.range(103).selectExpr("id * 3 % 103 as id")
    got = splits.ratio_split(df, ["id"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 61, "valid": 21, "test": 21}
    packed = splits.pack_batches(spark.range(200).selectExpr("id", "id % 60 + 1 as n"), "id", "n", 50, shards=4).toPandas()
    assert packed.groupby("batch").n.sum().max() <= 50 and len(packed) == len([k for k in range(200) if k % 60 + 1 <= 50])
    label = spark.range(100).selectExpr("id % 2 as k", "id", "cast(id % 10 < 2 as int) label")
    kept = splits.balanced_labels(label, ["k"], "id", num_pos=3).groupBy("k", "label").count().collect()
    assert all(r["count"] == 3 for r in kept) and len(kept) == 4


def test_similarity_split_keeps_pairs_together(spark):
    rng = random.Random(4)
    words = []
    for k in range(60):
        bits = 0
        for _ in range(20):
            bits |= 1 << rng.randrange(63)
        words += [(3 * k, [bits]), (3 * k + 1, [bits ^ 1]), (3 * k + 2, [bits ^ (1 << rng.randrange(63))])]
    df = spark.createDataFrame(words, "id long, w array<long>")
    sim = lambda a, b: bin(a & b).count("1") / bin(a | b).count("1")
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(words, 2) if sim(a[0], b[0]) >= 0.7}
    assert {(r.a, r.b) for r in splits.similar_pairs(df, "id", "w", 0.7).collect()} == want
    got = {r.id: r["split"] for r in splits.similarity_split(df, "id", "w", 0.7).collect()}
    assert len(got) == 180 and all(got[i] == got[j] for i, j in want) and set(got.values()) == {"train", "valid", "test"}


def test_impute(spark):
    from poseflow.operators import features

    rows = [("five", k, None if k < 5 else float(k)) for k in range(10)] + [("six", k, float("nan") if k < 6 else 9.0) for k in range(10)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    got = {(r.k, r.id): r.v for r in features.impute(df, ["v"], ["k"]).collect()}
    assert got["five", 0] == 7.0 and got["six", 0] == 0.0 and got["six", 9] == 9.0
    arrays = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, None), ("a", 3, [3.0, None])], "k string, id int, v array<double>")
    assert {r.id: r.v for r in features.impute_array(arrays, "v", 2, ["k"], "id").collect()} == {1: [1.0, 2.0], 2: [2.0, 2.0], 3: [3.0, 2.0]}


def test_user_code_failures_are_isolated(spark):
    from poseflow.operators import batch

    def fn(frame):
        if frame["k"].iloc[0] == "bad":
            raise ValueError("no")
        return pd.DataFrame([{"k": frame["k"].iloc[0], "n": len(frame)}])

    df = spark.createDataFrame([("ok", 1.0), ("ok", 2.0), ("bad", 3.0)], "k string, v double")
    good, failed = batch.quarantine(batch.map_complexes(df, ["k"], fn, "k string, n long"))
    assert [(r.k, r.n) for r in good.collect()] == [("ok", 2)] and "no" in failed.first().error

    def open_model():
        def predict(frame):
            if (frame["v"] > 2).any():
                raise ValueError("too large")
            return frame["v"] * 10

        return predict

    got = {r.v: (r.affinity, r.error) for r in batch.batch_score(df, open_model).collect()}
    assert got[1.0] == (10.0, None) and got[3.0][0] is None and "too large" in got[3.0][1]
