"""Hand-made cases of metrics, ranks and screening."""

import math

import pytest
from pyspark.sql import functions as F

from poseflow.operators import poses, ranks, scoring


def pose_table(spark, rows, complex_="c"):
    return spark.createDataFrame([(complex_, f"p{k}", float(r), float(s)) for k, (r, s) in enumerate(rows)], "complex string, code string, rmsd double, score double")


def test_success_has_inclusive_cut(spark):
    df = pose_table(spark, [(3.0, 9), (2.0, 8), (5.0, 7)])
    assert {r.k: r.rate for r in poses.pose_success(df).collect()} == {1: 0.0, 2: 1.0, 3: 1.0}
    negated = df.withColumn("score", -F.col("score"))
    assert {r.k: r.rate for r in poses.pose_success(negated, "negative").collect()} == {1: 0.0, 2: 1.0, 3: 1.0}
    with pytest.raises(ValueError):
        poses.pose_success(df, "upwards")


def test_spearman_needs_five_poses_and_variation(spark):
    four = pose_table(spark, [(1, 4), (1.5, 3), (1.8, 2), (2, 1), (2.5, 0)])
    got = {r.s: r for r in poses.pose_spearman(four).collect()}
    assert 2 not in got and got[3].spearman == pytest.approx(1.0)
    constant = pose_table(spark, [(k, 5) for k in range(5)], "d").unionByName(four)
    assert {r.s: (r.n_complexes, round(r.spearman, 9)) for r in poses.pose_spearman(constant).collect()}[5] == (1, 1.0)


def test_ranking_only_of_exactly_five(spark):
    rows = [(t, f"{t}{k}", float(k), float(k if t != "r" else -k)) for t, n in (("a", 4), ("b", 5), ("r", 5), ("c", 6)) for k in range(n)]
    df = spark.createDataFrame(rows, "target string, code string, logKa double, score double")
    got = {r.target: r for r in scoring.ranking_power(df).collect()}
    assert set(got) == {"b", "r"} and got["b"].representative == "b4"
    assert (got["b"].pi, got["b"].kendall, got["r"].pi, got["r"].kendall) == (1.0, 1.0, -1.0, -1.0)


@pytest.mark.parametrize("n, want", [(49, 1), (50, 1), (150, 2), (149, 1)])
def test_cutoffs_round_half_up(spark, n, want):
    assert spark.range(1).select(scoring.cutoffs(F.lit(n))[0]["top"]).first()[0] == want


def test_enrichment(spark):
    actives = spark.createDataFrame([("t", k, f"a{k}") for k in range(1, 11)] + [("u", 1, f"d{k}") for k in range(50)], "target string, rank int, ligand string")
    scores = [("t", f"a{k}", 100.0 - k) for k in range(1, 4)] + [("t", f"a{k}", float(-k)) for k in range(4, 11)] + [("t", f"d{k}", float(k)) for k in range(50)]
    got = {r.fraction: r for r in scoring.screening_power(spark.createDataFrame(scores, "target string, ligand string, score double"), actives).where("target = 't'").collect()}
    assert got[0.05].top == 3 and got[0.05].hits == 3 and got[0.05].ef == pytest.approx(6) and got[0.05].success


def test_scoring_power_and_linear_fit(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k + 1) for k in range(6)] + [(None, 1.0)], "score double, logKa double")
    r = scoring.scoring_power(df).first()
    assert (r.n, round(r.pearson, 12), round(r.slope, 12), round(r.intercept, 12)) == (6, 1.0, 2.0, 1.0) and r.sd < 1e-6
    assert scoring.scoring_power(spark.createDataFrame([(1.0, 2.0)] * 3, "score double, logKa double")).first().pearson is None


def test_core_keeps_first(spark):
    core = spark.createDataFrame([("x", "t2", 5.0), ("x", "t1", 9.0), ("y", "t1", 1.0)], "code string, target string, logKa double")
    got = scoring.join_core(core, spark.createDataFrame([("x", 1.0)], "code string, score double")).collect()
    assert [(r.code, r.target) for r in got] == [("x", "t1")]


def rigid(points, mirror=False):
    c, s = math.cos(0.7), math.sin(0.7)
    return [(c * x - s * y + 3, s * x + c * y - 1, (-z if mirror else z) + 2) for x, y, z in points]


def test_kabsch(spark):
    base = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0), (1.0, 1.0, 1.0)]
    rows = [("moved", k, *p, *q) for k, (p, q) in enumerate(zip(base, rigid(base)))]
    rows += [("mirror", k, *p, *q) for k, (p, q) in enumerate(zip(base, rigid(base, True)))]
    rows += [("one", 0, *base[1], *base[2])]
    df = spark.createDataFrame(rows, "complex string, atom_idx int, px double, py double, pz double, tx double, ty double, tz double")
    got = {r.complex: r.kabsch_rmsd for r in poses.kabsch_rmsd(df, ["complex"]).collect()}
    plain = {r.complex: r.rmsd for r in poses.rmsd(df, ["complex"]).collect()}
    assert got["moved"] < 1e-6 and 0.1 < got["mirror"] <= plain["mirror"] and got["one"] < 1e-6


def test_auroc_with_ties_and_one_class(spark):
    rows = [("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.4, 1), ("a", 0.9, 1), ("b", 0.5, 1)]
    got = {r.k: r for r in poses.classification_metrics(spark.createDataFrame(rows, "k string, s double, y int"), "s", "y", keys=["k"]).collect()}
    assert got["a"].auroc == pytest.approx(3.5 / 4) and got["b"].auroc is None and got["b"].recall_1 == 1.0 and got["b"].recall_0 is None


def test_ranks(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 5.0), ("k", 3, 7.0), ("k", 4, None)], "k string, id int, v double")
    assert {r.id: r.a for r in df.where("v is not null").select("id", ranks.avg_rank(["k"], "v").alias("a")).collect()} == {1: 1.5, 2: 1.5, 3: 3.0}
    assert ranks.best_row(df, ["k"], "v", "id").first().id == 3 and ranks.best_row(df, ["k"], "v", "id", largest=False).first().id == 1
    assert [r.id for r in ranks.last_n(df.where("v is not null"), ["k"], 2, "v", "id").orderBy("id").collect()] == [1, 3]


def test_slice_flat_crosses_blocks(spark):
    lengths = spark.createDataFrame([(1, 2, 3), (2, 0, 5), (3, 300, 300)], "o int, p long, c long")
    values = spark.range(6 + 90000).selectExpr("id as position", "cast(id as double) value")
    got = ranks.slice_flat(lengths, values, "o")
    assert got.count() == 90006 and got.where("o = 3 and i = 299 and j = 299").first().value == 90005.0 and got.where("o = 1 and i = 1 and j = 0").first().value == 3.0


def test_bootstrap_covers_mean(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 20 as double) v")
    r = scoring.bootstrap(df, "v", "id", replicates=200).first()
    assert r.low < r.estimate < r.high and r.estimate == 9.5 and r.high - r.low < 2


def test_pocket_report_prefers_foreign_pockets(spark):
    rows = [("p", 1, True, 10, 10, 5.0, 9.0), ("p", 2, False, 9, 10, 5.0, 8.0), ("q", 1, True, 4, 10, 6.0, 7.0)]
    r = poses.pocket_selection_report(spark.createDataFrame(rows, "pdb string, index int, is_native boolean, num_contact int, native_num_contact int, affinity double, affinity_pred double")).first()
    assert (r.n, r.cover_9, r.cover_8, r.cover_5) == (2, 0.0, 0.5, 0.5)
