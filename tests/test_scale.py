"""Plans that must not grow faster than their input."""

import itertools
import math
import random
import re

import pytest

from poseflow.operators import joins, poses, spatial, splits, waters


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_explodes(text: str) -> bool:
    """Does a broadcast hold an explode, whose rows Spark expects to be as few as those before it?"""
    lines = [(re.search(r"[A-Za-z*]", x).start(), x) for x in text.splitlines() if re.search(r"[A-Za-z*]", x)]
    for k, (depth, line) in enumerate(lines):
        below = lines[k + 1 :]
        end = next((i for i, (d, _) in enumerate(below) if d <= depth), len(below))
        if "BroadcastExchange" in line and any("Generate explode" in x for _, x in below[:end]):
            return True
    return False


def test_bound_to_unbound_broadcasts_nothing(spark):
    """Atoms made by explode look small to Spark, so their broadcast outgrew the driver."""
    pairs = spark.sql("SELECT id pdb_name_0, 0 model_0, 'A' chain_0, 1 residue_0, id pdb_name_1, 0 model_1, 'B' chain_1, 2 residue_1 FROM range(20)")
    names = spark.sql("SELECT id bound, id + 100 unbound FROM range(20)")
    atoms = spark.sql("SELECT id + 100 pdb_name, 0 model, explode(array('A', 'B')) chain FROM range(15)").selectExpr("*", "explode(array(1, 2)) residue")
    found = joins.bound_to_unbound(pairs, names, atoms)
    assert "Broadcast" not in plan(found)
    assert sorted(r.pdb_name_0 for r in found.collect()) == list(range(100, 115))


def test_hits_of_sums_make_no_product(spark):
    """Equal to the best rows of all pairs, with shares that round to one sum, nulls and repeated names; only the best rows of a compound meet proteins."""
    proteins = spark.createDataFrame([("P", 1, 8.0), ("P", 2, 8.0), ("Q", 3, 0.1), (None, 4, 9.0), ("N", 5, None)], "protein_name string, protein_id long, protein_share double")
    shares = [(0, 1.0), (12, 1.0 + 2**-52), (123, 1.0 + 2**-52), (7, None)]
    compounds = spark.createDataFrame([(s, i, x) for s in ("a", "b", None) for i, x in shares] + [("b", k, 0.5) for k in range(20, 60)], "smiles string, compound_id long, compound_share double")
    pocket = "concat(compound_id, '-', protein_id)"
    pairs = proteins.crossJoin(compounds).selectExpr("protein_name", "smiles", f"{pocket} pocket_name", "protein_share + compound_share affinity")
    found = poses.hits_of_sums(proteins, compounds)
    columns = ["protein_name", "smiles", "pocket_name", "affinity"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, poses.hits(pairs).select(columns).collect()))
    assert {r.pocket_name for r in found.where("protein_name = 'P'").collect()} == {"0-1"}
    from poseflow.plans import queries

    assert "compound_share" in plan(queries.QUERIES["screening_hits"](spark, "/root/testdata/sf0.001")) and "part.parquet" not in plan(queries.QUERIES["screening_hits"](spark, "/root/testdata/sf0.001"))


def test_points_sent_around_are_not_broadcast(spark, monkeypatch):
    points = spark.range(50).selectExpr("concat('0/', id) wid", "'0' protein", "id water_id", "'s' k", "id % 7 / 50 x", "id % 5 / 50 y", "id / 500 z")
    assert not broadcast_explodes(plan(spatial.grid_join(points, points, 0.1, ["k"]))) and not broadcast_explodes(plan(spatial.grid_self_join(points, 0.1, ["k"])))
    plans, save = [], waters.Scratch.save
    monkeypatch.setattr(waters.Scratch, "save", lambda self, df, name: plans.append(plan(df)) or save(self, df, name))
    for method in ("complete",):
        waters.cluster_waters(points.select("protein", "water_id", "x", "y", "z"), 0.04, method)
    assert sum("Generate explode" in p for p in plans) >= 4 and not any(map(broadcast_explodes, plans))


def test_equal_fingerprints_meet_as_classes(spark, monkeypatch):
    """Pairs of copies come from blocks of members; no pair of rows is made before, and a split makes none."""
    monkeypatch.setattr(splits, "BLOCK", 7)
    words = [[0b1111, 0], [0b1111, 1], [0b11110000, 0], [0, 0], [0, 0b111]]
    held = {k: words[k % 5] for k in range(100)} | {200: [0b11111, 0], 201: None}
    df = spark.createDataFrame(list(held.items()), "id long, words array<long>")
    bits = {k: {(i, b) for i, w in enumerate(x or []) for b in range(64) if w >> b & 1} for k, x in held.items()}
    want = {(a, b): len(x & y) / len(x | y) for a, x in bits.items() for b, y in bits.items() if a < b and x | y and len(x & y) >= 0.8 * len(x | y)}
    made, save = [], splits.Scratch.save

    def count(self, df, name):
        out = save(self, df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(splits.Scratch, "save", count)
    got = splits.similar_pairs(df, "id", "words", 0.8).collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want) > 1000
    assert max(made) <= 102
    split = {r.id: r.component for r in splits.similarity_split(df, "id", "words", 0.8).collect()}
    assert max(made) <= 102 and len(split) == 102 and all(split[a] == split[b] for a, b in want) and split[3] == 3 and split[8] == 8 and split[201] == 201


def test_pose_spearman_makes_no_row_for_a_limit(spark):
    """Nulls and ties as by ranks within each limit; what is sorted are the poses alone."""
    rows = [("c", r, s) for r, s in ((1.0, 5.0), (1.5, 5.0), (2.0, 1.0), (2.0, 7.0), (2.5, None), (3.0, 2.0), (None, 3.0), (4.0, 2.0))]
    df = spark.createDataFrame(rows, "complex string, rmsd double, score double")
    found = poses.pose_spearman(df, limits=(2, 3, 10), least=4)
    text = plan(found)
    assert text.rindex("Generate") < text.index("Window")
    got = {r.s: r.spearman for r in found.collect()}
    for s in (2, 3, 10):
        want = poses.spearman(df.where(f"rmsd <= {s}"), ["complex"], "rmsd", "score", 4).first().spearman
        assert abs(got[s] + want) < 1e-9


def test_product_spreads_a_key(spark, monkeypatch):
    """One structure's pairs are many tasks' work."""
    monkeypatch.setattr(spatial, "BLOCK", 10)
    a, b = (spark.range(n).selectExpr("id div 1000 k", "id", "id / 10 x", "0D y", "0D z") for n in (200, 30))
    pairs = spatial.contact_map(a, b, ["k"], contact=1.0)
    assert pairs.select("a_id", "b_id").distinct().count() == pairs.count() == 6000
    assert pairs.where("label <> (abs(a_id / 10 - b_id / 10) < 1)").count() == 0
    tasks = spatial.all_pairs(a, b, ["k"]).selectExpr("spark_partition_id() p").groupBy("p").count()
    assert tasks.count() > 1


def test_edge_frames_are_dealt_by_blocks(spark):
    from poseflow.plans import queries

    assert "__block" in plan(queries.QUERIES["edge_frames"](spark, "/root/testdata/sf0.001"))


def test_average_linkage_broadcasts_no_table(spark, monkeypatch):
    """Centres and members of all clusters were broadcast in each round, and each mean measured anew; now a pair is measured again only after a merge of its own."""
    rng = random.Random(5)
    rows = [(f"{k % 3}", k, rng.random(), rng.random(), rng.random()) for k in range(90)]
    df = spark.createDataFrame(rows, "protein string, water_id long, x double, y double, z double")
    plans, save = [], waters.Scratch.save
    monkeypatch.setattr(waters.Scratch, "save", lambda self, df, name: plans.append(plan(df)) or save(self, df, name))
    got = {r.water_id: r.cluster for r in waters.cluster_waters(df, 0.35, "average").collect()}
    assert not any("BroadcastExchange" in p for p in plans)
    at = {f"{p}/{k}": (x, y, z) for p, k, x, y, z in rows}
    held = {w: [w] for w in at}
    while True:
        mean = lambda a, b: sum(math.dist(at[i], at[j]) for i in held[a] for j in held[b]) / len(held[a]) / len(held[b])
        d, a, b = min((mean(a, b), a, b) for a, b in itertools.combinations(sorted(held), 2))
        if d > 0.35:
            break
        held[a] += held.pop(b)
    assert got == {int(w.split("/")[1]): c for c, members in held.items() for w in members} and max(map(len, held.values())) > 3


def merged_by_hand(at, distance, method):
    """Name by name, clusters by merging the closest two at a time."""
    held = {w: [w] for w in at}
    apart = {(a, b): math.dist(at[a], at[b]) for a in at for b in at}
    for_all = {"complete": max, "average": lambda x: sum(x) / len(x)}[method]
    known = {(a, b): apart[a, b] for a, b in itertools.combinations(sorted(held), 2)}
    while known and min(known.values()) <= distance:
        _, a, b = min((d, a, b) for (a, b), d in known.items())
        held[a] += held.pop(b)
        known = {p: d for p, d in known.items() if a not in p and b not in p}
        known |= {tuple(sorted((a, c))): for_all([apart[i, j] for i in held[a] for j in held[c]]) for c in held if c != a}
    return {w: c for c, own in held.items() for w in own}


@pytest.mark.parametrize("method", ["complete", "average"])
def test_crowded_waters_make_few_pairs(spark, monkeypatch, method):
    """Pairs followed the square of how densely waters lie; copies at one place are one point; waters without a finite place stay alone."""
    rng, made, save = random.Random(7), {}, waters.Scratch.save

    def count(self, df, name):
        out = save(self, df, name)
        if name.startswith(("near", "close", "pairs")):
            made[name] = out.count()
        return out

    monkeypatch.setattr(waters.Scratch, "save", count)
    rows = [(f"{k % 5}", k, rng.random(), rng.random(), rng.random()) for k in range(250)]
    rows += [(f"{k % 5}", 1000 + k, *rows[k % 7][2:]) for k in range(40)]
    lost = [("n", 1, math.nan, 0.0, 0.0), ("n", 2, math.nan, 0.0, 0.0), ("i", 1, math.inf, 0.0, 0.0), ("i", 2, math.inf, 0.0, 0.0)]
    df = spark.createDataFrame(rows + lost, "protein string, water_id long, x double, y double, z double")
    got = {f"{r.protein}/{r.water_id}": r.cluster for r in waters.cluster_waters(df, 0.6, method).collect()}
    want = merged_by_hand({f"{p}/{k}": (x, y, z) for p, k, x, y, z in rows}, 0.6, method)
    assert got == want | {f"{p}/{k}": f"{p}/{k}" for p, k, *_ in lost} and len(set(want.values())) < 40
    assert max(made.values()) <= 16 * 250


def test_score_files_are_listed_without_a_glob(spark):
    """The driver listed folder by folder for the glob, and the plan named each folder."""
    from poseflow.plans import queries

    assert "InMemoryFileIndex(1 paths)" in queries.QUERIES["score_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_score_files_need_no_folder_each(spark, monkeypatch):
    """Each file had its own folder, which Spark's writer made and the reader listed; on local file systems a process was started for each."""
    import os

    from poseflow.plans import queries, readers

    folders, read = [], readers.text.read_score_dir
    monkeypatch.setattr(readers.text, "read_score_dir", lambda spark, path, *a, **b: folders.append(path) or read(spark, path, *a, **b))
    found = queries.QUERIES["score_files"](spark, "/root/testdata/sf0.001")
    complexes = {r[0] for r in found.select("complex").distinct().collect()}
    assert sorted(os.listdir(folders[0].removeprefix("file://"))) == sorted(f"grp={c}_score.dat" for c in complexes) and len(complexes) > 1


def test_named_files_hold_their_lines_in_order(spark, tmp_path):
    from poseflow.sources import files, text

    df = spark.range(30000).selectExpr("if(id % 3 = 0, null, concat('c ', id % 3)) c", "30000 - id k", "if(id = 4, null, concat(id, ' ', id % 7)) value")
    want = {c: [(i, None if i == 4 else f"{i} {i % 7}") for i in reversed(range(30000)) if i % 3 == m] for m, c in enumerate(["__HIVE_DEFAULT_PARTITION__", "c 1", "c 2"])}
    for _ in range(2):  # again over what lies there
        assert files.write_named(df, f"file://{tmp_path}/a", "c", ["k"], ending="_score.dat") == 3
    assert {p.name: p.read_text() for p in (tmp_path / "a").iterdir()} == {f"c={c}_score.dat": "".join(f"{line or ''}\n" for _, line in lines) for c, lines in want.items()}
    (tmp_path / "a" / "other.txt").write_text("x 1\n")
    scores = text.read_score_dir(spark, str(tmp_path / "a"), "score", "score")
    assert scores.count() == 29999 and scores.where("score <> code % 7").count() == 0
    assert "InMemoryFileIndex(1 paths)" in scores._jdf.queryExecution().toString()
    assert files.write_named(df.where("k < 0"), str(tmp_path / "none"), "c", ["k"]) == 0 and text.read_score_dir(spark, str(tmp_path / "none"), "score", "score").count() == 0


def test_missing_sources_are_dealt_by_their_number(spark, monkeypatch):
    """A task's sources did not get fewer with more tasks than the shuffle has parts; and they were sorted."""
    monkeypatch.setattr(joins, "PART", 10, raising=False)
    pairs = spark.range(200).selectExpr("id % 50 complex", "cast(id % 20 as string) a", "if(id % 3 = 0, null, cast(id % 7 as string)) b")
    files = spark.range(5).selectExpr("cast(id as string) path").union(spark.sql("SELECT cast(null as string) path"))
    found = joins.missing_sources(pairs, files, ["a", "b"])
    want = {(k % 50, p) for k in range(200) for p in (str(k % 20), None if k % 3 == 0 else str(k % 7)) if p is not None and int(p) >= 5}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "REPARTITION_BY_NUM" in plan(found) and ", 40)" in plan(found) and "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" not in plan(found)
