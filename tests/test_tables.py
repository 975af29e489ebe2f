"""Keys, sources, joins and residues on small files and tables."""

import gzip

import pytest
from pyspark.sql import functions as F

from poseflow.functions import scalars
from poseflow.operators import joins, keys, residues
from poseflow.sources import files, formats, text

ATOM = "ATOM  {:>5} {:<4} {:<3} {:1}{:>4}    {:8.3f}{:8.3f}{:8.3f}  1.00 20.00          {:>2}"


def pdb_lines():
    line = lambda k, name, res, chain, n, x, e: ATOM.format(k, name if len(name) > 3 else f" {name}", res, chain, n, x, 0.0, 0.0, e)
    return [
        "HEADER    TEST", line(1, "N", "ALA", "A", 1, 0.0, "N"), line(2, "CA", "ALA", "A", 1, 1.5, "C"), line(3, "HA", "ALA", "A", 1, 2.0, "H"),
        line(4, "N", "GLY", "A", 2, 3.0, "N"), line(5, "CA", "SER", " ", 3, 4.0, "C"), "TER", "HETATM    6  O   HOH A 101       1.000   2.000   3.000  0.50 30.00           O", "END",
    ]


def test_pdb_atoms_and_waters(spark, tmp_path):
    (tmp_path / "1abcx.pdb").write_text("\n".join(pdb_lines()) + "\n")
    with gzip.open(tmp_path / "2xyz.pdb.gz", "wt") as f:
        f.write("\n".join(["MODEL        2", *pdb_lines()[1:3]]))
    rows = text.read_pdb_atoms(spark, str(tmp_path)).collect()
    got = {(r.pdb_name, r.model, r.chain, r.residue, r.atom_name) for r in rows}
    assert got == {("1abcx.pdb", "0", "A", "1", "N"), ("1abcx.pdb", "0", "A", "1", "CA"), ("1abcx.pdb", "0", "X", "3", "CA"), ("2xyz.pdb", "2", "A", "1", "N"), ("2xyz.pdb", "2", "A", "1", "CA")}
    water = text.read_waters(spark, str(tmp_path / "1abcx.pdb")).first()
    assert (water.protein, water.water_id, water.x, water.z, water.occupancy, water.bfactor) == ("1abcx", "101", 1.0, 3.0, 0.5, 30.0)
    assert files.discover(spark, str(tmp_path)).count() == 2


def test_mol2_quarantine(spark, tmp_path):
    (tmp_path / "a.mol2").write_text("@<TRIPOS>MOLECULE\nx\n@<TRIPOS>ATOM\n 1 C1 0.1 0.2 0.3 C.ar 1 L 0\n 2 H1 1 x 1 H 1 L 0\n@<TRIPOS>BOND\n1 1 2 1\n")
    (tmp_path / "b.mol2").write_text("nothing")
    rows = {(r.pdb_name, r.atom_name): r for r in text.read_mol2_atoms(spark, str(tmp_path)).collect()}
    assert rows["a.mol2", "C1"].element == "C" and rows["a.mol2", "C1"].error is None and rows["a.mol2", "H1"].error == "bad coordinates"
    assert [r.error for k, r in rows.items() if k[0] == "b.mol2"] == ["no ATOM block"]


def test_scores_and_info(spark, tmp_path):
    (tmp_path / "1abc_score.dat").write_text("#code score\n1abc_1\t-3.5\n1abc_2,,  2\n\n")
    (tmp_path / "2def_score.dat").write_text("#code,score\n2def_1 x\n")
    got = {(r.complex, r.code): r.score for r in text.read_score_dir(spark, str(tmp_path), "score", "score").collect()}
    assert got == {("1abc", "1abc_1"): -3.5, ("1abc", "1abc_2"): 2.0, ("2def", "2def_1"): None}
    (tmp_path / "info.dat").write_text("skip\n" * 8 + "#T L1 L2 L3\nt1 a b\n")
    assert [tuple(r) for r in text.read_target_info(spark, str(tmp_path / "info.dat"), 3).orderBy("rank").collect()] == [("t1", 1, "a"), ("t1", 2, "b")]


def test_indexes_and_profiles(spark, tmp_path):
    (tmp_path / "index").write_text("# head\n3zzf  2.20  2012  0.40  Ki=400mM  // 3zzf.pdf (NLG)\nbad line\n")
    r = text.read_affinity_index(spark, str(tmp_path / "index")).collect()
    assert [tuple(x) for x in r] == [("3zzf", 2.2, 2012, 0.4, "Ki=400mM", "NLG")]
    emission, move = "A 1 " + " ".join(["1000", "*"] * 10) + " 1", " ".join(["0"] * 10)
    (tmp_path / "p.hhm").write_text("\n".join(["x", "#", *["h"] * 5, emission, move, "", "end", "//"]) + "\n")
    p = text.read_profile_hmm(spark, str(tmp_path / "p.hhm")).first()
    assert p.position == 0 and p.emissions[:2] == [0.5, 0.0] and p.transitions == [1.0] * 10
    (tmp_path / "bad.hhm").write_text("\n".join(["#", *["h"] * 5, "1 2 3", "end", "//"]))
    with pytest.raises(Exception, match="tokens"):
        text.read_profile_hmm(spark, str(tmp_path / "bad.hhm")).collect()
    (tmp_path / "a.tbl").write_text("junk\nchain res cx\n* 12 ALA 1 2 3 4 5 6\n")
    t = text.read_protrusion_tbl(spark, str(tmp_path / "a.tbl")).first()
    assert (t.chain, t.residue, t.avg_cx, t.min_cx) == (" ", "12", 1.0, 6.0)
    (tmp_path / "a.pssm").write_text("\n".join(["h1", "h2", "1 M " + " ".join(["2"] * 20) + " " + " ".join(["50"] * 20), *["f"] * 6]))
    s = text.read_pssm(spark, str(tmp_path / "a.pssm")).first()
    assert (s.position, s.residue, s.pssm[0], s.counts[19]) == (1, "M", 2.0, 0.5)
    (tmp_path / "s.jsonl").write_text('{"name": "n", "seq": "AG", "coords": {"N": [[1,2,3],[4,5,6]], "CA": [[1,1,1],null], "C": [[0,0,0],[0,0,0]], "O": [[0,0,0],[0,0,0]]}}\n')
    j = files.read_structures_json(spark, str(tmp_path / "s.jsonl")).orderBy("position").collect()
    assert j[0].n.y == 2.0 and j[1].ca is None and len(j) == 2


def test_lists_and_writers(spark, tmp_path):
    (tmp_path / "ids").write_text("1ABC,2def\n3GHI \n")
    assert sorted(r.id for r in text.read_id_dir(spark, str(tmp_path / "ids")).collect()) == ["1abc", "2def", "3ghi"]
    assert text.read_id_list(spark, str(tmp_path / "ids")).count() == 2
    files.combine_files(spark, [str(tmp_path / "ids"), str(tmp_path / "ids")], str(tmp_path / "out"), skip=1, single=True)
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    files.write_key_values(spark.createDataFrame([("k", ["a", "b"])], "k string, v array<string>"), str(tmp_path / "kv"), "k", "v")
    assert spark.read.text(str(tmp_path / "kv")).first()[0] == "k\ta\tb"
    atoms = spark.createDataFrame([("p", "A", "1", "ALA", False), ("p", "A", "2", "GLY", False), ("p", "L", "1", "LIG", True), ("p", "W", "1", "HOH", True)], "k string, chain string, residue string, resname string, hetero boolean")
    parts = files.complex_parts(atoms, atoms.where("resname = 'ALA'"), ["k"]).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"protein": 2, "ligand": 1, "pocket": 1, "complex": 3}


def test_entries(spark, tmp_path):
    (tmp_path / "1abc.json").write_text('{"rcsb_id": "1ABC", "pdbx_vrpt_summary": {"PDB_resolution": 1.9}, "refine": [{"ls_R_factor_obs": 0.2}], "struct": {"pdbx_descriptor": "KINASE (E.C.2.7.11.1)"}, "rcsb_accession_info": {"initial_release_date": "2012-03-04T00:00:00Z"}, "rcsb_binding_affinity": [{"comp_id": "LIG", "type": "Ki", "unit": "nM", "value": 10}, {"comp_id": "LIG", "type": "Ki", "unit": "nM", "value": 30}, {"comp_id": "LIG", "type": "Kd", "unit": "%", "value": 5}]}')
    e = files.read_entries(spark, str(tmp_path))
    a = files.entry_attributes(e).first()
    assert (a.resolution, a.r_factor, a.ec, str(a.release_date)) == (1.9, 0.2, "2.7.11.1", "2012-03-04")
    r = files.flatten_affinity(e, ["rcsb_id"], "rcsb_binding_affinity").first()
    assert r.Ki == 20 and r.Kd is None
    assert files.flatten_affinity(e, ["rcsb_id"], "rcsb_binding_affinity", all_units=True).first().Kd == 5


def test_keys(spark):
    df = keys.file_keys(spark.createDataFrame([("/d/1abc.pdb1.gz",), ("/d/complex_x_7.pdb",)], "path string")).collect()
    assert [(r.name, r.code, r.type, r.grp, r.base) for r in df] == [("1abc.pdb1", "1abc", "pdb1", "ab", "1abc.pdb1"), ("complex_x_7.pdb", "7", "pdb", "", "7.pdb")]
    roles = keys.binding_role(spark.createDataFrame([("1abc_protein.pdb",), ("1abc_pocket",), ("1abc",)], "name string"), "pdbbind").collect()
    assert [(r.role, r.bound) for r in roles] == [("receptor", True), ("pocket", True), ("x", None)]
    assert keys.valid_ids(spark.createDataFrame([("1abc", "A"), ("1ab", "A"), ("1abc", "AB")], "pdb string, chain string")).count() == 1
    keys.check_parameters()
    with pytest.raises(ValueError):
        keys.check_parameters(distance=3.0)
    raw = keys.raw_path(spark.createDataFrame([("/i/ab/1abc.pdb",)], "path string"), "/raw/", "db5", ".pdb").first().raw
    assert raw == "/raw/ab/1abc.pdb"


def test_unknown_unit(spark):
    one = spark.range(1)
    assert one.select(scalars.to_nm(F.lit("uM"), F.lit(2.0))).first()[0] == 2000.0
    with pytest.raises(Exception, match="unknown unit"):
        one.select(scalars.to_nm(F.lit("kM"), F.lit(1.0))).collect()


def test_keep_list_needs_all_chains(spark):
    pairs = spark.createDataFrame([("c", "1", 1), ("c", "1", 2), ("d", "1", 1)], "code string, struct_id string, pair_id int")
    chains = spark.createDataFrame([("c", 1, "a"), ("c", 1, "b"), ("c", 2, "a"), ("d", 1, "z")], "code string, pair_id int, chain string")
    listed = spark.createDataFrame([("c", "a")], "code string, chain string")
    assert [tuple(r) for r in joins.prune_pairs(pairs, chains, listed).collect()] == [("c", "1", 2)]
    assert joins.prune_pairs(pairs, chains, None).count() == 3 and joins.prune_pairs(pairs, chains, listed, pairs.where("code = 'd'")).count() == 2


def test_negatives_do_not_depend_on_partitioning(spark):
    a, b = spark.range(2).selectExpr("'c' k", "id i"), spark.range(3).selectExpr("'c' k", "id j")
    pos = spark.createDataFrame([("c", 0, 0), ("c", 1, 2)], "k string, i long, j long")
    one = {(r.i, r.j) for r in joins.negatives(a, b, pos, ["k"]).collect()}
    two = {(r.i, r.j) for r in joins.negatives(a.repartition(3), b.repartition(2), pos, ["k"]).collect()}
    assert one == two and len(one) == 2 and not one & {(0, 0), (1, 2)} and joins.negatives(a, b, pos, ["k"], full=True).count() == 4


def test_lookups_and_references(spark):
    atoms = spark.createDataFrame([("p", "1", "CA", "7", 1.0, 2.0, 3.0)], "k string, residue string, atom_name string, aid string, x double, y double, z double")
    got = {r.residue: (r.aid, r.n_ca) for r in joins.ca_lookup(spark.createDataFrame([("p", "1"), ("p", "2")], "k string, residue string"), atoms, ["k", "residue"]).collect()}
    assert got == {"1": ("7", 1), "2": (None, 0)}
    m = lambda rows: spark.createDataFrame(rows, "pdb string, chain string, uniprot string")
    refs = joins.cross_references(m([("p", "A", "x")]), [m([("p", "A", "U1")]), m([("p", "A", "U2"), ("p", "A", "U1")])], spark.createDataFrame([("U1", "C1"), ("U2", "C2")], "uniprot string, chembl string")).first()
    assert refs.uniprot == ["U1", "U2"] and refs.chembl == ["C1", "C2"]
    names = spark.createDataFrame([("b", "u")], "bound string, unbound string")
    pair = spark.createDataFrame([("b", "0", "A", "1", "b", "0", "B", "2"), ("b", "0", "A", "9", "b", "0", "B", "2")], ", ".join(f"{c}_{k} string" for k in (0, 1) for c in ("pdb_name", "model", "chain", "residue")))
    unbound = spark.createDataFrame([("u", "0", "A", "1"), ("u", "0", "B", "2")], "pdb_name string, model string, chain string, residue string")
    assert [r.residue_0 for r in joins.bound_to_unbound(pair, names, unbound).collect()] == ["1"]
    left = joins.unmatched_letters(spark.createDataFrame([("k", "X"), ("k", "Y"), ("k", "Z")], "k string, chain string"), spark.createDataFrame([("k", "A", "Y")], "k string, bound string, unbound string"), ["k"]).orderBy("chain").collect()
    assert [(r.chain, r.letter) for r in left] == [("X", "B"), ("Z", "C")]
    with pytest.raises(FileNotFoundError):
        joins.require_files(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([], "key string"))


def test_residue_filters(spark):
    rows = [("p", "1", "ALA", "CA", 30.0, False, "C"), ("p", "1", "ALA", "N", 9.0, False, "N"), ("p", "2", "GLY", "N", 50.0, False, "N"), ("p", "3", "LIG", "CA", 50.0, True, "C"), ("p", "4", "SER", "CA", 5.0, False, "C"), ("p", "4", "SER", "HA", 5.0, False, "H")]
    df = spark.createDataFrame(rows, "k string, residue string, resname string, atom_name string, bfactor double, hetero boolean, element string")
    assert {r.residue for r in residues.standard_residues(df, ["k", "residue"], 20.0).collect()} == {"1"}
    assert {r.residue for r in residues.standard_residues(df, ["k", "residue"]).collect()} == {"1", "4"}
    assert residues.heavy_atoms(df).count() == 5 and residues.ca_atoms(df).count() == 3
    models = spark.createDataFrame([("p", "2", 5), ("p", "1", 9), ("p", "2", 7)], "pdb_name string, model string, aid int")
    assert [r.aid for r in residues.first_model(models).orderBy("aid").collect()] == [5, 7]
    flags = residues.split_hetero(spark.createDataFrame([(" ",), ("W",), ("H_LIG",)], "hetero_flag string")).collect()
    assert [r.part for r in flags] == ["protein", "ligand"]
    kept = residues.few_atoms(spark.createDataFrame([("HOH", 1), ("A", None), ("B", 7), ("C", 8)], "ligand string, n_heavy int"), ["HOH"]).collect()
    assert {r.ligand for r in kept} == {"A", "C"}
    f = residues.formula_features(spark.createDataFrame([("x", "C6H12O6"), ("y", "Xx2")], "ligand string, formula string")).collect()
    got = {r.ligand: r for r in f}
    assert got["x"].mass == pytest.approx(180.156) and (got["x"].n_atoms, got["x"].n_heavy) == (24, 12) and got["y"].mass is None
    sides = spark.createDataFrame([("a", "ligand"), ("a", "receptor"), ("b", "ligand")], "k string, side string")
    assert [r.k for r in residues.size_limit(spark.createDataFrame([("a",), ("b",)], "k string"), sides, ["k"]).collect()] == ["a"]


def test_scratch_folders(spark):
    """On a cluster the shared folder must be named; scratch tables go when they are released."""
    import os
    from types import SimpleNamespace

    from poseflow import tables

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        tables.shared_dir(fake)
    mark = tables.held(spark)
    scratch = tables.Scratch(spark, "test")
    assert scratch.save(spark.range(3), "a").count() == 3 and scratch.save(spark.range(2), "b").count() == 2
    folder = scratch.root.removeprefix("file:")
    scratch.drop("a", "absent")
    assert os.listdir(folder) == ["b"] and tables.held(spark) == mark + 1
    tables.release(spark, mark)
    assert not os.path.exists(folder) and tables.held(spark) == mark


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 700 as code", "id as a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("left_pairs", "right_pairs"):
            files.write_bucketed(rows, name, ["code"], 8, str(tmp_path / name))
        joined = spark.table("left_pairs").join(spark.table("right_pairs").withColumnRenamed("a", "b"), "code").groupBy("code").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and joined.count() == 700
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_pairs", "right_pairs"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_aborted_write_is_resumed(spark, tmp_path):
    path, seen = str(tmp_path / "parts"), tmp_path / "seen"
    df = spark.range(100).selectExpr("id % 5 as part", "id")

    def fails(rows):
        from pyspark.sql.functions import udf

        def check(part):
            with seen.open("a") as f:
                f.write(f"{part}\n")
            if part == 3 and not (tmp_path / "mended").exists():
                raise ValueError("part 3")
            return part

        return rows.withColumn("part", udf(check, "long")("part"))

    with pytest.raises(Exception, match="part 3"):
        files.write_resumable(fails(df), path, "part", at_once=1)
    (tmp_path / "mended").write_text("")
    done = {r.part for r in files.finished_parts(spark, path, "part").collect()}
    assert done < set("01234")
    before = seen.read_text()
    assert files.write_resumable(df, path, "part", at_once=2) == 5 - len(done) and seen.read_text() == before
    assert files.write_resumable(df, path, "part") == 0
    back = spark.read.parquet(path)
    assert sorted(r.id for r in back.collect()) == list(range(100)) and back.where("part = 3").count() == 20


def test_complexes_of_any_size_stream_by_batches(spark):
    import pyarrow as pa

    from poseflow.operators import batch

    def widest(batches):
        sizes = []
        for b in batches:
            sizes.append(b.num_rows)
            if b.column("k")[0].as_py() == "bad" and len(sizes) == 2:
                raise ValueError("no")
            yield pa.RecordBatch.from_pydict({"k": b.column("k").slice(0, 1), "rows": pa.array([b.num_rows], pa.int64())})

    df = spark.range(120_000).selectExpr("case when id % 4 = 0 then 'bad' when id % 1000 = 1 then 'few' else 'large' end as k", "id")
    found, counts = batch.observed(batch.stream_complexes(df, ["k"], widest, "k string, rows long"))
    rows = found.collect()
    assert max(r.rows for r in rows if r.rows) <= 10_000 and counts.get == {"rows": len(rows), "failures": 1}
    good, failed = batch.settled(spark.createDataFrame(rows, found.schema), ["k"])
    assert {r.k: r["sum(rows)"] for r in good.groupBy("k").sum("rows").collect()} == {"few": 120, "large": 89_880}
    assert [(r.k, r.rows) for r in failed.collect()] == [("bad", None)] and "no" in failed.first().error


def _models(n):
    head = [f"MODEL     {k:>4}" for k in range(1, n + 1)]
    body = [line for line in pdb_lines() if line.startswith(("ATOM", "TER"))]
    return "\n".join(["HEADER    MANY"] + [x for h in head for x in (h, *body, "ENDMDL")] + ["END"]) + "\n"


@pytest.mark.parametrize("split", [1111, 1 << 20])
def test_pdb_source_splits_at_models(spark, tmp_path, split):
    (tmp_path / "1many.pdb").write_text(_models(12))
    (tmp_path / "2onex.pdb").write_text("\r\n".join(pdb_lines()))
    with gzip.open(tmp_path / "3zipx.pdb.gz", "wt") as f:
        f.write(_models(3))
    (tmp_path / "_hidden.pdb").write_text(_models(1))
    show = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    got = formats.load_pdb_atoms(spark, f"{tmp_path}/*.pdb*", split_bytes=split)
    want = text.read_pdb_atoms(spark, f"{tmp_path}/[0-9]*.pdb*")
    assert show(got) == show(want) and got.where("pdb_name = '1many.pdb'").select("model").distinct().count() == 12
    ranges = formats.PdbReader({"path": f"file://{tmp_path}/*", "splitbytes": str(split)})
    assert len(ranges.partitions()) > 4 or split > 10_000
    assert list(ranges.pushFilters([formats.EqualTo(("pdb_name",), "2onex.pdb"), formats.EqualTo(("model",), "1")])) == [formats.EqualTo(("model",), "1")]
    assert {p.path.rsplit("/", 1)[1] for p in ranges.partitions()} == {"2onex.pdb"}
    one = spark.read.format("pdb").load(str(tmp_path)).where("pdb_name = '3zipx.pdb' and atom_name = 'CA'")
    assert one.where("pdb_name = 'none'").count() == 0 and one.count() == 6 and {r.model for r in one.collect()} == {"1", "2", "3"}


def test_mol2_and_hhm_sources(spark, tmp_path):
    one = "@<TRIPOS>MOLECULE\nm{0}\n 2 1\n@<TRIPOS>ATOM\n 1 C1 {0}.5 2.0 3.0 C.3 1 LIG\n 2 O1 x 2.0 3.0 O.2 1 LIG\n@<TRIPOS>BOND\n 1 1 2 1\n"
    (tmp_path / "a.mol2").write_text("".join(one.format(k) for k in range(30)) + "@<TRIPOS>MOLECULE\nempty\n@<TRIPOS>BOND\n")
    (tmp_path / "b.mol2").write_text(one.format(7))
    formats.register(spark)
    rows = spark.read.format("mol2").option("splitBytes", 200).option("name", r"([^/]+)$").load(f"{tmp_path}/*.mol2").collect()
    assert len(rows) == 63 and {r.molecule for r in rows if r.pdb_name == "a.mol2"} == {"empty", *(f"m{k}" for k in range(30))}
    assert [r.error for r in rows if r.molecule == "empty"] == ["no ATOM block"]
    plain = lambda rs: sorted(str((r.pdb_name, r.model, r.x, r.element, r.atom_name, r.aid, r.error)) for r in rs)
    assert plain(r for r in rows if r.pdb_name == "b.mol2") == plain(text.read_mol2_atoms(spark, f"{tmp_path}/b.mol2").collect())
    hmm = ["HHsearch", "# a", "NULL x", "HMM x", "x", "x", "x"]
    for k in range(4):
        hmm += [" ".join(["A", str(k)] + [str(100 * j + k) if j % 3 else "*" for j in range(21)]), " ".join(str(k * j) for j in range(10)), ""]
    (tmp_path / "p.hhm").write_text("\n".join([*hmm, "//", "end"]))
    got = spark.read.format("hhm").load(f"{tmp_path}/p.hhm").drop("path").orderBy("position").collect()
    want = text.read_profile_hmm(spark, f"{tmp_path}/p.hhm").drop("path").orderBy("position").collect()
    near = lambda r: (*tuple(r)[:2], pytest.approx(r.emissions), pytest.approx(r.transitions))
    assert [tuple(r) for r in got] == [near(r) for r in want] and len(got) == 4
