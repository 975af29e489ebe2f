"""Residues and look-ups over the points: B4-B9, C8-C10, D27, I10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graphs, joins, residues, splits
from .registry import Registry
from .views import table, view

REGISTRY = query = Registry()

_NAMED = "n AS (SELECT *, CASE aid // 3 % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'O' END AS atom_name FROM v_atoms)"


def _named(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("N", "CA", "C", "O")]), (F.floor(F.col("aid") / 3) % 4 + 1).cast("int"))
    return view(spark, d, "v_atoms").withColumn("atom_name", name)


@query(f"WITH {_NAMED} SELECT pdb_name, residue % 7 AS residue, min(x) FILTER (WHERE atom_name = 'CA') IS NOT NULL AS has_ca, count(DISTINCT atom_name) AS kinds FROM n GROUP BY pdb_name, residue % 7 HAVING count(DISTINCT atom_name) = 4")
def backbone_complete(spark, d):
    whole = residues.backbone_complete(_named(spark, d).withColumn("residue", F.col("residue") % 7), ["pdb_name", "residue"])
    return whole.select("pdb_name", "residue", F.col("ca").isNotNull().alias("has_ca"), F.lit(4).cast("long").alias("kinds"))


@query(f"WITH {_NAMED} SELECT pdb_name, residue, min(aid) FILTER (WHERE atom_name = 'CA') AS aid, count(*) FILTER (WHERE atom_name = 'CA') AS n_ca FROM n GROUP BY ALL")
def ca_lookup(spark, d):
    atoms = _named(spark, d)
    return joins.ca_lookup(atoms.select("pdb_name", "residue").distinct(), atoms, ["pdb_name", "residue"]).select("pdb_name", "residue", "aid", F.col("n_ca").cast("long").alias("n_ca"))


@query(f"WITH {_NAMED} SELECT pdb_name, count(*) FILTER (WHERE atom_name <> 'N') AS n_heavy, count(*) FILTER (WHERE atom_name = 'CA') AS n_ca FROM n GROUP BY pdb_name")
def atom_filters(spark, d):
    atoms = _named(spark, d).withColumn("element", F.when(F.col("atom_name") == "N", "H").otherwise("C"))
    heavy = residues.heavy_atoms(atoms).groupBy("pdb_name").agg(F.count("*").alias("n_heavy"))
    return heavy.join(residues.ca_atoms(atoms).groupBy("pdb_name").agg(F.count("*").alias("n_ca")), "pdb_name")


@query("SELECT pdb_name, aid FROM (SELECT pdb_name, aid, aid % 3 AS model, arg_min(aid % 3, aid) OVER (PARTITION BY pdb_name) AS m FROM v_atoms) WHERE model = m")
def first_model(spark, d):
    return residues.first_model(view(spark, d, "v_atoms").withColumn("model", F.col("aid") % 3)).select("pdb_name", "aid")


@query(f"""WITH {_NAMED}, r AS (SELECT pdb_name, residue FROM n WHERE residue % 5 > 0 GROUP BY ALL HAVING max(aid % 50) FILTER (WHERE atom_name = 'CA') >= 20)
SELECT n.pdb_name, n.residue, n.aid FROM n JOIN r USING (pdb_name, residue)""")
def standard_residues(spark, d):
    atoms = _named(spark, d).withColumns({"resname": F.when(F.col("residue") % 5 > 0, "ALA").otherwise("UNK"), "hetero": F.lit(False), "bfactor": (F.col("aid") % 50).cast("double")})
    return residues.standard_residues(atoms, ["pdb_name", "residue"], 20.0).select("pdb_name", "residue", "aid")


@query("""WITH e AS (SELECT a.k, a.id AS src, b.id AS dst, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
  FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id < b.id)
SELECT k, src, dst, acos(greatest(-1, least(1, (ax * bx + ay * by_ + az * bz) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + by_ * by_ + bz * bz))))) AS angle FROM e WHERE dist < 0.06""")
def edge_angles(spark, d):
    p = view(spark, d, "v_points")
    edges = graphs.radius_graph(p, ["k"], 0.06).where("src < dst")
    return graphs.edge_angles(edges, p.select("k", "id", V.vec("x", "y", "z").alias("normal")), ["k"]).select("k", "src", "dst", "angle")


@query("""WITH u AS (SELECT o_custkey AS pdb, o_orderkey % 7 AS uniprot, min(o_orderkey % 2) AS k FROM orders GROUP BY ALL), l AS (SELECT pdb, string_agg(uniprot::VARCHAR, ',' ORDER BY k, uniprot) AS uniprot FROM u GROUP BY pdb)
SELECT c_custkey AS pdb, uniprot FROM customer LEFT JOIN l ON pdb = c_custkey""")
def cross_references(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pdb"), F.lit("A").alias("chain"), (F.col("o_orderkey") % 7).cast("string").alias("uniprot"), "o_orderkey")
    chembl = o.select("uniprot", F.concat(F.lit("C"), "uniprot").alias("chembl")).distinct()
    chains = table(spark, d, "customer").select(F.col("c_custkey").alias("pdb"), F.lit("A").alias("chain"))
    found = joins.cross_references(chains, [o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")], chembl)
    return found.select("pdb", F.array_join("uniprot", ",").alias("uniprot"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey + 1000000 AS pdb_name_0, l_linenumber AS residue_0, l_linenumber + 1 AS residue_1, count(*) AS n FROM p WHERE l_linenumber % 5 > 0 AND (l_linenumber + 1) % 5 > 0 AND l_linenumber + 1 < 8 GROUP BY ALL""")
def bound_to_unbound(spark, d):
    p = table(spark, d, "lineitem")
    pairs = p.selectExpr("l_orderkey pdb_name_0", "0 model_0", "'A' chain_0", "l_linenumber residue_0", "l_orderkey pdb_name_1", "0 model_1", "'B' chain_1", "l_linenumber + 1 residue_1")
    names = p.selectExpr("l_orderkey bound", "l_orderkey + 1000000 unbound").distinct()
    atoms = names.selectExpr("unbound pdb_name", "0 model", "explode(array('A', 'B')) chain").withColumn("residue", F.explode(F.sequence(F.lit(1), F.lit(7)))).where("residue % 5 > 0")
    return joins.bound_to_unbound(pairs, names, atoms).groupBy("pdb_name_0", "residue_0", "residue_1").agg(F.count("*").alias("n"))


@query("SELECT pdb_name, aid, chain = '1' AND residue = 13 AND pdb_name % 2 = 0 AS mutated FROM v_atoms")
def mutated_residues(spark, d):
    atoms = view(spark, d, "v_atoms").withColumn("residue", F.col("residue").cast("string"))
    mutations = atoms.where("pdb_name % 2 = 0").select("pdb_name", F.lit("W113Y").alias("mutation")).distinct()
    return splits.mutated_residues(atoms, mutations, "pdb_name").select("pdb_name", "aid", "mutated")
