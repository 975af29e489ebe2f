"""Distance joins, graphs and geometry features: C20-C47, D24, D27, D28, E6-E8, F4, G6, H3-H11, I9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, vectors as V
from ..operators import graphs, ranks, spatial
from ..operators.components import connected_components
from .registry import Registry
from .views import view

REGISTRY = query = Registry()

#: Lengths in the unit of the points, whose coordinates lie mostly within 0.3 of zero.
R = 0.06

_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_PAIRS = f"p AS (SELECT a.k, a.id AS src, b.id AS dst, {_D} AS dist FROM v_points a JOIN v_points b ON a.k = b.k)"


@query(f"SELECT DISTINCT a.pdb_name, a.chain AS a_chain, a.residue AS a_residue, b.chain AS b_chain, b.residue AS b_residue FROM v_atoms a JOIN v_atoms b ON a.pdb_name = b.pdb_name WHERE a.chain < b.chain AND {_D} < {R}")
def near_residues(spark, d):
    atoms = view(spark, d, "v_atoms")
    return spatial.near_atoms(atoms, atoms, R, ["pdb_name"], ["chain", "residue"]).where("a_chain < b_chain")


@query(f"SELECT a.pdb_name, a.aid AS a_aid, b.aid AS b_aid FROM v_atoms a JOIN v_atoms b ON a.pdb_name = b.pdb_name WHERE a.aid < b.aid AND {_D} < {R}")
def near_atoms(spark, d):
    atoms = view(spark, d, "v_atoms")
    return spatial.near_atoms(atoms, atoms, R, ["pdb_name"], ["aid"]).where("a_aid < b_aid")


_CHAINS = f"""c AS (SELECT a.pdb_name, a.chain AS chain_0, b.chain AS chain_1, count(*) AS n_contacts FROM v_atoms a JOIN v_atoms b ON a.pdb_name = b.pdb_name WHERE a.chain < b.chain AND {_D} < 0.04 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY pdb_name ORDER BY chain_0, chain_1) - 1 AS pair_id FROM c)"""


@query(f"WITH {_CHAINS} SELECT pdb_name, chain_0, chain_1, n_contacts, CAST(pair_id AS INT) AS pair_id FROM n")
def chain_pairs(spark, d):
    return spatial.chain_pairs(view(spark, d, "v_atoms"), 0.04)


@query(f"WITH {_CHAINS} SELECT pdb_name, chain_0, chain_1, n_contacts FROM (SELECT *, row_number() OVER (PARTITION BY pdb_name ORDER BY n_contacts DESC, pair_id) AS k FROM n) WHERE k = 1")
def busiest_pair(spark, d):
    return spatial.busiest_pair(spatial.chain_pairs(view(spark, d, "v_atoms"), 0.04)).drop("pair_id")


@query(f"""WITH p AS (SELECT a.k, a.id AS a_id, b.id AS b_id, {_D} AS dist FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id % 2 = 0 AND b.id % 2 = 1)
SELECT k, a_id, b_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY k, a_id ORDER BY dist, b_id) AS n FROM p) WHERE n = 1""")
def nearest(spark, d):
    p = view(spark, d, "v_points")
    return spatial.nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["k"], "id")


@query(f"SELECT a.pdb_name, a.chain, a.residue, min({_D}) AS min_dist FROM v_atoms a JOIN v_atoms b ON a.pdb_name = b.pdb_name WHERE a.aid % 5 > 0 AND b.aid % 5 = 0 AND {_D} <= {R} AND {_D} > 0 GROUP BY ALL")
def pocket_residues(spark, d):
    a = view(spark, d, "v_atoms")
    return spatial.pocket_residues(a.where("aid % 5 > 0"), a.where("aid % 5 = 0"), ["pdb_name"], ["chain", "residue"], R)


@query(f"""WITH m AS (SELECT a.pdb_name, a.chain, min({_D}) AS min_dist FROM v_atoms a JOIN v_atoms b ON a.pdb_name = b.pdb_name WHERE a.aid % 50 > 0 AND b.aid % 50 = 0 AND a.chain <> '3' GROUP BY ALL)
SELECT pdb_name, chain, min_dist FROM (SELECT *, row_number() OVER (PARTITION BY pdb_name ORDER BY min_dist, chain) AS n FROM m) WHERE min_dist < 0.03 OR n = 1""")
def chains_near_ligand(spark, d):
    a = view(spark, d, "v_atoms").withColumn("is_water", F.col("chain") == "3")
    return spatial.chains_near_ligand(a.where("aid % 50 > 0"), a.where("aid % 50 = 0"), ["pdb_name"], 0.03)


@query(f"""WITH i AS (SELECT DISTINCT a.k, a.id FROM v_points a JOIN v_points b ON a.k = b.k WHERE b.id % 50 = 0 AND {_D} < {R}),
m AS (SELECT v.k, v.id, i.id IS NOT NULL AS inside, count(i.id) OVER (PARTITION BY v.k) AS n, row_number() OVER (PARTITION BY v.k ORDER BY v.id) AS r FROM v_points v LEFT JOIN i ON v.k = i.k AND v.id = i.id)
SELECT k, id FROM m WHERE inside OR (n < 5 AND r <= 10)""")
def nodes_in_pocket(spark, d):
    p = view(spark, d, "v_points")
    return spatial.nodes_in_pocket(p, p.where("id % 50 = 0"), ["k"], R, 5, 10).select("k", "id")


@query(f"WITH {_PAIRS} SELECT * FROM p WHERE dist < {R} AND src <> dst")
def radius_graph(spark, d):
    return graphs.radius_graph(view(spark, d, "v_points"), ["k"], R)


@query(f"WITH {_PAIRS} SELECT k, src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY k, src ORDER BY dist, dst) AS n FROM p WHERE src <> dst) WHERE n <= 5")
def knn_graph(spark, d):
    return graphs.knn_graph(view(spark, d, "v_points"), ["k"], 5)


@query(f"WITH {_PAIRS} SELECT k, src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY k, src ORDER BY dist, dst) AS n FROM p WHERE src <> dst) WHERE n = 1 OR (n <= 4 AND dist < {R})")
def radius_knn_graph(spark, d):
    return graphs.radius_knn_graph(view(spark, d, "v_points"), ["k"], R, 4)


@query(f"WITH {_PAIRS} SELECT k, src, dst, dist FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY dist) AS n FROM p WHERE dist <= {R}) WHERE n <= 100")
def limited_edges(spark, d):
    return graphs.limited_edges(view(spark, d, "v_points"), ["k"], R, 100)


@query(f"""WITH {_PAIRS}, n AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS i FROM v_points WHERE id % 3 > 0)
SELECT p.k, a.i AS src_index, b.i AS dst_index, dist FROM p JOIN n a ON a.k = p.k AND a.id = src JOIN n b ON b.k = p.k AND b.id = dst WHERE dist < {R} AND src <> dst""")
def reindexed_edges(spark, d):
    p = view(spark, d, "v_points")
    _, edges = graphs.reindex_edges(p.where("id % 3 > 0"), graphs.radius_graph(p, ["k"], R), ["k"])
    return edges.select("k", F.col("src_index").cast("long").alias("src_index"), F.col("dst_index").cast("long").alias("dst_index"), "dist")


@query(f"""WITH {_PAIRS}, e AS (SELECT k, src, dst FROM p WHERE dist < 0.03 AND src < dst), b AS (SELECT * FROM e UNION SELECT k, dst, src FROM e)
SELECT * FROM b UNION ALL SELECT k, id, NULL FROM v_points v WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = v.k AND b.src = v.id)""")
def finished_graph(spark, d):
    p = view(spark, d, "v_points")
    return graphs.finish_graph(p, graphs.radius_graph(p, ["k"], 0.03).where("src < dst"), ["k"])


@query(f"SELECT a.k, a.id AS a_id, b.id AS b_id, least({_D}, 0.2) AS dist, {_D} < 0.1 AS label FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id % 5 = 0 AND b.id % 5 > 0")
def contact_map(spark, d):
    p = view(spark, d, "v_points")
    return spatial.contact_map(p.where("id % 5 = 0"), p.where("id % 5 > 0"), ["k"], contact=0.1, clamp=0.2)


@query(f"SELECT a.k, sum(exp(-0.2 * ({_D} * {_D}) * greatest(4 * ({_D} * {_D}) - 8, 1.0))) AS clash FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id % 5 = 0 AND b.id % 5 > 0 GROUP BY a.k")
def clash_score(spark, d):
    p = view(spark, d, "v_points")
    return spatial.clash_score(p.where("id % 5 = 0"), p.where("id % 5 > 0"), ["k"])


@query(f"""WITH p AS (SELECT a.k, a.id AS i, b.id AS j, {_D} AS dist FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id % 5 = 0 AND b.id % 5 > 0),
g AS (SELECT k, i, -25.0 * ln(1e-3 + sum(exp(-dist * dist / 25.0))) AS g FROM p GROUP BY k, i), h AS (SELECT k, j, -25.0 * ln(1e-3 + sum(exp(-dist * dist / 25.0))) AS g FROM p GROUP BY k, j)
SELECT k, a + b AS clash FROM (SELECT k, avg(greatest(10.0 - g, 0)) AS a FROM g GROUP BY k) JOIN (SELECT k, avg(greatest(10.0 - g, 0)) AS b FROM h GROUP BY k) USING (k)""")
def surface_clash(spark, d):
    p = view(spark, d, "v_points")
    return spatial.surface_clash(p.where("id % 5 = 0"), p.where("id % 5 > 0"), ["k"])


@query(f"""WITH s AS (SELECT a.pdb_name, a.residue AS i, b.residue AS j, min({_D}) AS d FROM v_atoms a JOIN v_atoms b ON a.pdb_name = b.pdb_name WHERE {_D} < 0.02 * sqrt(-2 * ln(1e-3)) GROUP BY ALL)
SELECT pdb_name, i AS residue, count(*) AS cn, sum(exp(-d * d / (2 * 0.02 * 0.02))) AS similarity FROM s GROUP BY pdb_name, i""")
def coordination_number(spark, d):
    similar = spatial.residue_similarity(view(spark, d, "v_atoms"), ["pdb_name"], "residue", sigma=0.02)
    total = similar.groupBy("pdb_name", F.col("a_residue").alias("residue")).agg(F.sum("similarity").alias("similarity"))
    return spatial.coordination_number(similar, ["pdb_name"], "residue").join(total, ["pdb_name", "residue"])


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT a.pdb_name, a.chain AS c, b.chain AS o FROM v_atoms a JOIN v_atoms b ON a.pdb_name = b.pdb_name WHERE {_D} < 0.02),
r AS (SELECT DISTINCT pdb_name, chain AS c, chain AS o FROM v_atoms UNION SELECT r.pdb_name, r.c, e.o FROM r JOIN e ON e.pdb_name = r.pdb_name AND e.c = r.o),
m AS (SELECT pdb_name, c, min(o) AS root FROM r GROUP BY pdb_name, c)
SELECT pdb_name, count(*) AS n_chains, count(DISTINCT root) AS n_parts, count(DISTINCT root) = 1 AS connected FROM m GROUP BY pdb_name""")
def connected_structures(spark, d):
    return spatial.connected_structures(view(spark, d, "v_atoms"), cutoff=0.02)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - p_partkey % 41 + p_partkey * 5 % 41 AS b FROM part), s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT DISTINCT a AS node, a AS o FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.o = s.a)
SELECT node, min(o) AS root FROM r GROUP BY node""")
def connected_components_query(spark, d):
    from .views import table

    return connected_components(table(spark, d, "part").selectExpr("p_partkey as a", "p_partkey - p_partkey % 41 + p_partkey * 5 % 41 as b"))


@query(f"SELECT DISTINCT a.k, a.id FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id % 3 > 0 AND b.id % 30 = 0 AND {_D} < {R}")
def subgraph_near(spark, d):
    p = view(spark, d, "v_points")
    return spatial.subgraph_near(p.where("id % 3 > 0"), p.where("id % 30 = 0"), ["k"], R).select("k", "id")


@query(f"SELECT a.k, a.id AS a_id, b.id AS b_id, {_D} AS dist FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id % 4 > 0 AND b.id % 40 = 0 AND {_D} <= {R}")
def ball(spark, d):
    p = view(spark, d, "v_points").withColumn("element", F.when(F.col("id") % 4 == 0, "H").otherwise("C"))
    return spatial.ball(p, p.where("id % 40 = 0"), ["k"], R).select("k", "a_id", "b_id", "dist")


@query(f"""WITH p AS (SELECT a.k, a.id AS id, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, (a.z + b.z) / 2 AS z, {_D} AS dist, b.id AS o FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id % 5 = 0 AND b.id % 5 > 0)
SELECT k, id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY dist, o) AS n FROM p) WHERE n = 1 AND dist < {R}""")
def pocket_points(spark, d):
    p = view(spark, d, "v_points")
    return spatial.pocket_points(p.where("id % 5 = 0"), p.where("id % 5 > 0"), ["k"], R, "match_atoms")


@query(f"""WITH p AS (SELECT a.k, a.id AS id, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, (a.z + b.z) / 2 AS z, {_D} AS dist, b.id AS o FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id % 5 = 0 AND b.id % 5 > 0),
f AS (SELECT k, dist AS d4 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dist, id, o) AS n FROM p) WHERE n = 4)
SELECT p.k, id, x, y, z FROM p LEFT JOIN f ON p.k = f.k WHERE d4 IS NULL OR dist < 0.001 + 0.5 * greatest(floor((d4 - 0.001) / 0.5) + 1, 0)""")
def pocket_points_by_radius(spark, d):
    p = view(spark, d, "v_points")
    return spatial.pocket_points(p.where("id % 5 = 0"), p.where("id % 5 > 0"), ["k"], 0.001, "radius_based")


@query(f"""WITH {_PAIRS}, e AS (SELECT p.*, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM p JOIN v_points a ON a.k = p.k AND a.id = src JOIN v_points b ON b.k = p.k AND b.id = dst WHERE dist < {R} AND src <> dst),
w AS (SELECT *, exp(-(dist * dist - min(dist * dist) OVER (PARTITION BY k, src)) / 1.0) AS w FROM e)
SELECT k, src, sqrt(pow(sum(w * dx), 2) + pow(sum(w * dy), 2) + pow(sum(w * dz), 2)) / sum(w * dist) AS ratio_1 FROM w GROUP BY k, src""")
def mean_vector_ratio(spark, d):
    p = view(spark, d, "v_points")
    return graphs.mean_vector_ratio(graphs.radius_graph(p, ["k"], R), p, ["k"], (1.0,))


#: Each embedding bonded to the next of its label, and rings of six in a row.
_BONDS = """e AS (SELECT label AS k, vec_id, lead(vec_id) OVER w AS dst, (row_number() OVER w - 1) // 6 AS ring FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
o AS (SELECT k, vec_id AS src, dst FROM e WHERE dst IS NOT NULL UNION SELECT k, dst, vec_id FROM e WHERE dst IS NOT NULL)"""


def _bonds(spark, d):
    from pyspark.sql import Window

    from .views import table

    e = table(spark, d, "embeddings").selectExpr("label as k", "vec_id")
    by = Window.partitionBy("k").orderBy("vec_id")
    bonds = e.withColumn("dst", F.lead("vec_id").over(by)).where("dst is not null").selectExpr("k", "vec_id as src", "dst")
    return bonds, e.withColumn("n", F.row_number().over(by)).selectExpr("k", "(n - 1) div 6 as ring", "vec_id as atom")


@query(f"WITH {_BONDS} SELECT k, src, dst FROM (SELECT * FROM o UNION SELECT a.k, a.src, b.dst FROM o a JOIN o b ON a.k = b.k AND a.dst = b.src) WHERE src <> dst")
def bond_neighbours(spark, d):
    return graphs.bond_neighbours(_bonds(spark, d)[0], ["k"])


@query(f"""WITH {_BONDS} SELECT * FROM o UNION SELECT a.k, a.src, b.dst FROM o a JOIN o b ON a.k = b.k AND a.dst = b.src UNION SELECT a.k, a.vec_id, b.vec_id FROM e a JOIN e b ON a.k = b.k AND a.ring = b.ring WHERE a.vec_id <> b.vec_id UNION SELECT k, src, src FROM o""")
def flex_mask(spark, d):
    return graphs.flex_mask(*_bonds(spark, d), ["k"]).distinct()


@query("SELECT p_partkey, exp(-pow((p_retailprice / 100 - 3 * (20.0 / 15)) / 1.25, 2)) AS rbf_3, exp(-pow(p_retailprice / 100 / 2.0, 2) / pow(1.5, 7)) AS basis_7, CAST(floor(least(p_retailprice / 100, 15.0) + 0.5) AS INT) AS bin, cos(p_size * exp(2 * 2 * (-ln(10000.0) / 16))) AS pos_2 FROM part")
def distance_features(spark, d):
    from .views import table

    x = F.col("p_retailprice") / 100
    return table(spark, d, "part").select("p_partkey", scalars.rbf(x)[3].alias("rbf_3"), scalars.distance_basis(x, 2.0)[7].alias("basis_7"), scalars.distance_bin(x).alias("bin"), scalars.positional_encoding(F.col("p_size"))[2].alias("pos_2"))


@query("""WITH c AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz, row_number() OVER w - 1 AS number FROM v_chain WINDOW w AS (PARTITION BY k ORDER BY id)),
n AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM c)
SELECT k, id, CAST(number AS INT) AS number, coalesce(dx / nullif(n, 0), 0) AS fx, coalesce(dy / nullif(n, 0), 0) AS fy, coalesce(dz / nullif(n, 0), 0) AS fz FROM n""")
def chain_orientations(spark, d):
    df = ranks.orientations(ranks.residue_counter(view(spark, d, "v_chain"), ["k"], "id"), ["k"], "id")
    return df.select("k", "id", "number", F.col("forward.x").alias("fx"), F.col("forward.y").alias("fy"), F.col("forward.z").alias("fz"))


@query("""WITH p AS (SELECT id, k, x, y, z, lead(x) OVER w AS bx, lead(y) OVER w AS bz, lead(z) OVER w AS bq FROM v_points WINDOW w AS (PARTITION BY k ORDER BY id))
SELECT id, y * bq - z * bz AS cx, x * bx + y * bz + z * bq AS d, acos(greatest(-1, least(1, (x * bx + y * bz + z * bq) / (sqrt(x * x + y * y + z * z) * sqrt(bx * bx + bz * bz + bq * bq))))) AS angle FROM p WHERE bx IS NOT NULL""")
def vector_functions(spark, d):
    from pyspark.sql import Window

    p = view(spark, d, "v_points").withColumn("v", V.vec("x", "y", "z"))
    p = p.withColumn("w", F.lead("v").over(Window.partitionBy("k").orderBy("id"))).where("w is not null")
    return p.select("id", V.cross(F.col("v"), F.col("w"))["x"].alias("cx"), V.dot(F.col("v"), F.col("w")).alias("d"), V.angle(F.col("v"), F.col("w")).alias("angle"))
