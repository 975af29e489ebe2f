"""Filters, motions and variants of operators: B1, B2, B8, B13, B16, B21, B22, B26-B28, C22, C23, C28, C39, C48, D16, D23, D25, D26, D30, E7, E8, H1, H2, H9, H12, H13, H15, I10, J3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, vectors as V
from ..operators import batch, features, graphs, joins, keys, poses, ranks, residues, spatial, splits
from .registry import Registry
from .views import drawn, table, view

REGISTRY = query = Registry()

_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'protein' ELSE 'ligand' END AS part FROM events WHERE event_id % 4 < 3")
def split_hetero(spark, d):
    flag = F.get(F.array(F.lit(" "), F.lit(None), F.lit("H_X"), F.lit("W")), (F.col("event_id") % 4).cast("int"))
    return residues.split_hetero(table(spark, d, "events").select("event_id", flag.alias("hetero_flag"))).select("event_id", "part")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 > 0 AND o_custkey % 40 / 10 <= 2.5 AND o_orderstatus = 'F'")
def xray_entries(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey") % 40 / 10).alias("resolution"), F.when(F.col("o_orderstatus") == "F", "X-RAY DIFFRACTION").otherwise("SOLUTION NMR").alias("method"))
    return residues.xray_filter(residues.resolution_filter(e, 2.5)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_partkey % 2 = 0) BETWEEN 1 AND 3 AND count(*) FILTER (WHERE l_partkey % 2 = 1) > 0)")
def size_limited(spark, d):
    atoms = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_partkey") % 2 == 0, "ligand").otherwise("receptor").alias("side"))
    return residues.size_limit(table(spark, d, "orders").select("o_orderkey"), atoms, ["o_orderkey"], 3)


@query("""WITH a AS (SELECT label AS k, vec_id AS id, CASE vec_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'N' ELSE 'H' END AS element, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
b AS (SELECT k, id AS src, nxt AS dst FROM a WHERE nxt IS NOT NULL AND id % 3 > 0), o AS (SELECT k, src, dst FROM b UNION SELECT k, dst, src FROM b),
n AS (SELECT o.k, o.src, count(*) AS n, max(a.element) AS near FROM o JOIN a ON a.k = o.k AND a.id = o.dst GROUP BY ALL)
SELECT a.k, a.id, a.element FROM a LEFT JOIN n ON n.k = a.k AND n.src = a.id WHERE NOT coalesce(a.element = 'H' AND n.n = 1 AND n.near = 'C', false)""")
def polar_hydrogens(spark, d):
    from pyspark.sql import Window

    element = F.get(F.array(F.lit("C"), F.lit("N"), F.lit("H"), F.lit("H")), (F.col("vec_id") % 4).cast("int"))
    atoms = table(spark, d, "embeddings").select(F.col("label").alias("k"), F.col("vec_id").alias("id"), element.alias("element"))
    bonds = atoms.select("k", F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("k").orderBy("id")).alias("dst")).where("dst is not null and src % 3 > 0")
    return graphs.polar_hydrogens_only(atoms, bonds, ["k"])


@query("SELECT c_custkey, pdb, chain FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 4 END, 'a') AS pdb, CASE WHEN c_custkey % 5 = 0 THEN 'AB' WHEN c_custkey % 5 = 1 THEN '-' ELSE 'A' END AS chain FROM customer) WHERE length(pdb) = 4 AND chain = 'A'")
def valid_ids(spark, d):
    pdb = F.when(F.col("c_custkey") % 3 == 0, F.lpad(F.col("c_custkey").cast("string"), 5, "a")).otherwise(F.lpad(F.col("c_custkey").cast("string"), 4, "a"))
    chain = F.when(F.col("c_custkey") % 5 == 0, "AB").when(F.col("c_custkey") % 5 == 1, "-").otherwise("A")
    keys.check_parameters(90, 2.5, 2.0, 0.7)
    return keys.valid_ids(table(spark, d, "customer").select("c_custkey", pdb.alias("pdb"), chain.alias("chain")))


@query("SELECT c_custkey, '/raw/' || (c_custkey % 9) || '/s' || c_custkey || '.mol2' AS raw, '/raw/' || left('s' || c_custkey, 4) || '/s' || c_custkey || '.mol2' AS by_code FROM customer")
def raw_paths(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws("/", F.lit("/data"), (F.col("c_custkey") % 9).cast("string"), F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit(".pdb"))).alias("path"))
    by_code = keys.raw_path(c, "/raw", "pdbbind", ".mol2").select("c_custkey", F.col("raw").alias("by_code"))
    return keys.raw_path(c, "/raw/", "db5", ".mol2").select("c_custkey", "raw").join(by_code, "c_custkey")


@query("""SELECT c_custkey, style, CASE c_custkey % 4 WHEN 3 THEN 'x' WHEN 0 THEN CASE style WHEN 'dockground' THEN 'ligand' ELSE 'receptor' END WHEN 1 THEN CASE style WHEN 'dockground' THEN 'receptor' ELSE 'ligand' END ELSE CASE style WHEN 'dockground' THEN 'ligand' ELSE 'pocket' END END AS role,
CASE c_custkey % 4 WHEN 3 THEN NULL ELSE style = 'pdbbind' OR c_custkey % 4 = 2 END AS bound FROM customer, (SELECT unnest(['dockground', 'pdbbind']) AS style)""")
def binding_roles(spark, d):
    marks = {"dockground": ("_u1", "_u2", "_b1", "_z"), "pdbbind": ("_protein", "_ligand", "_pocket", "_z")}

    def of(style):
        mark = F.get(F.array(*[F.lit(m) for m in marks[style]]), (F.col("c_custkey") % 4).cast("int"))
        named = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("1abc"), mark, F.lit(".pdb")).alias("name"))
        return keys.binding_role(named, style).select("c_custkey", F.lit(style).alias("style"), "role", "bound")

    return of("dockground").unionByName(of("pdbbind"))


_CA = "SELECT DISTINCT a.pdb_name, {} FROM (SELECT * FROM v_atoms WHERE aid % 3 = 0) a JOIN (SELECT * FROM v_atoms WHERE aid % 3 = 0) b ON a.pdb_name = b.pdb_name WHERE " + f"{_D} < 0.1"


@query(_CA.format("a.residue AS a_residue, b.residue AS b_residue"))
def near_ca_residues(spark, d):
    ca = residues.ca_atoms(view(spark, d, "v_atoms").withColumn("atom_name", F.when(F.col("aid") % 3 == 0, "CA").otherwise("N")))
    return spatial.near_atoms(ca, ca, 0.1, ["pdb_name"], ["residue"])


@query(_CA.format("a.aid AS a_aid, b.aid AS b_aid"))
def near_ca_atoms(spark, d):
    ca = residues.ca_atoms(view(spark, d, "v_atoms").withColumn("atom_name", F.when(F.col("aid") % 3 == 0, "CA").otherwise("N")))
    return spatial.near_atoms(ca, ca, 0.1, ["pdb_name"], ["aid"])


@query(f"""WITH p AS (SELECT a.k, a.id, a.x, a.y, a.z, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, (a.z + b.z) / 2 AS mz, {_D} AS dist, b.id AS o FROM v_points a JOIN v_points b ON a.k = b.k WHERE a.id % 5 = 0 AND b.id % 5 > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY dist, o) AS r FROM p WHERE dist < 0.06)
SELECT 'match_atoms_to_lig' AS mode, k, id, x, y, z FROM n WHERE r = 1 UNION ALL SELECT 'match_terminal_atoms', k, id, mx, my, mz FROM n WHERE r = 1 AND id % 3 <= 1 UNION ALL SELECT 'lig_atoms', k, id, x, y, z FROM v_points WHERE id % 5 = 0""")
def pocket_point_modes(spark, d):
    p = view(spark, d, "v_points").withColumn("degree", F.col("id") % 3)
    mode = lambda m: spatial.pocket_points(p.where("id % 5 = 0"), p.where("id % 5 > 0"), ["k"], 0.06, m).select(F.lit(m).alias("mode"), "k", "id", "x", "y", "z")
    return mode("match_atoms_to_lig").unionByName(mode("match_terminal_atoms")).unionByName(mode("lig_atoms"))


def _knn(points: str, key: str, ident: str, radius: float, k: int) -> str:
    return f"""SELECT {key}, src, dst, dist FROM (SELECT a.{key}, a.{ident} AS src, b.{ident} AS dst, {_D} AS dist, row_number() OVER (PARTITION BY a.{key}, a.{ident} ORDER BY {_D}, b.{ident}) AS n FROM {points} a JOIN {points} b ON a.{key} = b.{key} WHERE a.{ident} <> b.{ident})
WHERE n = 1 OR (n <= {k} AND dist < {radius})"""


@query(f"""WITH c AS (SELECT pdb_name, residue, arg_min(x, aid) AS x, arg_min(y, aid) AS y, arg_min(z, aid) AS z FROM v_atoms GROUP BY pdb_name, residue)
SELECT a.pdb_name, 'membership' AS kind, CAST(a.residue AS VARCHAR) AS src, CAST(b.aid AS VARCHAR) AS dst, {_D} AS dist FROM c a JOIN v_atoms b ON a.pdb_name = b.pdb_name AND a.residue = b.residue
UNION ALL SELECT pdb_name, 'surface', CAST(src AS VARCHAR), CAST(dst AS VARCHAR), dist FROM ({_knn('v_atoms', 'pdb_name', 'aid', 0.05, 5)})
UNION ALL SELECT pdb_name, 'residue', CAST(src AS VARCHAR), CAST(dst AS VARCHAR), dist FROM ({_knn('c', 'pdb_name', 'residue', 0.08, 5)})""")
def hierarchical_edges(spark, d):
    atoms = view(spark, d, "v_atoms")
    ca = atoms.groupBy("pdb_name", "residue").agg(*[F.min_by(c, "aid").alias(c) for c in "xyz"])
    return graphs.hierarchical_edges(atoms, ca, ["pdb_name"], "residue", "aid", 0.05, 0.08, 5)


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS chain, max(l_quantity) AS q FROM lineitem GROUP BY ALL), m AS (SELECT k, chain FROM c WHERE q > 25), u AS (SELECT k, count(*) AS n FROM m GROUP BY k),
r AS (SELECT c.k, c.chain, coalesce(u.n, 0) + row_number() OVER (PARTITION BY c.k ORDER BY c.chain) - 1 AS i FROM c LEFT JOIN u ON u.k = c.k WHERE q <= 25)
SELECT k, chain, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(i + 1 AS INT), 1) AS letter FROM r""")
def unmatched_letters(spark, d):
    chains = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("chain")).agg(F.max("l_quantity").alias("q"))
    return joins.unmatched_letters(chains.select("k", "chain"), chains.where("q > 25").select("k", F.col("chain").alias("unbound")), ["k"])


@query("SELECT event_id, 1 - least(value, 20.0) / 10 AS plain, greatest(0.000001, least(0.99999, 1 - value / 10)) AS p FROM events")
def contact_probabilities(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", (1 - F.least("value", F.lit(20.0)) / 10).alias("plain"), poses.contact_probability(F.col("value")).alias("p"))


@query("""WITH v AS (SELECT o_custkey AS k, o_orderkey AS id, e, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 > e THEN o_totalprice * (e + 1) END AS v FROM orders, (SELECT unnest([0, 1, 2]) AS e)),
s AS (SELECT k, e, CASE WHEN count(*) - count(v) <= 3 THEN coalesce(avg(v), 0) ELSE 0 END AS f FROM v GROUP BY k, e)
SELECT v.k, id, CAST(v.e AS INT) AS element, coalesce(v, f) AS value FROM v JOIN s ON v.k = s.k AND v.e = s.e""")
def imputed_arrays(spark, d):
    value = lambda e: F.when(F.col("o_orderkey") % 7 > e, F.col("o_totalprice") * (e + 1))
    whole = F.when(F.col("o_orderkey") % 5 > 0, F.array(*[value(e) for e in range(3)])).when(F.col("o_orderkey") % 2 > 0, F.array(F.lit(1.0)))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), whole.alias("a"))
    return features.impute_array(rows, "a", 3, ["k"], "id", "mean", 3).select("k", "id", F.posexplode("a").alias("element", "value"))


@query("""WITH v AS (SELECT id, k, value, id % 3 = 0 AS ca FROM v_feat), s AS (SELECT k, CASE WHEN count(*) - count(value) <= 1 THEN coalesce(max(value), 0) ELSE 0 END AS f FROM v WHERE ca GROUP BY k)
SELECT id, CASE WHEN ca THEN coalesce(value, f) ELSE value END AS value FROM v LEFT JOIN s ON v.k = s.k""")
def imputed_ca(spark, d):
    rows = view(spark, d, "v_feat").withColumn("atom_name", F.when(F.col("id") % 3 == 0, "CA").otherwise("CB"))
    return features.impute_ca(rows, ["value"], ["k"], "max", 1).select("id", "value")


@query("SELECT p_partkey AS ligand FROM part WHERE p_partkey % 10 > 0 AND CASE WHEN p_size % 3 > 0 THEN p_size ELSE 8 END > 7")
def few_atoms(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ligand"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("n_heavy"), F.when(F.col("p_partkey") % 10 == 0, "HOH").otherwise("LIG").alias("name"))
    return residues.few_atoms(p, ["HOH"], name="name").select("ligand")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS number, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status, round(CAST(o_custkey % 1000 AS DECIMAL(20, 6)) / 8, 2)::DOUBLE AS rounded, o_custkey % 3 = 2 AS whole FROM orders")
def named_parts(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("n"), F.col("o_custkey").cast("string"), F.lit("_"), "o_orderstatus")).otherwise("none")
    parts = scalars.named_groups(text, r"^n(\d+)_([A-Z])$", ["number", "status"])
    numbers = F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % 3)
    return o.select("o_orderkey", parts["number"].cast("long").alias("number"), parts["status"].alias("status"), scalars.half_up(F.col("o_custkey") % 1000 / 8).alias("rounded"), scalars.checked_array(numbers, 3).isNotNull().alias("whole"))


@query("SELECT event_id, event_id AS id, 'a\"b' AS quoted, user_id % 7 AS last FROM events")
def lenient_json_values(spark, d):
    doc = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "quoted": "a\\"b", "odd": "\\d", "list": [1, '), (F.col("user_id") % 7).cast("string"), F.lit(", ], }"))
    return table(spark, d, "events").select("event_id", scalars.json_path(doc, "id").cast("long").alias("id"), scalars.json_path(doc, "quoted").alias("quoted"), scalars.json_path(doc, "list[1]").cast("long").alias("last"))


@query("SELECT o_orderkey AS complex, l_partkey AS atom, l_partkey % 3 = 0 AS lig, o_custkey AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 4 > 0")
def labelled_sites(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("complex"), F.col("l_partkey").alias("atom"), F.when(F.col("l_suppkey") % 4 == 0, "H").otherwise("C").alias("element"))
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("complex"), F.col("o_custkey").alias("label"))
    sites = splits.labelled_sites(l.where("atom % 3 > 0"), l.where("atom % 3 = 0"), labels)
    return sites.select("complex", "atom", (F.col("lig_flag") == 1).alias("lig"), "label")


@query("SELECT o_custkey AS ligand, min(o_orderkey) FILTER (WHERE o_orderkey % 3 = 1) AS active, min(o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS inactive FROM orders GROUP BY o_custkey HAVING active IS NOT NULL AND inactive IS NOT NULL")
def active_pairs(spark, d):
    return splits.active_pairs(table(spark, d, "orders").select(F.col("o_custkey").alias("ligand"), F.col("o_orderkey").alias("structure"), (F.col("o_orderkey") % 3).alias("active")))


@query("SELECT o_orderkey, o_totalprice * 2 AS score FROM orders WHERE o_orderstatus = 'F' AND o_totalprice * 2 > 200000")
def composed_steps(spark, d):
    steps = (lambda x: x.where("o_orderstatus = 'F'"), lambda x: x.select("o_orderkey", (F.col("o_totalprice") * 2).alias("score")), poses.positive_scores, lambda x: x.where("score > 200000"))
    return batch.compose(table(spark, d, "orders"), *steps)


#: Three vectors of an embedding, and a nearby origin, for normals and frames.
_THREE = ", ".join(f"CAST(embedding[{{{k}}}] AS DOUBLE) AS {n}" for k, n in enumerate(("ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz")))


def _three(spark, d):
    e = spark.sql("SELECT vec_id AS id, label AS k, " + _THREE.format(*range(9)) + " FROM {e}", e=table(spark, d, "embeddings"))
    return e.withColumns({n: V.vec(*[F.col(f"{n}{c}" if f"{n}{c}" != "by" else "by_") for c in "xyz"]) for n in "abc"})


_V = f"v AS (SELECT vec_id AS id, label AS k, {_THREE.format(*range(1, 10))} FROM embeddings)"


@query(f"""WITH {_V}, e AS (SELECT id, ax - bx AS px, ay - by_ AS py, az - bz AS pz, bx - cx AS qx, by_ - cy AS qy, bz - cz AS qz FROM v)
SELECT id, CASE WHEN id % 7 > 0 THEN py * qz - pz * qy END AS x, CASE WHEN id % 7 > 0 THEN pz * qx - px * qz END AS y, CASE WHEN id % 7 > 0 THEN px * qy - py * qx END AS z FROM e""")
def amide_normals(spark, d):
    v = _three(spark, d)
    normal = V.amide_normal(F.col("a"), F.when(F.col("id") % 7 > 0, F.col("b")), F.col("c"))
    return v.select("id", *[normal[c].alias(c) for c in "xyz"])


_FRAMES = f"""{_V}, u1 AS (SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_) + (az - bz) * (az - bz)) AS nl, sqrt((cx - bx) * (cx - bx) + (cy - by_) * (cy - by_) + (cz - bz) * (cz - bz)) AS cl FROM v),
u2 AS (SELECT *, (ax - bx) / nl AS ux, (ay - by_) / nl AS uy, (az - bz) / nl AS uz, (cx - bx) / cl AS wx, (cy - by_) / cl AS wy, (cz - bz) / cl AS wz FROM u1),
u3 AS (SELECT *, uy * wz - uz * wy AS rx, uz * wx - ux * wz AS ry, ux * wy - uy * wx AS rz FROM u2), u4 AS (SELECT *, rx / sqrt(rx * rx + ry * ry + rz * rz) AS nx, ry / sqrt(rx * rx + ry * ry + rz * rz) AS ny, rz / sqrt(rx * rx + ry * ry + rz * rz) AS nz FROM u3),
f AS (SELECT *, ny * uz - nz * uy AS vx, nz * ux - nx * uz AS vy, nx * uy - ny * ux AS vz FROM u4)"""


def _inside(x: str, y: str, z: str) -> list[str]:
    return [f"{p}x * ({x}) + {p}y * ({y}) + {p}z * ({z})" for p in ("t.n", "t.u", "t.v")]


_TWELVE = [*_inside("s.bx - t.bx", "s.by_ - t.by_", "s.bz - t.bz"), *[c for p in ("n", "u", "v") for c in _inside(f"s.{p}x", f"s.{p}y", f"s.{p}z")]]


@query(f"WITH {_FRAMES} SELECT s.id AS src, t.id AS dst, {', '.join(f'{c} AS o{k}' for k, c in enumerate(_TWELVE))} FROM f s JOIN f t ON s.k = t.k AND t.id > s.id")
def edge_frames(spark, d):
    f = _three(spark, d).select("k", "id", F.col("b").alias("ca"), V.local_frame(F.col("a"), F.col("b"), F.col("c")).alias("f"))
    at = lambda end, name: f.select("k", F.col("id").alias(name), F.col("ca").alias(f"ca_{end}"), F.col("f").alias(f"f_{end}"))
    both = spatial.product(at("s", "src"), at("t", "dst"), ["k"]).where("dst > src")
    o = both.select("src", "dst", V.edge_orientation(F.col("ca_s"), F.col("ca_t"), F.col("f_s"), F.col("f_t")).alias("o"))
    return o.select("src", "dst", *[F.col("o")[k].alias(f"o{k}") for k in range(12)])


@query(f"""WITH {_FRAMES}, b AS (SELECT *, wx + ux AS sx, wy + uy AS sy, wz + uz AS sz, wy * uz - wz * uy AS tx, wz * ux - wx * uz AS ty, wx * uy - wy * ux AS tz FROM f)
SELECT id, {', '.join(f"-s{c} / sqrt(sx * sx + sy * sy + sz * sz) * sqrt(1 / 3) - t{c} / sqrt(tx * tx + ty * ty + tz * tz) * sqrt(2 / 3) AS {c}" for c in 'xyz')} FROM b""")
def sidechain_directions(spark, d):
    side = V.sidechain_direction(F.col("a"), F.col("b"), F.col("c"))
    return _three(spark, d).select("id", *[side[c].alias(c) for c in "xyz"])


_ROTATED = f"""WITH {_V}, h AS (SELECT *, {drawn(5, 'id')} AS p, {drawn(6, 'id')} AS q, {drawn(7, 'id')} AS r FROM v),
q AS (SELECT *, sqrt(1 - p) * sin(2 * pi() * q) AS w, sqrt(1 - p) * cos(2 * pi() * q) AS i, sqrt(p) * sin(2 * pi() * r) AS j, sqrt(p) * cos(2 * pi() * r) AS k FROM (SELECT * EXCLUDE (k) FROM h))
SELECT id, (1 - 2 * (j * j + k * k)) * (ax - bx) + 2 * (i * j - k * w) * (ay - by_) + 2 * (i * k + j * w) * (az - bz) + bx + cx AS x, 2 * (i * j + k * w) * (ax - bx) + (1 - 2 * (i * i + k * k)) * (ay - by_) + 2 * (j * k - i * w) * (az - bz) + by_ + cy AS y,
2 * (i * k - j * w) * (ax - bx) + 2 * (j * k + i * w) * (ay - by_) + (1 - 2 * (i * i + j * j)) * (az - bz) + bz + cz AS z FROM q"""


@query(_ROTATED)
def rotated_points(spark, d):
    v = _three(spark, d).withColumn("m", V.rotation(5, "id"))
    moved = V.rotate_translate(F.col("a"), F.col("m"), F.col("c"), F.col("b"))
    return v.select("id", *[moved[c].alias(c) for c in "xyz"])


@query(f"""WITH {_V} SELECT id, ax + (2 * {drawn(9, 'id')} - 1) * 0.5 AS x, ay + (2 * {drawn(10, 'id')} - 1) * 0.5 AS y, az + (2 * {drawn(11, 'id')} - 1) * 0.5 AS z FROM v""")
def jittered_points(spark, d):
    moved = V.jitter(F.col("a"), 0.5, 9, "id")
    return _three(spark, d).select("id", *[moved[c].alias(c) for c in "xyz"])


def _dihedral(p: list[str]) -> tuple[str, str]:
    """(steps, angle): columns of bonds and normals of four points named by prefix, and the angle in degrees."""
    bond = lambda n, a, b: ", ".join(f"{b}{c} - {a}{c} AS {n}{c}" for c in "xyz")
    cross = lambda n, a, b: f"{a}y * {b}z - {a}z * {b}y AS {n}x, {a}z * {b}x - {a}x * {b}z AS {n}y, {a}x * {b}y - {a}y * {b}x AS {n}z"
    return ", ".join([bond("d0", p[0], p[1]), bond("d1", p[1], p[2]), bond("d2", p[2], p[3])]), ", ".join([cross("m0", "d0", "d1"), cross("m1", "d1", "d2")])


_ANGLE = "degrees(atan2(sqrt(d1x * d1x + d1y * d1y + d1z * d1z) * (d0x * m1x + d0y * m1y + d0z * m1z), m0x * m1x + m0y * m1y + m0z * m1z))"


def _angle_of(name: str, source: str, points: list[str], keep: str) -> str:
    """CTEs that end in `name` with the columns kept and the dihedral of four points as angle."""
    bonds, normals = _dihedral(points)
    return f"{name}_b AS (SELECT *, {bonds} FROM {source}), {name}_n AS (SELECT *, {normals} FROM {name}_b), {name} AS (SELECT {keep}, {_ANGLE} AS angle FROM {name}_n)"


_CHAIN = f"""{_V}, r AS (SELECT *, {', '.join(f"{fn}({c}) OVER w AS {p}{c[:2]}" for fn, p in (('lag', 'l'), ('lead', 'n')) for c in ('ax', 'ay', 'az', 'bx', 'by_', 'bz', 'cx', 'cy', 'cz'))} FROM v WINDOW w AS (PARTITION BY k ORDER BY id)),
s AS (SELECT *, bx AS ex, by_ AS ey, bz AS ez FROM r)"""


@query(f"""WITH {_CHAIN}, {_angle_of('phi', 's', ['lc', 'a', 'e', 'c'], 'id')}, {_angle_of('psi', 's', ['a', 'e', 'c', 'na'], 'id')}, {_angle_of('omega', 's', ['e', 'c', 'na', 'nb'], 'id')}
SELECT phi.id, cos(radians(coalesce(phi.angle, 0))) AS d0, cos(radians(coalesce(psi.angle, 0))) AS d1, cos(radians(coalesce(omega.angle, 0))) AS d2, sin(radians(coalesce(phi.angle, 0))) AS d3, sin(radians(coalesce(psi.angle, 0))) AS d4, sin(radians(coalesce(omega.angle, 0))) AS d5
FROM phi JOIN psi ON phi.id = psi.id JOIN omega ON phi.id = omega.id""")
def backbone_dihedrals(spark, d):
    rows = _three(spark, d).select("k", "id", F.col("a").alias("n"), F.col("b").alias("ca"), F.col("c"))
    found = ranks.backbone_dihedrals(rows, ["k"], "id")
    return found.select("id", *[F.col("dihedrals")[k].alias(f"d{k}") for k in range(6)])


_MEAN = lambda end, other: f"""SELECT b.src, b.dst, {', '.join(f'sum(p.{c} * w) / sum(w) AS {end[0]}m{c}' for c in 'xyz')} FROM (SELECT b.src, b.dst, o.b AS near, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS w
FROM bonds b JOIN ends o ON o.a = b.{end} AND o.b <> b.{other} JOIN v_points p ON p.id = o.b JOIN v_points q ON q.id = b.{end} WHERE b.src % 2 = 0) b JOIN v_points p ON p.id = b.near GROUP BY b.src, b.dst"""  # noqa: E731


@query(f"""WITH bonds AS (SELECT a.id AS src, b.id AS dst FROM v_points a JOIN v_points b ON b.id = a.id + 1), ends AS (SELECT src AS a, dst AS b FROM bonds UNION SELECT dst, src FROM bonds), ms AS ({_MEAN('src', 'dst')}), md AS ({_MEAN('dst', 'src')}),
four AS (SELECT ms.src, ms.dst, smx, smy, smz, dmx, dmy, dmz, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM ms JOIN md ON ms.src = md.src AND ms.dst = md.dst JOIN v_points p ON p.id = ms.src JOIN v_points q ON q.id = ms.dst),
{_angle_of('t', 'four', ['sm', 'p', 'q', 'dm'], 'src, dst')} SELECT src, dst, angle AS torsion FROM t""")
def torsion_angles(spark, d):
    p = view(spark, d, "v_points").withColumn("k", F.lit(0))
    ends = p.select("k", F.col("id").alias("dst"))
    bonds = p.selectExpr("k", "id as src", "id + 1 as dst", "id % 2 = 0 as rotatable").join(ends, ["k", "dst"], "left_semi").select("k", "src", "dst", "rotatable")
    return graphs.torsion_angles(bonds, p, ["k"]).select("src", "dst", "torsion")


@query(f"""WITH a AS (SELECT *, CASE aid // 3 % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'O' END AS atom_name, CASE WHEN residue % 2 = 0 THEN 'G' ELSE 'A' END AS letter FROM v_atoms),
s AS (SELECT a.pdb_name, a.residue AS i, b.residue AS j FROM a JOIN a b ON a.pdb_name = b.pdb_name WHERE {_D} < 0.02 * sqrt(-2 * ln(1e-3)) GROUP BY ALL),
m AS (SELECT pdb_name, residue, min(struct_pack(x := x, y := y, z := z)) FILTER (WHERE atom_name = 'CA') AS ca FROM a GROUP BY ALL),
k AS (SELECT a.*, m.ca, row_number() OVER (PARTITION BY a.pdb_name, a.residue ORDER BY aid) AS n FROM a JOIN m ON a.pdb_name = m.pdb_name AND a.residue = m.residue WHERE m.ca IS NOT NULL),
g AS (SELECT *, sqrt((x - ca.x) * (x - ca.x) + (y - ca.y) * (y - ca.y) + (z - ca.z) * (z - ca.z)) AS l, CASE WHEN letter = 'G' AND atom_name IN ('N', 'C') THEN -1.0 WHEN letter <> 'G' AND n > 4 THEN 1.0 END AS sign FROM k),
d AS (SELECT pdb_name, residue, letter, any_value(ca) AS ca, avg(coalesce((x - ca.x) / nullif(l, 0), 0) * sign) AS dx, avg(coalesce((y - ca.y) / nullif(l, 0), 0) * sign) AS dy, avg(coalesce((z - ca.z) / nullif(l, 0), 0) * sign) AS dz FROM g GROUP BY ALL),
p AS (SELECT s.pdb_name, s.i, o.letter AS own, t.letter AS other, o.dx * (t.ca.x - o.ca.x) + o.dy * (t.ca.y - o.ca.y) + o.dz * (t.ca.z - o.ca.z) > 0 AS up FROM s JOIN d o ON o.pdb_name = s.pdb_name AND o.residue = s.i JOIN d t ON t.pdb_name = s.pdb_name AND t.residue = s.j WHERE o.dx IS NOT NULL),
c AS (SELECT pdb_name, i, count(*) AS n, {', '.join(f"(count(*) FILTER (WHERE {'up' if up else 'NOT up'} AND other = '{x}') + CAST(any_value(own) = '{x}' AS INT)) AS {x.lower()}_{'up' if up else 'down'}" for up in (True, False) for x in 'AG')} FROM p GROUP BY ALL)
SELECT d.pdb_name, d.residue, a_up / (1 + n) AS a_up, g_up / (1 + n) AS g_up, a_down / (1 + n) AS a_down, g_down / (1 + n) AS g_down, (a_up + g_up + a_down + g_down) / (1 + n) AS total FROM d LEFT JOIN c ON c.pdb_name = d.pdb_name AND c.i = d.residue""")
def half_sphere_composition(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("N", "CA", "C", "O")]), (F.floor(F.col("aid") / 3) % 4 + 1).cast("int"))
    atoms = view(spark, d, "v_atoms").withColumns({"atom_name": name, "resname": F.when(F.col("residue") % 2 == 0, "GLY").otherwise("ALA")})
    similar = spatial.residue_similarity(atoms, ["pdb_name"], "residue", sigma=0.02)
    found = features.half_sphere_composition(similar, features.sidechain_vectors(atoms, ["pdb_name", "residue"]), ["pdb_name"], "residue")
    at = lambda x, down: F.col("hsaac")[[*residues.LETTERS.values(), "X"].index(x) + 21 * down]
    total = F.aggregate("hsaac", F.lit(0.0), lambda s, x: s + x)
    return found.select("pdb_name", "residue", at("A", 0).alias("a_up"), at("G", 0).alias("g_up"), at("A", 1).alias("a_down"), at("G", 1).alias("g_down"), total.alias("total"))


@query("""WITH c AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM v_chain WINDOW w AS (PARTITION BY k ORDER BY id))
SELECT k, id, coalesce(-dx / nullif(sqrt(dx * dx + dy * dy + dz * dz), 0), 0) AS bx, coalesce(-dy / nullif(sqrt(dx * dx + dy * dy + dz * dz), 0), 0) AS b_y, coalesce(-dz / nullif(sqrt(dx * dx + dy * dy + dz * dz), 0), 0) AS bz FROM c""")
def backward_orientations(spark, d):
    df = ranks.orientations(view(spark, d, "v_chain"), ["k"], "id")
    return df.select("k", "id", F.col("backward.x").alias("bx"), F.col("backward.y").alias("b_y"), F.col("backward.z").alias("bz"))


@query("""SELECT p_partkey, k, exp(-pow((p_retailprice / 100 - k * (20.0 / 15)) / 1.25, 2)) AS rbf, CASE WHEN k < 15 THEN exp(-pow(p_retailprice / 100 / 2.0, 2) / pow(1.5, k)) END AS basis, CASE WHEN k < 8 THEN cos(p_size * exp(k * 2 * (-ln(10000.0) / 16))) ELSE sin(p_size * exp((k - 8) * 2 * (-ln(10000.0) / 16))) END AS position,
CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 3 = 0 THEN 15 ELSE CAST(floor(least(p_retailprice / 100, 15.0) + 0.5) AS INT) END AS bin FROM part, (SELECT unnest(range(16)) AS k)""")
def whole_distance_features(spark, d):
    x = F.col("p_retailprice") / 100
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(F.arrays_zip(scalars.rbf(x).alias("rbf"), scalars.distance_basis(x, 2.0).alias("basis"), scalars.positional_encoding(F.col("p_size")).alias("position"))).alias("k", "v"), scalars.distance_bin(x, F.col("p_size") % 3 > 0, F.col("p_size") % 5 == 0).alias("bin"))
    return rows.select("p_partkey", F.col("k").cast("long").alias("k"), *[F.col("v")[n].alias(n) for n in ("rbf", "basis", "position")], "bin")
