"""Keys, filters, equi joins, features, splits: A13, A22, B*, C3-C14, C43, C44, C48, C49, D19-D23, E9, E11, G1-G5, H1, H14, H15, H17, I1-I8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import batch, features, joins, keys, ranks, residues, splits, waters
from ..sources import files
from .registry import Registry
from .views import drawn, table, view

REGISTRY = query = Registry()


@query("""WITH f AS (SELECT c_custkey, concat('complex_', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '_r_b' ELSE '_l_u' END, '.pdb.gz') AS path FROM customer), k AS (SELECT *, string_split(path, '.')[1] AS a FROM f)
SELECT c_custkey, concat(a, '.pdb') AS name, string_split(a, '_')[-1] AS code, substr(string_split(a, '_')[-1], 2, 2) AS grp, CASE WHEN c_custkey % 2 = 0 THEN 'receptor' ELSE 'ligand' END AS role, c_custkey % 2 = 0 AS bound FROM k""")
def file_keys(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("/data/complex_"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "_r_b").otherwise("_l_u"), F.lit(".pdb.gz")).alias("path"))
    return keys.binding_role(keys.file_keys(c), "db5").select("c_custkey", "name", "code", "grp", "role", "bound")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS INT) ELSE 0 END AS model, substr(c_mktsegment, 1, 1) AS chain FROM customer")
def split_model_chain(spark, d):
    c = table(spark, d, "customer")
    name = F.concat_ws("_", F.lit("1abc"), F.substring("c_mktsegment", 1, 1), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string")).otherwise("x"))
    return c.withColumn("s", keys.split_model_chain(name)).select("c_custkey", "s.model", "s.chain")


@query("SELECT p_partkey, p_retailprice * CASE p_size % 6 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 WHEN 2 THEN 1e3 WHEN 3 THEN 1.0 WHEN 4 THEN 1e-3 ELSE 1e-6 END AS nm FROM part")
def to_nanomolar(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in scalars.NANOMOLAR]), F.col("p_size") % 6 + 1)
    return table(spark, d, "part").select("p_partkey", scalars.to_nm(unit, F.col("p_retailprice")).alias("nm"))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END AS category, CAST(CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 0 ELSE 1 END AS DOUBLE) AS is_misc FROM part")
def categories(spark, d):
    words = ["ECONOMY", "STANDARD", "misc"]
    return table(spark, d, "part").select("p_partkey", scalars.category_index(F.col("p_type"), words).alias("category"), scalars.one_hot(F.col("p_type"), words)[2].alias("is_misc"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'none' AS missing FROM events")
def json_values(spark, d):
    return table(spark, d, "events").select("event_id", scalars.json_path(F.col("props"), "k").cast("long").alias("k"), scalars.json_path(F.col("props"), "absent.path", "none").alias("missing"))


@query("""SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS click, avg(value) FILTER (WHERE event_type = 'view') AS "view", avg(value) FILTER (WHERE event_type = 'error') AS error FROM events
WHERE event_id % 3 < 2 AND event_type IN ('click', 'view', 'error') GROUP BY user_id""")
def flattened_affinity(spark, d):
    unit = F.when(F.col("event_id") % 3 < 2, "nM").otherwise("kg")
    m = F.array(F.struct(F.lit("lig").alias("comp_id"), F.col("event_type").alias("type"), unit.alias("unit"), F.col("value").alias("value")))
    entries = table(spark, d, "events").select("user_id", m.alias("m"))
    return files.flatten_affinity(entries, ["user_id"], "m", types=("click", "view", "error")).drop("comp_id")


@query("SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY ALL")
def mean_affinity(spark, d):
    return files.mean_affinity(table(spark, d, "events"), ["user_id"], "event_type")


@query("SELECT event_id, CAST(ts AS DATE)::VARCHAR AS day FROM events")
def dates(spark, d):
    ts = table(spark, d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return ts.select("event_id", F.when(F.col("event_id") % 2 == 0, scalars.compact_date(iso)).otherwise(scalars.compact_date(F.date_format("ts", "yyyyMMdd"))).cast("string").alias("day"))


@query("SELECT c_custkey, c.c_nationkey FROM customer c WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def pending(spark, d):
    return joins.pending(table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <> 1")
def expect_files(spark, d):
    return joins.expect_files(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key")))


@query("""WITH f AS (SELECT o_custkey AS code, CASE o_orderkey % 3 WHEN 0 THEN 'ligand' WHEN 1 THEN 'receptor' ELSE 'pocket' END AS role, lpad(o_orderkey::VARCHAR, 10, '0') AS path FROM orders)
SELECT code AS complex, 0 AS id, max(path) FILTER (WHERE role = 'ligand') AS src0, max(path) FILTER (WHERE role = 'receptor') AS src1, max(path) FILTER (WHERE role = 'pocket') AS src2 FROM f GROUP BY code HAVING src0 IS NOT NULL AND src1 IS NOT NULL""")
def assembled_complexes(spark, d):
    role = F.element_at(F.array(F.lit("ligand"), F.lit("receptor"), F.lit("pocket")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), role.alias("role"), F.lit(True).alias("bound"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("path"))
    return joins.file_pair(joins.assemble_complexes(f))


@query("SELECT l_orderkey AS complex, l_partkey::VARCHAR AS path FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY ALL")
def missing_sources(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("complex"), F.col("l_partkey").cast("string").alias("src0"))
    return joins.missing_sources(pairs, table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").cast("string").alias("path")), ["src0"])


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS code, l_suppkey AS pair_id, l_linenumber AS chain FROM lineitem), listed AS (SELECT DISTINCT code, pair_id, chain FROM p WHERE chain <> 2 OR code % 2 = 0),
ok AS (SELECT DISTINCT code, pair_id FROM p WHERE (code, pair_id) IN (SELECT code, pair_id FROM listed) AND (code, pair_id) NOT IN (SELECT code, pair_id FROM p WHERE (code, pair_id, chain) NOT IN (SELECT code, pair_id, chain FROM listed)))
SELECT code, pair_id FROM ok UNION SELECT code, pair_id FROM p WHERE code % 10 = 1""")
def pruned_pairs(spark, d):
    chains = table(spark, d, "lineitem").selectExpr("l_orderkey as code", "l_suppkey as pair_id", "l_linenumber as chain").distinct()
    pairs = chains.select("code", F.lit("1").alias("struct_id"), "pair_id").distinct()
    listed = chains.where("chain <> 2 or code % 2 = 0")
    both = joins.criteria_join([listed.where("code % 3 = 0"), listed.where("code % 3 > 0"), listed.select("code").distinct()])
    return joins.prune_pairs(pairs, chains, both, pairs.where("code % 10 = 1")).select("code", "pair_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN coalesce(p_retailprice, -1) END AS price FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def attached_features(spark, d):
    atoms = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") == 1, "CA").otherwise("CB").alias("atom_name"))
    f = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"))
    return joins.attach_features(atoms, f, ["l_partkey"], {"price": -1.0}).drop("atom_name")


#: The lines of each order as residues of both sides, and the pairs in contact.
_SIDES = "i AS (SELECT DISTINCT l_orderkey AS complex, CAST(l_linenumber AS BIGINT) AS i FROM lineitem), c AS (SELECT a.complex, a.i, b.i AS j, (a.complex + a.i * b.i) % 4 = 0 AS near FROM i a JOIN i b ON a.complex = b.complex)"


def _sides(spark, d):
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey as complex", "cast(l_linenumber as bigint) as i").distinct()
    a, b = lines, lines.withColumnRenamed("i", "j")
    return a, b, a.join(b, "complex").where("(complex + i * j) % 4 = 0")


@query(f"WITH {_SIDES} SELECT complex, i, j, CAST(near AS INT) AS label FROM c")
def label_matrix(spark, d):
    return joins.label_matrix(*_sides(spark, d), ["complex"])


@query(f"WITH {_SIDES} SELECT complex, i, j FROM c WHERE NOT near")
def negatives(spark, d):
    return joins.negatives(*_sides(spark, d), ["complex"], full=True)


@query(f"""WITH {_SIDES}, n AS (SELECT complex, count(*) AS n FROM c WHERE near GROUP BY complex), r AS (SELECT complex, i, j, row_number() OVER (PARTITION BY complex ORDER BY {drawn(7, 'i', 'j')}, i, j) AS k FROM c WHERE NOT near)
SELECT r.complex, i, j FROM r JOIN n ON r.complex = n.complex WHERE k <= n""")
def sampled_negatives(spark, d):
    return joins.negatives(*_sides(spark, d), ["complex"], seed=7)


@query("""WITH b AS (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
SELECT l_orderkey AS complex, l_linenumber AS bound, l_partkey AS unbound FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_partkey) AS k FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey, l_linenumber) AS mm FROM b) WHERE l_extendedprice > mm - 20000) WHERE k = 1""")
def best_chain_match(spark, d):
    s = table(spark, d, "lineitem").selectExpr("l_orderkey as complex", "l_linenumber as bound", "l_partkey as unbound", "l_extendedprice as sequence_score", "l_quantity as rmsd")
    return joins.best_chain_match(s, ["complex"], 20000).select("complex", "bound", "unbound")


@query("SELECT user_id AS k, event_id AS column, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS index FROM events WHERE event_type <> 'error'")
def reference_numbering(spark, d):
    a = table(spark, d, "events").selectExpr("user_id as k", "event_id as column", "case when event_type <> 'error' then event_type end as residue_0", "case when event_type = 'view' then 1 end as residue_1")
    return joins.reference_numbering(a, ["k"]).select("k", "column", "index")


@query("SELECT c_custkey AS id, 0 AS list FROM customer WHERE c_nationkey < 5 UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY o_custkey")
def united_ids(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("place"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("place"))
    return joins.union_distinct([a, b], "id", "place").select("id", "list")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_operations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    ids = table(spark, d, "customer").select("c_custkey")
    return joins.except_ids(joins.intersect_ids(ids, o.where("o_orderstatus = 'O'"), "c_custkey"), o.where("o_orderstatus = 'F'"), "c_custkey")


@query("SELECT l_partkey AS value, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS keys FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_partkey")
def inverted_multimap(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return joins.invert_multimap(m, "l_orderkey", "parts").select("value", F.array_join("keys", ",").alias("keys"))


@query("SELECT 'a' AS part, s_name AS name, NULL AS c_acctbal FROM supplier UNION ALL SELECT 'b', c_name, c_acctbal FROM customer")
def concat_tables(spark, d):
    return joins.concat_tables({"a": table(spark, d, "supplier").select(F.col("s_name").alias("name")), "b": table(spark, d, "customer").select(F.col("c_name").alias("name"), "c_acctbal")})


@query("""WITH c AS (SELECT s_name AS protein_name, avg(s_acctbal) AS x FROM supplier GROUP BY s_name),
k AS (SELECT s_name AS protein_name, 'pocket_' || k AS pocket_name, CAST(s_acctbal AS DOUBLE) + k AS x FROM supplier, (SELECT unnest([1, 2]) AS k))
SELECT protein_name, p_name AS compound_name, pocket_name, round(x, 3) AS x, round(2 * x, 3) AS y, round(-x, 3) AS z
FROM (SELECT protein_name, 'protein_center' AS pocket_name, x FROM c UNION ALL SELECT * FROM k), (SELECT DISTINCT p_name FROM part)""")
def candidates(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_name as protein_name", "s_acctbal as x", "2 * s_acctbal as y", "-s_acctbal as z")
    pockets = s.withColumn("rank", F.explode(F.array(F.lit(5), F.lit(9)))).withColumn("x", F.col("x") + F.when(F.col("rank") == 5, 1).otherwise(2))
    pockets = pockets.withColumns({"y": 2 * F.col("x"), "z": -F.col("x")})
    compounds = table(spark, d, "part").selectExpr("p_name as compound_name", "p_name as smiles").distinct()
    return joins.candidates(s, compounds, pockets).select("protein_name", "compound_name", "pocket_name", "pocket_com.*")


@query("SELECT id, (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) AS value FROM v_feat WINDOW w AS (PARTITION BY k)")
def min_max_scaled(spark, d):
    return features.min_max_scale(view(spark, d, "v_feat"), ["value"], ["k"]).select("id", "value")


@query("WITH s AS (SELECT k, CASE WHEN count(*) - count(value) <= 2 THEN coalesce(median(value), 0) ELSE 0 END AS f FROM v_feat GROUP BY k) SELECT id, coalesce(value, f) AS value FROM v_feat JOIN s USING (k)")
def imputed(spark, d):
    return features.impute(view(spark, d, "v_feat"), ["value"], ["k"], most=2).select("id", "value")


@query("""SELECT count(DISTINCT k) AS n_complexes, count(*) AS n_residues, count(*) FILTER (WHERE id % 5 = 0) AS n_interface, count(value) AS valid_value, (SELECT count(*) FROM v_binary) AS n_pairs, (SELECT sum(y)::BIGINT FROM v_binary) AS n_positive,
(SELECT (count(*) - sum(y))::BIGINT FROM v_binary) AS n_negative, count(*) FILTER (WHERE id % 5 = 0) / count(*) AS share_interface, (SELECT avg(y) FROM v_binary) AS positive_ratio FROM v_feat""")
def dataset_statistics(spark, d):
    r = view(spark, d, "v_feat").withColumn("interface", F.col("id") % 5 == 0)
    return features.dataset_statistics(r, view(spark, d, "v_binary").withColumnRenamed("y", "label"), {"value": "double"}, "k")


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, position, CASE WHEN position < floor(n * 6 / 10) THEN 'train' WHEN position < floor(n * 8 / 10) THEN 'valid' ELSE 'test' END AS split FROM n""")
def ratio_split(spark, d):
    return splits.ratio_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 < 6 THEN 'train' WHEN c_custkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM customer WHERE c_custkey % 10 < 9")
def list_split(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return splits.list_split(c, c.where("c_custkey % 10 < 6"), c.where("c_custkey % 10 in (5, 6, 7)"), c.where("c_custkey % 10 in (7, 8)"), "c_custkey")


@query("""WITH s AS (SELECT *, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'train' WHEN o_orderdate < DATE '1998-01-01' THEN 'valid' ELSE 'test' END AS split FROM orders)
SELECT split, count(*) AS n, count(*) FILTER (WHERE split = 'train' AND o_custkey NOT IN (SELECT o_custkey FROM s WHERE split = 'test')) AS free FROM s GROUP BY split""")
def time_split(spark, d):
    s = splits.time_split(table(spark, d, "orders"), F.col("o_orderdate"), F.lit("1996-01-01").cast("date"), F.lit("1998-01-01").cast("date"))
    free = splits.overlap_free(s.where("split = 'train'"), s.where("split = 'test'"), ["o_custkey"]).groupBy("split").agg(F.count("*").alias("free"))
    return s.groupBy("split").agg(F.count("*").alias("n")).join(free, "split", "left").na.fill(0, ["free"])


#: Bits of the parts' fingerprints, their number, and of two parts those in common.
_BITS = """f AS (SELECT p_partkey AS id, unnest(list_distinct([p_size % 64, p_size * 7 % 64, p_partkey % 8, p_partkey % 512 // 8, 63 - p_size % 5])) AS bit FROM part), n AS (SELECT id, count(*) AS n FROM f GROUP BY id),
i AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM f a JOIN f b USING (bit) WHERE a.id < b.id GROUP BY ALL)"""


@query(f"WITH {_BITS} SELECT a, b, i / (x.n + y.n - i) AS similarity FROM i JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE i / (x.n + y.n - i) >= 0.6")
def similar_fingerprints(spark, d):
    return splits.similar_pairs(fingerprints(table(spark, d, "part")), "id", "words", 0.6)


def fingerprints(part):
    bits = F.array_distinct(F.transform(F.array(F.expr("p_size % 64"), F.expr("p_size * 7 % 64"), F.expr("p_partkey % 8"), F.expr("p_partkey % 512 div 8"), F.expr("63 - p_size % 5")), lambda x: x.cast("int")))
    word = F.aggregate(F.transform(bits, lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return part.select(F.col("p_partkey").alias("id"), F.array(word).alias("words"))


@query(f"""WITH RECURSIVE {_BITS}, e AS (SELECT a, b FROM i JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE i / (x.n + y.n - i) >= 0.9), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT id AS node, id AS o FROM (SELECT p_partkey AS id FROM part) UNION SELECT r.node, l.b FROM r JOIN l ON r.o = l.a), g AS (SELECT node AS id, min(o) AS component FROM r GROUP BY node),
s AS (SELECT component, count(*) AS n FROM g GROUP BY component), t AS (SELECT component, (sum(n) OVER (ORDER BY n DESC, component) - n) / sum(n) OVER () AS share FROM s)
SELECT id, g.component, CASE WHEN share < 0.6 THEN 'train' WHEN share < 0.6 + 0.2 THEN 'valid' ELSE 'test' END AS split FROM g JOIN t ON g.component = t.component""")
def similarity_split(spark, d):
    return splits.similarity_split(fingerprints(table(spark, d, "part")), "id", "words", 0.9)


@query(f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {drawn(0, 'o_orderkey')}, o_orderkey LIMIT 100")
def sampled_rows(spark, d):
    return splits.sample_rows(table(spark, d, "orders"), 100, "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 = 0 AS pos, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 = 0 ORDER BY {drawn(0, 'o_orderkey')}, o_orderkey) AS k, least(count(*) FILTER (WHERE o_orderkey % 4 = 0) OVER (PARTITION BY o_custkey), 3) AS n FROM orders)
SELECT o_custkey, o_orderkey, CAST(pos AS INT) AS label FROM r WHERE k <= n""")
def balanced_labels(spark, d):
    o = table(spark, d, "orders").withColumn("label", (F.col("o_orderkey") % 4 == 0).cast("int"))
    return splits.balanced_labels(o, ["o_custkey"], "o_orderkey", num_pos=3).select("o_custkey", "o_orderkey", "label")


@query(f"""WITH RECURSIVE i AS (SELECT p_partkey, p_size, CAST(floor({drawn(0, 'p_partkey')} * 8) AS INT) AS s, {drawn(1, 'p_partkey')} AS u FROM part WHERE p_size <= 100 AND p_size > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY u, p_partkey) AS k FROM i),
f AS (SELECT p_partkey, p_size, s, k, CAST(0 AS BIGINT) AS number, CAST(p_size AS BIGINT) AS used FROM o WHERE k = 1
  UNION ALL SELECT o.p_partkey, o.p_size, o.s, o.k, CASE WHEN used + o.p_size > 100 THEN number + 1 ELSE number END, CASE WHEN used + o.p_size > 100 THEN o.p_size ELSE used + o.p_size END FROM f JOIN o ON o.s = f.s AND o.k = f.k + 1)
SELECT p_partkey, p_size, s || '-' || number AS batch FROM f""")
def packed_batches(spark, d):
    return splits.pack_batches(table(spark, d, "part"), "p_partkey", "p_size", 100, shards=8)


@query(f"""WITH c AS (SELECT k, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v_points GROUP BY k), p AS (SELECT v.k, id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS d FROM v_points v JOIN c ON v.k = c.k),
r AS (SELECT *, min(d) OVER (PARTITION BY k) + 0.05 AS lo, max(d) OVER (PARTITION BY k) AS hi, {drawn(0, 'k')} AS u FROM p) SELECT k, id FROM r WHERE d < lo + u * greatest(hi - lo, 0)""")
def shell_subset(spark, d):
    p = view(spark, d, "v_points")
    return splits.shell_subset(p, p.groupBy("k").agg(*[F.avg(c).alias(c) for c in "xyz"]), ["k"], 0.05).select("k", "id")


_WATER = "w AS (SELECT c_nationkey::VARCHAR AS protein, c_custkey AS water_id, c_acctbal + 1001 AS bfactor, 1.0 + c_custkey % 3 AS occupancy FROM customer)"


@query(f"""WITH {_WATER}, m AS (SELECT *, coalesce((bfactor / avg(bfactor) OVER p) / (occupancy / avg(occupancy) OVER p) >= 2.0, false) AS bad FROM w WINDOW p AS (PARTITION BY protein)),
k AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY protein) * 2 > count(*) OVER (PARTITION BY protein) AS gone FROM m) SELECT protein, water_id FROM k WHERE protein = '7' OR (NOT bad AND NOT gone)""")
def mobile_waters(spark, d):
    return waters.mobility_filter(_waters(spark, d), 2.0, "7").select("protein", "water_id")


@query(f"""WITH {_WATER}, m AS (SELECT *, coalesce((bfactor - avg(bfactor) OVER p) / stddev_pop(bfactor) OVER p >= 1.0, false) AS bad FROM w WINDOW p AS (PARTITION BY protein)),
k AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY protein) * 2 > count(*) OVER (PARTITION BY protein) AS gone FROM m) SELECT protein, water_id FROM k WHERE NOT bad AND NOT gone""")
def bfactor_waters(spark, d):
    return waters.bfactor_filter(_waters(spark, d)).select("protein", "water_id")


def _waters(spark, d):
    return table(spark, d, "customer").selectExpr("cast(c_nationkey as string) protein", "c_custkey water_id", "c_acctbal + 1001 bfactor", "1.0D + c_custkey % 3 occupancy")


_CONSERVED = """w AS (SELECT CAST(id % 5 AS VARCHAR) AS protein, id AS water_id, concat_ws('/', CAST(id % 5 AS VARCHAR), id) AS wid, x, y, z FROM v_points)"""


@query(f"""WITH RECURSIVE {_CONSERVED}, l AS (SELECT a.wid AS a, b.wid AS b FROM w a JOIN w b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.02),
r AS (SELECT wid AS node, wid AS o FROM w UNION SELECT r.node, l.b FROM r JOIN l ON r.o = l.a), g AS (SELECT node AS wid, min(o) AS cluster FROM r GROUP BY node),
o AS (SELECT cluster, protein, min(water_id) AS water_id FROM w JOIN g ON w.wid = g.wid GROUP BY cluster, protein HAVING count(*) = 1),
s AS (SELECT cluster, count(*) AS n_proteins, max(water_id) FILTER (WHERE protein = '0') AS water_id FROM o GROUP BY cluster)
SELECT cluster, n_proteins, n_proteins / (SELECT count(DISTINCT protein) FROM w) AS conservation, water_id FROM s WHERE water_id IS NOT NULL AND n_proteins / (SELECT count(DISTINCT protein) FROM w) >= 0.2""")
def water_conservation_single(spark, d):
    w = view(spark, d, "v_points").select((F.col("id") % 5).cast("string").alias("protein"), F.col("id").alias("water_id"), "x", "y", "z")
    return waters.water_conservation(w, "0", 0.02, "single", probability=0.2).select("cluster", "n_proteins", "conservation", "water_id")


def _linked(measure: str, distance: float, probability: float) -> str:
    """Clusters that merge while each is the other's nearest, all at once in each step, from single waters and all pairs of them."""
    return f"""WITH RECURSIVE {_CONSERVED},
st AS (SELECT 0 AS step, wid, wid AS c, x, y, z FROM w
  UNION ALL (
  WITH p AS (SELECT a.c AS l, b.c AS g, {measure}(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d
    FROM st a JOIN st b ON a.c < b.c GROUP BY ALL HAVING d <= {distance}),
  best AS (SELECT c, min({{{{'d': d, 'l': l, 'g': g}}}}) AS m FROM (SELECT l AS c, d, l, g FROM p UNION ALL SELECT g, d, l, g FROM p) GROUP BY c),
  merged AS (SELECT m.l AS l, m.g AS g FROM best GROUP BY m HAVING count(*) = 2)
  SELECT step + 1, wid, coalesce(l, c), x, y, z FROM st LEFT JOIN merged ON c = g WHERE (SELECT count(*) FROM merged) > 0)),
g AS (SELECT wid, c AS cluster FROM st WHERE step = (SELECT max(step) FROM st)),
o AS (SELECT cluster, protein, min(water_id) AS water_id FROM w JOIN g USING (wid) GROUP BY cluster, protein HAVING count(*) = 1),
s AS (SELECT cluster, count(*) AS n_proteins, max(water_id) FILTER (WHERE protein = '0') AS water_id FROM o GROUP BY cluster)
SELECT cluster, n_proteins, n_proteins / (SELECT count(DISTINCT protein) FROM w) AS conservation, water_id FROM s
WHERE water_id IS NOT NULL AND n_proteins / (SELECT count(DISTINCT protein) FROM w) >= {probability}""".replace("{{", "{").replace("}}", "}")


def _site_waters(spark, d):
    return view(spark, d, "v_points").select((F.col("id") % 5).cast("string").alias("protein"), F.col("id").alias("water_id"), "x", "y", "z")


@query(_linked("max", 0.04, 0.4))
def water_conservation(spark, d):
    return waters.water_conservation(_site_waters(spark, d), "0", 0.04, probability=0.4).select("cluster", "n_proteins", "conservation", "water_id")


@query(_linked("avg", 0.04, 0.4))
def water_conservation_average(spark, d):
    return waters.water_conservation(_site_waters(spark, d), "0", 0.04, "average", 0.4).select("cluster", "n_proteins", "conservation", "water_id")


@query("SELECT c_custkey AS ligand, (1 + c_custkey % 9) * 12.011::DOUBLE + (c_custkey % 4 + 1) * 1.008::DOUBLE + 15.999::DOUBLE AS mass, CAST(1 + c_custkey % 9 + c_custkey % 4 + 1 + 1 AS BIGINT) AS n_atoms, CAST(1 + c_custkey % 9 + 1 AS BIGINT) AS n_heavy FROM customer")
def formula_features(spark, d):
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("ligand"), F.concat(F.lit("C"), (1 + F.col("c_custkey") % 9).cast("string"), F.lit("H"), (F.col("c_custkey") % 4 + 1).cast("string"), F.lit("O")).alias("formula"))
    return residues.formula_features(f).select("ligand", "mass", F.col("n_atoms").cast("long").alias("n_atoms"), F.col("n_heavy").cast("long").alias("n_heavy"))


@query("SELECT p_partkey AS ligand, CASE WHEN p_partkey % 10 = 0 THEN 'special' WHEN p_size < 8 THEN 'atoms' WHEN p_retailprice > 1500 AND p_size % 5 > 0 THEN 'mass' END AS reason FROM part")
def filtered_ligands(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ligand"), F.col("p_size").alias("n_heavy"), F.when(F.col("p_size") % 5 > 0, F.col("p_retailprice")).alias("mass_number"), F.when(F.col("p_partkey") % 10 == 0, "HOH").otherwise("LIG").alias("name"))
    return residues.filter_ligands(p, ["HOH"], (8, 1e9), (0, 1500), name="name").select("ligand", "reason")


@query(f"SELECT user_id, string_agg(CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'G' WHEN 2 THEN 'H' ELSE 'W' END, '' ORDER BY event_id) AS sequence FROM events WHERE event_id % 5 <> 3 GROUP BY user_id")
def sequences(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("ALA", "GLY", "HID", "SEC", "TRP")]), (F.col("event_id") % 5 + 1).cast("int"))
    return residues.to_sequence(table(spark, d, "events").select("user_id", "event_id", name.alias("resname")), ["user_id"], "event_id").drop("n")


@query("""WITH c AS (SELECT l_orderkey, l_suppkey, CASE l_suppkey % 2 WHEN 0 THEN 'GLY' ELSE 'ALA' END AS resname, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_suppkey, n AS n_atoms, CASE WHEN resname = 'GLY' THEN CASE WHEN n >= 4 THEN 'g' ELSE 'G' END ELSE CASE WHEN n >= 5 THEN 'a' ELSE 'A' END END AS letter FROM c""")
def missing_atoms(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_suppkey") % 2 == 0, "GLY").otherwise("ALA").alias("resname"), F.lit("C").alias("element"))
    return residues.missing_atoms(a, ["l_orderkey"], ["l_suppkey"]).select("l_orderkey", "l_suppkey", "n_atoms", "letter")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'R') WHERE k = 1")
def first_ligand(spark, d):
    return ranks.first_ligand(table(spark, d, "lineitem"), ["l_orderkey"], "R", chain="l_linenumber", name="l_returnflag").select("l_orderkey", "l_partkey", "l_linenumber")


@query("""WITH b AS (SELECT s_suppkey, s_suppkey % 4 AS p, s_nationkey % 3 AS c, sum((s_suppkey % 4) * (s_nationkey % 3)) OVER (ORDER BY s_suppkey) AS stop FROM supplier), v AS (SELECT o_orderkey AS position, o_totalprice AS value FROM orders)
SELECT s_suppkey, CAST((position - (stop - p * c)) // c AS BIGINT) AS i, CAST((position - (stop - p * c)) % c AS BIGINT) AS j, value FROM b JOIN v ON position >= stop - p * c AND position < stop""")
def sliced_vector(spark, d):
    b = table(spark, d, "supplier").selectExpr("s_suppkey", "cast(s_suppkey % 4 as long) p", "cast(s_nationkey % 3 as long) c")
    return ranks.slice_flat(b, table(spark, d, "orders").selectExpr("o_orderkey as position", "o_totalprice as value"), "s_suppkey")


@query("SELECT target, code, score * 2 + 1 AS affinity FROM v_core")
def batch_scored(spark, d):
    return batch.batch_score(view(spark, d, "v_core"), lambda: lambda frame: frame["score"] * 2 + 1).select("target", "code", "affinity")


@query("SELECT k, count(*) AS n, max(x) - min(x) AS width FROM v_points GROUP BY k")
def mapped_complexes(spark, d):
    import pandas as pd

    fn = lambda f: pd.DataFrame([{"k": f["k"].iloc[0], "n": len(f), "width": f["x"].max() - f["x"].min()}])
    return batch.map_complexes(view(spark, d, "v_points"), ["k"], fn, "k int, n long, width double").select("k", "n", "width")


@query("SELECT k, count(*) AS n, max(x) - min(x) AS width FROM v_points GROUP BY k")
def streamed_complexes(spark, d):
    """A batch at a time; the k of a complex comes with its rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def widths(batches):
        k, n, low, high = None, 0, float("inf"), float("-inf")
        for b in batches:
            k, n = b.column("k")[0].as_py(), n + b.num_rows
            low, high = min(low, pc.min(b.column("x")).as_py()), max(high, pc.max(b.column("x")).as_py())
        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "n": pa.array([n], pa.int64()), "width": [high - low]})

    found = batch.stream_complexes(view(spark, d, "v_points"), ["k"], widths, "k int, n long, width double")
    return batch.settled(found, ["k"])[0]
