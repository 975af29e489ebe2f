"""Round trips of the formats: files made of the given tables by Spark, read by the readers, against SQL over the tables. A2-A6, A9-A12, A14, A15, A18-A21, C6, E10, J5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batch, joins
from ..sources import files, formats, text
from ..tables import Scratch
from .registry import Registry
from .views import table

REGISTRY = query = Registry()

#: A group's file is grp=<name>.txt.
GROUP = r"/grp=([^/]+)\.txt$"


def _grouped_files(spark, rows: DataFrame, name: str, order: list[str], ending: str = ".txt") -> str:
    """Writes a text file per grp, its lines (value) in order; the folder's path."""
    path = Scratch(spark, "files").path(name)
    files.write_named(rows, path, "grp", order, ending=ending)
    return path


def _group() -> F.Column:
    return F.regexp_extract("path", GROUP, 1).alias("grp")


#: Atoms of the embeddings, with coordinates of three places, in SQL of both engines but for the place of the first array element.
_ATOM = """SELECT concat('s', lpad(CAST(label AS VARCHAR(9)), 3, '0'), 'q') AS grp, 1 + vec_id % 2 AS model, vec_id % 4 AS c, vec_id % 40 AS residue, vec_id % 100000 AS aid, vec_id,
CASE WHEN vec_id % 11 = 0 THEN 'H' WHEN vec_id % 3 = 0 THEN 'CA' WHEN vec_id % 3 = 1 THEN 'N' ELSE 'O' END AS atom_name, CASE WHEN vec_id % 11 = 0 THEN 'H' WHEN vec_id % 3 = 0 THEN 'C' WHEN vec_id % 3 = 1 THEN 'N' ELSE 'O' END AS element,
CASE WHEN vec_id % 5 = 0 THEN 'GLY' ELSE 'TRP' END AS resname, floor(CAST(embedding[{0}] AS DOUBLE) * 1000) / 1000 AS x, floor(CAST(embedding[{1}] AS DOUBLE) * 1000) / 1000 AS y, floor(CAST(embedding[{2}] AS DOUBLE) * 1000) / 1000 AS z"""
_ATOMS = f"a AS ({_ATOM.format(1, 2, 3)} FROM embeddings)"


def _atoms(spark, d) -> DataFrame:
    return spark.sql(_ATOM.format(0, 1, 2).replace("VARCHAR(9)", "STRING") + " FROM {e}", e=table(spark, d, "embeddings"))


def _pdb_line(record: str, chain) -> F.Column:
    places = "%-6s%5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s"
    return F.format_string(places, F.lit(record), "aid", "atom_name", "resname", chain, "residue", "x", "y", "z", F.lit(1.0), F.col("residue") + 0.5, "element")


@query(f"""WITH {_ATOMS}, r AS (SELECT grp AS pdb_name, CAST(model AS VARCHAR) AS model, CASE c WHEN 0 THEN 'Q' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS chain, CAST(residue AS VARCHAR) AS residue, resname, x, y, z, element, atom_name, CAST(aid AS VARCHAR) AS aid FROM a WHERE element <> 'H')
SELECT pdb_name, model, chain, residue, resname, x, y, z, element, atom_name, aid FROM (SELECT *, bool_or(atom_name = 'CA') OVER (PARTITION BY pdb_name, model, chain, residue) AS ca FROM r) WHERE ca""")
def pdb_atoms(spark, d):
    return text.read_pdb_atoms(spark, _pdb(spark, d), GROUP)


def _pdb(spark, d) -> str:
    atoms = _atoms(spark, d)
    lines = atoms.select("grp", "model", "vec_id", _pdb_line("ATOM", F.get(F.array(*[F.lit(x) for x in (" ", "A", "B", "C")]), F.col("c").cast("int"))).alias("value"))
    heads = atoms.select("grp", "model").distinct().select("grp", "model", F.lit(-1).cast("long").alias("vec_id"), F.format_string("MODEL     %4d", "model").alias("value"))
    return _grouped_files(spark, lines.unionByName(heads), "pdb", ["model", "vec_id"])


@query(REGISTRY.sql["pdb_atoms"])
def pdb_atoms_by_source(spark, d):
    """The same files in ranges of 4 kB that begin at MODEL lines."""
    return formats.load_pdb_atoms(spark, _pdb(spark, d), GROUP, 4096)


@query(f"""WITH {_ATOMS} SELECT grp AS pdb_name, '0' AS model, x, y, z, element, atom_name, CAST(aid AS VARCHAR) AS aid, CASE WHEN x IS NULL THEN 'bad coordinates' END AS error
FROM (SELECT grp, CASE WHEN vec_id % 17 > 0 THEN x END AS x, y, z, element, atom_name, aid FROM a WHERE grp <> 's003q') UNION ALL SELECT 's003q', '0', NULL, NULL, NULL, NULL, NULL, NULL, 'no ATOM block' FROM (SELECT 1 FROM a WHERE grp = 's003q' LIMIT 1)""")
def mol2_atoms(spark, d):
    return text.read_mol2_atoms(spark, _mol2(spark, d), GROUP)


@query(REGISTRY.sql["mol2_atoms"])
def mol2_atoms_by_source(spark, d):
    formats.register(spark)
    return spark.read.format("mol2").option("name", GROUP).load(_mol2(spark, d)).drop("molecule")


def _mol2(spark, d) -> str:
    atoms = _atoms(spark, d)
    x = F.when(F.col("vec_id") % 17 > 0, F.format_string("%.3f", "x")).otherwise("?")
    lines = atoms.where("grp <> 's003q'").select("grp", "vec_id", F.format_string("%7d %-4s %s %.3f %.3f %s.3 1 LIG 0.0", "aid", "atom_name", x, "y", "z", "element").alias("value"))
    heads = atoms.select("grp").distinct().select("grp", F.posexplode(F.when(F.col("grp") == "s003q", F.array(F.lit("@<TRIPOS>MOLECULE"))).otherwise(F.array(F.lit("@<TRIPOS>MOLECULE"), F.lit("@<TRIPOS>ATOM")))).alias("k", "value"))
    tail = atoms.select("grp").distinct().select("grp", F.lit(1 << 60).alias("vec_id"), F.lit("@<TRIPOS>BOND").alias("value"))
    return _grouped_files(spark, lines.unionByName(heads.select("grp", (F.col("k") - 2).cast("long").alias("vec_id"), "value")).unionByName(tail), "mol2", ["vec_id"])


@query(f"""WITH {_ATOMS} SELECT grp AS pdb_name, count(*) FILTER (WHERE grp <> 's003q' AND vec_id % 17 > 0) AS good, count(*) FILTER (WHERE grp <> 's003q' AND vec_id % 17 = 0) + max(CASE WHEN grp = 's003q' THEN 1 ELSE 0 END) AS failed FROM a GROUP BY grp""")
def quarantined_atoms(spark, d):
    good, failed = batch.quarantine(text.read_mol2_atoms(spark, _mol2(spark, d), GROUP))
    counted = lambda df, name: df.groupBy("pdb_name").agg(F.count("*").alias(name))
    return counted(good, "good").join(counted(failed, "failed"), "pdb_name", "full").na.fill(0, ["good", "failed"])


@query(f"WITH {_ATOMS} SELECT grp AS protein, CAST(residue AS VARCHAR) AS water_id, x, y, z, CAST(1 AS DOUBLE) AS occupancy, CAST(residue + 0.5 AS DOUBLE) AS bfactor FROM a WHERE vec_id % 2 = 0")
def water_atoms(spark, d):
    odd = F.col("vec_id") % 2 == 1
    rows = _atoms(spark, d).withColumns({"resname": F.when(odd, "LIG").otherwise("HOH"), "atom_name": F.lit("O"), "element": F.lit("O")})
    return text.read_waters(spark, _grouped_files(spark, rows.select("grp", "vec_id", _pdb_line("HETATM", F.lit("W")).alias("value")), "waters", ["vec_id"]), GROUP)


@query("SELECT CAST(l_suppkey AS VARCHAR) AS complex, concat(l_orderkey, ' ', l_linenumber) AS code, CAST(l_quantity AS DOUBLE) AS score FROM lineitem")
def score_files(spark, d):
    code = F.concat_ws("%20", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("grp"), "l_orderkey", F.concat_ws("\t", code, F.col("l_quantity").cast("string")).alias("value"))
    heads = rows.select("grp").distinct().select("grp", F.lit(-1).cast("long").alias("l_orderkey"), F.lit("#code score").alias("value"))
    path = _grouped_files(spark, rows.unionByName(heads), "scores", ["l_orderkey"], "_score.dat")
    return text.read_score_dir(spark, path, "score", "score", name=r"/grp=([^/]+)_score\.dat$")


@query("""SELECT target, CAST(k AS INT) AS rank, ligand FROM (SELECT 't' || l_suppkey AS target, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k, CAST(l_partkey AS VARCHAR) AS ligand FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE k <= 10""")
def target_info(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.slice(F.sort_array(F.collect_set("l_partkey")), 1, 10).alias("l"))
    rows = wide.select((F.col("l_suppkey") % 5).cast("string").alias("grp"), F.col("l_suppkey").cast("long").alias("k"), F.concat_ws(" ", F.concat(F.lit("t"), F.col("l_suppkey").cast("string")), F.array_join("l", " ")).alias("value"))
    heads = rows.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(-8).cast("long"), F.lit(-1).cast("long"))).alias("k"), F.lit("a line of the head").alias("value"))
    return text.read_target_info(spark, _grouped_files(spark, rows.unionByName(heads), "targets", ["k"]))


@query("""SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS pdb, o_orderkey % 300 / 100 AS resolution, CAST(1990 + o_orderkey % 30 AS INT) AS year, CASE WHEN o_orderkey % 13 > 0 THEN o_custkey % 1200 / 100 END AS affinity, 'Ki=' || o_custkey || 'nM' AS raw, 'L' || (o_orderkey % 999) AS ligand
FROM orders WHERE o_orderkey % 10 > 0""")
def affinity_index(spark, d):
    path = Scratch(spark, "files").path("index")
    o = table(spark, d, "orders")
    s = lambda c: c.cast("string")
    value = F.concat_ws("  ", F.lpad(s(F.col("o_orderkey")), 8, "0"), s(F.col("o_orderkey") % 300 / 100), s(1990 + F.col("o_orderkey") % 30), F.when(F.col("o_orderkey") % 13 > 0, s(F.col("o_custkey") % 1200 / 100)).otherwise("none"), F.concat(F.lit("Ki="), s(F.col("o_custkey")), F.lit("nM")), F.concat(F.lit("// 1abc.pdf (L"), s(F.col("o_orderkey") % 999), F.lit(") and more")))
    o.select(F.when(F.col("o_orderkey") % 10 > 0, value).otherwise(F.concat(F.lit("# "), value)).alias("value")).write.text(path)
    return text.read_affinity_index(spark, path)


#: Positions of suppliers in the profile of their nation.
_PLACED = "s AS (SELECT s_nationkey AS n, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position FROM supplier)"


def _profile_rows(spark, d, value: F.Column) -> DataFrame:
    """(grp, k, value) of suppliers as lines of their nation's file; k leaves room before and after."""
    return table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("grp"), (F.col("s_suppkey") * 2).cast("double").alias("k"), value.alias("value"))


def _numbers(count: int, base: int, what) -> F.Column:
    return F.array_join(F.transform(F.sequence(F.lit(base), F.lit(base + count - 1)), what), " ")


def _with_ends(rows: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    ends = [(-float(len(before) - k), x) for k, x in enumerate(before)] + [(1e18 + k * 1e6, x) for k, x in enumerate(after)]
    lines = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("value")) for k, x in ends])).alias("e")
    return rows.unionByName(rows.select("grp").distinct().select("grp", lines).select("grp", "e.k", "e.value"))


@query(f"""WITH {_PLACED}, e AS (SELECT CAST(n AS VARCHAR) AS grp, CAST(position AS BIGINT) AS position, CASE WHEN s % 2 = 0 THEN 'A' ELSE 'W' END AS residue, kind, k, CASE WHEN (s * (k + 1)) % 7 = 0 THEN 0.0 ELSE pow(2.0, -((s * (k + 1)) % 5000) / 1000.0) END AS p
FROM s, (SELECT 'emission' AS kind, unnest(range(20)) AS k UNION ALL SELECT 'transition', unnest(range(20, 30)))) SELECT grp, position, residue, kind, CASE WHEN kind = 'emission' THEN k ELSE k - 20 END AS k, p FROM e""")
def profile_hmm(spark, d):
    token = lambda k: F.when(F.col("s_suppkey") * (k + 1) % 7 == 0, "*").otherwise((F.col("s_suppkey") * (k + 1) % 5000).cast("string"))
    residue = F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("W")
    first = _profile_rows(spark, d, F.concat_ws(" ", residue, F.col("s_suppkey").cast("string"), _numbers(20, 0, token), F.lit("7")))
    second = _profile_rows(spark, d, F.concat(F.lit("   "), _numbers(10, 20, token))).withColumn("k", F.col("k") + 1)
    rows = _with_ends(first.unionByName(second), ["NAME x", "# a remark", "#", *["a line of the head"] * 5], ["", "//"])
    # The two lines of the tail: an empty one and the mark.
    p = text.read_profile_hmm(spark, _grouped_files(spark, rows, "hmm", ["k"])).select(_group(), F.col("position").cast("long").alias("position"), "residue", "emissions", "transitions")
    part = lambda c, kind: p.select("grp", "position", "residue", F.lit(kind).alias("kind"), F.posexplode(c).alias("k", "p"))
    return part("emissions", "emission").unionByName(part("transitions", "transition")).withColumn("k", F.col("k").cast("long"))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS grp, CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE 'A' END AS chain, CAST(s_suppkey AS VARCHAR) AS residue, s_suppkey % 100 / 4 AS avg_cx, s_suppkey % 99 / 4 AS s_avg_cx, s_suppkey % 98 / 4 AS s_ch_avg_cx, s_suppkey % 97 / 4 AS s_ch_s_avg_cx,
s_suppkey % 96 / 4 AS max_cx, s_suppkey % 95 / 4 AS min_cx FROM supplier""")
def protrusion_tables(spark, d):
    chain = F.when(F.col("s_suppkey") % 3 == 0, "*").otherwise("A")
    values = _numbers(6, 0, lambda k: (F.col("s_suppkey") % (100 - k) / 4).cast("string"))
    rows = _with_ends(_profile_rows(spark, d, F.concat_ws("   ", chain, F.col("s_suppkey").cast("string"), F.lit("TRP"), values)), ["name of the structure", "", "chain  residue  name  values"], [])
    found = text.read_protrusion_tbl(spark, _grouped_files(spark, rows, "tbl", ["k"]))
    return found.select(_group(), "chain", "residue", *text.PROTRUSION)


def _pssm(spark, d) -> DataFrame:
    residue = F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("W")
    score, share = lambda k: (F.col("s_suppkey") * k % 19 - 9).cast("string"), lambda k: (F.col("s_suppkey") * k % 101).cast("string")
    value = F.concat_ws(" ", F.col("s_suppkey").cast("string"), residue, _numbers(20, 1, score), _numbers(20, 1, share), F.lit("0.5 0.6"))
    rows = _with_ends(_profile_rows(spark, d, value), ["", "a line of the head"], ["", "a", "b", "c", "d", "e"])
    return text.read_pssm(spark, _grouped_files(spark, rows, "pssm", ["k"]))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS grp, CAST(s_suppkey AS INT) AS position, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'W' END AS residue, k, CAST(s_suppkey * (k + 1) % 19 - 9 AS DOUBLE) AS pssm, s_suppkey * (k + 1) % 101 / 100 AS share,
CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS al2co FROM supplier, (SELECT unnest(range(20)) AS k)""")
def pssm_with_conservation(spark, d):
    pssm = _pssm(spark, d)
    place = table(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_nationkey").cast("string").alias("grp"), F.col("s_suppkey").cast("int").alias("position"), F.col("s_acctbal").alias("al2co"))
    al2co = pssm.select("path", _group()).distinct().join(place, "grp").drop("grp")
    both = text.attach_al2co(pssm, al2co)
    long = both.select(_group(), "position", "residue", "al2co", F.posexplode(F.arrays_zip("pssm", "counts")).alias("k", "v"))
    return long.select("grp", "position", "residue", F.col("k").cast("long").alias("k"), "v.pssm", F.col("v.counts").alias("share"), "al2co")


@query(f"""WITH {_ATOMS} SELECT a.grp AS pdb_name, a.aid, s.s_acctbal AS score FROM a JOIN supplier s ON s.s_nationkey = a.residue AND s.s_suppkey % 4 = a.c""")
def conservation_joined(spark, d):
    atoms = _atoms(spark, d).select("model", F.col("grp").alias("pdb_name"), F.col("c").cast("string").alias("chain"), F.col("residue").cast("string").alias("residue"), "aid")
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 4).cast("string").alias("chain"), F.col("s_nationkey").cast("string").alias("residue"), F.col("s_acctbal").alias("score"))
    profiles = atoms.select("model", "pdb_name").distinct().join(s, F.lit(True))
    return joins.join_conservation(atoms, profiles).select("pdb_name", "aid", "score")


@query(f"""WITH {_ATOMS}, p AS (SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY vec_id) - 1 AS INT) AS position, string_agg(left(resname, 1), '') OVER (PARTITION BY grp ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS seq, vec_id, x, y, z FROM a)
SELECT grp AS name, seq, position, x AS n_x, CASE WHEN vec_id % 13 > 0 THEN y END AS ca_y, z + 1 AS c_z, x + y AS o_x FROM p""")
def structures_json(spark, d):
    path = Scratch(spark, "files").path("structures")
    a = _atoms(spark, d)
    point = lambda x, y, z: F.array(x, y, z)
    x, y, z = (F.col(c) for c in "xyz")
    row = F.struct("vec_id", F.substring("resname", 1, 1).alias("l"), point(x, y, z).alias("N"), F.when(F.col("vec_id") % 13 > 0, point(x, y, z)).otherwise(F.array(x, y)).alias("CA"), point(x, y, z + 1).alias("C"), point(x + y, y, z).alias("O"))
    whole = a.groupBy(F.col("grp").alias("name")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    part = lambda c: F.transform("r", lambda v: v[c]).alias(c)
    whole.select("name", F.array_join(part("l"), "").alias("seq"), F.struct(*[part(c) for c in ("N", "CA", "C", "O")]).alias("coords")).write.json(path)
    s = files.read_structures_json(spark, path)
    return s.select("name", "seq", "position", F.col("n.x").alias("n_x"), F.col("ca.y").alias("ca_y"), F.col("c.z").alias("c_z"), F.col("o.x").alias("o_x"))


@query("""SELECT 'x' || o_orderkey AS pdb, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey / 100 END AS resolution, CAST(CASE WHEN o_orderkey % 5 = 1 THEN 0.1 WHEN o_orderkey % 5 = 2 THEN 0.2 WHEN o_orderkey % 5 = 3 THEN 0.3 END AS DOUBLE) AS r_factor,
CASE WHEN o_orderkey % 2 = 0 THEN '1.2.' || (o_custkey % 9) || '.4' END AS ec, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS release_date FROM orders""")
def entry_attributes(spark, d):
    path = Scratch(spark, "files").path("entries")
    o, number = table(spark, d, "orders"), F.col("o_orderkey")
    r = lambda k, v: F.when(number % 5 == k, F.lit(v)).alias(("", "ls_R_factor_R_free", "ls_R_factor_obs", "ls_R_factor_R_work")[k])
    told = F.when(number % 2 == 0, F.concat(F.lit("HYDROLASE (E.C.1.2."), (F.col("o_custkey") % 9).cast("string"), F.lit(".4)"))).otherwise("UNKNOWN")
    entry = F.struct(
        F.concat(F.lit("x"), number.cast("string")).alias("rcsb_id"), F.struct(F.when(number % 3 > 0, F.col("o_custkey") / 100).alias("PDB_resolution")).alias("pdbx_vrpt_summary"), F.when(number % 5 > 0, F.array(F.struct(r(1, 0.1), r(2, 0.2), r(3, 0.3)))).alias("refine"),
        F.struct(told.alias("pdbx_descriptor")).alias("struct"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("initial_release_date")).alias("rcsb_accession_info"),
    )
    # A file holds the entries of some orders as one document.
    o.groupBy((number % 50).alias("k")).agg(F.to_json(F.collect_list(entry)).alias("value")).repartition(8, "k").select("value").write.option("lineSep", "\n").text(path)
    whole = spark.read.schema(files.ENTRY_SCHEMA).json(path)
    return files.entry_attributes(whole).withColumn("release_date", F.col("release_date").cast("string"))


@query("SELECT 'p' || p_partkey AS compound_name, p_name || '(=O)' AS smiles FROM part WHERE p_size % 10 > 0")
def compound_files(spark, d):
    path = Scratch(spark, "files").path("compounds")
    smiles = F.when(F.col("p_size") % 10 > 0, F.concat("p_name", F.lit("(=O)")))
    table(spark, d, "part").select(smiles.alias("smiles"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("compound_name")).write.option("header", True).csv(path)
    return files.read_compounds(spark, path)


@query("SELECT CAST(s_nationkey AS VARCHAR) AS grp, s_name AS value FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)) WHERE k > 1 AND k < n")
def middle_lines(spark, d):
    path = _grouped_files(spark, _profile_rows(spark, d, F.col("s_name")), "lines", ["k"])
    return text.whole_lines(spark, path, 1, 1).select(_group(), "value")


@query("SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS grp FROM supplier")
def discovered_files(spark, d):
    path = _grouped_files(spark, _profile_rows(spark, d, F.col("s_name")), "lines", ["k"])
    return files.discover(spark, path, r"/grp=[^/]*\.txt$").where("length > 0 and modified is not null").select(_group())


@query("SELECT '>' || c_name || '-0-A' AS value FROM customer UNION ALL SELECT upper(c_mktsegment) FROM customer")
def written_fasta(spark, d):
    path = Scratch(spark, "files").path("fasta")
    files.write_fasta(table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit(0).alias("model"), F.lit("A").alias("chain"), F.upper("c_mktsegment").alias("sequence")), path)
    return spark.read.text(path)


@query("""WITH k AS (SELECT 'c' || o_custkey || chr(9) || string_agg(CAST(o_orderkey AS VARCHAR), chr(9) ORDER BY o_orderkey) AS value FROM orders GROUP BY o_custkey) SELECT value, count(*) AS n FROM (SELECT value FROM k UNION ALL SELECT s_name FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) WHERE r > 1) GROUP BY value""")
def combined_files(spark, d):
    scratch = Scratch(spark, "files")
    keyed = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("orders"))
    files.write_key_values(keyed.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), "orders"), scratch.path("keys"), "key", "orders")
    names = _grouped_files(spark, _profile_rows(spark, d, F.col("s_name")), "names", ["k"])
    files.combine_files(spark, [names], scratch.path("tails"), skip=1)
    files.combine_files(spark, [scratch.path("keys"), scratch.path("tails")], scratch.path("all"))
    return spark.read.text(scratch.path("all")).groupBy("value").agg(F.count("*").alias("n"))


@query(f"""WITH {_ATOMS}, dry AS (SELECT *, vec_id % 7 < 3 AS hetero FROM a WHERE vec_id % 10 > 0) SELECT 'complex' AS part, grp, vec_id FROM dry UNION ALL SELECT CASE WHEN hetero THEN 'ligand' ELSE 'protein' END, grp, vec_id FROM dry
UNION ALL SELECT 'pocket', grp, vec_id FROM dry WHERE NOT hetero AND residue < 10 AND c = 1""")
def written_parts(spark, d):
    path = Scratch(spark, "files").path("parts")
    a = _atoms(spark, d).withColumns({"chain": F.col("c"), "hetero": F.col("vec_id") % 7 < 3, "resname": F.when(F.col("vec_id") % 10 == 0, "HOH").otherwise("ALA")})
    pocket = a.where("residue < 10 and c = 1").select("grp", "chain", "residue")
    files.write_complex_parts(files.complex_parts(a.select("grp", "chain", "residue", "resname", "hetero", "vec_id"), pocket, ["grp"]), path)
    return spark.read.parquet(path).select(F.col("part").cast("string").alias("part"), "grp", "vec_id")
