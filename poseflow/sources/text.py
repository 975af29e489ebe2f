"""Text files of scores, lists, profiles and atoms as typed tables.

Lines that do not fit are dropped where the format has headers or remarks; numbers are cast leniently to null. `path` columns are
the files' names. Only formats whose lines need their neighbours are read whole, file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def whole_lines(spark: SparkSession, path: str, skip: int = 0, skip_end: int = 0) -> DataFrame:
    """(path, line, value): numbered lines from 0 of small files read whole, without the first and last so many."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("l"))
    lines = files.select("path", F.size("l").alias("n"), F.posexplode("l").alias("line", "value"))
    return lines.where((F.col("line") >= skip) & (F.col("line") < F.col("n") - skip_end)).drop("n")


def fields(value: Column, separators: str = r"[,\t ]+") -> Column:
    return F.split(F.trim(value), separators)


def read_delimited(spark: SparkSession, path: str, columns: dict[str, str], skip: int = 0, separators: str = r"[,\t ]+", nested: bool = False, names: str = "*") -> DataFrame:
    """Columns by position with the given types, and path; lines that start with # and blank ones are headers (A1). With skip,
    the first so many lines of each file go. nested: the files of all folders below too, which tasks list side by side. names: a glob
    of the names of the folder's files to read, which lists the folder once."""
    if skip:
        lines = whole_lines(spark, path, skip)
    else:
        lines = spark.read.option("recursiveFileLookup", nested).option("pathGlobFilter", names).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = lines.where("trim(value) <> '' and not startswith(value, '#')")
    parts = fields(F.col("value"), separators)
    return lines.select(*[F.get(parts, k).try_cast(t).alias(c) for k, (c, t) in enumerate(columns.items())], "path")


def read_score_dir(spark: SparkSession, path: str, suffix: str, value: str, files: str | None = None, name: str | None = None) -> DataFrame:
    """(complex, code, value) of a directory of <complex>_<suffix>.dat files (A2), or of those that the glob `files` gives; the complex is the first
    group of `name` in the path, if given. files **: all files of the folder and of those below. Other globs are listed path by path by the driver."""
    columns, root = {"code": "string", value: "double"}, path.rstrip("/")
    if files in (None, "**"):
        df = read_delimited(spark, root, columns, nested=files == "**", names="*" if files else f"*_{suffix}.dat")
    else:
        df = read_delimited(spark, f"{root}/{files}", columns)
    return df.select(F.regexp_extract("path", name or rf"([^/]+)_{suffix}\.dat$", 1).alias("complex"), F.regexp_replace("code", "%20", " ").alias("code"), value)


def read_target_info(spark: SparkSession, path: str, ligands: int = 10, skip: int = 8) -> DataFrame:
    """(target, rank, ligand) from wide lines `target L1 L2 ...` after `skip` lines (A1)."""
    wide = read_delimited(spark, path, {"target": "string", **{f"l{k}": "string" for k in range(1, ligands + 1)}}, skip)
    long = wide.select("target", F.posexplode(F.array(*[f"l{k}" for k in range(1, ligands + 1)])).alias("rank", "ligand"))
    return long.where("ligand is not null").withColumn("rank", F.col("rank") + 1)


def _cut(start: int, end: int) -> Column:
    """Columns of a fixed-width line, numbered from 1."""
    return F.trim(F.substring("value", start, end - start + 1))


#: The file's name, without .gz, as a structure's name; another pattern can name a structure by its folder.
FILE_NAME = r"([^/]+?)(\.gz)?$"


def read_pdb_atoms(spark: SparkSession, path: str, name: str = FILE_NAME) -> DataFrame:
    """pdb_name, model, chain, residue, resname, x, y, z, element, atom_name, aid of the ATOM lines of PDB files, plain or gzip (A3).

    Hydrogens (lines that end in H) and residues without a CA go. A blank chain is the file name's 5th character in upper case. Models
    count from the MODEL lines before an atom, 0 without any, so a file is read whole.
    """
    lines = whole_lines(spark, path)
    name = F.regexp_extract("path", name, 1)
    model = F.last(F.when(F.col("value").startswith("MODEL "), F.trim(F.substring("value", 7, 10))), ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    rows = lines.where("startswith(value, 'ATOM') or startswith(value, 'MODEL ')").withColumn("model", F.coalesce(model, F.lit("0")))
    rows = rows.where("startswith(value, 'ATOM') and not endswith(rtrim(value), 'H')")
    chain = F.coalesce(F.nullif(_cut(22, 22), F.lit("")), F.upper(F.substring(name, 5, 1)))
    number = lambda a, b: _cut(a, b).try_cast("double")
    atoms = rows.select(name.alias("pdb_name"), "model", chain.alias("chain"), _cut(23, 27).alias("residue"), _cut(18, 20).alias("resname"), number(31, 38).alias("x"), number(39, 46).alias("y"), number(47, 54).alias("z"), F.coalesce(F.nullif(_cut(77, 78), F.lit("")), F.regexp_extract(_cut(13, 16), "[A-Z]", 0)).alias("element"), _cut(13, 16).alias("atom_name"), _cut(7, 11).alias("aid"))
    return with_ca(atoms)


def with_ca(atoms: DataFrame) -> DataFrame:
    """Atoms with coordinates, of residues with a CA."""
    ca = F.bool_or(F.col("atom_name") == "CA").over(Window.partitionBy("pdb_name", "model", "chain", "residue"))
    return atoms.withColumn("__ca", ca).where("__ca and x is not null and y is not null and z is not null").drop("__ca")


def read_mol2_atoms(spark: SparkSession, path: str, name: str = r"([^/]+)$") -> DataFrame:
    """pdb_name, model, x, y, z, element, atom_name, aid, error: the ATOM blocks of mol2 files; a file without one is a row with an error
    alone (A4, J5)."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("pdb_name"), F.regexp_extract("value", r"@<TRIPOS>ATOM\r?\n([^@]*)", 1).alias("block"))
    lines = files.select("pdb_name", F.explode(F.split("block", r"\r?\n")).alias("value"), (F.col("block") == "").alias("bad"))
    p = fields(F.col("value"), r"\s+")
    number = lambda k: F.get(p, k).try_cast("double")
    atoms = lines.where("bad or trim(value) <> ''").select("pdb_name", F.lit("0").alias("model"), number(2).alias("x"), number(3).alias("y"), number(4).alias("z"), F.element_at(F.split(F.get(p, 5), r"\."), 1).alias("element"), F.get(p, 1).alias("atom_name"), F.nullif(F.get(p, 0), F.lit("")).alias("aid"), "bad")
    return atoms.withColumn("error", F.when(F.col("bad"), "no ATOM block").when(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull(), "bad coordinates")).drop("bad")


def read_affinity_index(spark: SparkSession, path: str) -> DataFrame:
    """(pdb, resolution, year, affinity, raw, ligand) of lines `pdb  resolution  year  affinity  raw // ref (ligand)`."""
    pattern = r"^(\S+)\s+(\S+)\s+(\d{4})\s+(\S+)\s+(\S+)\s*//\s*.*?\(([^)]*)\)"
    part = lambda k, t: F.nullif(F.regexp_extract("value", pattern, k), F.lit("")).try_cast(t)
    lines = spark.read.text(path).where("not startswith(value, '#')")
    return lines.where(F.col("value").rlike(pattern)).select(part(1, "string").alias("pdb"), part(2, "double").alias("resolution"), part(3, "int").alias("year"), part(4, "double").alias("affinity"), part(5, "string").alias("raw"), part(6, "string").alias("ligand"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): one per line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_id_dir(spark: SparkSession, path: str) -> DataFrame:
    """(id): comma-separated ids of all files, in lower case."""
    return spark.read.text(path).select(F.explode(F.split(F.lower(F.rtrim("value")), ",")).alias("id")).select(F.trim("id").alias("id")).where("id <> ''")


def read_table_file(spark: SparkSession, path: str, separator: str, columns: dict[str, int], skip: int = 0) -> DataFrame:
    """Columns by name from positions of split lines."""
    lines = whole_lines(spark, path, skip) if skip else spark.read.text(path)
    parts = F.split("value", separator)
    return lines.where("trim(value) <> ''").select(*[F.trim(F.get(parts, k)).alias(c) for c, k in columns.items()])


def read_multimap(spark: SparkSession, path: str, separator: str, key: int, columns: list[int]) -> DataFrame:
    """(key, rows): the rows of each key as arrays, sorted."""
    table = read_table_file(spark, path, separator, {"key": key, **{f"c{k}": k for k in columns}})
    return table.groupBy("key").agg(F.sort_array(F.collect_list(F.array(*[f"c{k}" for k in columns]))).alias("rows"))


def _probability(token: Column) -> Column:
    return F.when(token == "*", 0.0).otherwise(F.pow(F.lit(2.0), -token.try_cast("double") / 1000))


def read_profile_hmm(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, residue, emissions of 20, transitions of 10) of HHM files: after the last # line, without 5 lines of head and 2 of tail,
    lines of 23 tokens hold emissions, those of 10 the transitions that follow; other widths are an error (A9)."""
    lines = whole_lines(spark, path)
    whole = Window.partitionBy("path")
    lines = lines.withColumns({"__h": F.max(F.when(F.col("value").startswith("#"), F.col("line"))).over(whole), "__e": F.max("line").over(whole)})
    body = lines.where("line > coalesce(__h, -1) + 5 and line <= __e - 2 and trim(value) <> ''").select("path", "line", F.split(F.trim("value"), r"\s+").alias("t"))
    width = F.size("t")
    checked = F.when(width.isin(23, 10), width).otherwise(F.raise_error(F.format_string("profile line with %d tokens", width)).cast("int"))
    rows = body.withColumn("w", checked).withColumn("pair", F.count_if(F.col("w") == 23).over(whole.orderBy("line")))
    emitted = rows.where("w = 23").select("path", "pair", F.get("t", 0).alias("residue"), F.transform(F.slice("t", 3, 20), _probability).alias("emissions"))
    moved = rows.where("w = 10").select("path", "pair", F.transform("t", _probability).alias("transitions"))
    return emitted.join(moved, ["path", "pair"], "left").select("path", (F.col("pair") - 1).alias("position"), "residue", "emissions", "transitions")


PROTRUSION = ("avg_cx", "s_avg_cx", "s_ch_avg_cx", "s_ch_s_avg_cx", "max_cx", "min_cx")


def read_protrusion_tbl(spark: SparkSession, path: str) -> DataFrame:
    """(path, chain, residue, six values) of the lines after that which starts with `chain`; chain * is blank (A10)."""
    lines = whole_lines(spark, path)
    marker = F.max(F.when(F.get(fields(F.col("value"), r"\s+"), 0) == "chain", F.col("line"))).over(Window.partitionBy("path"))
    rows = lines.withColumn("__m", marker).where("line > __m and trim(value) <> ''")
    p = fields(F.col("value"), r"\s+")
    chain = F.get(p, 0)
    return rows.select("path", F.when(chain == "*", " ").otherwise(chain).alias("chain"), F.get(p, 1).alias("residue"), *[F.element_at(p, k - 6).try_cast("double").alias(c) for k, c in enumerate(PROTRUSION)])


def read_pssm(spark: SparkSession, path: str, skip: int = 2, skip_end: int = 6) -> DataFrame:
    """(path, position, residue, pssm of 20, counts of 20 as shares)."""
    lines = whole_lines(spark, path, skip, skip_end)
    t = fields(F.col("value"), r"\s+")
    rows = lines.where(F.size(t) >= 42)
    number = lambda x: x.try_cast("double")
    return rows.select("path", F.get(t, 0).try_cast("int").alias("position"), F.get(t, 1).alias("residue"), F.transform(F.slice(t, 3, 20), number).alias("pssm"), F.transform(F.slice(t, 23, 20), lambda x: number(x) / 100).alias("counts"))


def attach_al2co(pssm: DataFrame, al2co: DataFrame) -> DataFrame:
    """pssm with al2co by file and position (A11). al2co: path, position, al2co."""
    return pssm.join(al2co, ["path", "position"], "left")


def read_waters(spark: SparkSession, path: str, name: str = r"([^/]+?)(\.[^/]*)?$") -> DataFrame:
    """(protein, water_id, x, y, z, occupancy, bfactor) of the HETATM HOH lines."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("protein"), "value")
    rows = lines.where((F.col("value").startswith("HETATM")) & (F.substring("value", 18, 3) == "HOH"))
    number = lambda a, b: _cut(a, b).try_cast("double")
    return rows.select("protein", _cut(23, 30).alias("water_id"), number(31, 38).alias("x"), number(39, 46).alias("y"), number(47, 54).alias("z"), number(55, 60).alias("occupancy"), number(61, 66).alias("bfactor"))
