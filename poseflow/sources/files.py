"""Finding files, and writing tables of pairs, reports, sequences and parts."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import batched, groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import compact_date
from .formats import _local

#: Affinity types, and the units of the first form.
AFFINITY_TYPES = ("Ki", "Kd", "IC50", "EC50", "&Delta;G", "&Delta;H", "-T&Delta;S", "Ka")
AFFINITY_UNITS = ("nM", "kJ/mol", "M^-1")
STRUCTURE_FILES = r"\.pdb[0-9]*(\.gz)?$"

STRUCTURE_SCHEMA = "name string, seq string, coords struct<N: array<array<double>>, CA: array<array<double>>, C: array<array<double>>, O: array<array<double>>>"
ENTRY_SCHEMA = "rcsb_id string, pdbx_vrpt_summary struct<PDB_resolution: double>, refine array<struct<ls_R_factor_R_free: double, ls_R_factor_obs: double, ls_R_factor_R_work: double>>, struct struct<pdbx_descriptor: string>, rcsb_accession_info struct<initial_release_date: string>, rcsb_entry_info struct<nonpolymer_bound_components: array<string>>, rcsb_binding_affinity array<struct<comp_id: string, type: string, unit: string, value: double>>"


def discover(spark: SparkSession, path: str | list[str], pattern: str = STRUCTURE_FILES, list_file: bool = False) -> DataFrame:
    """(path, length, modified) of the files under directories, of a glob, or named in a list file, whose names match; their bytes are not read (A5)."""
    if list_file:
        names = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
        return names.where(F.col("path").rlike(pattern)).select("path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).where(F.col("path").rlike(pattern))


def read_structures_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, position, n, ca, c, o): a row per residue of JSON lines, points as STRUCT<x, y, z>."""
    point = lambda c: F.when(F.size(c) == 3, F.struct(c[0].alias("x"), c[1].alias("y"), c[2].alias("z")))
    zipped = F.arrays_zip(*[F.col(f"coords.{a}") for a in ("N", "CA", "C", "O")])
    rows = spark.read.schema(STRUCTURE_SCHEMA).json(path).select("name", "seq", F.posexplode(zipped).alias("position", "r"))
    return rows.select("name", "seq", "position", *[point(F.col(f"r.{a}")).alias(a.lower()) for a in ("N", "CA", "C", "O")])


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Saved entry documents, one JSON file each."""
    return spark.read.schema(ENTRY_SCHEMA).option("multiLine", True).json(path)


def flatten_affinity(entries: DataFrame, keys: list[str], measurements: str, all_units: bool = False, types: tuple[str, ...] = AFFINITY_TYPES, units: tuple[str, ...] = AFFINITY_UNITS) -> DataFrame:
    """(keys, comp_id, one column per type): the mean of each ligand's values of a type (A13, D20). Of the known units alone, unless all_units."""
    rows = entries.select(*keys, F.explode(measurements).alias("m")).select(*keys, "m.comp_id", "m.type", "m.unit", "m.value").where(F.col("type").isin(*types))
    if not all_units:
        rows = rows.where(F.col("unit").isin(*units))
    return rows.groupBy(*keys, "comp_id").pivot("type", list(types)).avg("value")


def mean_affinity(rows: DataFrame, keys: list[str], type_col: str = "type", value: str = "value") -> DataFrame:
    """(keys, type, value): the mean per key and type."""
    return rows.groupBy(*keys, type_col).agg(F.avg(value).alias(value))


def entry_attributes(entries: DataFrame) -> DataFrame:
    """(pdb, resolution, r_factor, ec, release_date): r_factor is the first given of free, observed and work; null where absent."""
    refine = F.get("refine", 0)
    ec = F.nullif(F.regexp_extract("struct.pdbx_descriptor", r"E\.?C\.?\s*([0-9]+(\.[0-9-]+){3})", 1), F.lit(""))
    r: Column = F.coalesce(refine["ls_R_factor_R_free"], refine["ls_R_factor_obs"], refine["ls_R_factor_R_work"])
    return entries.select(F.col("rcsb_id").alias("pdb"), F.col("pdbx_vrpt_summary.PDB_resolution").alias("resolution"), r.alias("r_factor"), ec.alias("ec"), compact_date(F.col("rcsb_accession_info.initial_release_date")).alias("release_date"))


def read_compounds(spark: SparkSession, path: str) -> DataFrame:
    """(compound_name, smiles) of a CSV file with these headers."""
    df = spark.read.option("header", True).csv(path)
    name = F.col("compound_name") if "compound_name" in df.columns else F.concat(F.lit("compound_"), F.abs(F.xxhash64("smiles")).cast("string"))
    return df.where("smiles is not null").select(name.alias("compound_name"), "smiles")


def write_report(df: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_pairs(df: DataFrame, path: str, code: str = "code") -> None:
    """One Parquet table, partitioned by the code's characters 2 and 3."""
    df.withColumn("grp", F.substring(code, 2, 2)).write.mode("overwrite").partitionBy("grp").parquet(path)


def load_pairs(spark: SparkSession, path: str, ids: DataFrame | None = None, code: str = "code") -> DataFrame:
    """The pairs, or those of listed codes; their groups prune partitions."""
    df = spark.read.option("basePath", path).parquet(path)
    if ids is None:
        return df
    keys = ids.select(F.col(code), F.substring(code, 2, 2).alias("grp")).distinct()
    return df.join(keys, ["grp", code], "left_semi")


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int = 64, path: str | None = None) -> None:
    """A table of the catalog in buckets by keys, each sorted by them: joins and groups by these keys of tables with as many buckets need no
    exchange (A17, C13). path: where its files go, else Spark's warehouse."""
    dealt = df.repartition(buckets, *keys)  # a file per bucket, not one per bucket and task
    writer = dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}/_finished"  # Spark's readers pass over names with an underscore


def finished_parts(spark: SparkSession, path: str, part: str) -> DataFrame:
    """(part): the parts that `write_resumable` has finished under the path."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_manifest(path))
    schema = f"{part} string"
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema).select(part)
    return spark.read.schema(schema).json(_manifest(path)).select(part).distinct()


def write_resumable(df: DataFrame, path: str, part: str, at_once: int = 16) -> int:
    """Writes df as Parquet under a folder per value of `part`, `at_once` values at a time, and notes each that is done; values noted by an earlier run
    are not computed again, and what an aborted one has left of others is replaced (A17, C13). Gives the number of values written.

    Values are few, such as groups of codes: their names come to the driver. A part's rows are dealt to as many tasks as they need."""
    spark = df.sparkSession
    named = df.withColumn(part, F.coalesce(F.col(part).cast("string"), F.lit("null")))
    left = named.select(part).distinct().join(finished_parts(spark, path, part), part, "left_anti")
    names = sorted(r[0] for r in left.collect())
    for at in range(0, len(names), at_once):
        some = names[at : at + at_once]
        rows = named.where(F.col(part).isin(some))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
        spark.createDataFrame([(x,) for x in some], f"{part} string").coalesce(1).write.mode("append").json(_manifest(path))
    return len(names)


def fasta(sequences: DataFrame) -> DataFrame:
    """(value): records >name-model-chain of sequences name, model, chain, sequence."""
    return sequences.select(F.format_string(">%s-%s-%s\n%s", "name", F.col("model").cast("string"), "chain", "sequence").alias("value"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    fasta(sequences).write.mode("overwrite").text(path)


def write_named(df: DataFrame, path: str, name: str, order: list[str], value: str = "value", ending: str = ".txt") -> int:
    """A text file <name>=<its value><ending> in the folder for each value of name, with its lines in order (A2); how many. A name of null is that of Spark's writers.

    Tasks write them through pyarrow's file systems, line by line: partitionBy makes a folder for each file and, on local file systems, starts a chmod for each
    folder, file and checksum. A file is written under a hidden name and put in place whole, so a task may run again or twice.
    """
    local = _local(path)
    system, root = (None, local) if local is not None else fs.FileSystem.from_uri(path)
    os.makedirs(root, exist_ok=True) if system is None else system.create_dir(root, recursive=True)

    def place(hidden: str, final: str) -> None:
        if system is None:
            os.replace(hidden, final)
        elif system.get_file_info(final).type == fs.FileType.NotFound:
            system.move(hidden, final)
        else:
            system.delete_file(hidden)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, attempt = 0, TaskContext.get().taskAttemptId()
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for key, group in groupby(rows, lambda row: row[0]):
            key = "__HIVE_DEFAULT_PARTITION__" if key is None else key
            if "/" in key:
                raise ValueError(f"not a file's name: {key}")
            hidden, final = f"{root}/_{attempt}-{key}{ending}", f"{root}/{name}={key}{ending}"
            with open(hidden, "wb") if system is None else system.open_output_stream(hidden) as out:
                for some in batched(group, 10000):
                    out.write("".join([f"{'' if line is None else line}\n" for _, line in some]).encode())
            place(hidden, final)
            made += 1
        yield pa.record_batch({"n": pa.array([made], pa.int64())})

    sorted_lines = df.repartition(name).sortWithinPartitions(name, *order).select(F.col(name).cast("string"), value)
    return sorted_lines.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def combine_files(spark: SparkSession, paths: list[str], path: str, skip: int = 0, single: bool = False) -> None:
    """Lines of all files, in one folder, or one file on request (A19). skip: lines of each file's head to drop."""
    from .text import whole_lines

    lines = spark.read.text(paths) if not skip else None
    if lines is None:
        from functools import reduce

        lines = reduce(DataFrame.unionByName, [whole_lines(spark, p, skip) for p in paths]).select("value")
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def write_key_values(df: DataFrame, path: str, key: str, values: str, separator: str = "\t") -> None:
    """Lines of a key and its values."""
    df.select(F.concat_ws(separator, F.col(key), F.array_join(values, separator)).alias("value")).write.mode("overwrite").text(path)


def complex_parts(atoms: DataFrame, pocket: DataFrame, keys: list[str]) -> DataFrame:
    """atoms of each part: protein and pocket (no hetero atoms), ligand, and complex (both); water goes (A20). atoms: keys, chain, residue, resname, hetero.
    pocket: keys, chain, residue."""
    dry = atoms.where("resname <> 'HOH'")
    protein, ligand = dry.where("not hetero"), dry.where("hetero")
    inside = protein.join(pocket.select(*keys, "chain", "residue").distinct(), [*keys, "chain", "residue"], "left_semi").select(*dry.columns)
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return part(protein, "protein").unionByName(part(ligand, "ligand")).unionByName(part(inside, "pocket")).unionByName(part(dry, "complex"))


def write_complex_parts(parts: DataFrame, path: str) -> None:
    parts.write.mode("overwrite").partitionBy("part").parquet(path)
