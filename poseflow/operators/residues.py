"""Filters of atoms and residues, sequences, ligand filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Letters of the standard residues, and names that stand for them.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
SYNONYMS = {"HID": "HIS", "CYX": "CYS", "ASX": "ASP", "GLX": "GLY"}
DROPPED = ("SEC", "PYL")
#: Heavy atoms of a complete residue.
HEAVY_ATOMS = {
    "ALA": 5, "ARG": 11, "ASN": 8, "ASP": 8, "CYS": 6, "GLN": 9, "GLU": 9, "GLY": 4, "HIS": 10, "ILE": 8,
    "LEU": 8, "LYS": 9, "MET": 8, "PHE": 11, "PRO": 7, "SER": 6, "THR": 7, "TRP": 14, "TYR": 12, "VAL": 7,
}
#: Standard atomic masses of the elements met in ligands.
MASSES = {
    "H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Mg": 24.305, "Si": 28.085, "P": 30.974,
    "S": 32.06, "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38,
    "As": 74.922, "Se": 78.971, "Br": 79.904, "Ru": 101.07, "Pt": 195.08, "I": 126.904, "Hg": 200.59, "V": 50.942, "W": 183.84, "Mo": 95.95,
}


def lookup(table: dict, key: Column) -> Column:
    """A constant dictionary's value, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def heavy_atoms(atoms: DataFrame) -> DataFrame:
    """(B4)"""
    return atoms.where("element <> 'H'")


def ca_atoms(atoms: DataFrame) -> DataFrame:
    """(B5)"""
    return atoms.where("atom_name = 'CA'")


def first_model(atoms: DataFrame, structure: str = "pdb_name", order: str = "aid") -> DataFrame:
    """Rows of the model of each structure's first row."""
    first = F.min(F.struct(order, "model")).over(Window.partitionBy(structure))
    return atoms.withColumn("__m", first["model"]).where("model = __m").drop("__m")


def standard_residues(atoms: DataFrame, residue: list[str], bfactor_cutoff: float | None = None, ensure_ca: bool = True) -> DataFrame:
    """Rows of residues with a standard name, not hetero, with a CA, and with its b-factor not below the cutoff."""
    own = Window.partitionBy(*residue)
    ca = F.col("atom_name") == "CA"
    ok = F.col("resname").isin(*LETTERS) & ~F.coalesce(F.col("hetero"), F.lit(False))
    if ensure_ca:
        ok = ok & F.bool_or(ca).over(own)
    if bfactor_cutoff is not None:
        ok = ok & (F.max(F.when(ca, F.col("bfactor"))).over(own) >= bfactor_cutoff)
    return atoms.withColumn("__ok", ok).where("__ok").drop("__ok")


def split_hetero(atoms: DataFrame, hetero: str = "hetero_flag") -> DataFrame:
    """atoms with part: protein (blank flag) or ligand; water (W) goes."""
    flag = F.trim(F.coalesce(F.col(hetero), F.lit("")))
    return atoms.where(flag != "W").withColumn("part", F.when(flag == "", "protein").otherwise("ligand"))


def backbone_complete(atoms: DataFrame, residue: list[str], names: tuple[str, ...] = ("N", "CA", "C", "O")) -> DataFrame:
    """One row per residue that has all the backbone atoms, with a STRUCT<x, y, z> column of each in lower case."""
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    wide = atoms.where(F.col("atom_name").isin(*names)).groupBy(*residue).agg(*[F.min(F.when(F.col("atom_name") == n, point)).alias(n.lower()) for n in names])
    return wide.where(" and ".join(f"{n.lower()} is not null" for n in names))


def clean_residue_name(name: Column) -> Column:
    """Standard name of a residue; null for those that are dropped."""
    return F.when(~name.isin(*DROPPED), F.coalesce(lookup(SYNONYMS, name), name))


def to_sequence(residues: DataFrame, keys: list[str], position: str, name: str = "resname") -> DataFrame:
    """(keys, sequence, n): one letter per residue in order, X for unknown names."""
    letter = F.coalesce(lookup(LETTERS, clean_residue_name(F.col(name))), F.lit("X"))
    rows = residues.where(clean_residue_name(F.col(name)).isNotNull()).select(*keys, F.struct(F.col(position).alias("p"), letter.alias("l")).alias("s")).distinct()
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("s")).select(*keys, F.array_join(F.transform("s", lambda x: x["l"]), "").alias("sequence"), F.size("s").alias("n"))


def missing_atoms(atoms: DataFrame, keys: list[str], residue: list[str]) -> DataFrame:
    """(keys, residue, resname, n_atoms, expected, letter): lower case where the residue is complete, upper case where atoms are missing."""
    counted = heavy_atoms(atoms).groupBy(*keys, *residue, "resname").agg(F.count("*").alias("n_atoms"))
    letter = F.coalesce(lookup(LETTERS, F.col("resname")), F.lit("X"))
    out = counted.withColumn("expected", lookup(HEAVY_ATOMS, F.col("resname")))
    return out.withColumn("letter", F.when(F.col("n_atoms") >= F.col("expected"), F.lower(letter)).otherwise(F.upper(letter)))


def formula_features(df: DataFrame, formula: str = "formula", key: str = "ligand") -> DataFrame:
    """(key, mass, mass_number, n_atoms, n_heavy) of a flat formula like C6H12O6; null mass if an element is unknown."""
    found = F.expr(f"regexp_extract_all({formula}, '[A-Z][a-z]?[0-9]*', 0)")
    rows = df.select(key, F.explode(found).alias("t")).select(key, F.regexp_extract("t", "^[A-Za-z]+", 0).alias("e"), F.coalesce(F.regexp_extract("t", r"\d+$", 0).try_cast("int"), F.lit(1)).alias("n"))
    mass = lookup(MASSES, F.col("e")) * F.col("n")
    total = lambda c: F.when(F.count("*") == F.count(c), F.sum(c))
    return rows.groupBy(key).agg(total(mass).alias("mass"), total(F.round(lookup(MASSES, F.col("e"))) * F.col("n")).alias("mass_number"), F.sum("n").alias("n_atoms"), F.sum(F.when(F.col("e") != "H", F.col("n")).otherwise(0)).alias("n_heavy"))


def filter_ligands(ligands: DataFrame, special: list[str], atoms: tuple[float, float] | None = None, mass: tuple[float, float] | None = None, name: str = "ligand") -> DataFrame:
    """ligands with reason: special, atoms or mass where it is to go, else null; a missing feature keeps it."""
    out = lambda c, r: ~F.coalesce(F.col(c).between(*r), F.lit(True)) if r else F.lit(False)
    return ligands.withColumn("reason", F.when(F.col(name).isin(*special), "special").when(out("n_heavy", atoms), "atoms").when(out("mass_number", mass), "mass"))


def few_atoms(ligands: DataFrame, special: list[str], most: int = 7, unknown: int = 8, name: str = "ligand") -> DataFrame:
    """The ligands kept by the older rule: not special, and more than `most` heavy atoms, an unknown number counting as `unknown`."""
    return ligands.where(~F.col(name).isin(*special) & (F.coalesce(F.col("n_heavy"), F.lit(unknown)) > most))


def resolution_filter(entries: DataFrame, cutoff: float) -> DataFrame:
    """(B21)"""
    return entries.where(F.col("resolution").isNotNull() & (F.col("resolution") <= cutoff))


def xray_filter(entries: DataFrame) -> DataFrame:
    """(B21)"""
    return entries.where("method = 'X-RAY DIFFRACTION'")


def size_limit(pairs: DataFrame, atoms: DataFrame, keys: list[str], limit: int = 17_500) -> DataFrame:
    """Pairs whose ligand has an atom and at most `limit`, and whose receptor has one (B22). atoms: keys, side (ligand or receptor)."""
    counted = atoms.groupBy(*keys).agg(F.count_if(F.col("side") == "ligand").alias("l"), F.count_if(F.col("side") == "receptor").alias("r"))
    return pairs.join(counted.where((F.col("l").between(1, limit)) & (F.col("r") > 0)), keys, "left_semi")
