"""Keys from file names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name marks of bound and unbound, receptor and ligand files, by the style of a benchmark.
ROLE_MARKS: dict[str, list[tuple[str, str, bool]]] = {
    "db5": [(r"_r_b(_|\.|$)", "receptor", True), (r"_l_b(_|\.|$)", "ligand", True), (r"_r_u(_|\.|$)", "receptor", False), (r"_l_u(_|\.|$)", "ligand", False)],
    "dockground": [(r"_u1(_|\.|$)", "ligand", False), (r"_u2(_|\.|$)", "receptor", False), (r"_b1(_|\.|$)", "ligand", True), (r"_b2(_|\.|$)", "receptor", True)],
    "pdbbind": [(r"_protein(_|\.|$)", "receptor", True), (r"_ligand(_|\.|$)", "ligand", True), (r"_pocket(_|\.|$)", "pocket", True)],
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """df with name (first two parts between dots), type (the second), code (4 characters, or the last part between underscores of complex_*), grp
    (the code's characters 2 and 3) and base (code.type) (B1)."""
    parts = F.split(basename(F.col(path)), r"\.")
    first, kind = F.get(parts, 0), F.get(parts, 1)
    code = F.when(first.startswith("complex_"), F.element_at(F.split(first, "_"), -1)).otherwise(F.substring(first, 1, 4))
    return df.withColumns({"name": F.concat_ws(".", first, kind), "type": kind, "code": code, "grp": F.substring(code, 2, 2), "base": F.concat_ws(".", code, kind)})


def binding_role(df: DataFrame, style: str, name: str = "name") -> DataFrame:
    """df with role (receptor, ligand, pocket, or x) and bound by the style's marks (B2)."""
    role, bound = F.lit("x"), F.lit(None).cast("boolean")
    for mark, r, b in reversed(ROLE_MARKS[style]):
        hit = F.col(name).rlike(mark)
        role, bound = F.when(hit, r).otherwise(role), F.when(hit, b).otherwise(bound)
    return df.withColumns({"role": role, "bound": bound})


def split_model_chain(name: Column) -> Column:
    """STRUCT<chain, model> of name_chain_model: the second part, and the third if it is digits, else 0."""
    parts = F.split(name, "_")
    return F.struct(F.get(parts, 1).alias("chain"), F.coalesce(F.when(F.get(parts, 2).rlike(r"^\d+$"), F.get(parts, 2).try_cast("int")), F.lit(0)).alias("model"))


def valid_ids(df: DataFrame, pdb: str = "pdb", chain: str = "chain") -> DataFrame:
    """Rows with a 4-character id and a 1-character chain."""
    return df.where(F.col(pdb).rlike("^[0-9A-Za-z]{4}$") & F.col(chain).rlike("^[0-9A-Za-z]$"))


def check_parameters(identity: int = 90, resolution: float = 2.5, distance: float = 2.0, probability: float = 0.7) -> None:
    """Raises for a parameter of the water search out of range."""
    if identity not in (30, 40, 50, 70, 90, 95, 100):
        raise ValueError("identity is one of 30, 40, 50, 70, 90, 95, 100")
    if not 0 < resolution <= 3.0 or not 0 < distance <= 2.8 or not 0.4 <= probability <= 1:
        raise ValueError("resolution is at most 3.0, distance at most 2.8, probability from 0.4 to 1")


def raw_path(df: DataFrame, root: str, style: str, extension: str, path: str = "path") -> DataFrame:
    """df with raw, the file that a stage's file came from: its directory is the previous one, or for pdbbind the code."""
    keyed = file_keys(df, path)
    folder = F.col("code") if style == "pdbbind" else F.element_at(F.split(F.col(path), "/"), -2)
    return keyed.withColumn("raw", F.concat_ws("/", F.lit(root.rstrip("/")), folder, F.concat(F.get(F.split(F.col("name"), r"\."), 0), F.lit(extension))))
