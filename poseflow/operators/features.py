"""Statistics, scaling, imputation and residue environment features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .residues import LETTERS, clean_residue_name, lookup


def valid(c: str, kind: str = "double") -> Column:
    """Is a feature given: not null, NaN or '-'; an array without any null or NaN inside."""
    if kind == "array":
        return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    if kind == "string":
        return F.coalesce(~F.col(c).isin("-", "NA", ""), F.lit(False))
    return F.col(c).isNotNull() & ~F.isnan(c)


def dataset_statistics(residues: DataFrame, pairs: DataFrame, features: dict[str, str], complex_col: str = "complex") -> DataFrame:
    """One row of counts (D21): n_complexes, n_residues, n_interface, valid_<feature>, and from pairs (label 0 or 1) n_pairs, n_positive, n_negative,
    with the ratios share_interface and positive_ratio. features: name to kind (double, string, array); residues has interface."""
    a = residues.agg(F.countDistinct(complex_col).alias("n_complexes"), F.count("*").alias("n_residues"), F.count_if(F.col("interface")).alias("n_interface"), *[F.count_if(valid(c, k)).alias(f"valid_{c}") for c, k in features.items()])
    b = pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_negative"))
    return a.crossJoin(b).withColumns({"share_interface": F.try_divide(F.col("n_interface").cast("double"), F.col("n_residues")), "positive_ratio": F.try_divide(F.col("n_positive").cast("double"), F.col("n_pairs"))})


def min_max_scale(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """df with the columns scaled to [0, 1] within the keys; null where all values are equal."""
    by = Window.partitionBy(*keys)
    return df.withColumns({c: F.try_divide(F.col(c) - F.min(c).over(by), F.max(c).over(by) - F.min(c).over(by)) for c in columns})


FILLS = ("median", "mean", "min", "max", "zero")


def impute(df: DataFrame, columns: list[str], keys: list[str], fill: str = "median", most: int = 5) -> DataFrame:
    """df with gaps (null, NaN) of the columns filled by the key's statistic if there are at most `most`, else by zero."""
    if fill not in FILLS:
        raise ValueError(f"fill is one of {FILLS}")
    clean = df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})
    make = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max, "zero": lambda c: F.lit(0.0)}[fill]
    stats = clean.groupBy(*keys).agg(*[F.when(F.count_if(F.col(c).isNull()) <= most, F.coalesce(make(c), F.lit(0.0))).otherwise(0.0).alias(f"__{c}") for c in columns])
    return clean.join(stats, keys, "left").withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def impute_array(df: DataFrame, column: str, size: int, keys: list[str], id_col: str, fill: str = "median", most: int = 5) -> DataFrame:
    """df with the array column filled element by element as `impute` does; a missing array or one of another size is all gaps (D23). id_col
    identifies a row within the keys."""
    whole = F.when(F.size(column) == size, F.col(column)).otherwise(F.array_repeat(F.lit(None).cast("double"), size))
    long = df.select(*keys, id_col, F.posexplode(whole).alias("__k", "__v"))
    filled = impute(long, ["__v"], [*keys, "__k"], fill, most)
    back = filled.groupBy(*keys, id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "__v"))), lambda x: x["__v"]).alias(column))
    return df.drop(column).join(back, [*keys, id_col], "left")


def impute_ca(df: DataFrame, columns: list[str], keys: list[str], fill: str = "median", most: int = 5) -> DataFrame:
    """`impute` on CA rows alone; other rows stay."""
    ca = F.coalesce(F.col("atom_name") == "CA", F.lit(False))
    typed = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return impute(typed.where(ca), columns, keys, fill, most).select(*typed.columns).unionByName(typed.where(~ca))


def sidechain_vectors(atoms: DataFrame, residue: list[str]) -> DataFrame:
    """(residue, resname, ca, direction): the mean unit vector from CA to the atoms after the first four by aid; of glycine, minus those to N and C; null where there
    are none (D25)."""
    own = Window.partitionBy(*residue)
    rows = atoms.withColumn("__k", F.row_number().over(own.orderBy(F.col("aid").try_cast("long"), "aid"))).withColumn("__ca", F.min(F.when(F.col("atom_name") == "CA", F.struct(*[F.col(c).cast("double").alias(c) for c in V.AXES]))).over(own))
    step = V.unit(V.sub(V.vec(*V.AXES), F.col("__ca")))
    gly = F.col("resname") == "GLY"
    sign = F.when(gly & F.col("atom_name").isin("N", "C"), -1.0).when(~gly & (F.col("__k") > 4), 1.0)
    direction = F.struct(*[F.avg(step[c] * sign).alias(c) for c in V.AXES])
    out = rows.where("__ca is not null").groupBy(*residue, "resname").agg(F.min("__ca").alias("ca"), direction.alias("direction"))
    return out.withColumn("direction", F.when(F.col("direction.x").isNotNull(), F.col("direction")))


def half_sphere_composition(similar: DataFrame, vectors: DataFrame, keys: list[str], residue: str) -> DataFrame:
    """(keys, residue, hsaac): counts by letter (20 and X) of similar residues whose CA lies in the half sphere of the side chain, then of the others, with the own letter
    counted once more on both sides, over 1 + n (D25). The own residue, at distance zero, is down. Null without a direction.

    similar: keys, a_<residue>, b_<residue>; vectors: keys, residue, resname, ca, direction.
    """
    letters = [*LETTERS.values(), "X"]
    letter = F.coalesce(lookup(LETTERS, clean_residue_name(F.col("resname"))), F.lit("X"))
    a = vectors.select(*keys, F.col(residue).alias(f"a_{residue}"), letter.alias("own"), F.col("ca").alias("from"), "direction")
    b = vectors.select(*keys, F.col(residue).alias(f"b_{residue}"), letter.alias("other"), F.col("ca").alias("to"))
    joined = similar.join(a, [*keys, f"a_{residue}"]).join(b, [*keys, f"b_{residue}"])
    up = V.dot(F.col("direction"), V.sub(F.col("to"), F.col("from"))) > 0
    count = lambda side, x: F.count_if(side & (F.col("other") == x)) + (F.first("own") == x).cast("int")
    grouped = joined.where("direction is not null").groupBy(*keys, f"a_{residue}").agg(F.count("*").alias("n"), F.array(*[count(up, x) for x in letters], *[count(~up, x) for x in letters]).alias("c"))
    found = grouped.select(*keys, F.col(f"a_{residue}").alias(residue), F.transform("c", lambda x: x / (1 + F.col("n"))).alias("hsaac"))
    return vectors.select(*keys, residue).join(found, [*keys, residue], "left")
