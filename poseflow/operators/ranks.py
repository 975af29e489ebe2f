"""Window operators: top-k, tie-averaged ranks, running values, best rows, order in a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import vectors as V
from .ordered import sums_before


def place(keys: list[str], *order: Column | str) -> Column:
    """1, 2, ... within the keys, in an order that must be total to be repeatable."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key with their rank (E1); ranks above k are cut before the shuffle by Spark's group limit."""
    return df.withColumn("rank", place(keys, *order)).where(F.col("rank") <= k)


def wide_ranks(top: DataFrame, keys: list[str], k: int, columns: list[str]) -> DataFrame:
    """One row per key with column_1 ... column_k of its first k rows."""
    return top.groupBy(*keys).agg(*[F.max(F.when(F.col("rank") == j, F.col(c))).alias(f"{c}_{j}") for c in columns for j in range(1, k + 1)])


def avg_rank(keys: list[str], value: str) -> Column:
    """Rank within the keys where equal values share the mean of their places."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def running_min(keys: list[str], value: str, *order: Column | str) -> Column:
    """Smallest value so far."""
    return F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def last_n(df: DataFrame, keys: list[str], n: int, value: str, tie: str) -> DataFrame:
    """The n rows of each key with the largest values, ties to the smaller `tie`."""
    return df.withColumn("__k", place(keys, F.desc(value), tie)).where(F.col("__k") <= n).drop("__k")


def best_row(df: DataFrame, keys: list[str], value: str, tie: str, largest: bool = True) -> DataFrame:
    """The row of each key with the largest value (F2: the smallest), ties to the smaller `tie`; null values lose (E5).
    An aggregate, so a hot key is reduced before the shuffle."""
    sign = F.col(value).cast("double") * (1 if largest else -1)
    row = F.struct(*[c for c in df.columns if c not in keys])
    first = F.min_by(row, F.struct(F.when(sign.isNull(), 1).otherwise(0), -sign, F.col(tie)))
    return df.groupBy(*keys).agg(first.alias("__row")).select(*keys, "__row.*")


def take_first(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order."""
    return df.orderBy(*order).limit(n)


def residue_counter(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with number, the ordinal from 0 of each row in its structure."""
    return df.withColumn("number", place(keys, order) - 1)


def backbone_dihedrals(residues: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with phi, psi and omega's cosines and sines as `dihedrals` (array of 6) from the atoms n, ca, c of each residue and the ones
    before and after it; angles that reach beyond an end are zero (E7)."""
    by = Window.partitionBy(*keys).orderBy(order)
    before = lambda c: F.lag(c).over(by)
    after = lambda c: F.lead(c).over(by)
    angles = [
        V.dihedral(before("c"), F.col("n"), F.col("ca"), F.col("c")),
        V.dihedral(F.col("n"), F.col("ca"), F.col("c"), after("n")),
        V.dihedral(F.col("ca"), F.col("c"), after("n"), after("ca")),
    ]
    radians = [F.radians(F.coalesce(a, F.lit(0.0))) for a in angles]
    return residues.withColumn("dihedrals", F.array(*[F.cos(a) for a in radians], *[F.sin(a) for a in radians]))


def orientations(residues: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with forward and backward, unit vectors to the next and the previous row's x, y, z, zero at the ends."""
    by = Window.partitionBy(*keys).orderBy(order)
    own = V.vec("x", "y", "z")

    def towards(shift) -> Column:
        other = F.struct(*[F.coalesce(shift(a).over(by), F.col(a)).cast("double").alias(a) for a in V.AXES])
        return V.unit(V.sub(other, own))

    return residues.withColumns({"forward": towards(F.lead), "backward": towards(F.lag)})


def first_ligand(atoms: DataFrame, keys: list[str], ligand: str, chain: str = "chain", name: str = "resname") -> DataFrame:
    """The atoms of the named residue in the lowest chain that holds it."""
    own = atoms.where(F.col(name) == ligand)
    return own.withColumn("__k", F.dense_rank().over(Window.partitionBy(*keys).orderBy(chain))).where("__k = 1").drop("__k")


def slice_flat(lengths: DataFrame, values: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """Cuts a flat vector into blocks (E11). lengths: order, p, c; values: position from 0, value. Each row of lengths gets the p * c values
    after those of the rows before, as (order, i, j, value).

    The offsets are sums within the keys given, or over all, of range partitions; the values are joined by range, block by block of 2^16 positions.
    """
    keys = keys or []
    size = F.col("p").cast("long") * F.col("c")
    spans = sums_before(lengths, keys, [order], size, "start").select(*keys, order, "c", "start", (F.col("start") + size).alias("stop")).where("stop > start")
    step = 1 << 16
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("stop") - 1) / step))))
    joined = values.withColumn("__b", F.floor(F.col("position") / step)).join(spans, [*keys, "__b"]).where("position >= start and position < stop")
    at = F.col("position") - F.col("start")
    return joined.select(*keys, order, F.floor(at / F.col("c")).alias("i"), (at % F.col("c")).alias("j"), "value")
