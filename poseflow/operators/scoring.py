"""Scoring, ranking and screening power of scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import orientation
from ..tables import Scratch
from .poses import correlation, spearman
from .ranks import best_row, place

FRACTIONS = (0.01, 0.05, 0.1)


def join_core(core: DataFrame, scores: DataFrame, *order: Column | str) -> DataFrame:
    """Core rows, the first by the order of each code, with their scores."""
    first = core.withColumn("__k", place(["code"], *(order or ("target", "logKa")))).where("__k = 1").drop("__k")
    return first.join(scores, "code")


def scoring_power(df: DataFrame, x: str = "score", y: str = "logKa") -> DataFrame:
    """One row: n, pearson, slope, intercept of y over x, and sd, the root of the squared residuals over n - 1 (D3)."""
    r = correlation(x, y)
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(n.alias("n"), r.alias("pearson"), slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"), F.sqrt(F.try_divide(F.var_pop(y) * n * (1 - r * r), n - 1)).alias("sd"))


def of_size(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows of keys that have exactly `size` rows."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("__n") == size).drop("__n")


def pairs_within(df: DataFrame, keys: list[str], id_col: str, columns: list[str]) -> DataFrame:
    """Unordered pairs of rows of a key (ids i < j) with columns a_*, b_*: for keys of few rows only."""
    side = lambda s: df.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in [id_col, *columns]])
    return side("a").join(side("b"), keys).where(F.col(f"a_{id_col}") < F.col(f"b_{id_col}"))


def kendall(df: DataFrame, keys: list[str], id_col: str, x: str, y: str) -> DataFrame:
    """(keys, kendall): tau-b; null where x or y is constant."""
    dx, dy = F.signum(F.col(f"a_{x}") - F.col(f"b_{x}")), F.signum(F.col(f"a_{y}") - F.col(f"b_{y}"))
    agreed = pairs_within(df, keys, id_col, [x, y]).groupBy(*keys).agg(F.sum(dx * dy).alias("s"), F.sum(dx * dx).alias("nx"), F.sum(dy * dy).alias("ny"))
    return agreed.select(*keys, F.try_divide(F.col("s"), F.sqrt(F.col("nx") * F.col("ny"))).alias("kendall"))


def predictive_index(df: DataFrame, keys: list[str], id_col: str, x: str = "score", y: str = "logKa") -> DataFrame:
    """(keys, pi): over pairs, the difference in y counts for where x orders them alike and against where not."""
    dx, dy = F.signum(F.col(f"a_{x}") - F.col(f"b_{x}")), F.col(f"a_{y}") - F.col(f"b_{y}")
    exact = lambda c: F.sum(c.cast("decimal(28,9)")).cast("double")  # noqa: E731  opposite pairs cancel to zero
    sums = pairs_within(df, keys, id_col, [x, y]).groupBy(*keys).agg(exact(dy * dx).alias("s"), exact(F.abs(dy)).alias("w"))
    return sums.select(*keys, F.try_divide(F.col("s"), F.col("w")).alias("pi"))


def ranking_power(df: DataFrame, keys: list[str] | None = None, id_col: str = "code", size: int = 5) -> DataFrame:
    """(target, representative, spearman, kendall, pi) of each target with exactly `size` rows; the representative is the code with the highest
    logKa, ties to the smaller (D4). Means over targets are plain averages."""
    keys = keys or ["target"]
    rows = of_size(df, keys, size)
    head = best_row(rows, keys, "logKa", id_col).select(*keys, F.col(id_col).alias("representative"))
    parts = [spearman(rows, keys, "score", "logKa").drop("n"), kendall(rows, keys, id_col, "score", "logKa"), predictive_index(rows, keys, id_col)]
    for p in parts:
        head = head.join(p, keys)
    return head


def best_per_ligand(scores: DataFrame, favorable: str = "positive") -> DataFrame:
    """(target, ligand, score): the best score of each ligand."""
    return scores.groupBy("target", "ligand").agg((F.max if orientation(favorable) > 0 else F.min)("score").alias("score"))


def decoy_semi(scores: DataFrame, actives: DataFrame) -> DataFrame:
    """Score rows of ligands that are listed for any target."""
    return scores.join(actives.where("ligand is not null").select("ligand").distinct(), "ligand", "left_semi")


def cutoffs(n: Column, fractions: tuple[float, ...] = FRACTIONS) -> Column:
    """Array of struct<fraction, top>: the fraction of n rounded half up, at least 1."""
    return F.array(*[F.struct(F.lit(p).alias("fraction"), F.greatest(F.floor(n * p + 0.5), F.lit(1)).cast("long").alias("top")) for p in fractions])


def screening_power(scores: DataFrame, actives: DataFrame, favorable: str = "positive", fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """(target, fraction, top, success, hits, ef) (D9). Scores are those of listed ligands, the best of each; n is the number of distinct listed
    ligands. success: the target's first active is in the top; ef: its actives there over all its actives times the fraction."""
    best = best_per_ligand(decoy_semi(scores, actives), favorable)
    n = actives.agg(F.countDistinct("ligand").alias("n"))
    ranked = best.withColumn("place", place(["target"], F.col("score") * -orientation(favorable), "ligand"))
    own = actives.where("ligand is not null").join(ranked, ["target", "ligand"], "left")
    cuts = n.select(F.explode(cutoffs(F.col("n"), fractions)).alias("c")).select("c.fraction", "c.top")
    return _top_hits(own.crossJoin(F.broadcast(cuts)), "target")


def _top_hits(rows: DataFrame, key: str) -> DataFrame:
    inside = F.coalesce(F.col("place") <= F.col("top"), F.lit(False))
    counted = rows.groupBy(key, "fraction", "top").agg(F.bool_or(inside & (F.col("rank") == 1)).alias("success"), F.sum(inside.cast("long")).alias("hits"), F.count("*").alias("actives"))
    return counted.select(key, "fraction", "top", "success", "hits", (F.col("hits") / (F.col("actives") * F.col("fraction"))).alias("ef"))


def reverse_screening(scores: DataFrame, ligand_info: DataFrame, favorable: str = "positive", size: int = 5, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """(ligand, fraction, top, success): for ligands of groups of exactly `size`, is their own target t1 among the top targets by best
    score (D10). n is the number of distinct targets."""
    ligands = of_size(ligand_info, ["grp"], size).select(F.col("code").alias("ligand"), "t1")
    best = best_per_ligand(scores, favorable)
    ranked = best.withColumn("place", place(["ligand"], F.col("score") * -orientation(favorable), "target"))
    own = ligands.join(ranked, (ranked["ligand"] == ligands["ligand"]) & (ranked["target"] == ligands["t1"]), "left").select(ligands["ligand"], "place")
    cuts = scores.agg(F.countDistinct("target").alias("n")).select(F.explode(cutoffs(F.col("n"), fractions)).alias("c")).select("c.fraction", "c.top")
    return own.crossJoin(F.broadcast(cuts)).select("ligand", "fraction", "top", F.coalesce(F.col("place") <= F.col("top"), F.lit(False)).alias("success"))


#: A prime for hashes by powers in 64-bit integers; the fifth power permutes its residues.
_PRIME = (1 << 31) - 1
#: Probabilities of at most 0, 1, ... 11 under Poisson(1).
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def bootstrap_means(df: DataFrame, value: str, id_col: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(r, m): the mean of each replicate, r from 1, null where it drew no row.

    A replicate weighs each row by a Poisson(1) count. With h the first 28 bits of an MD5 of the row's id, the draw is x^5 mod 2^31 - 1 of
    x = h + 69621 r + 40503 seed, so a row needs no other row, and no replicate is a row before it is a sum: a task holds two sums per replicate.
    """
    bounds = np.array(POISSON) * _PRIME
    head = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 7), 16, 10).cast("long")
    rows = df.where(F.col(value).isNotNull()).select(head.alias("h"), F.col(value).cast("double").alias("v"))
    shift = 69621 * np.arange(1, replicates + 1, dtype=np.int64) + 40503 * seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = np.zeros(replicates), np.zeros(replicates, np.int64)
        for batch in batches:
            h, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            step = max(1, (1 << 20) // replicates)
            for at in range(0, len(h), step):
                x = (h[at : at + step, None] + shift) % _PRIME
                square = x * x % _PRIME
                drawn = np.searchsorted(bounds, square * square % _PRIME * x % _PRIME, "right")
                sums += v[at : at + step] @ drawn
                weights += drawn.sum(0)
        yield pa.RecordBatch.from_pydict({"r": pa.array(np.arange(1, replicates + 1)), "s": pa.array(sums), "w": pa.array(weights)})

    parts = rows.mapInArrow(run, "r long, s double, w long")
    return parts.groupBy("r").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))


def bootstrap(df: DataFrame, value: str, id_col: str, replicates: int = 1000, confidence: float = 0.9, seed: int = 0) -> DataFrame:
    """One row: estimate (mean), low and high of a bias-corrected and accelerated interval over `bootstrap_means` (D29). The acceleration comes
    from sums of powers, as the jackknife of a mean has a closed form."""
    from statistics import NormalDist

    rows = df.where(F.col(value).isNotNull())
    means = Scratch(df.sparkSession, "bootstrap").save(bootstrap_means(df, value, id_col, replicates, seed), "means")
    stats = rows.agg(F.count("*").alias("n"), F.avg(value).alias("estimate"), F.skewness(value).alias("skew")).first()
    # A mean that differs from the estimate by rounding alone is not below it.
    below = (F.lit(stats["estimate"]) - F.col("m") > abs(stats["estimate"] or 0.0) * 1e-12).cast("double")
    shifted = means.agg(F.avg(below).alias("share")).first()["share"] if stats["n"] else None
    z0 = 0.0 if share_out(shifted) else NormalDist().inv_cdf(shifted)
    a = (stats["skew"] or 0.0) / (6 * stats["n"] ** 0.5) if stats["n"] else 0.0
    ends = []
    for q in ((1 - confidence) / 2, (1 + confidence) / 2):
        z = z0 + NormalDist().inv_cdf(q)
        ends.append(NormalDist().cdf(z0 + z / (1 - a * z)))
    return means.agg(*[F.percentile("m", F.lit(q)).alias(n) for q, n in zip(ends, ("low", "high"))]).select(F.lit(stats["estimate"]).cast("double").alias("estimate"), "low", "high")


def share_out(share: float | None) -> bool:
    """A share that has no normal quantile."""
    return share is None or share <= 0 or share >= 1
