"""Metrics of poses and predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, orientation
from ..tables import Scratch
from .ordered import quantiles, sums_before
from .ranks import avg_rank, best_row, place


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's, null for constant or single values, which `corr` fails on."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def join_pose(rmsds: DataFrame, scores: DataFrame) -> DataFrame:
    """(complex, code, rmsd, score)."""
    return rmsds.join(scores, ["complex", "code"])


def pose_success(poses: DataFrame, favorable: str = "positive", ks: tuple[int, ...] = (1, 2, 3), cut: float = 2.0) -> DataFrame:
    """(k, n_complexes, n_success, rate): complexes with a pose of rmsd at most the cut among the k best scores, ties to the smaller code."""
    score = F.col("score") * orientation(favorable)
    ranked = poses.withColumn("rank", place(["complex"], F.desc(score), "code"))
    best = ranked.groupBy("complex").agg(*[F.min(F.when(F.col("rank") <= k, F.col("rmsd"))).alias(f"m{k}") for k in ks])
    long = best.select("complex", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"m{k}") <= cut, F.lit(False)).alias("ok")) for k in ks])).alias("s"))
    return long.groupBy(F.col("s.k").alias("k")).agg(F.count("*").alias("n_complexes"), F.sum(F.col("s.ok").cast("long")).alias("n_success"), F.avg(F.col("s.ok").cast("double")).alias("rate"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """(keys, n, spearman) by tie-averaged ranks; keys with fewer rows give none, constant values null."""
    ranked = df.select(*keys, avg_rank(keys, x).alias("rx"), avg_rank(keys, y).alias("ry"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation("rx", "ry").alias("spearman")).where(F.col("n") >= least)


def pose_spearman(poses: DataFrame, favorable: str = "positive", limits: tuple[int, ...] = tuple(range(2, 11)), least: int = 5) -> DataFrame:
    """(s, n_complexes, spearman): the mean over complexes of the rank correlation of rmsd and score of the poses with rmsd at most s,
    where there are `least`; the sign makes a good score positive (D2)."""
    # Poses within a limit are the first by rmsd, so their ranks by rmsd are those among all. Their ranks by score are counted for all limits in one pass, and no row
    # is made for a limit: at most `le` of them have a score up to the row's, `eq` the same one.
    enough = poses.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("complex"))).where(F.col("__n") >= least)
    near = enough.where(F.col("rmsd") <= max(limits)).select("complex", "rmsd", "score")
    upto = Window.partitionBy("complex").orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = lambda s: F.when(F.col("rmsd") <= s, 1)
    among = {s: F.coalesce(F.sum(inside(s)).over(upto), F.lit(0)) - (F.coalesce(F.sum(inside(s)).over(Window.partitionBy("complex", "score")), F.lit(0)) - 1) / 2 for s in limits}
    ranked = near.withColumn("rx", avg_rank(["complex"], "rmsd")).select("complex", "rmsd", "rx", *[F.when(F.col("rmsd") <= s, r).alias(f"ry{k}") for k, (s, r) in enumerate(among.items())])
    both = lambda k, s: correlation(F.when(F.col("rmsd") <= s, F.col("rx")), F.col(f"ry{k}"))
    wide = ranked.groupBy("complex").agg(*[F.when(F.count(f"ry{k}") >= least, both(k, s)).alias(f"r{k}") for k, s in enumerate(limits)])
    each = wide.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"r{k}").alias("spearman")) for k, s in enumerate(limits)])).alias("e")).select("e.*").where("spearman is not null")
    return each.groupBy("s").agg(F.count("*").alias("n_complexes"), (F.avg("spearman") * -orientation(favorable)).alias("spearman"))


def rmsd(poses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_atoms, rmsd) over px..tz."""
    d2 = sum(((F.col(f"p{c}") - F.col(f"t{c}")) * (F.col(f"p{c}") - F.col(f"t{c}")) for c in "yz"), (F.col("px") - F.col("tx")) * (F.col("px") - F.col("tx")))
    return poses.groupBy(*keys).agg(F.count("*").alias("n_atoms"), F.sqrt(F.avg(d2)).alias("rmsd"))


def rmsd_summary(rmsds: DataFrame, value: str = "rmsd", below: tuple[float, ...] = (2, 5, 10, 20, 50)) -> DataFrame:
    """One row: mean, std (population), median, its lower form, quartiles, and the share below each limit (D12). Quantiles come from positions in a range-partitioned
    order, so no task gathers all values."""
    v = F.col(value)
    moments = rmsds.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), *[F.avg((v < b).cast("double")).alias(f"below_{b:g}") for b in below])
    middle = quantiles(rmsds, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, {"median_lower": 0.5})
    return moments.crossJoin(middle).select("mean", "std", "median_lower", "q25", "median", "q75", *[f"below_{b:g}" for b in below])


def kabsch_rmsd(poses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kabsch_rmsd): RMSD after the best rotation and translation, without reflections.

    With A the 3x3 matrix of covariances of p and t, the squared RMSD is var(p) + var(t) - 2 (s1 + s2 + sign(det A) s3), the s
    being A's singular values: roots of the eigenvalues of A'A, which a closed form gives.
    """
    axes = "xyz"
    cov = {f"a{i}{j}": F.covar_pop(f"p{i}", f"t{j}") for i in axes for j in axes}
    var = [F.var_pop(f"{s}{c}") for s in "pt" for c in axes]
    df = poses.groupBy(*keys).agg(*[c.alias(k) for k, c in cov.items()], sum(var[1:], var[0]).alias("spread"))
    a = lambda i, j: F.col(f"a{i}{j}")
    det = sum((a("x", axes[i]) * (a("y", axes[(i + 1) % 3]) * a("z", axes[(i + 2) % 3]) - a("y", axes[(i + 2) % 3]) * a("z", axes[(i + 1) % 3])) for i in (1, 2)), a("x", "x") * (a("y", "y") * a("z", "z") - a("y", "z") * a("z", "y")))
    s = {(i, j): sum((a(k, i) * a(k, j) for k in "yz"), a("x", i) * a("x", j)) for i in axes for j in axes if i <= j}
    df = df.withColumns({"det": det, **{f"s{i}{j}": c for (i, j), c in s.items()}})
    q = (F.col("sxx") + F.col("syy") + F.col("szz")) / 3
    off = F.col("sxy") * F.col("sxy") + F.col("sxz") * F.col("sxz") + F.col("syz") * F.col("syz")
    df = df.withColumn("q", q)
    square = lambda c: (F.col(c) - F.col("q")) * (F.col(c) - F.col("q"))
    df = df.withColumn("p", F.sqrt((square("sxx") + square("syy") + square("szz") + 2 * off) / 6))
    b = {k: F.try_divide(F.col(f"s{k}") - (F.col("q") if k[0] == k[1] else F.lit(0.0)), F.col("p")) for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    half = (b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])) / 2
    df = df.withColumn("phi", F.acos(clamp(F.coalesce(half, F.lit(1.0)), -1.0, 1.0)) / 3)
    first = F.col("q") + 2 * F.col("p") * F.cos("phi")
    third = F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * math.pi / 3)
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    trace = root(first) + root(3 * F.col("q") - first - third) + F.signum("det") * root(third)
    return df.select(*keys, F.sqrt(F.greatest(F.col("spread") - 2 * trace, F.lit(0.0))).alias("kabsch_rmsd"))


def centroid_distance(poses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centroid_distance)."""
    gap = [F.avg(f"p{c}") - F.avg(f"t{c}") for c in "xyz"]
    return poses.groupBy(*keys).agg(F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("centroid_distance"))


def hard_examples(poses: DataFrame, keys: list[str], cutoff: float = 5.0) -> DataFrame:
    """Complexes whose predicted centroid lies farther off than the cutoff."""
    return centroid_distance(poses, keys).where(F.col("centroid_distance") > cutoff)


def regression_metrics(df: DataFrame, pred: str, true: str, keys: list[str] | None = None) -> DataFrame:
    """n, mae, rmse, r2, pearson (1e-8 in the divisor, within [-1, 1]) and mean_loss, the squared error of the mean."""
    e = F.col(pred) - F.col(true)
    total = F.var_pop(true) * F.count(true)
    pearson = F.covar_pop(pred, true) * F.count(true) / (F.sqrt(F.var_pop(pred) * F.count(true)) * F.sqrt(total) + 1e-8)
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), total)).alias("r2"), clamp(pearson, -1.0, 1.0).alias("pearson"), F.var_pop(true).alias("mean_loss"))


def affinity_loss(df: DataFrame, pred: str, true: str, decoy: str, gap: float = 1.0) -> DataFrame:
    """One row: the mean over rows of the squared error of true rows, and of the excess of decoys above true - gap."""
    excess = F.greatest(F.col(pred) - (F.col(true) - gap), F.lit(0.0))
    return df.agg(F.avg(F.when(F.col(decoy), excess * excess).otherwise((F.col(pred) - F.col(true)) * (F.col(pred) - F.col(true)))).alias("loss"))


def value_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean_c and std_c (sample) of each column."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def contact_probability(distance: Column) -> Column:
    """1 - d / 10 within [1e-6, 0.99999], the score of a predicted distance."""
    return clamp(1 - distance / 10, 1e-6, 0.99999)


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Per key: n, bce, accuracy, auroc, and precision, recall and f1 of class 1 and 0, null where undefined (D16, D17). label is 0 or 1;
    scores in (0, 1) for bce.

    AUROC comes from counts per distinct score: each score's negatives below it and half of its own. The negatives below are sums over range partitions with
    offsets, so neither a key nor the whole table is sorted in one task.
    """
    keys = keys or []
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    flag = lambda c: F.sum(c.cast("long"))
    bce = -F.avg(F.when(y, F.ln(F.col(score))).otherwise(F.ln(1 - F.col(score))))
    base = df.groupBy(*keys).agg(F.count("*").alias("n"), bce.alias("bce"), flag(y & hit).alias("tp"), flag(~y & hit).alias("fp"), flag(y & ~hit).alias("fn"), flag(~y & ~hit).alias("tn"))
    counts = df.groupBy(*keys, F.col(score).alias("__s")).agg(flag(y).alias("p"), flag(~y).alias("q"))
    summed = sums_before(counts, keys, ["__s"], "q", "below")
    area = summed.withColumn("w", F.col("p") * (F.col("below") + F.col("q") / 2)).groupBy(*keys).agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q")).alias("auroc"))
    joined = base.join(area, keys) if keys else base.crossJoin(area)
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    f1 = lambda a, b, c: F.try_divide(2.0 * F.col(a), 2 * F.col(a) + F.col(b) + F.col(c))
    return joined.select(*keys, "n", "bce", F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("n")).alias("accuracy"), "auroc", rate("tp", "fp").alias("precision_1"), rate("tp", "fn").alias("recall_1"), f1("tp", "fp", "fn").alias("f1_1"), rate("tn", "fn").alias("precision_0"), rate("tn", "fp").alias("recall_0"), f1("tn", "fn", "fp").alias("f1_0"))


def training_filter(pockets: DataFrame, max_length: int = 100, least_contacts: int = 5) -> DataFrame:
    """(B19)"""
    return pockets.where((F.col("c_length") < max_length) & (F.col("native_num_contact") > least_contacts))


def positive_scores(df: DataFrame, favorable: str = "positive") -> DataFrame:
    """Rows with a score above 0 once larger is better, with that score."""
    return df.withColumn("score", F.col("score") * orientation(favorable)).where("score > 0")


def hits(candidates: DataFrame, threshold: float = 7.0) -> DataFrame:
    """The best row of each protein and compound, where its affinity is above the threshold."""
    return best_row(candidates, ["protein_name", "smiles"], "affinity", "pocket_name").where(F.col("affinity") > threshold)


def hits_of_sums(proteins: DataFrame, compounds: DataFrame, threshold: float = 7.0) -> DataFrame:
    """`hits` of all pairs of a protein's and a compound's pocket, (protein_name, smiles, pocket_name, affinity), where the affinity is the sum of their shares and
    the pocket's name compound_id-protein_id.

    proteins: protein_name, protein_id, protein_share; compounds: smiles, compound_id, compound_share; ids are integers. Whatever the protein, the best row of
    a compound has its largest share, or one that rounds to the same sum: sums of two doubles that agree have shares closer than 2^-50 of the largest
    sum. Of equal shares the first name wins, which does not depend on the protein as no id goes on with `-`. Only these rows of a compound, mostly
    one, meet the proteins, so that the work follows proteins and compounds and the rows of the answer.
    """
    compounds = compounds.where("compound_share is not null")
    largest = proteins.agg(F.coalesce(F.max(F.abs("protein_share")), F.lit(0.0)).alias("__s"))
    top = compounds.groupBy("smiles").agg(F.max("compound_share").alias("__m"))
    # largest is one row.
    least = top.crossJoin(F.broadcast(largest)).select("smiles", (F.col("__m") - (F.col("__s") + F.abs("__m")) * 2.0**-50).alias("__least"))
    distinct = compounds.groupBy("smiles", "compound_share").agg(F.min_by("compound_id", F.concat(F.col("compound_id").cast("string"), F.lit("-"))).alias("compound_id"))
    able = distinct.alias("d").join(least.alias("l"), F.col("d.smiles").eqNullSafe(F.col("l.smiles"))).where("compound_share >= __least").select("d.*")
    able = Scratch(proteins.sparkSession, "hits").save(able, "able")
    # Dealt by number, as the few bytes of the proteins would be one task otherwise, however many rows they make.
    dealt = proteins.repartition(int(proteins.sparkSession.conf.get("spark.sql.shuffle.partitions")), "protein_name", "protein_id")
    pocket = F.concat(F.col("compound_id").cast("string"), F.lit("-"), F.col("protein_id").cast("string")).alias("pocket_name")
    rows = dealt.crossJoin(able).select("protein_name", "smiles", pocket, (F.col("protein_share") + F.col("compound_share")).alias("affinity"))
    return hits(rows.where(F.col("affinity") > threshold), threshold)


def native_equivalent(contacts: Column, native_contacts: Column, centre_distance: Column) -> Column:
    """Does a pocket cover the native one: 0.9 of its contacts, or, where unknown, a centre within 8."""
    return F.coalesce(F.try_divide(contacts.cast("double"), native_contacts) >= 0.9, centre_distance < 8)


def pocket_selection_report(pockets: DataFrame) -> DataFrame:
    """One row: n, cover_9, cover_8, cover_5 (shares of proteins whose chosen pocket has above that share of native contacts), pearson and rmse of
    the chosen pockets' affinity_pred (D18).

    pockets: pdb, index, is_native, num_contact, native_num_contact, affinity, affinity_pred. Chosen is the best affinity_pred that is
    not native, or native where a protein has no other; ties to the smaller index.
    """
    order = F.struct(F.col("is_native").cast("int"), -F.col("affinity_pred"), F.col("index"))
    rows = pockets.where("affinity_pred is not null").groupBy("pdb").agg(F.min_by(F.struct("num_contact", "native_num_contact", "affinity", "affinity_pred"), order).alias("r")).select("r.*")
    ratio = F.try_divide(F.col("num_contact").cast("double"), F.col("native_num_contact"))
    e = F.col("affinity_pred") - F.col("affinity")
    return rows.agg(F.count("*").alias("n"), *[F.avg((ratio > x).cast("double")).alias(f"cover_{int(10 * x)}") for x in (0.9, 0.8, 0.5)], correlation("affinity_pred", "affinity").alias("pearson"), F.sqrt(F.avg(e * e)).alias("rmse"))
