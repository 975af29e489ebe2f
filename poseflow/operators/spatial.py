"""Distance joins (C20-C23, C27-C31, C33, C42, C45-C47, I9): the grid join, and where there is no radius the partition of `space`.

Points are rows with key columns (structure, complex, ...) and x, y, z. Rows with a null key or coordinate are near nothing.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..tables import Scratch
from .components import connected_components
from .space import AXES, nearest_k


def _sided(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])


def _squared() -> Column:
    return sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in AXES[1:]), (F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x")))


def grid_join(a: DataFrame, b: DataFrame, cutoff: float | str, keys: list[str], inclusive: bool = False) -> DataFrame:
    """All pairs of a row of a and a row of b with equal keys and a distance below the cutoff (up to it, if inclusive). The cutoff may be a
    column of both, the same within the keys.

    Returns the keys, the other columns as a_* and b_*, and dist. Both sides get a cell of side `cutoff`; b goes to its own and the 26 cells
    around, an equi join on keys and cell brings each pair together once, and the distance decides. The work follows
    the number of close pairs, and a large structure is spread over tasks by its cells. Points sent around are merged, never broadcast: Spark expects
    of them the size before.
    """
    wide = lambda side: F.col(f"{side}_{cutoff}") if isinstance(cutoff, str) else F.lit(cutoff)
    cell = lambda side, c: F.floor(F.col(f"{side}_{c}") / wide(side)).cast("long")
    left = _sided(a, keys, "a").withColumn("__cell", F.struct(*[cell("a", c).alias(c) for c in AXES]))
    steps = F.array(*[F.struct(*[F.lit(s).cast("long").alias(c) for c, s in zip(AXES, (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    right = _sided(b, keys, "b").withColumn("__step", F.explode(steps))
    right = right.withColumn("__cell", F.struct(*[(cell("b", c) + F.col(f"__step.{c}")).alias(c) for c in AXES])).drop("__step")
    near = _squared() <= wide("a") * wide("a") if inclusive else _squared() < wide("a") * wide("a")
    return left.join(right.hint("merge"), [*keys, "__cell"]).where(near).withColumn("dist", F.sqrt(_squared())).drop("__cell")


#: The cell itself and half of the 26 around it: of two neighbouring cells one is the other's.
HALF_SHELL = [s for s in itertools.product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)]


def _half_shell(points: DataFrame, cutoff: float, keys: list[str]) -> DataFrame:
    """Rows a and b of equal keys in one cell, both ways and with themselves, and rows of neighbouring cells, one way; ahead: are they of two cells?"""
    left = _sided(points, keys, "a").withColumn("__cell", F.struct(*[F.floor(F.col(f"a_{c}") / cutoff).cast("long").alias(c) for c in AXES]))
    steps = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(AXES, s)]) for s in HALF_SHELL])
    right = _sided(points, keys, "b").withColumn("__step", F.explode(steps))
    right = right.withColumn("__cell", F.struct(*[(F.floor(F.col(f"b_{c}") / cutoff).cast("long") + F.col(f"__step.{c}")).alias(c) for c in AXES]))
    ahead = F.lit(False)
    for c in AXES:
        ahead = ahead | (F.col(f"__step.{c}") != 0)
    return left.join(right.withColumn("__ahead", ahead).drop("__step").hint("merge"), [*keys, "__cell"]).drop("__cell")


def grid_self_join(points: DataFrame, cutoff: float, keys: list[str], inclusive: bool = False) -> DataFrame:
    """`grid_join` of a table with itself: each row with itself, and each pair both ways. Points go to 14 cells instead of 27, a pair of two cells meets
    once, and its mirror image is made after the distance test."""
    near = _squared() <= cutoff * cutoff if inclusive else _squared() < cutoff * cutoff
    met = _half_shell(points, cutoff, keys).where(near).withColumn("dist", F.sqrt(_squared()))
    names = [c for c in points.columns if c not in keys]
    as_is = F.struct(*[F.col(f"{side}_{c}").alias(f"{side}_{c}") for side in "ab" for c in names])
    mirrored = F.struct(*[F.col(f"{other}_{c}").alias(f"{side}_{c}") for side, other in ("ab", "ba") for c in names])
    both = F.explode(F.when(F.col("__ahead"), F.array(as_is, mirrored)).otherwise(F.array(as_is)))
    return met.select(*keys, both.alias("p"), "dist").select(*keys, "p.*", "dist")


#: Rows of the left side that a task multiplies at a time in `product`.
BLOCK = 1000


def product(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a join b on the keys, where most pairs are the answer: a key's rows of a are dealt into blocks of about BLOCK, and its rows of b go to each block, so that a
    large key is many groups of one block times its rows of b."""
    sizes = a.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("__n"))
    left = a.join(sizes, keys).withColumn("__block", F.pmod(F.xxhash64(*[c for c in a.columns if c not in keys]), F.col("__n"))).drop("__n")
    right = b.join(sizes, keys).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
    # Dealt by number: by their few bytes these sides would be few tasks, however many pairs they make.
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(n, *keys, "__block")
    return dealt(left).join(dealt(right).hint("merge"), [*keys, "__block"]).drop("__block")


def all_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair within equal keys with its dist: the whole product is the answer, spread over blocks of each structure."""
    return product(_sided(a, keys, "a"), _sided(b, keys, "b"), keys).withColumn("dist", F.sqrt(_squared()))


def near_atoms(a: DataFrame, b: DataFrame, cutoff: float, keys: list[str], columns: list[str]) -> DataFrame:
    """Distinct pairs of the given columns of points closer than the cutoff. With residue columns and heavy atoms it is
    C20, with atom columns C21, on CA atoms C22 and C23."""
    narrow = lambda df: df.select(*keys, *columns, *[c for c in AXES if c not in columns])
    near = grid_self_join(narrow(a), cutoff, keys) if a is b else grid_join(narrow(a), narrow(b), cutoff, keys)
    return near.select(*keys, *[f"a_{c}" for c in columns], *[f"b_{c}" for c in columns]).distinct()


def chain_pairs(atoms: DataFrame, cutoff: float, structure: str = "pdb_name", chain: str = "chain") -> DataFrame:
    """(structure, chain_0, chain_1, n_contacts, pair_id): ordered pairs of chains with points closer than the cutoff,
    numbered from 0 within the structure (C24)."""
    near = grid_self_join(atoms.select(structure, chain, *AXES), cutoff, [structure]).where(F.col(f"a_{chain}") < F.col(f"b_{chain}"))
    found = near.groupBy(structure, F.col(f"a_{chain}").alias("chain_0"), F.col(f"b_{chain}").alias("chain_1")).agg(F.count("*").alias("n_contacts"))
    return found.withColumn("pair_id", F.row_number().over(Window.partitionBy(structure).orderBy("chain_0", "chain_1")) - 1)


def busiest_pair(pairs: DataFrame, structure: str = "pdb_name") -> DataFrame:
    """The pair with most contacts of each structure, the first of equal ones."""
    best = Window.partitionBy(structure).orderBy(F.desc("n_contacts"), "pair_id")
    return pairs.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")


def nearest(a: DataFrame, b: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, a_id, b_id, dist): for each row of a its nearest row of b with equal keys, ties to the smaller id (C27). A row whose keys b has not is
    left out."""
    found = nearest_k(a, b, keys, 1, id_col)
    return found.select(*keys, F.col("src").alias(f"a_{id_col}"), F.col("dst").alias(f"b_{id_col}"), "dist")


def _first_shell(a: DataFrame, b: DataFrame, keys: list[str], cutoff: float, id_col: str, least: int = 4, step: float = 0.5) -> DataFrame:
    """The pairs of `grid_join` within the first cutoff + k * step below which the structure has `least` pairs, or all of fewer.

    The `least` closest pairs of a structure are among the pairs of each row of a with its `least` nearest rows of b; their largest distance gives
    the structure's cutoff, and only pairs within it are made.
    """
    scratch = Scratch(a.sparkSession, "shell")
    near = scratch.save(nearest_k(a.withColumn("__a", F.struct(id_col, *AXES)), b.withColumn("__b", F.struct(id_col, *AXES)), keys, least, "__a", "__b"), "near")
    smallest = near.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "src", "dst"))).where(F.col("__k") <= least)
    last = smallest.groupBy(*keys).agg(F.count("*").alias("__n"), F.max("dist").alias("__d"))
    shells = F.greatest(F.floor((F.col("__d") - cutoff) / step) + 1, F.lit(0))
    # A structure with fewer pairs has them all within its largest distance.
    wide = F.when(F.col("__n") == least, cutoff + step * shells).otherwise(F.col("__d") * (1 + 1e-9) + 1e-9)
    sized = scratch.save(last.select(*keys, wide.alias("__r")), "sized")
    return grid_join(a.join(sized, keys), b.join(sized, keys), "__r", keys)


def pocket_points(ligand: DataFrame, receptor: DataFrame, keys: list[str], cutoff: float, mode: str, id_col: str = "id") -> DataFrame:
    """Points that stand for the binding pocket (C28): keys, id (of the ligand atom), x, y, z. Modes:

    lig_atoms: the ligand's atoms. match_atoms: mid-points to the nearest receptor atom, where it is within the cutoff.
    match_atoms_to_lig: ligand atoms with a receptor atom within the cutoff. match_terminal_atoms: as match_atoms, of atoms whose
    column degree is at most 1. radius_based: mid-points of all pairs within the first cutoff + 0.5 k below which
    there are four pairs (all pairs, if there are fewer): that follows from the fourth smallest distance (see `_first_shell`).
    """
    if mode == "lig_atoms":
        return ligand.select(*keys, id_col, *AXES)
    if mode == "radius_based":
        pairs = _first_shell(ligand.select(*keys, id_col, *AXES), receptor.select(*keys, id_col, *AXES), keys, cutoff, id_col)
        return pairs.select(*keys, F.col(f"a_{id_col}").alias(id_col), *[((F.col(f"a_{c}") + F.col(f"b_{c}")) / 2).alias(c) for c in AXES])
    atoms = ligand.where("degree <= 1") if mode == "match_terminal_atoms" else ligand
    atoms = atoms.select(*keys, id_col, *AXES)
    close = grid_join(atoms, receptor.select(*keys, id_col, *AXES), cutoff, keys)
    best = close.groupBy(*keys, f"a_{id_col}").agg(F.min_by(F.struct(*[f"{s}_{c}" for s in "ab" for c in AXES]), F.struct("dist", f"b_{id_col}")).alias("p"))
    point = (lambda c: F.col(f"p.a_{c}")) if mode == "match_atoms_to_lig" else (lambda c: (F.col(f"p.a_{c}") + F.col(f"p.b_{c}")) / 2)
    return best.select(*keys, F.col(f"a_{id_col}").alias(id_col), *[point(c).alias(c) for c in AXES])


def pocket_residues(receptor: DataFrame, ligand: DataFrame, keys: list[str], residue: list[str], distance: float = 6.0) -> DataFrame:
    """Residues with an atom at most `distance` from, but not at, a ligand atom, with min_dist."""
    near = grid_join(receptor.select(*keys, *residue, *AXES), ligand.select(*keys, *AXES), distance, keys, inclusive=True).where("dist > 0")
    return near.groupBy(*keys, *[F.col(f"a_{c}").alias(c) for c in residue]).agg(F.min("dist").alias("min_dist"))


def chains_near_ligand(receptor: DataFrame, ligand: DataFrame, keys: list[str], cutoff: float, chain: str = "chain", water: str = "is_water", fallback: bool = True) -> DataFrame:
    """(keys, chain, min_dist): chains with an atom closer to the ligand than the cutoff, and where there are none the closest
    one (ties to the smaller name), unless not `fallback`; water chains never (C30). A grid join finds the chains; in structures without any, each
    ligand atom looks for its nearest one."""
    atoms = receptor.where(~F.coalesce(F.col(water), F.lit(False))).select(*keys, chain, *AXES)
    lig = ligand.select(*keys, *AXES)
    least = lambda pairs: pairs.groupBy(*keys, F.col(f"a_{chain}").alias(chain)).agg(F.min("dist").alias("min_dist"))
    near = least(grid_join(atoms, lig, cutoff, keys))
    if not fallback:
        return near
    near = Scratch(receptor.sparkSession, "chains").save(near, "near")
    left = atoms.join(near.select(*keys).distinct(), keys, "left_anti")
    rest = nearest_k(lig.withColumn("__id", F.struct(*AXES)), left, keys, 1, "__id", chain)
    first = rest.groupBy(*keys).agg(F.min(F.struct("dist", "dst")).alias("m")).select(*keys, F.col("m.dst").alias(chain), F.col("m.dist").alias("min_dist"))
    return near.unionByName(first)


def nodes_in_pocket(nodes: DataFrame, centres: DataFrame, keys: list[str], radius: float = 20.0, least: int = 5, first: int = 100, id_col: str = "id") -> DataFrame:
    """Nodes within the radius of a centre of their structure; where fewer than `least` are, also the `first` first by
    id (C31)."""
    inside = grid_join(nodes.select(*keys, id_col, *AXES), centres.select(*keys, *AXES), radius, keys).select(*keys, F.col(f"a_{id_col}").alias(id_col)).distinct().withColumn("__in", F.lit(True))
    whole = Window.partitionBy(*keys)
    marked = nodes.join(inside, [*keys, id_col], "left").withColumn("__n", F.count("__in").over(whole)).withColumn("__k", F.row_number().over(whole.orderBy(id_col)))
    return marked.where(F.col("__in") | ((F.col("__n") < least) & (F.col("__k") <= first))).drop("__in", "__n", "__k")


def ball(atoms: DataFrame, centres: DataFrame, keys: list[str], radius: float = 30.0) -> DataFrame:
    """Heavy atoms within the radius, inclusive, of a centre: keys, a_* of the atom, b_* of the centre, dist."""
    return grid_join(atoms.where("element <> 'H'"), centres, radius, keys, inclusive=True)


def contact_map(protein: DataFrame, ligand: DataFrame, keys: list[str], id_col: str = "id", contact: float = 8.0, clamp: float = 10.0) -> DataFrame:
    """(keys, a_id, b_id, dist clamped, label): every protein node with every ligand atom."""
    pairs = all_pairs(protein.select(*keys, id_col, *AXES), ligand.select(*keys, id_col, *AXES), keys)
    return pairs.select(*keys, f"a_{id_col}", f"b_{id_col}", F.least("dist", F.lit(clamp)).alias("dist"), (F.col("dist") < contact).alias("label"))


def _sized(a: DataFrame, b: DataFrame, keys: list[str], radius: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with __na and __nb, their numbers of points per structure, and __r, a radius made of these. Structures of one side only go."""
    known = lambda df: df.where(" and ".join(f"`{c}` is not null" for c in (*keys, *AXES)))
    a, b = known(a), known(b)
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    sizes = Scratch(a.sparkSession, "sizes").save(count(a, "__na").join(count(b, "__nb"), keys).withColumn("__r", radius), "sizes")
    return a.join(sizes, keys), b.join(sizes, keys)


def clash_score(ligand: DataFrame, receptor: DataFrame, keys: list[str], aggression: float = 0.0, epsilon: float = 1e-12) -> DataFrame:
    """(keys, clash): sum over pairs of exp(-0.2 d^2 max(4 d^2 - 8, 1)), times 1 + aggression.

    Only pairs within a radius are made, beyond which all pairs of the structure together give less than `epsilon`: with n pairs of points that is
    where n times the kernel is epsilon, sqrt(1 + sqrt(1 + 1.25 log(n / epsilon))), about 2.9 for a million pairs. The sum is never above
    the whole one, and short of it by less than epsilon (1 + aggression)."""
    n = F.greatest(F.col("__na").cast("double") * F.col("__nb"), F.lit(1.0))
    radius = F.greatest(F.sqrt(1 + F.sqrt(1 + 1.25 * F.log(n / epsilon))), F.lit(1.5))
    a, b = _sized(ligand.select(*keys, *AXES), receptor.select(*keys, *AXES), keys, radius)
    d2 = F.col("dist") * F.col("dist")
    near = grid_join(a, b, "__r", keys).groupBy(*keys).agg((F.sum(F.exp(-0.2 * d2 * F.greatest(4 * d2 - 8, F.lit(1.0)))) * (1 + aggression)).alias("clash"))
    return a.select(*keys).distinct().join(near, keys, "left").withColumn("clash", F.coalesce("clash", F.lit(0.0)))


def surface_clash(ligand: DataFrame, receptor: DataFrame, keys: list[str], id_col: str = "id", sigma: float = 25.0, surface: float = 10.0, epsilon: float = 1e-9) -> DataFrame:
    """(keys, clash): means over both sides of max(surface - G, 0) with G = -sigma log(1e-3 + sum exp(-d^2 / sigma)).

    A point whose sum is below exp(-surface / sigma) counts nothing, and above that the term changes by at most sigma exp(surface / sigma) times
    what the sum lacks. So pairs are made within the radius sqrt(sigma log(n sigma exp(surface / sigma) / epsilon)) alone, n being
    the structure's points on the larger side: each side's mean is short of the whole one by less than epsilon."""
    n = F.greatest(F.col("__na"), F.col("__nb"))
    radius = F.sqrt(sigma * F.greatest(F.log(n * (sigma * math.exp(surface / sigma) / epsilon)), F.lit(1.0)))
    scratch = Scratch(ligand.sparkSession, "surface")
    a, b = _sized(ligand.select(*keys, id_col, *AXES), receptor.select(*keys, id_col, *AXES), keys, radius)
    kernel = F.exp(-F.col("dist") * F.col("dist") / sigma).alias("e")
    sizes = [F.col(f"a_{n}") for n in ("__na", "__nb")]
    pairs = scratch.save(grid_join(a, b, "__r", keys).select(*keys, f"a_{id_col}", f"b_{id_col}", *sizes, kernel), "pairs")
    g = -sigma * F.log(1e-3 + F.sum("e"))

    def side(s: str) -> DataFrame:
        points = pairs.groupBy(*keys, f"{s}_{id_col}", f"a___n{s}").agg(g.alias("g"))
        return points.groupBy(*keys).agg((F.sum(F.greatest(surface - F.col("g"), F.lit(0.0))) / F.first(f"a___n{s}")).alias(s))

    zero = F.lit(0.0)
    both = a.select(*keys).distinct().join(side("a"), keys, "left").join(side("b"), keys, "left")
    return both.select(*keys, (F.coalesce("a", zero) + F.coalesce("b", zero)).alias("clash"))


def residue_similarity(atoms: DataFrame, keys: list[str], residue: str, sigma: float = 2.0, threshold: float = 1e-3) -> DataFrame:
    """(keys, a_residue, b_residue, similarity): exp(-d^2 / (2 sigma^2)) of the smallest atom distance of two residues, both orders
    and each with itself, where it exceeds the threshold, which makes the radius finite (C46). Count by a_residue
    for the coordination number (D24)."""
    radius = sigma * math.sqrt(-2 * math.log(threshold))
    near = grid_self_join(atoms.select(*keys, residue, *AXES), radius, keys)
    d = near.groupBy(*keys, f"a_{residue}", f"b_{residue}").agg(F.min("dist").alias("d"))
    return d.select(*keys, f"a_{residue}", f"b_{residue}", F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma)).alias("similarity"))


def coordination_number(similar: DataFrame, keys: list[str], residue: str) -> DataFrame:
    """(keys, residue, cn): similar residues, itself included."""
    return similar.groupBy(*keys, F.col(f"a_{residue}").alias(residue)).agg(F.count("*").alias("cn"))


def connected_structures(atoms: DataFrame, structure: str = "pdb_name", chain: str = "chain", cutoff: float = 5.0) -> DataFrame:
    """(structure, n_chains, n_parts, connected): are all chains joined by contacts below the cutoff?"""
    name = F.to_json(F.struct(structure, chain))
    chains = atoms.select(structure, chain, name.alias("node")).distinct()
    pairs = chain_pairs(atoms, cutoff, structure, chain)
    link = lambda c: F.to_json(F.struct(structure, F.col(c).alias(chain)))
    roots = connected_components(pairs.select(link("chain_0").alias("a"), link("chain_1").alias("b")))
    placed = chains.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return placed.groupBy(structure).agg(F.count("*").alias("n_chains"), F.countDistinct("root").alias("n_parts")).withColumn("connected", F.col("n_parts") == 1)


def subgraph_near(receptor: DataFrame, ligand: DataFrame, keys: list[str], radius: float = 10.0, id_col: str = "id") -> DataFrame:
    """Receptor atoms closer to the ligand than the radius."""
    near = grid_join(receptor.select(*keys, id_col, *AXES), ligand.select(*keys, *AXES), radius, keys).select(*keys, F.col(f"a_{id_col}").alias(id_col)).distinct()
    return receptor.join(near, [*keys, id_col], "left_semi")
