"""Neighbour graphs and bond graphs as edge tables (C32, C34-C41, D27, D28, D30, B26). Points as in `spatial`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import vectors as V
from ..tables import Scratch
from .space import nearest_k
from .spatial import AXES, all_pairs, grid_join, grid_self_join


def _edges(pairs: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    return pairs.where(F.col(f"a_{id_col}") != F.col(f"b_{id_col}")).select(*keys, F.col(f"a_{id_col}").alias("src"), F.col(f"b_{id_col}").alias("dst"), "dist")


def radius_graph(nodes: DataFrame, keys: list[str], radius: float = 4.5, id_col: str = "id") -> DataFrame:
    """(keys, src, dst, dist): all pairs of other nodes below the radius, both ways."""
    points = nodes.select(*keys, id_col, *AXES)
    return _edges(grid_self_join(points, radius, keys), keys, id_col)


def knn_graph(nodes: DataFrame, keys: list[str], k: int = 30, id_col: str = "id") -> DataFrame:
    """(keys, src, dst, dist): the k nearest others of each node, ties to the smaller id, by the partition of `space`."""
    return nearest_k(nodes, nodes, keys, k, id_col, exclude_same=True).drop("rank")


def radius_knn_graph(nodes: DataFrame, keys: list[str], radius: float, max_neighbours: int, id_col: str = "id") -> DataFrame:
    """Edges to the nearest `max_neighbours` others below the radius, ties to the smaller id; a node without any gets its
    nearest other node (C34). A node alone in its structure has no edge. Nodes without any look within four times the radius first; those that have
    none there either search the partition of `space`."""
    near = Window.partitionBy(*keys, "src").orderBy("dist", "dst")
    edges = radius_graph(nodes, keys, radius, id_col).withColumn("__k", F.row_number().over(near)).where(F.col("__k") <= max_neighbours).drop("__k")
    points = nodes.select(*keys, id_col, *AXES)
    scratch = Scratch(nodes.sparkSession, "radius-knn")
    edges = scratch.save(edges, "edges")
    alone = scratch.save(points.join(edges.select(*keys, F.col("src").alias(id_col)).distinct(), [*keys, id_col], "left_anti"), "alone")
    wider = _edges(grid_join(alone, points, 4 * radius, keys), keys, id_col)
    first = wider.groupBy(*keys, "src").agg(F.min(F.struct("dist", "dst")).alias("m"))
    close = scratch.save(first.select(*keys, "src", F.col("m.dst").alias("dst"), F.col("m.dist").alias("dist")), "close")
    far = scratch.save(alone.join(close.select(*keys, F.col("src").alias(id_col)), [*keys, id_col], "left_anti"), "far")
    return edges.unionByName(close).unionByName(nearest_k(far, points, keys, 1, id_col, exclude_same=True).drop("rank"))


def limited_edges(nodes: DataFrame, keys: list[str], cutoff: float, limit: int, id_col: str = "id") -> DataFrame:
    """(keys, src, dst, dist) up to the cutoff, a node with itself included; where a structure has more than `limit` edges, those up to its
    limit-th smallest distance, with all ties (C37, F4)."""
    points = nodes.select(*keys, id_col, *AXES)
    pairs = grid_self_join(points, cutoff, keys, inclusive=True).select(*keys, F.col(f"a_{id_col}").alias("src"), F.col(f"b_{id_col}").alias("dst"), "dist")
    return pairs.withColumn("__k", F.rank().over(Window.partitionBy(*keys).orderBy("dist"))).where(F.col("__k") <= limit).drop("__k")


def reindex_edges(nodes: DataFrame, edges: DataFrame, keys: list[str], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Kept nodes with a dense index from 0, and the edges between them by index."""
    indexed = nodes.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy(id_col)) - 1)
    index = lambda end: indexed.select(*keys, F.col(id_col).alias(end), F.col("index").alias(f"{end}_index"))
    return indexed, edges.join(index("src"), [*keys, "src"]).join(index("dst"), [*keys, "dst"])


def finish_graph(nodes: DataFrame, edges: DataFrame, keys: list[str], id_col: str = "id", self_loops: bool = False) -> DataFrame:
    """(keys, src, dst): edges both ways, once each, without loops unless asked for; a node without an edge stays as a row with a
    null dst (C38)."""
    ends = edges.select(*keys, "src", "dst")
    both = ends.unionByName(ends.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = both if self_loops else both.where("src <> dst")
    isolated = nodes.select(*keys, F.col(id_col).alias("src")).join(both.select(*keys, "src").distinct(), [*keys, "src"], "left_anti")
    return both.unionByName(isolated.withColumn("dst", F.lit(None).cast(both.schema["dst"].dataType)))


def hierarchical_edges(surface: DataFrame, residues: DataFrame, keys: list[str], residue: str, id_col: str, surface_radius: float, residue_radius: float, max_neighbours: int) -> DataFrame:
    """(keys, kind, src, dst, dist): each surface atom with its residue's CA (membership), and the graphs of surface atoms
    (surface) and of CA atoms (residue) (C39). residues: keys, residue, x, y, z."""
    atoms, ca = surface.select(*keys, residue, id_col, *AXES), residues.select(*keys, residue, *AXES)
    joined = all_pairs(ca, atoms, [*keys, residue])
    member = joined.select(*keys, F.lit("membership").alias("kind"), F.col(residue).cast("string").alias("src"), F.col(f"b_{id_col}").cast("string").alias("dst"), "dist")
    typed = lambda edges, kind: edges.select(*keys, F.lit(kind).alias("kind"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "dist")
    return member.unionByName(typed(radius_knn_graph(atoms, keys, surface_radius, max_neighbours, id_col), "surface")).unionByName(typed(radius_knn_graph(ca, keys, residue_radius, max_neighbours, residue), "residue"))


def bond_neighbours(bonds: DataFrame, keys: list[str], hops: int = 2, rings: DataFrame | None = None) -> DataFrame:
    """(keys, src, dst): atoms within `hops` bonds, and with rings (keys, ring, atom) the members of a common ring.
    bonds: keys, src, dst, each bond once or both ways."""
    ends = bonds.select(*keys, "src", "dst")
    one = ends.unionByName(ends.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    out = reached = one
    for _ in range(hops - 1):
        step = one.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("__next"))
        reached = reached.join(step, [*keys, "dst"]).select(*keys, "src", F.col("__next").alias("dst")).distinct()
        out = out.unionByName(reached)
    if rings is not None:
        out = out.unionByName(ring_pairs(rings, keys))
    return out.where("src <> dst").distinct()


def ring_pairs(rings: DataFrame, keys: list[str]) -> DataFrame:
    a, b = rings.select(*keys, "ring", F.col("atom").alias("src")), rings.select(*keys, "ring", F.col("atom").alias("dst"))
    return a.join(b, [*keys, "ring"]).select(*keys, "src", "dst")


def flex_mask(bonds: DataFrame, rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst) of atoms whose distance a torsion leaves alone: within two bonds, or in a common ring, or the same."""
    atoms = bonds.select(*keys, F.col("src").alias("a")).unionByName(bonds.select(*keys, F.col("dst").alias("a"))).distinct()
    return bond_neighbours(bonds, keys, 2, rings).unionByName(atoms.select(*keys, F.col("a").alias("src"), F.col("a").alias("dst")))


def polar_hydrogens_only(atoms: DataFrame, bonds: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Without the hydrogens whose only neighbour is a carbon."""
    ends = bonds.select(*keys, "src", "dst")
    both = ends.unionByName(ends.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    other = atoms.select(*keys, F.col(id_col).alias("dst"), F.col("element").alias("near"))
    single = both.join(other, [*keys, "dst"]).groupBy(*keys, F.col("src").alias(id_col)).agg(F.count("*").alias("n"), F.max("near").alias("near")).where("n = 1 and near = 'C'")
    drop = atoms.where("element = 'H'").select(*keys, id_col).join(single.select(*keys, id_col), [*keys, id_col], "left_semi")
    return atoms.join(drop, [*keys, id_col], "left_anti")


def edge_angles(edges: DataFrame, normals: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """edges with angle, in radians, between the normals of their ends; 0 where one is missing or zero."""
    of = lambda end: normals.select(*keys, F.col(id_col).alias(end), F.col("normal").alias(f"__{end}"))
    joined = edges.join(of("src"), [*keys, "src"], "left").join(of("dst"), [*keys, "dst"], "left")
    return joined.withColumn("angle", V.angle(F.col("__src"), F.col("__dst"))).drop("__src", "__dst")


def mean_vector_ratio(edges: DataFrame, nodes: DataFrame, keys: list[str], sigmas: tuple[float, ...] = (1.0, 2.0, 5.0, 10.0, 30.0), id_col: str = "id") -> DataFrame:
    """(keys, src, ratio_<sigma> ...): length of the weighted mean of the vectors to a node's neighbours over the weighted mean of their
    lengths, weights exp(-d^2 / sigma) that add up to 1 (D28)."""
    at = lambda end: nodes.select(*keys, F.col(id_col).alias(end), *[F.col(c).alias(f"{end}_{c}") for c in AXES])
    joined = edges.join(at("src"), [*keys, "src"]).join(at("dst"), [*keys, "dst"])
    d2 = F.col("dist") * F.col("dist")
    out = []
    for s in sigmas:
        # The nearest neighbour's weight is 1 before scaling, so that none underflows.
        w = F.exp(-(d2 - F.col("__least")) / s)
        length = F.sqrt(sum((F.pow(F.sum(w * (F.col(f"src_{c}") - F.col(f"dst_{c}"))), F.lit(2.0)) for c in AXES[1:]), F.pow(F.sum(w * (F.col("src_x") - F.col("dst_x"))), F.lit(2.0))))
        out.append(F.try_divide(length, F.sum(w * F.col("dist"))).alias(f"ratio_{s:g}"))
    joined = joined.withColumn("__least", F.min(d2).over(Window.partitionBy(*keys, "src")))
    return joined.groupBy(*keys, "src").agg(*out)


def torsion_angles(bonds: DataFrame, atoms: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """(keys, src, dst, torsion) of each bond with rotatable = true whose ends have other neighbours: the dihedral, in degrees, between the means of
    those, each weighted by its bond length (D30). bonds: keys, src, dst, rotatable, each bond once."""
    ends = bonds.select(*keys, "src", "dst")
    both = ends.unionByName(ends.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    at = atoms.select(*keys, F.col(id_col).alias("n"), *AXES)
    points = atoms.select(*keys, id_col, V.vec(*AXES).alias("v"))

    def side(end: str, other: str) -> DataFrame:
        near = bonds.where("rotatable").select(*keys, "src", "dst").join(both.select(*keys, F.col("src").alias(end), F.col("dst").alias("n")), [*keys, end]).where(F.col("n") != F.col(other))
        own = points.select(*keys, F.col(id_col).alias(end), F.col("v").alias("own"))
        near = near.join(at, [*keys, "n"]).join(own, [*keys, end]).withColumn("w", V.distance(V.vec(*AXES), F.col("own")))
        mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(c)
        return near.groupBy(*keys, "src", "dst").agg(F.struct(*[mean(c) for c in AXES]).alias(f"mean_{end}"), F.first("own").alias(f"at_{end}"))

    joined = side("src", "dst").join(side("dst", "src"), [*keys, "src", "dst"])
    return joined.select(*keys, "src", "dst", V.dihedral(F.col("mean_src"), F.col("at_src"), F.col("at_dst"), F.col("mean_dst")).alias("torsion"))
