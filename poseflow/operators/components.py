"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component.

    Edges are undirected and of any orderable type; edges with a null end, loops and repeats count for nothing. A
    node without an edge to another node has no row.

    Each round points every node's larger neighbours, and then itself and its smaller ones, at the smallest node
    known to each, until nothing changes (a logarithmic number of rounds in practice). The smallest neighbours are
    a table of their own that the edges join, so a node with many edges is a skewed join, which adaptive execution
    splits, and no group is ever held together.
    """
    scratch = Scratch(edges.sparkSession, "components")

    def towards_smallest(pairs: DataFrame, name: str, larger_only: bool) -> DataFrame:
        least = scratch.save(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        joined = pairs.join(least, "u")
        if larger_only:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    now = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct(), "edges0")
    state = None
    for k in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.save(towards_smallest(both, f"large{k}", True), f"large{k}")
        downward = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        last, now = now, scratch.save(towards_smallest(downward, f"small{k}", False), f"edges{k + 1}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"large{k}-least", f"large{k}", f"small{k}-least", f"edges{k}")
        if seen == state or not seen[0]:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
