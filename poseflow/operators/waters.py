"""Conserved waters of superposed structures."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..tables import Scratch
from .components import connected_components
from .spatial import AXES, _half_shell, grid_self_join


def _filtered(waters: DataFrame, bad: Column, query: str | None) -> DataFrame:
    """Without bad waters, and without proteins of which more than half are bad; the query protein stays whole."""
    by = Window.partitionBy("protein")
    bad = F.coalesce(bad, F.lit(False))
    marked = waters.withColumn("__bad", bad).withColumn("__drop", F.count_if(F.col("__bad")).over(by) * 2 > F.count("*").over(by))
    keep = ~F.col("__bad") & ~F.col("__drop")
    if query is not None:
        keep = keep | (F.col("protein") == query)
    return marked.where(keep).drop("__bad", "__drop")


def mobility_filter(waters: DataFrame, cutoff: float = 2.0, query: str | None = None) -> DataFrame:
    """Drops waters whose b-factor over the protein's mean, over the same of the occupancy, reaches the cutoff."""
    by = Window.partitionBy("protein")
    mobility = F.try_divide(F.try_divide(F.col("bfactor"), F.avg("bfactor").over(by)), F.try_divide(F.col("occupancy"), F.avg("occupancy").over(by)))
    return _filtered(waters, mobility >= cutoff, query)


def bfactor_filter(waters: DataFrame, cutoff: float = 1.0, query: str | None = None) -> DataFrame:
    """Drops waters whose b-factor lies `cutoff` standard deviations or more above the protein's mean."""
    by = Window.partitionBy("protein")
    return _filtered(waters, F.try_divide(F.col("bfactor") - F.avg("bfactor").over(by), F.stddev_pop("bfactor").over(by)) >= cutoff, query)


#: Scales, as shares of the distance, at which tight and lonely groups of waters are looked for.
SCALES = (1.0, 0.6, 0.3)


def _box() -> list[Column]:
    return [f(c).alias(f"{c}_{side}") for c in AXES for side, f in (("lo", F.min), ("hi", F.max))]


def _box_gap(a: str, b: str) -> Column:
    """The distance of two boxes."""
    gaps = [F.greatest(F.col(f"{a}_{c}_lo") - F.col(f"{b}_{c}_hi"), F.col(f"{b}_{c}_lo") - F.col(f"{a}_{c}_hi"), F.lit(0.0)) for c in AXES]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def _diagonal() -> Column:
    spans = [F.col(f"{c}_hi") - F.col(f"{c}_lo") for c in AXES]
    return F.sqrt(spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2])


def _merge(df: DataFrame) -> DataFrame:
    """df for a join by sorting: tables of waters, cells and clusters grow with the structures, so none of them may pass whole through the driver as a broadcast."""
    return df.hint("merge")


def _sided(df: DataFrame, side: str, *but: str) -> DataFrame:
    return df.select(*but, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in but])


def tight_groups(points: DataFrame, scale: float, scratch: Scratch, name: str) -> DataFrame:
    """(wid, cluster) of the groups of points that lie within `scale` of each other, and farther than that from all others.

    Points fall into cells of the scale, of which the box around their points is all that is looked at. Cells are near if their boxes are within
    the scale. If a group's diameter is at most the scale, all its cells are near each other, and if it is lonely they are near to
    no others: so it is known by all its cells having it, and nothing else, as their near cells. The work follows cells, not pairs of points; of two cells
    one is sent around, to 40 of the 80 places that can be near. Cells sent around are merged: Spark expects of them the size before, and would broadcast them.
    """
    cell = F.struct(*[F.floor(F.col(c) / scale).cast("long").alias(c) for c in AXES])
    placed = points.withColumn("cell", cell)
    cells = scratch.save(placed.groupBy("cell").agg(F.min("wid").alias("first"), *_box()), f"{name}-cells")
    # Boxes of cells d steps apart on an axis are d - 1 sides apart at least.
    steps = [s for s in itertools.product(range(-2, 3), repeat=3) if s > (0, 0, 0) and sum(max(abs(x) - 1, 0) for x in s) <= 1]
    step = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(AXES, s)]) for s in steps])).alias("step")
    around = _sided(cells.drop("first"), "b").select("*", step)
    around = around.withColumn("a_cell", F.struct(*[(F.col(f"b_cell.{c}") + F.col(f"step.{c}")).alias(c) for c in AXES])).drop("step")
    near = _sided(cells.drop("first"), "a").join(_merge(around), "a_cell").where(_box_gap("a", "b") <= scale)
    both = F.explode(F.array(F.struct(F.col("a_cell").alias("cell"), F.col("b_cell").alias("other")), F.struct(F.col("b_cell").alias("cell"), F.col("a_cell").alias("other"))))
    linked = near.select(both.alias("p")).select("p.*").unionByName(cells.select("cell", F.col("cell").alias("other")))
    known = linked.groupBy("cell").agg(F.min("other").alias("least"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("other")).alias("print"))
    known = scratch.save(known.join(_merge(cells), "cell"), f"{name}-known")
    whole = [f(f"{c}_{x}").alias(f"{c}_{x}") for c in AXES for x, f in (("lo", F.min), ("hi", F.max))]
    groups = known.groupBy("least").agg(
        F.count("*").alias("size"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("print").alias("print_lo"), F.max("print").alias("print_hi"),
        F.bit_xor(F.xxhash64("cell")).alias("own"), F.min("first").alias("cluster"), *whole,
    )
    sound = groups.where("n_lo = size and n_hi = size and print_lo = own and print_hi = own").where(_diagonal() <= scale).select("least", "cluster")
    return placed.select("wid", "cell").join(_merge(known.select("cell", "least").join(_merge(sound), "least").select("cell", "cluster")), "cell").select("wid", "cluster")


def _contracted(points: DataFrame, distance: float, scratch: Scratch) -> DataFrame:
    """points with cluster: that of their tight group at the largest scale that has one, else themselves. Such a group is a cluster of complete and of average
    linkage at a height of at most the scale, before anything else joins it, so that clustering may start from there."""
    left, done = points, []
    for k, share in enumerate(SCALES):
        found = scratch.save(tight_groups(left, share * distance, scratch, f"tight{k}"), f"tight{k}")
        done.append(found)
        left = scratch.save(left.join(_merge(found.select("wid")), "wid", "left_anti"), f"loose{k}")
    every = functools.reduce(DataFrame.union, [*done, left.select("wid", F.col("wid").alias("cluster"))])
    return points.join(_merge(every), "wid").select("wid", "cluster", "w", *AXES)


def _apart(a: str, b: str) -> Column:
    d = [F.col(f"{a}_{c}") - F.col(f"{b}_{c}") for c in AXES]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


#: A level's radius is so many times that of the level before, and at the first one cells of that side hold so many other clusters for a cluster, on average.
GROWTH, CROWD = 1.6, 2.0
#: What a distance is widened by where rounding must not lose a pair that is tested exactly later.
SLACK = 1 + 1e-6


def _levels(shapes: DataFrame, distance: float) -> list[float]:
    """Radii that grow up to the distance, the first so small that the clusters within it of each other are few."""
    radii = [distance]
    # Points that are not apart by 1e-9 of the distance stay crowded.
    while radii[0] > 1e-9 * distance:
        held = shapes.groupBy(*[F.floor(F.col(c) / radii[0]).alias(c) for c in AXES]).agg(F.count("*").cast("double").alias("n"))
        n, others = held.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))).first()
        if not n or others <= CROWD * n:
            break
        radii.insert(0, radii[0] / GROWTH)
    return radii


def _shapes(members: DataFrame, method: str) -> DataFrame:
    """(cluster, s, w, x, y, z, ...): its places and waters, and its centre (average); or its box, the low corner of it, and its outermost places (complete)."""
    grouped, size = members.groupBy("cluster"), [F.count("*").alias("s"), F.sum("w").alias("w")]
    if method == "average":
        return grouped.agg(*size, *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in AXES])
    ends = [f(F.struct(*AXES), c) for c in AXES for f in (F.min_by, F.max_by)]
    return grouped.agg(*size, F.array(*ends).alias("ends"), *_box()).select("*", *[F.col(f"{c}_lo").alias(c) for c in AXES])


def _ends(members: DataFrame, c: str, side: str) -> DataFrame:
    return members.select(F.col("cluster").alias(c), *[F.col(x).alias(f"{side}_{x}") for x in ("w", *AXES)])


def _summed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with v, the sum of the distances of the two clusters' waters, and n, the number of these."""
    both = pairs.select("c", "o", "wc", "wo").join(_merge(_ends(members, "c", "a")), "c").join(_merge(_ends(members, "o", "b")), "o")
    summed = both.groupBy("c", "o", "wc", "wo").agg(F.sum(_apart("a", "b") * F.col("a_w") * F.col("b_w")).alias("v"))
    return summed.select(*PAIR[:4], (F.col("wc") * F.col("wo")).alias("n"), "v")


def _farthest(close: DataFrame, members: DataFrame) -> DataFrame:
    """close with v, the largest distance of the two clusters' places, from v of their outermost ones. Only places that may be farther than that from
    some place in the other cluster's box are compared."""

    def outer(c: str, side: str, other: str) -> DataFrame:
        spans = [F.greatest(F.abs(F.col(f"{side}_{x}") - F.col(f"{other}_{x}_lo")), F.abs(F.col(f"{side}_{x}") - F.col(f"{other}_{x}_hi"))) for x in AXES]
        bounded = close.select("c", "o", "v", *[f"{other}_{x}_{end}" for x in AXES for end in ("lo", "hi")]).join(_merge(_ends(members, c, side)), c)
        far = bounded.where(F.sqrt(spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2]) > F.col("v"))
        return far.select("c", "o", *[f"{side}_{x}" for x in AXES])

    inner = outer("c", "a", "b").join(_merge(outer("o", "b", "a")), ["c", "o"]).groupBy("c", "o").agg(F.max(_apart("a", "b")).alias("far"))
    return close.join(_merge(inner), ["c", "o"], "left").withColumn("v", F.greatest("v", F.coalesce("far", "v")))


#: Two clusters, c before o, and their waters; over n pairs of these, v is the largest distance (complete) or the sum of distances (average).
PAIR = ["c", "o", "wc", "wo", "n", "v"]


def _cluster_pairs(members: DataFrame, shapes: DataFrame, radius: float, method: str, scratch: Scratch, name: str) -> DataFrame:
    """Pairs of clusters that may merge within the radius. They meet by their centres, which the mean never falls below (average), or by their boxes, which one of the radius
    holds (complete); bounds come before the product of two clusters' places."""
    box = [] if method == "average" else [f"{c}_{x}" for c in AXES for x in ("lo", "hi")]
    met = _half_shell(shapes.select("cluster", "s", "w", *AXES, *box), radius * SLACK, []).where(F.col("__ahead") | (F.col("a_cluster") < F.col("b_cluster")))
    met = met.withColumn("v", _apart("a", "b"))
    if method == "average":
        met = met.where(F.col("v") <= radius * SLACK)
    else:
        met = met.where(F.greatest(*[F.greatest(f"a_{c}_hi", f"b_{c}_hi") - F.least(f"a_{c}_lo", f"b_{c}_lo") for c in AXES]) <= radius)
    first = F.col("a_cluster") < F.col("b_cluster")
    sides = [F.when(first, F.col(f"{p}_{x}")).otherwise(F.col(f"{q}_{x}")).alias(y) for y, x, p, q in (("c", "cluster", "a", "b"), ("o", "cluster", "b", "a"), ("wc", "w", "a", "b"), ("wo", "w", "b", "a"))]
    near = scratch.save(met.select(*sides, (F.col("a_w") * F.col("b_w")).alias("n"), "v", ((F.col("a_s") == 1) & (F.col("b_s") == 1)).alias("points")), f"near{name}")
    points, rest = near.where("points"), near.where("not points")
    if method == "average":
        return points.withColumn("v", F.col("v") * F.col("n")).select(PAIR).unionByName(_summed(rest, members))
    outline = shapes.select("cluster", "ends", *box)
    close = rest.join(_merge(_sided(outline, "a").withColumnRenamed("a_cluster", "c")), "c").join(_merge(_sided(outline, "b").withColumnRenamed("b_cluster", "o")), "o")
    apart = lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) + (p["z"] - q["z"]) * (p["z"] - q["z"]))
    outermost = F.array_max(F.transform("a_ends", lambda p: F.array_max(F.transform("b_ends", lambda q: apart(p, q)))))
    close = scratch.save(close.withColumn("v", outermost).where(F.col("v") <= radius).drop("a_ends", "b_ends", "points"), f"close{name}")
    return points.select(PAIR).unionByName(_farthest(close, members).select(PAIR)).where(F.col("v") <= radius)


def cluster_waters(waters: DataFrame, distance: float = 2.0, method: str = "complete") -> DataFrame:
    """waters with cluster, the smallest name (protein/water_id) of its members.

    Waters at one place are one point from the start. Tight groups far from all else, as the copies of a site in superposed structures are, start as clusters (see
    `tight_groups`), so that such copies cost as much as there are of them, not their pairs. Then clusters grow by rounds: two merge when each is the other's nearest and
    their distance is at most `distance`, which is the largest (complete) or the mean one (average) of their members. A merge never brings a cluster nearer to a third
    than the nearer of the two was, so these rounds reach what merging the closest two at a time reaches; ties go to the smaller names.

    For the same reason all merges within a smaller radius may come first. So rounds go by levels of growing radius (see `_levels`): at the first few points are near each other,
    and at each next one the clusters that the level before left are so wide that few can be near each other. Pairs are made within a level's radius alone, and
    their number follows the points, however densely they lie. Under complete linkage two clusters stay known as a pair while all their members are within the radius.
    Under average linkage the sum of a pair's distances is added up over merges, and measured again if a part of it is not known, and the centres are within the radius, which the mean never
    falls below. single: components of the links. All steps are joins and groups, whatever a cluster's size. Rows that repeat a water, or
    without finite coordinates, are in clusters of their water's name.
    """
    if method not in ("complete", "average", "single"):
        raise ValueError("method is complete, average or single")
    scratch = Scratch(waters.sparkSession, "waters")
    rows = scratch.save(waters.withColumn("wid", F.concat_ws("/", "protein", "water_id")), "rows")
    points = rows.where(" and ".join(f"{c} is not null" for c in AXES)).groupBy("wid").agg(*[F.min(c).alias(c) for c in AXES])
    if method == "single":
        near = grid_self_join(points.withColumn("k", F.lit(0)), distance, ["k"], inclusive=True).where("a_wid < b_wid")
        roots = connected_components(near.select(F.col("a_wid").alias("a"), F.col("b_wid").alias("b"))).withColumnRenamed("root", "cluster")
        return rows.join(_merge(roots.withColumnRenamed("node", "wid")), "wid", "left").withColumn("cluster", F.coalesce("cluster", "wid")).drop("wid")
    points = scratch.save(points.where(" and ".join(f"abs({c}) < double('infinity')" for c in AXES)), "points")
    places = scratch.save(points.groupBy(*AXES).agg(F.min("wid").alias("wid"), F.count("*").alias("w")), "places")
    members = scratch.save(_contracted(places, distance, scratch), "members")
    # held: tables that the next step is made of, and that go after it.
    shapes, held = scratch.save(_shapes(members, method), "shapes"), ["members", "shapes"]
    for level, radius in enumerate(_levels(shapes, distance)):
        if level:
            shapes = scratch.save(_shapes(members, method), f"shapes{level}")
            held.append(f"shapes{level}")
        pairs = _cluster_pairs(members, shapes, radius, method, scratch, f"{level}")
        held += [f"near{level}", *([f"close{level}"] if method == "complete" else [])]
        for k in itertools.count():
            name = f"{level}-{k}"
            if method == "average" and k:
                pairs = scratch.save(pairs, f"open{name}")
                part = pairs.where("n < wc * wo")
                centres = lambda c, side: _shapes(members, method).select(F.col("cluster").alias(c), *[F.col(x).alias(f"{side}_{x}") for x in AXES])  # noqa: B023, E731
                possible = part.join(_merge(centres("c", "a")), "c").join(_merge(centres("o", "b")), "o").where(_apart("a", "b") <= radius * SLACK)
                # Where the centres are farther apart than the radius, so is the mean, and the pair is left out.
                pairs = pairs.where("n = wc * wo").unionByName(_summed(possible, members))
            pairs = scratch.save(pairs, f"pairs{name}")
            dist = F.col("v") / F.col("n") if method == "average" else F.col("v")
            within = pairs.withColumn("dist", dist).where(F.col("dist") <= radius)
            pair = F.struct("dist", "c", "o", (F.col("wc") + F.col("wo")).alias("w")).alias("p")
            best = within.select(F.explode(F.array("c", "o")).alias("x"), pair).groupBy("x").agg(F.min("p").alias("p"))
            merged = best.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select(F.col("p.c").alias("into"), F.col("p.o").alias("cluster"), F.col("p.w").alias("w"))
            merged = scratch.save(merged, f"merged{name}")
            now = [f"pairs{name}", f"merged{name}"]
            done = merged.isEmpty()
            if not done:
                renamed = members.join(_merge(merged.select("into", "cluster")), "cluster", "left").withColumn("cluster", F.coalesce("into", "cluster"))
                members = scratch.save(renamed.select("wid", "cluster", "w", *AXES), f"members{name}")
                now.append(f"members{name}")
                touched = merged.unionByName(merged.select("into", F.col("into").alias("cluster"), "w"))
                to = lambda c: _merge(touched.select(F.col("cluster").alias(c), F.col("into").alias(f"{c}_into"), F.col("w").alias(f"{c}_w")))  # noqa: B023, E731
                moved = pairs.join(to("c"), "c", "left").join(to("o"), "o", "left")
                moved = moved.withColumns({"c": F.coalesce("c_into", "c"), "o": F.coalesce("o_into", "o"), "wc": F.coalesce("c_w", "wc"), "wo": F.coalesce("o_w", "wo")}).where("c <> o")
                first = F.col("c") < F.col("o")
                moved = moved.select(F.least("c", "o").alias("c"), F.greatest("c", "o").alias("o"), F.when(first, F.col("wc")).otherwise(F.col("wo")).alias("wc"), F.when(first, F.col("wo")).otherwise(F.col("wc")).alias("wo"), "n", "v")
                pairs = moved.groupBy("c", "o", "wc", "wo").agg(F.sum("n").alias("n"), (F.sum if method == "average" else F.max)("v").alias("v"))
                if method == "complete":
                    pairs = pairs.where("n = wc * wo")
            stay = [x for x in held if x.startswith("members")] if done else []
            scratch.drop(*[x for x in held if x not in stay], *([f"open{name}"] if method == "average" and k else []), *(now[:2] if done else []))
            held = stay if done else now
            if done:
                break
    placed = points.join(_merge(places.select(F.col("wid").alias("place"), *AXES)), list(AXES)).select("wid", "place")
    placed = placed.join(_merge(members.select(F.col("wid").alias("place"), "cluster")), "place").select("wid", "cluster")
    return rows.join(_merge(placed), "wid", "left").withColumn("cluster", F.coalesce("cluster", "wid")).drop("wid")


def water_conservation(waters: DataFrame, query: str, distance: float = 2.0, method: str = "complete", probability: float = 0.7) -> DataFrame:
    """(cluster, n_proteins, conservation, water_id of the query, proteins): clusters that hold the query protein and whose share of all proteins with exactly one water
    there reaches the probability (C50). A protein with two waters in a cluster does not count for it. proteins: sorted struct<protein, water_id> of those with one;
    `without_water` has the others."""
    clustered = cluster_waters(waters, distance, method)
    single = clustered.groupBy("cluster", "protein").agg(F.count("*").alias("n"), F.min("water_id").alias("water_id")).where("n = 1").drop("n")
    single = Scratch(waters.sparkSession, "conserved").save(single, "single")
    n_all = waters.select("protein").distinct().agg(F.count("*").alias("__all"))
    share = single.groupBy("cluster").agg(F.count("*").alias("n_proteins"), F.max(F.when(F.col("protein") == query, F.col("water_id"))).alias("water_id"))
    # n_all is one number.
    kept = share.where("water_id is not null").crossJoin(F.broadcast(n_all)).withColumn("conservation", F.col("n_proteins") / F.col("__all")).where(F.col("conservation") >= probability)
    named = F.sort_array(F.collect_list(F.struct("protein", F.col("water_id").cast("string").alias("water_id")))).alias("proteins")
    present = single.join(_merge(kept.select("cluster")), "cluster", "left_semi").groupBy("cluster").agg(named)
    return kept.join(_merge(present), "cluster").select("cluster", "n_proteins", "conservation", "water_id", "proteins")


def without_water(conserved: DataFrame, waters: DataFrame) -> DataFrame:
    """(cluster, protein, water_id), water_id being NoWater, of the proteins without a water of their own in each conserved cluster: with `proteins`, the whole table of
    clusters and proteins (C50). Conserved clusters have most proteins, so that table is what they hold already, times 1 / probability at most."""
    present = conserved.select("cluster", F.explode("proteins").alias("p")).select("cluster", "p.protein")
    every = conserved.select("cluster").crossJoin(waters.select("protein").distinct())
    return every.join(present, ["cluster", "protein"], "left_anti").withColumn("water_id", F.lit("NoWater"))
