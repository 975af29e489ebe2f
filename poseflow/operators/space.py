"""Nearest neighbours without a radius (C27, C30, C34, C35) by an adaptive partition of space: cells that halve, as deep as points are dense.

Points are rows with key columns (structure, complex, ...) and x, y, z. Rows with a null key or coordinate are near nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..tables import Scratch

AXES = ("x", "y", "z")
#: Halvings of a structure's cube, and those that are counted in one round.
DEEPEST, ROUND = 30, 5


def _named(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """keys and coordinates under names of their own, so that no column of the points clashes with those of the search."""
    known = [f"`{c}` is not null" for c in (*keys, *AXES)]
    return df.where(" and ".join(known)).select(
        F.struct(*[F.col(k) for k in keys]).alias("s"), F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in AXES],
    )


def _place(c: str, at: Column | None = None) -> Column:
    """Where a coordinate lies among the 2**DEEPEST finest cells of its axis; what is outside the cube goes to its rim."""
    value = F.col(c) if at is None else at
    share = (value - F.col(f"{c}0")) / F.col("span")
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0))))
    return F.least(F.floor(inside * float(1 << DEEPEST)), F.lit((1 << DEEPEST) - 1)).cast("long")


def _cell(level: Column) -> Column:
    """The cell at a level of a row with its finest places i_x, i_y, i_z."""
    shift = (F.lit(DEEPEST) - level).cast("int")
    return F.struct(*[F.call_function("shiftright", F.col(f"i_{c}"), shift).alias(c) for c in AXES])


def _cubes(points: DataFrame) -> DataFrame:
    """The least cube with axes of one length around each structure, which has at least the points `n`."""
    span = F.greatest(*[F.max(c) - F.min(c) for c in AXES])
    return points.groupBy("s").agg(*[F.min(c).alias(f"{c}0") for c in AXES], F.when(span > 0, span).otherwise(F.lit(1.0)).alias("span"))


def _full_levels(asked: DataFrame, points: DataFrame, need: int, scratch: Scratch) -> DataFrame:
    """asked with level: the deepest at which the row's own cell holds `need` points, 0 for structures with fewer. Round by round the cells of ROUND
    levels are counted, of the points and rows alone whose cell is still full at the last one."""
    done, live, held = None, asked.withColumn("level", F.lit(0)), points
    for k, first in enumerate(range(1, DEEPEST + 1, ROUND)):
        last = first + ROUND - 1
        levels = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("deep")
        cells = held.select("s", *[f"i_{c}" for c in AXES], levels).groupBy("s", "deep", _cell(F.col("deep")).alias("cell")).agg(F.count("*").alias("n"))
        full = cells.where(F.col("n") >= need).select("s", "deep", "cell")
        deeper = live.select("id", "s", *AXES, *[f"i_{c}" for c in AXES], levels).withColumn("cell", _cell(F.col("deep")))
        reached = deeper.join(full, ["s", "deep", "cell"]).groupBy("id", "s", *AXES).agg(F.max("deep").alias("reached"))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("id", "s", *AXES)]
        joined = live.alias("l").join(reached.alias("r"), same, "left").select("l.*", "reached")
        going = Observation(f"going{k}")
        joined = joined.withColumn("level", F.coalesce("reached", "level")).drop("reached").observe(going, F.count_if(F.col("level") == last).alias("n"))
        joined = scratch.save(joined, f"level{k}")
        settled = joined.where(F.col("level") < last)
        done = settled if done is None else done.unionByName(settled)
        live = joined.where(F.col("level") == last)
        if not going.get["n"]:
            break
        # Points of cells that are still asked for.
        at_last = lambda df: df.withColumn("cell", _cell(F.lit(last)))  # noqa: B023, E731
        held = scratch.save(at_last(held).join(at_last(live).select("s", "cell").distinct(), ["s", "cell"], "left_semi").drop("cell"), f"held{k}")
    return done.unionByName(live)


def _compared(asked: DataFrame, points: DataFrame, exclude_same: bool) -> DataFrame:
    """(s, src, x, y, z, far, dst, dist) of rows asked (with their cells `at`, an array of cells of one level) and the points in these cells. Points go to
    the levels that their structure is asked at, which are few."""
    wanted = asked.select("s", "level", "id", *AXES, "far", F.explode("at").alias("cell"))
    placed = points.join(asked.select("s", "level").distinct(), "s").withColumn("cell", _cell(F.col("level")))
    other = placed.select("s", "level", "cell", F.col("id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in AXES])
    apart = lambda c: (F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}"))
    pairs = wanted.join(other, ["s", "level", "cell"]).select("s", F.col("id").alias("src"), "dst", *AXES, "far", F.sqrt(apart("x") + apart("y") + apart("z")).alias("dist"))
    return pairs.where("src <> dst") if exclude_same else pairs


def _first(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("s", "src", *AXES).orderBy("dist", "dst")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _nothing(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    """`nearest_k` of no rows."""
    named = [F.lit(None).cast(a.schema[k].dataType).alias(k) for k in keys]
    ends = [F.lit(None).cast(x.schema[c].dataType).alias(n) for x, c, n in ((a, a_id, "src"), (b, b_id, "dst"))]
    return a.sparkSession.range(0).select(*named, *ends, F.lit(None).cast("double").alias("dist"), F.lit(None).cast("int").alias("rank"))


def nearest_k(a: DataFrame, b: DataFrame, keys: list[str], k: int, a_id: str = "id", b_id: str | None = None, exclude_same: bool = False) -> DataFrame:
    """(keys, src, dst, dist, rank): for each row of a its k nearest rows of b with equal keys, ties to the smaller id; without those of its own id,
    if `exclude_same`. Fewer where a structure has fewer; a row whose keys b does not have gives none.

    Each structure's cube is halved along all axes again and again, a cell's parts being looked at only where the cell is full: sparse and dense
    regions, planes, lines and distant clusters get cells of about equally many points. A row first meets the deepest cell around it that
    holds k others, at most eight times k where points don't coincide; the k-th nearest there bounds the ball in which its true neighbours lie.
    Then it meets the cells that the ball touches, at the level whose cells are as wide as its radius: 27 at most. Joins are on structure, level and cell, so a large structure spreads over its cells, and the work
    follows rows times k whatever the shape.

    Of points at one place only the k (or k + 1) with the smallest ids can be among anyone's nearest, so that many copies of a site stay
    linear. Rows of a may repeat ids; a row is known by its id and place.
    """
    if a.isEmpty():
        return _nothing(a, b, keys, a_id, b_id or a_id)
    scratch = Scratch(a.sparkSession, "nearest")
    need = k + 1 if exclude_same else k
    points = _named(b, keys, b_id or a_id).where("id is not null")
    first_ids = Window.partitionBy("s", *AXES).orderBy("id")
    points = points.distinct().withColumn("r", F.row_number().over(first_ids)).where(F.col("r") <= need).drop("r")
    cubes = scratch.save(_cubes(points), "cubes")
    fitted = lambda df: df.join(cubes, "s").withColumns({f"i_{c}": _place(c) for c in AXES})
    points = scratch.save(fitted(points).select("s", "id", *AXES, *[f"i_{c}" for c in AXES]), "points")
    asked = fitted(_named(a, keys, a_id).distinct()).select("s", "id", *AXES, *[f"i_{c}" for c in AXES], *[f"{c}0" for c in AXES], "span")
    levels = _full_levels(asked, points, need, scratch)

    own_cell = levels.withColumns({"at": F.array(_cell(F.col("level"))), "far": F.lit(0.0)})
    near = _first(_compared(own_cell, points, exclude_same), k)
    reach = near.groupBy("s", F.col("src").alias("id"), *AXES).agg(F.max("dist").alias("far"), F.count("*").alias("found"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("id", "s", *AXES)]
    rows = levels.alias("l").join(reach.alias("r"), same, "left").select("l.*", "far", "found")
    # A ball slightly larger than the bound, so that rounding loses nothing. Where ids repeat, a full cell may lack k others: such a row
    # meets its whole structure, as those do whose structure has fewer.
    few = (F.coalesce(F.col("found") < k, F.lit(True))) | (F.col("level") == 0)
    far = F.col("far") * (1 + 1e-9) + F.greatest(*[F.abs(c) for c in AXES]) * 1e-12
    rows = rows.withColumn("far", F.when(few, F.lit(float("inf"))).otherwise(far))
    wide = F.when(F.col("far") <= 0, DEEPEST).when(F.col("far") >= F.col("span"), 0).otherwise(F.floor(F.log2(F.col("span") / F.col("far"))))
    rows = rows.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(DEEPEST), wide)).cast("int"))
    down = lambda c: F.call_function("shiftright", c, (F.lit(DEEPEST) - F.col("level")).cast("int"))
    rows = rows.withColumns({f"steps_{c}": F.sequence(*[down(_place(c, F.col(c) + sign * F.col("far"))) for sign in (-1, 1)]) for c in AXES})
    cell = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    boxes = F.transform("steps_x", lambda x: F.transform("steps_y", lambda y: F.transform("steps_z", lambda z: cell(x, y, z))))
    rows = rows.withColumn("at", F.flatten(F.flatten(boxes))).select("s", "level", "id", *AXES, "far", "at")
    out = _first(_compared(rows, points, exclude_same).where("dist <= far"), k)
    return out.select(*[F.col(f"s.{c}").alias(c) for c in keys], "src", "dst", "dist", "rank")
