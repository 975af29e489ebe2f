"""Running sums, positions and quantiles of an order over whole tables, by range partitions with offsets: no task holds more than its part."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..tables import Scratch


def sums_before(df: DataFrame, keys: list[str], order: list[str], value: Column | str, name: str) -> DataFrame:
    """df with the sum of value over the rows before in the order, within the keys (over all rows without any).

    Rows are dealt by range of keys and order and summed up within their part; the sums of the parts before, a row per part and key that lies
    in it, are added. Rows of equal keys and order share theirs in no defined order, so these should be unique, as a large group of equal rows is one part.
    """
    scratch = Scratch(df.sparkSession, "ordered")
    ranged = df.withColumn("__v", value if isinstance(value, Column) else F.col(value)).repartitionByRange(*keys, *order)
    ranged = scratch.save(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part", *keys).agg(F.sum("__v").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__total").over(earlier), F.lit(0))).drop("__total")
    own = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__own", F.coalesce(F.sum("__v").over(own), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("__part", *keys)]
    joined = summed.alias("r").join(offsets.alias("o"), functools.reduce(lambda a, b: a & b, same))
    return joined.select("r.*", F.col("o.__before")).withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__v", "__own", "__before")


def global_position(df: DataFrame, *order: str) -> DataFrame:
    """df with position from 0 in the order given. A key should be unique, or its rows share their order."""
    return sums_before(df, [], list(order), F.lit(1).cast("long"), "position")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], lower: dict[str, float] | None = None) -> DataFrame:
    """One row with a column per quantile of the values that are not null: interpolated between the two nearest ones (shares), or the
    smallest value that so large a share of the rows does not exceed (lower).

    Equal values are counted first, within tasks and then together, and each value gets the number of rows before it; so a value that most rows
    share is one row."""
    counted = df.select(F.col(value).alias("__x")).where("__x is not null").groupBy("__x").agg(F.count("*").alias("__c"))
    rows = sums_before(counted, [], ["__x"], "__c", "__first").withColumn("__last", F.col("__first") + F.col("__c") - 1)
    n = rows.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("__n"))
    at = {name: F.lit(q) * (F.col("__n") - 1) for name, q in shares.items()}
    floors = [F.floor(c).alias(f"{k}_a") for k, c in at.items()]
    ceilings = [F.ceil(c).alias(f"{k}_b") for k, c in at.items()]
    weights = [(c - F.floor(c)).alias(f"{k}_w") for k, c in at.items()]
    firsts = [F.greatest(F.ceil(F.lit(q) * F.col("__n")) - 1, F.lit(0)).alias(f"{k}_a") for k, q in (lower or {}).items()]
    places = n.select(*floors, *ceilings, *weights, *firsts)
    # places is one row.
    inside = lambda c: F.col(c).between(F.col("__first"), F.col("__last"))
    near = rows.join(F.broadcast(places), functools.reduce(lambda a, b: a | b, [inside(c) for c in places.columns if not c.endswith("_w")]))
    value_at = lambda c: F.max(F.when(inside(c), F.col("__x")))
    first, weight = (lambda k: value_at(f"{k}_a")), (lambda k: F.max(f"{k}_w"))
    return near.agg(*[(first(k) + weight(k) * (value_at(f"{k}_b") - first(k))).alias(k) for k in shares], *[first(k).alias(k) for k in lower or {}])
