"""Vectors as STRUCT<x, y, z> columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def vec(x, y, z) -> Column:
    parts = [c if isinstance(c, Column) else F.col(c) for c in (x, y, z)]
    return F.struct(*[c.cast("double").alias(a) for c, a in zip(parts, AXES)])


def _each(fn, *vs: Column) -> Column:
    return F.struct(*[fn(*[v[a] for v in vs]).alias(a) for a in AXES])


def add(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x + y, a, b)


def sub(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x - y, a, b)


def scale(a: Column, s) -> Column:
    return _each(lambda x: x * s, a)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once, so that nested vector expressions do not multiply."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    scaled = lambda v, n: _each(lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)), v)
    return let(a, lambda v: let(norm(v), lambda n: scaled(v, n)))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Of the angle between two vectors, within [-1, 1]; null when one is zero."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b))))


def angle(a: Column, b: Column) -> Column:
    """In radians; 0 when a vector is zero."""
    return F.coalesce(F.acos(cosine(a, b)), F.lit(0.0))


def dihedral(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """In degrees, by atan2."""
    b0, b1, b2 = sub(p1, p0), sub(p2, p1), sub(p3, p2)
    n0, n1 = cross(b0, b1), cross(b1, b2)
    return F.degrees(F.atan2(norm(b1) * dot(b0, n1), dot(n0, n1)))


def sidechain_direction(n: Column, ca: Column, c: Column) -> Column:
    """Minus the bisector of CA-C and CA-N by sqrt(1/3) and minus their normal by sqrt(2/3)."""
    turned = lambda a, b: sub(scale(unit(add(a, b)), -math.sqrt(1 / 3)), scale(unit(cross(a, b)), math.sqrt(2 / 3)))
    return let(unit(sub(c, ca)), lambda to_c: let(unit(sub(n, ca)), lambda to_n: turned(to_c, to_n)))


def amide_normal(ca: Column, cb: Column, n: Column) -> Column:
    """Cross product of CA-CB and CB-N; null where the residue has no CB."""
    return F.when(cb.isNotNull(), cross(sub(ca, cb), sub(cb, n)))


def local_frame(n: Column, ca: Column, c: Column) -> Column:
    """STRUCT of three axes of a residue: u towards N, n normal to u and CA-C, and v = n x u (H9)."""
    axes = lambda u, w: F.struct(w.alias("n"), u.alias("u"), cross(w, u).alias("v"))
    return let(unit(sub(n, ca)), lambda u: let(unit(cross(u, unit(sub(c, ca)))), lambda w: axes(u, w)))


def in_frame(frame: Column, a: Column) -> Column:
    """The three coordinates of a vector in a local frame, as an array."""
    return F.array(dot(frame["n"], a), dot(frame["u"], a), dot(frame["v"], a))


def edge_orientation(src: Column, dst: Column, src_frame: Column, dst_frame: Column) -> Column:
    """Twelve numbers of an edge in the destination's frame: its offset, and the source's three axes (H9)."""
    return F.concat(in_frame(dst_frame, sub(src, dst)), *[in_frame(dst_frame, src_frame[k]) for k in ("n", "u", "v")])


def hash_uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, not on partitioning: the first 52 bits of an MD5 of the keys as text, which
    other engines have too."""
    parts = [k if isinstance(k, Column) else F.col(k) for k in keys]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def rotation(seed: int, *keys) -> Column:
    """A random rotation per key as three rows, from a random unit quaternion."""
    a, b, c = (hash_uniform(seed + k, *keys) for k in range(3))
    w, x = F.sqrt(1 - a) * F.sin(2 * math.pi * b), F.sqrt(1 - a) * F.cos(2 * math.pi * b)
    y, z = F.sqrt(a) * F.sin(2 * math.pi * c), F.sqrt(a) * F.cos(2 * math.pi * c)
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        F.array(2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        F.array(2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def rotate_translate(v: Column, matrix: Column, shift: Column, centre: Column) -> Column:
    """A rigid motion about a centre."""
    a = sub(v, centre)
    turned = F.struct(*[(matrix[i][0] * a["x"] + matrix[i][1] * a["y"] + matrix[i][2] * a["z"]).alias(x) for i, x in enumerate(AXES)])
    return add(add(turned, centre), shift)


def jitter(v: Column, amount: float, seed: int, *keys) -> Column:
    """Uniform noise within +-amount on each coordinate."""
    return F.struct(*[(v[a] + (2 * hash_uniform(seed + k, *keys) - 1) * amount).alias(a) for k, a in enumerate(AXES)])
