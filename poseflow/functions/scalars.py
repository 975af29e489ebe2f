"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors to nanomolar.
NANOMOLAR = {"M": 1e9, "mM": 1e6, "uM": 1e3, "nM": 1.0, "pM": 1e-3, "fM": 1e-6}


def half_up(c: Column, places: int = 2) -> Column:
    """Decimal rounding with ties away from zero, for reports only (H2)."""
    return F.round(c.cast("decimal(38,12)"), places).cast("double")


def to_nm(unit: Column, value: Column) -> Column:
    """A concentration in nanomolar; an unknown unit is an error, a null one null."""
    table = F.create_map(*[F.lit(x) for pair in NANOMOLAR.items() for x in pair])
    factor = F.coalesce(F.try_element_at(table, unit), F.when(unit.isNotNull(), F.raise_error(F.concat(F.lit("unknown unit "), unit)).cast("double")))
    return value * factor


def category_index(c: Column, vocabulary: list[str]) -> Column:
    """Place of a value in a list, else the last place, which stands for all others and null."""
    at = F.array_position(F.array(*[F.lit(x) for x in vocabulary]), c)
    return F.when(at > 0, at - 1).otherwise(len(vocabulary) - 1).cast("int")


def one_hot(c: Column, vocabulary: list[str]) -> Column:
    """A vector of the vocabulary's size, whose last place stands for unknown values; an empty vocabulary passes the value
    through (B16)."""
    if not vocabulary:
        return c
    return F.transform(F.sequence(F.lit(0), F.lit(len(vocabulary) - 1)), lambda k: (category_index(c, vocabulary) == k).cast("double"))


def checked_array(c: Column, length: int) -> Column:
    """An array of this length, or null."""
    return F.when(F.size(c) == length, c)


def orientation(favorable: str) -> int:
    """1 where larger scores are better, -1 where smaller ones are."""
    if favorable not in ("positive", "negative"):
        raise ValueError("favorable is 'positive' or 'negative'")
    return 1 if favorable == "positive" else -1


def rbf(d: Column, low: float = 0.0, high: float = 20.0, count: int = 16) -> Column:
    """exp(-((d - centre) / width)^2) at evenly spaced centres (H5)."""
    width, step = (high - low) / count, (high - low) / (count - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.exp(-F.pow((d - (low + k * step)) / width, F.lit(2.0))))


def distance_basis(d: Column, divisor: float = 1.0, count: int = 15, base: float = 1.5) -> Column:
    """exp(-(d / divisor)^2 / base^k) for k = 0, 1, ... (H6)."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.exp(-F.pow(d / divisor, F.lit(2.0)) / F.pow(F.lit(base), k)))


def distance_bin(d: Column, linked: Column | None = None, diagonal: Column | None = None, count: int = 16) -> Column:
    """Bin of width 1 from -0.5, distances above count - 1 in the last; pairs that are not linked are in the last bin, a
    pair of an atom with itself in the first (H7)."""
    out = F.floor(F.least(d, F.lit(float(count - 1))) + 0.5).cast("int")
    if linked is not None:
        out = F.when(linked, out).otherwise(count - 1)
    return out if diagonal is None else F.when(diagonal, 0).otherwise(out)


def positional_encoding(offset: Column, size: int = 16) -> Column:
    """Cosines, then sines, of an offset in a sequence at size / 2 frequencies (H8)."""
    frequency = lambda k: F.exp(k * 2 * (-F.log(F.lit(10000.0)) / size))
    places = F.sequence(F.lit(0), F.lit(size // 2 - 1))
    return F.concat(F.transform(places, lambda k: F.cos(offset * frequency(k))), F.transform(places, lambda k: F.sin(offset * frequency(k))))


def compact_date(c: Column) -> Column:
    """A date from YYYYMMDD, or from YYYY-MM-DD with what follows a T cut off."""
    text = F.split(c, "T")[0]
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(text, "yyyy-MM-dd"))


def lenient_json(c: Column) -> Column:
    """JSON text without backslashes before quotes' ends and without trailing commas."""
    return F.regexp_replace(F.regexp_replace(c, r"\\(?![\"\\/bfnrtu])", ""), r",\s*([}\]])", "$1")


def json_path(c: Column, path: str, default=None) -> Column:
    """A nested value, or the default."""
    return F.coalesce(F.get_json_object(lenient_json(c), f"$.{path}"), F.lit(default))


def named_groups(c: Column, pattern: str, names: list[str]) -> Column:
    """STRUCT of a pattern's groups, null where it or a group is absent (H1)."""
    return F.struct(*[F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).alias(n) for k, n in enumerate(names, 1)])


def tanimoto(a: Column, b: Column) -> Column:
    """Of two bitsets as arrays of 64-bit words; null where both are empty."""
    bits = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("long"), lambda s, x: s + x)
    both, either = bits(lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), bits(lambda x, y: F.bit_count(x.bitwiseOR(y)).cast("long"))
    return F.try_divide(both.cast("double"), either)


def clamp(c: Column, low: float, high: float) -> Column:
    """(H16)"""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
