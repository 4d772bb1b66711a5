"""Number columns: hashes of text, distances from similarities, and the Hilbert curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).when(text == "", F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"))


def djb2(text: Column, bits: int = 64) -> Column:
    """Bernstein's hash, ``hash * 33 + byte`` from 5381 on, modulo two to the ``bits`` (32 or 64), as a number without sign.

    Null for null.  64 bits do not fit a long: they come as ``decimal(20,0)``.
    """
    if bits == 32:
        return F.aggregate(_byte_values(text), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND((1 << 32) - 1))
    wide = lambda c: c.cast("decimal(20,0)")
    return F.aggregate(_byte_values(text), wide(F.lit(5381)), lambda h, c: wide((h * 33 + c) % F.expr("18446744073709551616BD")))


def modulo_power(n: Column, power: int) -> Column:
    """``n`` modulo a power of two."""
    if power < 1 or power & (power - 1):
        raise ValueError("not a power of two")
    return n.bitwiseAND(power - 1)


def mash_distance(jaccard: Column) -> Column:
    """``-ln(2 j / (1 + j))``, at most 1; 1 where nothing is shared."""
    return F.when(jaccard <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.log((1.0 + jaccard) / (2.0 * jaccard))))


def percent_identity(jaccard: Column) -> Column:
    """What a mapping's identity tag holds: one minus the distance, in percent."""
    return (1.0 - mash_distance(jaccard)) * 100.0


def curve_levels(places: int) -> int:
    """Levels of the smallest Hilbert curve whose square is at least ``places`` wide."""
    return max(1, (places - 1).bit_length())


def hilbert_point(d: Column, levels: int) -> Column:
    """``struct(x, y)`` of the place ``d`` on the Hilbert curve over a square of ``2 ** levels`` by side.

    Two bits of ``d`` choose the quarter at each level, from the finest to the coarsest; in the
    first quarter what was built so far is mirrored on the diagonal, in the last one on the other.
    """

    def grow(p: Column, k: Column) -> Column:
        side = F.expr("1L") * F.pow(F.lit(2.0), k).cast("long")
        quarter = F.floor(d / (side * side)) % 4
        x, y = p["x"], p["y"]
        across = F.when(quarter == 0, y).when(quarter == 3, side - 1 - y).otherwise(x)
        down = F.when(quarter == 0, x).when(quarter == 3, side - 1 - x).otherwise(y)
        return F.struct((across + F.when(quarter >= 2, side).otherwise(0)).cast("long").alias("x"), (down + F.when((quarter == 1) | (quarter == 2), side).otherwise(0)).cast("long").alias("y"))

    zero = F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), F.struct(zero.alias("x"), zero.alias("y")), grow)


def hilbert_index(x: Column, y: Column, levels: int) -> Column:
    """Inverse of :func:`hilbert_point`: from the coarsest quarter to the finest, turning the rest back."""

    def shrink(p: Column, k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        right, up = p["x"] >= side, p["y"] >= side
        quarter = F.when(right, F.when(up, 2).otherwise(3)).otherwise(F.when(up, 1).otherwise(0))
        a, b = p["x"] % side, p["y"] % side
        x2 = F.when(quarter == 0, b).when(quarter == 3, side - 1 - b).otherwise(a)
        y2 = F.when(quarter == 0, a).when(quarter == 3, side - 1 - a).otherwise(b)
        return F.struct(x2.cast("long").alias("x"), y2.cast("long").alias("y"), (p["d"] * 4 + quarter).cast("long").alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(levels - 1), F.lit(0), F.lit(-1)), start, shrink)["d"]
