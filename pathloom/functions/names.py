"""Path names: delimited fields, samples, haplotypes, sub-path ranges and level labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix(name: Column, delim: str, n: int) -> Column:
    """The part before the n-th delimiter, or before the last if there are fewer.

    A name without the delimiter is an error.
    """
    fields = F.size(F.split(name, F.lit("\\Q" + delim + "\\E"), -1))
    last = F.regexp_replace(name, "\\Q" + delim + "\\E(?!.*\\Q" + delim + "\\E).*$", "")
    cut = F.when(fields > n, F.substring_index(name, delim, n)).otherwise(last)
    return F.when(fields < 2, F.raise_error(F.concat(F.lit("path name without delimiter: "), name)).cast("string")).otherwise(cut)


def sample_of(name: Column, delim: str = "#", fields: int = 1) -> Column:
    """The first fields of ``sample#haplotype#contig``; the whole name where it has no more."""
    return F.substring_index(name, delim, fields)


def haplotype_of(name: Column) -> Column:
    """``sample#haplotype``."""
    return F.substring_index(name, "#", 2)


def subpath(name: Column, start: Column, end: Column) -> Column:
    """``name:start-end``."""
    return F.concat(name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def level_label(x: float) -> str:
    """A level with five decimals, trailing zeros dropped."""
    text = f"{x:.5f}".rstrip("0").rstrip(".")
    return text or "0"
