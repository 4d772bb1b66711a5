"""What arriving paths add to a collection: their segments, and those never seen before.

A collection that grows (assemblies of a species, versions of texts) is summed up by its
growth curve: how much new sequence each arrival brings.  Here a path comes as one text, cut
into segments; segments are known by their MD5 digest.  Everything is keyed by segment or by
path, and a segment's occurrences are reduced to its first owner before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(text: Column, delim: str) -> Column:
    """The non-empty pieces of a text between delimiters, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), F.lit("\\Q" + delim + "\\E"), -1), lambda x: x != "")


def sizes(df: DataFrame, path: str, pieces: str, *about: str) -> DataFrame:
    """A row for each path: ``n_segments``, ``n_distinct`` and ``n_chars`` of its array of pieces, and ``about``.

    Rows of the same path are one: what is counted in each of them adds up, the smallest
    value of each column of ``about`` stands for all (null where all are null).
    """
    chars = F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, x: acc + F.char_length(x))
    sums = {"n_segments": F.size(pieces), "n_distinct": F.size(F.array_distinct(pieces)), "n_chars": chars}
    return df.groupBy(path).agg(*[F.min(c).alias(c) for c in about], *[F.sum(v.cast("long")).alias(k) for k, v in sums.items()])


def first_owners(df: DataFrame, path: str, pieces: str) -> DataFrame:
    """``(segment, owner, chars)``: each different segment with the smallest path that has it."""
    each = df.select(F.col(path).alias("owner"), F.explode(F.array_distinct(pieces)).alias("piece"))
    return each.groupBy(F.md5("piece").alias("segment")).agg(F.min("owner").alias("owner"), F.max(F.char_length("piece")).cast("long").alias("chars"))


def unseen(owners: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``owners`` whose segment is not in ``known(segment)``; both hold a segment once."""
    return owners.join(known.select("segment"), "segment", "left_anti")


def gains(new: DataFrame, path: str) -> DataFrame:
    """``(path, new_segments, new_chars)`` of the paths that own a new segment."""
    return new.groupBy(F.col("owner").alias(path)).agg(F.count(F.lit(1)).alias("new_segments"), F.sum("chars").alias("new_chars"))
