"""DNA column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements.
CODES = ("ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb")


def reverse_complement(seq: Column) -> Column:
    """The other strand, case kept."""
    return F.reverse(F.translate(seq, *CODES))


def oriented(seq: Column, is_rev: Column) -> Column:
    """The sequence as a step reads it."""
    return F.when(is_rev, reverse_complement(seq)).otherwise(seq)


def uncalled(seq: Column) -> Column:
    """Number of N and n."""
    return F.length(seq) - F.length(F.translate(seq, "Nn", ""))


def crush_n(seq: Column) -> Column:
    """Runs of N as one N."""
    return F.regexp_replace(seq, "N+", "N")
