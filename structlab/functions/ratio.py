"""Ratios, cents and fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The just major scale.
DIATONIC = (("unison", 1.0), ("second", 9 / 8), ("third", 5 / 4), ("fourth", 4 / 3), ("fifth", 3 / 2), ("sixth", 5 / 3), ("seventh", 15 / 8), ("octave", 2.0))


def cents(a: Column, b: Column) -> Column:
    return 1200.0 * F.log2(a / b)


def reduce_to_octave(r: Column) -> Column:
    """Fold a positive ratio into [1, 2); null otherwise."""
    return F.when(r > 0, r / F.pow(F.lit(2.0), F.floor(F.log2(r)).cast("double")))


def nearest_diatonic(r: Column) -> Column:
    """struct(off, place, note, cents): the note nearest to an octave-reduced ratio; the first wins a tie."""
    folded = reduce_to_octave(r)
    notes = [F.struct(F.abs(cents(folded, F.lit(v))).alias("off"), F.lit(k).alias("place"), F.lit(n).alias("note"), cents(folded, F.lit(v)).alias("cents")) for k, (n, v) in enumerate(DIATONIC)]
    return F.array_min(F.array(*notes))


def nearest_fraction(r: Column, most: int = 12) -> Column:
    """struct(off, q, p): the fraction p/q nearest to ``r`` with q up to ``most``; the smallest q wins a tie."""
    tries = [F.struct(F.abs(F.round(r * q) / q - r).alias("off"), F.lit(q).alias("q"), F.round(r * q).cast("long").alias("p")) for q in range(1, most + 1)]
    return F.array_min(F.array(*tries))
