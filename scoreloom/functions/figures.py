"""Figures of inversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Figures of triads and of seventh chords by inversion.
TRIADS = ["", "6", "64"]
SEVENTHS = ["7", "65", "43", "42"]


def inversion_number_to_figure(inversion: Column, quality: Column) -> Column:
    """The figure of an inversion; augmented sixths count as sevenths, quality 'x' has none, others out of range are '?'."""
    table = lambda t: F.coalesce(F.get(F.array(*map(F.lit, t)), inversion.cast("int")), F.lit("?"))
    seventh = quality.contains("7") | quality.isin("Fr", "Ger", "aug6")
    return F.when(quality == "x", "").when(seventh, table(SEVENTHS)).otherwise(table(TRIADS))
