"""Overlap of boxes by cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROW = 1e-6


def overlaps(boxes: DataFrame, cell: float, grow: float = GROW) -> DataFrame:
    """``(a, b, volume)``, a < b, of boxes ``(id, lo_x ... hi_z)`` that overlap after growing, borders included.

    Each box is in every cell that it touches. A pair meets in several
    cells, and is kept in the one that holds the lower corner of its common
    part, so no pair is removed after the join. Volume is that of the boxes
    as given. Cells should be about as wide as the boxes.
    """
    key = lambda c: F.floor(c / cell).cast("long")
    grown = boxes.select("id", *[(F.col(f"lo_{c}") - grow).alias(f"lo_{c}") for c in "xyz"], *[(F.col(f"hi_{c}") + grow).alias(f"hi_{c}") for c in "xyz"])
    cells = grown
    for c in "xyz":
        cells = cells.withColumn(f"c_{c}", F.explode(F.sequence(key(F.col(f"lo_{c}")), key(F.col(f"hi_{c}")))))
    a, b = cells.alias("a"), cells.alias("b")
    meet = F.col("a.id") < F.col("b.id")
    for c in "xyz":
        meet = meet & (F.col(f"a.c_{c}") == F.col(f"b.c_{c}")) & (F.col(f"a.lo_{c}") <= F.col(f"b.hi_{c}")) & (F.col(f"b.lo_{c}") <= F.col(f"a.hi_{c}"))
        meet = meet & (F.col(f"a.c_{c}") == key(F.greatest(f"a.lo_{c}", f"b.lo_{c}")))
    volume = F.lit(1.0)
    for c in "xyz":
        volume = volume * F.greatest(F.least(F.col(f"a.hi_{c}"), F.col(f"b.hi_{c}")) - F.greatest(F.col(f"a.lo_{c}"), F.col(f"b.lo_{c}")) - 2 * grow, F.lit(0.0))
    return a.join(b, meet).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), volume.alias("volume"))
