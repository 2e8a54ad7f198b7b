"""Intervals as few aligned pieces, so that what holds at a point is found by equality.

The positions 0, 1, 2, ... are cut into units of 1, 4, 16, ... up to 4 ** top. An interval is the disjoint union of a few
units per size; a point lies in one unit per size. So "which intervals hold at this point" is an equi-join of n log n
rows on (size, unit), and aggregates that can be merged (max, min, sum) are taken per unit before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RADIX = 4
TOP = 8  # the largest unit has 65,536 positions: no unit is asked for by more points of one key


def units_of_interval(start: Column, end: Column, top: int = TOP) -> Column:
    """Array of struct<level, unit> whose disjoint union is [start, end); empty if it holds nothing.

    Longer intervals take several of the largest units.
    """
    def at(level: int) -> Column:
        lo, hi = F.ceil(start / RADIX**level), F.floor(end / RADIX**level)
        spans = F.sequence(lo, hi - 1)
        if level < top:
            # what the next larger units do not hold, to their left and to their right
            left, right = F.ceil(start / RADIX ** (level + 1)) * RADIX, F.floor(end / RADIX ** (level + 1)) * RADIX
            none = F.array().cast("array<bigint>")
            parts = F.concat(F.when(left > lo, F.sequence(lo, left - 1)).otherwise(none), F.when(hi > right, F.sequence(right, hi - 1)).otherwise(none))
            spans = F.when(left < right, parts).otherwise(spans)
        held = F.when(lo < hi, spans).otherwise(F.array().cast("array<bigint>"))
        return F.transform(held, lambda unit: F.struct(F.lit(level).alias("level"), unit.alias("unit")))

    return F.flatten(F.array(*(at(level) for level in range(top + 1))))


def units_of_point(position: Column, top: int = TOP) -> Column:
    """Array of struct<level, unit>: the unit of every size that holds the position."""
    return F.array(*(F.struct(F.lit(level).alias("level"), F.floor(position / RADIX**level).alias("unit")) for level in range(top + 1)))
