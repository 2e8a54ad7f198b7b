"""Joins: size-checked lookups, as-of matches, interval and closest-eligible matches, pairings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.series import ROWS_PER_TASK, Running, Series

def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a large table to a table with one row per key.

    Adaptive execution sends the right side to all tasks if it turns out to be small and splits hot keys if it is not, so
    no size is measured here.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"a lookup keeps the left rows or drops some, not {how}")
    return left.join(right, list(on), how)


def asof(
    left: DataFrame,
    right: DataFrame,
    *,
    on: tuple[str, str],
    ids: tuple[str, str],
    by: Sequence[str] = (),
    take: Sequence[str],
    direction: str = "backward",
    tolerance: int | None = None,
    matched_at: str = "matched_ts",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the ``take`` columns of the right row closest in time to each left row.

    ``on`` names the time columns and ``ids`` the tie-breaking columns of both sides, each ordered by its own type: of
    right rows at one time backward takes the last id, forward the first.  Backward matches at or before, forward at or after, nearest either (the earlier on a tie).  Works as one fill over the
    union of both sides, so it needs no join and no series has to fit one task.
    """
    by = list(by)
    right_rank = 2 if direction == "forward" else 0
    found = F.struct(F.col(on[1]).alias("_at"), *[F.col(c) for c in take])
    probe = left.select(
        *by, F.col(on[0]).alias("_t"), F.lit(1).alias("_side"), F.col(ids[0]).alias("_left_tie"),
        F.struct(*left.columns).alias("_left"),
    )
    build = right.where(F.col(on[1]).isNotNull()).select(
        *by, F.col(on[1]).alias("_t"), F.lit(right_rank).alias("_side"),
        F.col(ids[1]).alias("_right_tie"), found.alias("_right"),
    )
    both = probe.unionByName(build, allowMissingColumns=True)
    exprs = {}
    if direction in ("backward", "nearest"):
        exprs["_prev"] = Running("last", F.col("_right"))
    if direction in ("forward", "nearest"):
        exprs["_next"] = Running("next", F.col("_right"))
    filled = Series(both, by, ["_t", "_side", "_left_tie", "_right_tie"], rows_per_task).running(**exprs).where("_side = 1")
    if direction == "nearest":
        behind, ahead = F.col("_t") - F.col("_prev._at"), F.col("_next._at") - F.col("_t")
        hit = F.when(ahead.isNull() | (behind <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    else:
        hit = F.col("_prev" if direction == "backward" else "_next")
    if tolerance is not None:
        hit = F.when(F.abs(hit["_at"] - F.col("_t")) <= tolerance, hit)
    return filled.withColumn("_hit", hit).select(
        "_left.*", F.col("_hit._at").alias(matched_at), *[F.col(f"_hit.{c}").alias(c) for c in take]
    )


def closest_eligible(
    left: DataFrame, right: DataFrame, on: Sequence[str], nearest: str, tie: str, eligible: Column, keys: Sequence[str],
    take: Sequence[str],
) -> DataFrame:
    """Of the right rows with the same key that satisfy ``eligible``, the one with the smallest ``nearest``.

    ``eligible`` may use left columns and ``nearest``.  The right side is first cut to one row per key and ``nearest`` value,
    so a key with many rows meets the join with few; min_by then aggregates before its shuffle.
    """
    on = list(on)
    one = F.min_by(F.struct(*[c for c in take if c != nearest], tie), tie).alias("_row")
    few = right.groupBy(*on, nearest).agg(one)
    joined = left.join(few, on, "inner").where(eligible)
    best = joined.groupBy(*keys).agg(F.min_by(F.struct(nearest, "_row"), nearest).alias("_best"))
    return best.select(
        *keys, *[F.col("_best." + (c if c == nearest else f"_row.{c}")).alias(c) for c in take]
    )


def interval_lookup(df: DataFrame, ts: str, periods: DataFrame, start: str, end: str, length: int) -> DataFrame:
    """Attach the period that contains ``ts``: an equality on floor(ts / length) plus the exact test.

    Periods may be longer than ``length``; each is listed under every slot it touches.
    """
    first, last = F.floor(F.col(start) / length), F.floor((F.col(end) - 1) / length)
    slots = periods.withColumn("_slot", F.explode(F.sequence(first, last)))
    inside = (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))
    left = df.withColumn("_slot", F.floor(F.col(ts) / length))
    return left.join(slots, (left["_slot"] == slots["_slot"]) & inside, "left").drop("_slot")


def with_gap_check(df: DataFrame, column: str, message: str) -> DataFrame:
    """Fail the job if a looked-up column is missing in any row."""
    checked = F.when(F.assert_true(F.col(column).isNotNull(), message).isNull(), F.col(column))
    return df.withColumn(column, checked)


def compare_tables(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer comparison: where each key occurs, and difference and ratio per value."""
    left = old.select(*keys, *[F.col(v).alias(f"{v}_old") for v in values], F.lit(1).alias("_o"))
    right = new.select(*keys, *[F.col(v).alias(f"{v}_new") for v in values], F.lit(1).alias("_n"))
    both = left.join(right, list(keys), "full")
    presence = F.when(F.col("_o").isNull(), "new_only").when(F.col("_n").isNull(), "old_only").otherwise("both")
    out = [presence.alias("presence")]
    for v in values:
        a, b = F.col(f"{v}_old"), F.col(f"{v}_new")
        out += [(b - a).alias(f"{v}_diff"), F.try_divide(b, F.nullif(a, F.lit(0.0))).alias(f"{v}_ratio")]
    return both.select(*keys, *[f"{v}_{side}" for v in values for side in ("old", "new")], *out)
