"""Order books: state after every event from snapshots and level changes, and the state at a time.

A change row is (asset, seq, ts, is_snapshot, side, price, size).  A snapshot starts a new epoch: levels of
earlier epochs are gone.  Size 0 deletes a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import intervals
from tidemark.operators.aggregates import attach
from tidemark.operators.series import ROWS_PER_TASK, Running, Series, lag, lead
from tidemark.session import cut_lineage


def level_lives(changes: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every change with its place in the asset's history (``_pos``), the size its level had before (``_before``, 0 if
    none) and the place at which the level is changed again or its epoch ends (``_until``)."""
    series = Series(changes, ["asset"], ["seq"], rows_per_task)
    # epoch and place come from one dealing of the rows
    numbered = series._with(series.running(_epoch=Running("sum", F.col("is_snapshot").cast("int")), _pos=Running("count")).withColumn("_pos", F.col("_pos") - 1))
    level = Series(numbered.df, ["asset", "_epoch", "side", "price"], ["_pos"], rows_per_task, rows=numbered.rows)
    lives = level.frames({"_before": lag("size"), "_next": lead("_pos")}, before=1, after=1)
    ends = numbered.df.groupBy("asset", "_epoch").agg((F.max("_pos") + 1).alias("_end"))
    lives = attach(lives, ends, ["asset", "_epoch"])
    return lives.withColumns({"_before": F.greatest(F.coalesce("_before", F.lit(0.0)), F.lit(0.0)), "_until": F.coalesce("_next", "_end")}).drop("_next", "_end")


def best_prices(lives: DataFrame, top: int = intervals.TOP) -> DataFrame:
    """(asset, _pos, best_bid, best_ask) of every place at which a level is alive.

    The life of a level is a few aligned units of the history; each unit keeps its best prices, and an event asks the
    units that hold it.
    """
    alive = lives.where(F.col("size") > 0).select("asset", "side", "price", F.inline(intervals.units_of_interval(F.col("_pos"), F.col("_until"), top)))
    units = alive.groupBy("asset", "level", "unit").agg(
        F.max(F.when(F.col("side") == "BUY", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "SELL", F.col("price"))).alias("ask")
    )
    asked = lives.select("asset", "_pos", F.inline(intervals.units_of_point(F.col("_pos"), top)))
    return asked.join(units, ["asset", "level", "unit"]).groupBy("asset", "_pos").agg(F.max("bid").alias("best_bid"), F.min("ask").alias("best_ask"))


def replay(changes: DataFrame, rows_per_task: int = ROWS_PER_TASK, top: int = intervals.TOP) -> DataFrame:
    """Best prices, level counts and volumes after every event.

    Counts and volumes are running sums of what each event adds and takes within its epoch. Best prices come from the
    intervals in which levels are alive, so no levels are carried along and an asset of any length is shared out.
    """
    lives = cut_lineage(level_lives(changes, rows_per_task))  # read three times
    size, before = F.greatest("size", F.lit(0.0)), F.col("_before")
    sums = {}
    for side, name in (("BUY", "bid"), ("SELL", "ask")):
        own = F.col("side") == side
        sums[f"{name}_levels"] = Running("sum", F.when(own, (size > 0).cast("long") - (before > 0).cast("long")).otherwise(F.lit(0).cast("long")))
        sums[f"{name}_volume"] = Running("sum", F.when(own, size - before).otherwise(0.0))
    states = Series(lives, ["asset", "_epoch"], ["_pos"], rows_per_task).running(**sums)
    best = best_prices(lives, top)
    out = states.select("asset", "seq", "_pos", *sums).join(best, ["asset", "_pos"], "left")
    return out.select(
        "asset", "seq", "best_bid", "best_ask", "bid_levels", "ask_levels",
        # an empty side has no volume, whatever rounding leaves of its running sum
        *[F.when(F.col(f"{n}_levels") > 0, F.col(f"{n}_volume")).otherwise(0.0).alias(f"{n}_volume") for n in ("bid", "ask")],
        (F.col("best_ask") - F.col("best_bid")).alias("spread"), ((F.col("best_ask") + F.col("best_bid")) / 2).alias("mid_price"),
    )


def state_at(changes: DataFrame, until, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Levels alive at a time: the last size per level since the last snapshot."""
    past = changes.where(until)
    last_reset = past.groupBy(*keys).agg(F.max(F.when(F.col("is_snapshot"), F.col("seq"))).alias("_reset"))
    levels = past.groupBy(*keys, "side", "price").agg(
        F.max_by("size", "seq").alias("size"), F.max("seq").alias("seq")
    )
    alive = levels.join(last_reset, list(keys)).where(
        (F.col("size") > 0) & (F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset")))
    )
    return alive.select(*keys, "side", "price", "size")


def top_levels(bids: str, asks: str, n: int) -> dict:
    """Best n levels per side of arrays of struct<price, size>, spread and rounded mid.

    Feeds disagree on which end of the array is best, so the prices decide.
    """
    best_bids = F.slice(F.sort_array(F.col(bids), asc=False), 1, n)
    best_asks = F.slice(F.sort_array(F.col(asks)), 1, n)
    bid, ask = F.get(best_bids, F.lit(0))["price"], F.get(best_asks, F.lit(0))["price"]
    out = {}
    for side, levels in (("bid", best_bids), ("ask", best_asks)):
        for i in range(n):
            out[f"{side}_price_{i + 1}"] = F.get(levels, F.lit(i))["price"]
            out[f"{side}_size_{i + 1}"] = F.get(levels, F.lit(i))["size"]
    return out | {"spread": ask - bid, "mid_price": F.round((bid + ask) / 2, 3)}


