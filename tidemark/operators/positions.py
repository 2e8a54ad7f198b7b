"""Trades to outcomes, positions and trader profit and loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import outcome_prices, ratio
from tidemark.operators.aggregates import quantiles
from tidemark.operators.joins import lookup
from tidemark.operators.series import ROWS_PER_TASK, Running, Series

CLOSED_TOKENS = 0.001  # a position below this many tokens counts as closed
BREAKEVEN = 0.01  # profit below this counts as break-even


def settled_markets(markets: DataFrame) -> DataFrame:
    """Settlement prices and winners of a market table with ``outcome_prices`` as JSON text."""
    prices = outcome_prices("outcome_prices")
    return markets.select(
        "slug", F.col("closed").alias("market_closed"),
        F.get(prices, F.lit(0)).alias("up_price"), F.get(prices, F.lit(1)).alias("down_price"),
    ).withColumns({"up_won": F.col("up_price") == 1.0, "down_won": F.col("down_price") == 1.0})


def with_markets(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Attach the market of each trade."""
    return lookup(trades, settled_markets(markets), ["slug"])


def trade_result(trades: DataFrame) -> DataFrame:
    """Profit of every trade held to settlement, and won / lost / unresolved."""
    held = F.when(F.col("outcome") == "Up", F.col("up_won")).when(F.col("outcome") == "Down", F.col("down_won"))
    other = F.when(F.col("outcome") == "Up", F.col("down_won")).when(F.col("outcome") == "Down", F.col("up_won"))
    buy, price, size = F.col("side") == "BUY", F.col("price"), F.col("size")
    gain = (
        F.when(buy & held, (1.0 - price) * size)
        .when(buy & other, -price * size)
        .when((F.col("side") == "SELL") & other, price * size)
        .when((F.col("side") == "SELL") & held, (price - 1.0) * size)
        .otherwise(0.0)
    )
    won = (buy & held) | ((F.col("side") == "SELL") & other)
    return trades.withColumns(
        {
            "pnl": F.when(F.col("market_closed"), gain),
            "trade_result": F.when(
                F.col("market_closed"), F.when(won, "won").otherwise("lost")
            ).otherwise("unresolved"),
        }
    )


def positions(trades: DataFrame) -> DataFrame:
    """Net every (trader, market): tokens held, cash flow, settlement value, profit."""
    sign = F.when(F.col("side") == "BUY", 1.0).when(F.col("side") == "SELL", -1.0).otherwise(0.0)
    worth = F.col("price") * F.col("size")

    def tokens(outcome: str) -> Column:
        return F.sum(F.when(F.col("outcome") == outcome, sign * F.col("size")).otherwise(0.0))

    netted = trades.groupBy("trader", "slug").agg(
        tokens("Up").alias("net_up_tokens"),
        tokens("Down").alias("net_down_tokens"),
        F.sum(-sign * worth).alias("net_cash_flow"),
        F.max("up_price").alias("up_price"),
        F.max("down_price").alias("down_price"),
        F.count(F.lit(1)).alias("num_trades"),
        F.min("ts").alias("first_trade_time"),
        F.max("ts").alias("last_trade_time"),
        F.sum(worth).alias("market_volume"),
    )
    settled = F.col("net_up_tokens") * F.col("up_price") + F.col("net_down_tokens") * F.col("down_price")
    return netted.withColumns(
        {
            "final_position_value": settled,
            "holding_time_hours": (F.col("last_trade_time") - F.col("first_trade_time")) / 3600.0,
            "position_fully_closed": (F.abs("net_up_tokens") < CLOSED_TOKENS)
            & (F.abs("net_down_tokens") < CLOSED_TOKENS),
            "net_pnl": F.col("net_cash_flow") + settled,
        }
    ).drop("up_price", "down_price")


def trader_statistics(pos: DataFrame, rows: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per trader: activity, volume, profit, win and close rates, holding time, risk.

    ``rows`` is an upper bound of the number of positions, if known; it decides how the exact median is computed.
    """
    pnl, volume, closed = F.col("net_pnl"), F.col("market_volume"), F.col("position_fully_closed")
    small = (pos.count() if rows is None else rows) <= rows_per_task
    aggs = {
        "markets_participated": F.count(F.lit(1)),  # positions are unique per (trader, market)
        "total_trades": F.sum("num_trades"),
        "avg_trades_per_market": F.avg("num_trades"),
        "min_trades_per_market": F.min("num_trades"),
        "max_trades_per_market": F.max("num_trades"),
        "total_volume_traded": F.sum(volume),
        "avg_volume_per_market": F.avg(volume),
        "highest_volume_market": F.max(volume),
        "lowest_volume_market": F.min(volume),
        "total_pnl": F.sum(pnl),
        "avg_pnl_per_market": F.avg(pnl),
        "highest_pnl_market": F.max(pnl),
        "lowest_pnl_market": F.min(pnl),
        "winning_markets": F.count_if(pnl > 0),
        "losing_markets": F.count_if(pnl < 0),
        "breakeven_markets": F.count_if(F.abs(pnl) < BREAKEVEN),
        "fully_closed_positions": F.count_if(closed),
        "partial_positions": F.count_if(~closed),
        "first_trade_time": F.min("first_trade_time"),
        "last_trade_time": F.max("last_trade_time"),
        "avg_holding_time_per_market_hours": F.avg("holding_time_hours"),
        "pnl_std_dev": F.stddev_samp(pnl),
        "largest_win": F.max(F.when(pnl > 0, pnl)),
        "largest_loss": F.min(F.when(pnl < 0, pnl)),
        "_wins": F.sum(F.when(pnl > 0, pnl).otherwise(0.0)),
        "_losses": F.sum(F.when(pnl < 0, pnl).otherwise(0.0)),
    }
    if small:
        aggs["median_pnl_per_market"] = F.median(pnl)
    stats = pos.groupBy("trader").agg(*[c.alias(n) for n, c in aggs.items()])
    if not small:
        medians = quantiles(pos, ["trader"], "net_pnl", {"median_pnl_per_market": 0.5}, rows, rows_per_task)
        stats = stats.join(medians, "trader", "left")
    decided = F.col("winning_markets") + F.col("losing_markets")
    return stats.withColumns(
        {
            "win_rate": ratio("winning_markets", decided),
            "close_rate": ratio("fully_closed_positions", "markets_participated"),
            "trading_duration_days": (F.col("last_trade_time") - F.col("first_trade_time")) / 86400.0,
            "profit_factor": ratio("_wins", F.abs("_losses")),
        }
    ).drop("_wins", "_losses")


def top_traders(stats: DataFrame, by: str, k: int) -> DataFrame:
    """The k best traders by a column, ties by trader."""
    return stats.orderBy(F.col(by).desc_nulls_last(), F.col("trader")).limit(k)


def cohorts(pos: DataFrame) -> DataFrame:
    """Positions split by closed / partial, one / many trades, winner / loser: counts and profit."""
    splits = F.array(
        F.struct(F.lit("closed").alias("split"),
                 F.when(F.col("position_fully_closed"), "closed").otherwise("partial").alias("cohort")),
        F.struct(F.lit("trades").alias("split"),
                 F.when(F.col("num_trades") == 1, "single").otherwise("multi").alias("cohort")),
        F.struct(F.lit("result").alias("split"),
                 F.when(F.col("net_pnl") > 0, "winner").when(F.col("net_pnl") < 0, "loser").otherwise("flat").alias("cohort")),
    )
    return (
        pos.select("net_pnl", "market_volume", F.inline(splits))
        .groupBy("split", "cohort")
        .agg(F.count(F.lit(1)).alias("positions"), F.sum("net_pnl").alias("pnl"),
             F.avg("net_pnl").alias("avg_pnl"), F.sum("market_volume").alias("volume"))
    )


def equity_curve(trades: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str = "pnl",
                 rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Cumulative profit, its running high and the drawdown from it, per key in time order."""
    series = Series(trades, keys, order, rows_per_task)
    cum = series._with(series.running(equity=Running("sum", F.coalesce(F.col(pnl), F.lit(0.0)))))
    high = cum.running(high_water=Running("max", F.col("equity")))
    return high.withColumn("drawdown", F.col("equity") - F.col("high_water"))


def volume_by_market(trades: DataFrame) -> DataFrame:
    """Trades, volume and time span per trader and market."""
    worth = F.col("price") * F.col("size")
    return trades.groupBy("trader", "slug").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(worth).alias("volume"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def leaderboard(people: DataFrame, user: str, volume: str, pnl: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Ranks by profit and by volume, return on volume in percent, completeness flag."""
    base = people.withColumns({"_v": -F.col(volume), "_p": -F.col(pnl)})
    by_volume = Series(base, [], ["_v", user], rows_per_task).running(rank_by_volume=Running("count"))
    by_pnl = Series(by_volume, [], ["_p", user], rows_per_task).running(rank_by_pnl=Running("count"))
    return by_pnl.select(
        *people.columns, "rank_by_pnl", "rank_by_volume",
        ratio(F.col(pnl) * 100, volume).alias("pnl_roi_percentage"),
        (F.col(user).isNotNull() & F.col(volume).isNotNull() & F.col(pnl).isNotNull()).alias("is_complete_record"),
    )


