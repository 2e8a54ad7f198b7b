"""Aggregations: bars, positions, quantiles, profiles, rates, breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import aggregates as agg, grid, joins, positions as pos
from tidemark.operators.series import Running, Series, rolling
from tidemark.plans.registry import query
from tidemark.plans.standins import (
    ENRICHED, FORECASTS, MARKETS, OPTIONS, POSITIONS, QUOTES, QUOTE_ORDER, TICKS, TRADES, forecasts, markets, options,
    quotes, r, rounded, table, ticks, trades, with_,
)


@query(
    "d01_group_aggregates",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_discount), 8) AS avg_discount, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def group_aggregates(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        r(F.sum("l_quantity"), 2).alias("sum_qty"),
        r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        r(F.avg("l_discount"), 8).alias("avg_discount"), F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"), F.count(F.lit(1)).alias("n"),
    )


@query(
    "d02_ordered_first_last",
    with_(TICKS) + "SELECT user_id, arg_min(price, (ts_us, id)) AS first_price, arg_max(price, (ts_us, id)) AS last_price FROM ticks GROUP BY 1",
)
def first_last(spark, sf):
    by = F.struct("ts_us", "id")
    return ticks(spark, sf).groupBy("user_id").agg(
        F.min_by("price", by).alias("first_price"), F.max_by("price", by).alias("last_price")
    )


LAST_KEY = "(sec, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"


@query(
    "d03_last_known_per_column",
    with_(QUOTES) + f"""SELECT symbol, round(arg_max(bid, {LAST_KEY}) FILTER (bid IS NOT NULL), 9) AS bid,
    round(arg_max(ask, {LAST_KEY}) FILTER (ask IS NOT NULL), 9) AS ask, count(*) AS quote_count FROM quotes GROUP BY 1""",
)
def last_known(spark, sf):
    return rounded(grid.last_known(quotes(spark, sf), ["symbol"], ["bid", "ask"], QUOTE_ORDER), 9)


def bars_sql(step):
    return f"""bars AS (SELECT symbol, sec // {step} * {step} AS sec, arg_min(price, (ts_us, id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (ts_us, id)) AS close, sum(k)::BIGINT AS volume, count(*) AS trades,
    CASE WHEN sum(k) = 0 THEN NULL ELSE sum(price * k) / sum(k) END AS vwap FROM ticks GROUP BY 1, 2)"""


def tick_bars(spark, sf, step):
    return grid.bars(ticks(spark, sf), ["symbol"], grid.second_of("ts_us", step), "price", "k", ["ts_us", "id"])


@query("d04_ohlcv_bars", with_(TICKS, bars_sql(3600)) + "SELECT * EXCLUDE (vwap), round(vwap, 9) AS vwap FROM bars")
def ohlcv(spark, sf):
    return rounded(tick_bars(spark, sf, 3600), 9)


@query(
    "d05_vwap",
    "SELECT l_suppkey, round(sum(l_extendedprice / l_quantity * l_quantity) / sum(l_quantity), 6) AS vwap FROM lineitem GROUP BY 1",
)
def vwap(spark, sf):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        r(C.ratio(F.sum(price * F.col("l_quantity")), F.sum("l_quantity"))).alias("vwap")
    )


@query(
    "d06_conditional_aggregates",
    with_(ENRICHED) + """SELECT slug, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, round(max(pnl) FILTER (pnl > 0), 6) AS largest_win,
    round(sum(pnl) FILTER (pnl < 0), 6) AS lost FROM enriched WHERE market_closed GROUP BY 1""",
)
def conditional_aggregates(spark, sf):
    t = pos.trade_result(pos.with_markets(trades(spark, sf), markets(spark, sf))).where("market_closed")
    p = F.col("pnl")
    return t.groupBy("slug").agg(
        F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"),
        r(F.max(F.when(p > 0, p))).alias("largest_win"), r(F.sum(F.when(p < 0, p))).alias("lost"),
    )


@query("d07_distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def distinct_count(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders")
    )


@query(
    "d08_quantiles",
    "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1",
)
def quantile_set(spark, sf):
    lines = table(spark, sf, "lineitem", "l_suppkey", "l_extendedprice")
    return rounded(agg.quantiles(lines, ["l_suppkey"], "l_extendedprice", {"median": 0.5, "p25": 0.25, "p95": 0.95}))


@query(
    "d09_moments",
    """WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY 1)
    SELECT event_type, round(stddev_samp(value), 6) AS std, round(avg((value - mu) ** 3) / avg((value - mu) ** 2) ** 1.5e0, 6) AS skew, round(kurtosis_pop(value), 6) AS kurt
    FROM events JOIN m USING (event_type) GROUP BY 1""",
)
def moments(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        r(F.stddev_samp("value")).alias("std"), r(F.skewness("value")).alias("skew"), r(F.kurtosis("value")).alias("kurt")
    )


@query("d10_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS rho FROM lineitem GROUP BY 1")
def correlation(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r(C.correlation("l_quantity", "l_extendedprice"), 8).alias("rho"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "d11_correlation_pairs",
    """WITH p AS (
      SELECT 'l_quantity' AS "left", 'l_extendedprice' AS "right", corr(l_quantity, l_extendedprice) AS c FROM lineitem UNION ALL
      SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL
      SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL
      SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL
      SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL
      SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem)
    SELECT "left", "right", round(c, 8) AS corr, abs(c) > 0.5 AS above FROM p""",
)
def correlation_pairs(spark, sf):
    pairs = agg.correlation_pairs(table(spark, sf, "lineitem", *FEATURES), FEATURES)
    return pairs.select("left", "right", r("corr", 8).alias("corr"), (F.abs("corr") > 0.5).alias("above"))


@query(
    "d12_spearman",
    """WITH a AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0e0 AS x,
      rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0e0 AS y FROM lineitem)
    SELECT round(corr(x, y), 6) AS spearman, count(*) AS n FROM a""",
)
def spearman(spark, sf):
    return rounded(agg.spearman(table(spark, sf, "lineitem", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"))


@query(
    "d13_weighted_mean",
    "SELECT o_orderpriority, round(sum(o_totalprice * o_custkey) / sum(o_totalprice), 6) AS weighted FROM orders GROUP BY 1",
)
def weighted_mean(spark, sf):
    w = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        r(C.ratio(F.sum(w * F.col("o_custkey")), F.sum(w))).alias("weighted")
    )


def closed_positions(spark, sf):
    return pos.positions(pos.with_markets(trades(spark, sf), markets(spark, sf)).where("market_closed"))


@query(
    "d14_position_netting",
    with_(POSITIONS) + """SELECT trader, slug, round(net_up_tokens, 6) AS net_up_tokens, round(net_down_tokens, 6) AS net_down_tokens,
    round(net_cash_flow, 6) AS net_cash_flow, num_trades, first_trade_time, last_trade_time, round(market_volume, 6) AS market_volume,
    round(final_position_value, 6) AS final_position_value, round(holding_time_hours, 6) AS holding_time_hours, position_fully_closed, round(net_pnl, 6) AS net_pnl FROM positions""",
)
def netting(spark, sf):
    return rounded(closed_positions(spark, sf))


STATS = """stats AS (SELECT trader, count(*) AS markets_participated, sum(num_trades)::BIGINT AS total_trades, avg(num_trades) AS avg_trades_per_market,
  min(num_trades) AS min_trades_per_market, max(num_trades) AS max_trades_per_market, sum(market_volume) AS total_volume_traded,
  avg(market_volume) AS avg_volume_per_market, max(market_volume) AS highest_volume_market, min(market_volume) AS lowest_volume_market,
  sum(net_pnl) AS total_pnl, avg(net_pnl) AS avg_pnl_per_market, median(net_pnl) AS median_pnl_per_market, max(net_pnl) AS highest_pnl_market,
  min(net_pnl) AS lowest_pnl_market, count(*) FILTER (net_pnl > 0) AS winning_markets, count(*) FILTER (net_pnl < 0) AS losing_markets,
  count(*) FILTER (abs(net_pnl) < 0.01) AS breakeven_markets,
  CASE WHEN count(*) FILTER (net_pnl <> 0) = 0 THEN NULL ELSE count(*) FILTER (net_pnl > 0) / count(*) FILTER (net_pnl <> 0) END AS win_rate,
  count(*) FILTER (position_fully_closed) AS fully_closed_positions, count(*) FILTER (NOT position_fully_closed) AS partial_positions,
  count(*) FILTER (position_fully_closed) / count(*) AS close_rate, min(first_trade_time) AS first_trade_time, max(last_trade_time) AS last_trade_time,
  (max(last_trade_time) - min(first_trade_time)) / 86400.0e0 AS trading_duration_days, avg(holding_time_hours) AS avg_holding_time_per_market_hours,
  stddev_samp(net_pnl) AS pnl_std_dev, max(net_pnl) FILTER (net_pnl > 0) AS largest_win, min(net_pnl) FILTER (net_pnl < 0) AS largest_loss,
  CASE WHEN coalesce(sum(net_pnl) FILTER (net_pnl < 0), 0) = 0 THEN NULL ELSE coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) / abs(sum(net_pnl) FILTER (net_pnl < 0)) END AS profit_factor
  FROM positions GROUP BY trader)"""

STAT_DOUBLES = """avg_trades_per_market total_volume_traded avg_volume_per_market highest_volume_market lowest_volume_market total_pnl
avg_pnl_per_market median_pnl_per_market highest_pnl_market lowest_pnl_market win_rate close_rate trading_duration_days
avg_holding_time_per_market_hours pnl_std_dev largest_win largest_loss profit_factor""".split()


@query(
    "d15_trader_rollup",
    with_(POSITIONS, STATS) + "SELECT * REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in STAT_DOUBLES) + ") FROM stats",
)
def rollup(spark, sf):
    t = trades(spark, sf)
    bound = table(spark, sf, "lineitem").count()  # positions are at most as many as trades
    p = pos.positions(pos.with_markets(t, markets(spark, sf)).where("market_closed"))
    return rounded(pos.trader_statistics(p, rows=bound), 9)


@query(
    "d16_trade_pnl",
    with_(ENRICHED) + "SELECT side, outcome, up_won, trade_result, count(*) AS n, round(sum(pnl), 4) AS pnl FROM enriched GROUP BY ALL",
)
def trade_pnl(spark, sf):
    t = pos.trade_result(pos.with_markets(trades(spark, sf), markets(spark, sf)))
    return t.groupBy("side", "outcome", "up_won", "trade_result").agg(F.count(F.lit(1)).alias("n"), r(F.sum("pnl"), 4).alias("pnl"))


@query(
    "d17_volume_by_market",
    with_(TRADES) + "SELECT trader, slug, count(*) AS trades, round(sum(price * size), 6) AS volume, min(ts) AS first_ts, max(ts) AS last_ts FROM trades GROUP BY 1, 2",
)
def volume_by_market(spark, sf):
    return rounded(pos.volume_by_market(trades(spark, sf)))


@query(
    "d18_calendar_aggregates",
    """SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, isodow(o_orderdate) - 1 AS weekday, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY GROUPING SETS ((y, m), (weekday))""",
)
def calendar_aggregates(spark, sf):
    o = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.weekday("o_orderdate").alias("weekday"), "o_totalprice"
    )
    return o.groupingSets([["y", "m"], ["weekday"]], "y", "m", "weekday").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "d19_dynamic_windows",
    """SELECT 'day' AS every, epoch(date_trunc('day', ts))::BIGINT AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 2
    UNION ALL SELECT 'week', epoch(date_trunc('week', ts))::BIGINT, count(*), round(avg(value), 6) FROM events GROUP BY 2""",
)
def dynamic_windows(spark, sf):
    e = table(spark, sf, "events", "ts", "value")
    stats = [F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean")]
    daily = e.groupBy(F.window("ts", "1 day").alias("w")).agg(*stats).select(
        F.lit("day").alias("every"), F.unix_seconds("w.start").alias("start"), "n", "mean"
    )
    weekly = e.groupBy(F.unix_seconds(F.date_trunc("week", "ts")).alias("start")).agg(*stats)
    return daily.unionByName(weekly.select(F.lit("week").alias("every"), "start", "n", "mean"))


@query(
    "d20_segment_statistics",
    with_(OPTIONS) + """, s AS (SELECT type, CASE WHEN spot / strike < 0.99 THEN 'otm' WHEN spot / strike < 1.01 THEN 'atm' WHEN spot / strike >= 1.01 THEN 'itm' END AS money,
      CASE WHEN days < 365 THEN 'short' ELSE 'long' END AS ttl, ask - bid AS spread FROM options WHERE strike > 0)
    SELECT type, money, ttl, count(*) AS n, round(avg(spread), 9) AS mean_spread, round(stddev_samp(spread), 9) AS std_spread FROM s
    GROUP BY GROUPING SETS ((type), (money), (ttl), (type, money))""",
)
def segments(spark, sf):
    m = C.ratio("spot", "strike")
    s = options(spark, sf).where("strike > 0").select(
        "type", C.bucket(m, [0.99, 1.01], ["otm", "atm", "itm"]).alias("money"),
        C.bucket("days", [365], ["short", "long"]).alias("ttl"), (F.col("ask") - F.col("bid")).alias("spread"),
    )
    return s.groupingSets([["type"], ["money"], ["ttl"], ["type", "money"]], "type", "money", "ttl").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("spread"), 9).alias("mean_spread"), r(F.stddev_samp("spread"), 9).alias("std_spread")
    )


EXCEED = {"absolute": ("abs(y - p)", (0.01, 0.05, 0.1)), "relative": ("abs(q - p) / p", (0.05, 0.1, 0.2))}


@query(
    "d21_exceedance_table",
    with_(FORECASTS) + " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {t}e0 AS threshold, count(*) FILTER ({value} > {t}e0) AS n_above, round(count(*) FILTER ({value} > {t}e0) * 100.0e0 / count({value}), 6) AS pct_above FROM fc"
        for kind, (value, levels) in EXCEED.items() for t in levels),
)
def exceedance(spark, sf):
    p, q = F.col("p"), F.col("q")
    measures = {"absolute": F.abs(F.col("y") - p), "relative": C.ratio(F.abs(q - p), "p")}
    return rounded(agg.exceedance(forecasts(spark, sf), {kind: (measures[kind], levels) for kind, (_, levels) in EXCEED.items()}))


@query(
    "d22_null_profile",
    with_(QUOTES) + """SELECT 'bid' AS feature, count(*) AS rows, count(*) - count(bid) AS nulls, round((count(*) - count(bid)) / count(*), 9) AS null_rate, min(sec) FILTER (bid IS NOT NULL) AS first_known FROM quotes
    UNION ALL SELECT 'ask', count(*), count(*) - count(ask), round((count(*) - count(ask)) / count(*), 9), min(sec) FILTER (ask IS NOT NULL) FROM quotes
    UNION ALL SELECT 'bid_amount', count(*), count(*) - count(bid_amount), round((count(*) - count(bid_amount)) / count(*), 9), min(sec) FILTER (bid_amount IS NOT NULL) FROM quotes""",
)
def null_profile(spark, sf):
    return rounded(agg.null_profile(quotes(spark, sf), ["bid", "ask", "bid_amount"], "sec"), 9)


@query(
    "d23_pivot",
    """SELECT p_type AS feature, round(avg(l_discount) FILTER (l_returnflag = 'A'), 8) AS A, round(avg(l_discount) FILTER (l_returnflag = 'N'), 8) AS N, round(avg(l_discount) FILTER (l_returnflag = 'R'), 8) AS R
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def pivot(spark, sf):
    parts = table(spark, sf, "part", "p_partkey", "p_type").withColumnRenamed("p_partkey", "l_partkey")
    lines = joins.lookup(table(spark, sf, "lineitem", "l_partkey", "l_returnflag", "l_discount"), parts, ["l_partkey"], "inner")
    wide = lines.groupBy(F.col("p_type").alias("feature")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_discount"))
    return rounded(wide, 8)


@query(
    "d24_gini",
    """WITH s AS (SELECT o_orderpriority, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 6) AS gini FROM s GROUP BY 1""",
)
def gini(spark, sf):
    return rounded(agg.gini(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice"))


@query(
    "d25_argmax_per_group",
    "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best_order, max(o_totalprice) AS best FROM orders GROUP BY 1",
)
def argmax(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best_order"), F.max("o_totalprice").alias("best")
    )


@query(
    "d26_binned_grid",
    with_(FORECASTS) + """SELECT CAST(least(greatest(floor((moneyness + 0.1e0) / (1.1e0 / 20.0e0)), 0), 19) AS INTEGER) AS mbin, CAST(least(greatest(floor(vol / (1.0e0 / 5.0e0)), 0), 4) AS INTEGER) AS vbin,
    count(*) AS n, round(avg(y), 6) AS win_rate FROM fc GROUP BY 1, 2 HAVING count(*) >= 20""",
)
def binned_grid(spark, sf):
    return forecasts(spark, sf).groupBy(
        C.equal_width("moneyness", -0.1, 1.0, 20).alias("mbin"), C.equal_width("vol", 0.0, 1.0, 5).alias("vbin")
    ).agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("win_rate")).where("n >= 20")


@query(
    "d27_histogram_cdf",
    """WITH h AS (SELECT CAST(least(greatest(floor((l_extendedprice - 0.0e0) / (105000.0e0 / 50.0e0)), 0), 49) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT bin, n, round(n / sum(n) OVER (), 9) AS share, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) AS cdf FROM h""",
)
def histogram(spark, sf):
    return rounded(agg.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 0.0, 105000.0, 50), 9)


@query(
    "d28_gap_histogram",
    with_(TICKS) + """, s AS (SELECT DISTINCT symbol, sec FROM ticks), g AS (SELECT symbol, sec, sec - lag(sec) OVER (PARTITION BY symbol ORDER BY sec) AS gap FROM s)
    SELECT symbol, count(*) AS seconds_seen, max(sec) - min(sec) + 1 AS seconds_span, round(count(*) * 100.0e0 / (max(sec) - min(sec) + 1), 9) AS coverage_pct, max(gap) AS longest_gap,
    count(*) FILTER (gap > 1) AS gaps_over_1s, count(*) FILTER (gap > 5) AS gaps_over_5s, count(*) FILTER (gap > 60) AS gaps_over_60s, count(*) FILTER (gap > 3600) AS gaps_over_3600s FROM g GROUP BY 1""",
)
def gap_histogram(spark, sf):
    return rounded(grid.coverage(ticks(spark, sf), ["symbol"], "sec"), 9)


@query(
    "d29_fill_estimate",
    with_(QUOTES) + "SELECT symbol, count(*) AS rows_now, max(sec) - min(sec) + 1 AS rows_filled, round((max(sec) - min(sec) + 1) / count(*), 6) AS growth FROM quotes GROUP BY 1",
)
def fill_estimate(spark, sf):
    span = F.max("sec") - F.min("sec") + 1
    return quotes(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows_now"), span.alias("rows_filled"), r(span / F.count(F.lit(1))).alias("growth")
    )


FAILED = OPTIONS + """, f AS (SELECT *, NOT (bid IS NOT NULL AND ask IS NOT NULL AND days > 0) AS failed FROM options)"""


def option_failures(spark, sf):
    bad = ~(F.col("bid").isNotNull() & F.col("ask").isNotNull() & (F.col("days") > 0))
    return options(spark, sf).withColumn("failed", bad)


@query(
    "d30_pareto_days",
    with_(FAILED) + """, d AS (SELECT sec // 86400 AS day, count(*) FILTER (failed) AS n FROM f GROUP BY 1),
    s AS (SELECT n, row_number() OVER (ORDER BY n DESC, day) AS rk, sum(n) OVER (ORDER BY n DESC, day) / sum(n) OVER () AS share FROM d)
    SELECT min(rk) FILTER (share >= 0.5e0) AS days_for_50, min(rk) FILTER (share >= 0.8e0) AS days_for_80, count(*) AS days FROM s""",
)
def pareto(spark, sf):
    days = option_failures(spark, sf).groupBy(C.epoch_day("sec").alias("day")).agg(F.count_if("failed").alias("n"))
    upto = Series(days.withColumn("_o", -F.col("n")), [], ["_o", "day"]).running(
        rk=Running("count"), cum=Running("sum", F.col("n")), whole=Running("total", F.col("n"))
    )
    share = F.col("cum") / F.col("whole")
    return upto.agg(
        F.min(F.when(share >= 0.5, F.col("rk"))).alias("days_for_50"), F.min(F.when(share >= 0.8, F.col("rk"))).alias("days_for_80"),
        F.count(F.lit(1)).alias("days"),
    )


@query(
    "d31_market_universe",
    with_(MARKETS) + """SELECT count(*) AS markets, count(*) FILTER (closed) AS closed_markets, count(DISTINCT category) AS categories, round(sum(CAST(volume AS DOUBLE)), 4) AS volume,
    round(avg(CAST(volume AS DOUBLE)), 6) AS mean_volume, max(p_size) AS largest FROM markets""",
)
def universe(spark, sf):
    v = F.col("volume").try_cast("double")
    return markets(spark, sf).agg(
        F.count(F.lit(1)).alias("markets"), F.count_if("closed").alias("closed_markets"), F.countDistinct("category").alias("categories"),
        r(F.sum(v), 4).alias("volume"), r(F.avg(v)).alias("mean_volume"), F.max("p_size").alias("largest"),
    )


REWARDS = """rew AS (SELECT p_partkey AS market, p_name AS question, p_retailprice AS liquidity, p_size * 40.0e0 AS volume, p_size / 10.0e0 AS reward, p_type AS asset FROM part)"""


def rewards(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("market"), F.col("p_name").alias("question"), F.col("p_retailprice").alias("liquidity"),
        (F.col("p_size") * 40.0).alias("volume"), (F.col("p_size") / 10.0).alias("reward"), F.col("p_type").alias("asset"),
    )


@query(
    "d32_reward_efficiency",
    with_(REWARDS) + "SELECT asset, count(*) AS markets, round(sum(reward), 4) AS reward, round(avg(reward / liquidity), 9) AS per_liquidity, round(sum(reward) / sum(volume), 9) AS per_volume FROM rew GROUP BY 1",
)
def reward_efficiency(spark, sf):
    return rewards(spark, sf).groupBy("asset").agg(
        F.count(F.lit(1)).alias("markets"), r(F.sum("reward"), 4).alias("reward"),
        r(F.avg(C.ratio("reward", "liquidity")), 9).alias("per_liquidity"), r(C.ratio(F.sum("reward"), F.sum("volume")), 9).alias("per_volume"),
    )


def makers(liquidity, volume, low=50_000, high=200_000):
    """Estimated market makers by liquidity tier, more in active and fewer in quiet markets."""
    base = F.when(liquidity < low, 2).when(liquidity < high, 5).otherwise(12)
    activity = C.ratio(volume, liquidity)
    return (
        F.when(activity > 1.0, F.floor(base * 1.5)).when(activity < 0.1, F.greatest(F.lit(1), F.floor(base * 0.5))).otherwise(base)
    )


@query(
    "d33_competition_tiers",
    with_(REWARDS) + """, m AS (SELECT *, CASE WHEN liquidity < 950 THEN 2 WHEN liquidity < 1050 THEN 5 ELSE 12 END AS base FROM rew),
    n AS (SELECT *, CAST(CASE WHEN volume / liquidity > 1 THEN floor(base * 1.5e0) WHEN volume / liquidity < 0.1e0 THEN greatest(1, floor(base * 0.5e0)) ELSE base END AS BIGINT) AS makers FROM m)
    SELECT market, makers, round(reward / makers * 0.6e0, 9) AS share FROM n""",
)
def competition(spark, sf):
    m = rewards(spark, sf).withColumn("makers", makers(F.col("liquidity"), F.col("volume"), 950, 1050))
    return m.select("market", "makers", r(F.col("reward") / F.col("makers") * 0.6, 9).alias("share"))


@query(
    "d34_leaderboard",
    """WITH v AS (SELECT o_custkey, sum(o_totalprice) AS volume FROM orders GROUP BY 1)
    SELECT c_custkey, round(volume, 2) AS volume_usd, c_acctbal AS pnl_usd, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank_by_pnl,
    row_number() OVER (ORDER BY round(volume, 2) DESC, c_custkey) AS rank_by_volume, round(c_acctbal * 100 / round(volume, 2), 6) AS pnl_roi_percentage, true AS is_complete_record
    FROM customer JOIN v ON c_custkey = o_custkey""",
)
def leaderboard(spark, sf):
    volume = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(r(F.sum("o_totalprice"), 2).alias("volume_usd"))
    people = table(spark, sf, "customer", "c_custkey", "c_acctbal").withColumnRenamed("c_acctbal", "pnl_usd").join(volume, "c_custkey")
    return pos.leaderboard(people, "c_custkey", "volume_usd", "pnl_usd").withColumn("pnl_roi_percentage", r("pnl_roi_percentage"))


@query(
    "d35_options_coverage",
    with_(QUOTES) + """SELECT count(DISTINCT sec) FILTER (bid IS NOT NULL AND ask IS NOT NULL) AS covered, max(sec) - min(sec) + 1 AS span,
    round(count(DISTINCT sec) FILTER (bid IS NOT NULL AND ask IS NOT NULL) / (max(sec) - min(sec) + 1), 9) AS coverage FROM quotes""",
)
def options_coverage(spark, sf):
    valid = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    out = quotes(spark, sf).agg(
        F.countDistinct(F.when(valid, F.col("sec"))).alias("covered"), (F.max("sec") - F.min("sec") + 1).alias("span")
    )
    return out.withColumn("coverage", r(C.ratio("covered", "span"), 9))


@query(
    "d36_daily_funding_rate",
    with_(TICKS) + "SELECT strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, round(avg(price / 1000000), 12) AS mean_rate, round(avg(price / 1000000) * 3 * 365 * 100, 8) AS annual_pct, count(*) AS n FROM ticks GROUP BY 1",
)
def funding(spark, sf):
    rate = F.avg(F.col("price") / 1000000)
    return ticks(spark, sf).groupBy(F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd").alias("date")).agg(
        r(rate, 12).alias("mean_rate"), r(rate * 3 * 365 * 100, 8).alias("annual_pct"), F.count(F.lit(1)).alias("n")
    )


@query(
    "d37_rate_blend",
    with_(TICKS) + """, a AS (SELECT sec // 86400 AS day, avg(price) / 10 AS a FROM ticks WHERE symbol = 'view' GROUP BY 1), b AS (SELECT sec // 86400 AS day, avg(price) / 12 AS b FROM ticks WHERE symbol = 'click' GROUP BY 1)
    SELECT day, round(0.5e0 * a + 0.5e0 * b, 8) AS blended, CASE WHEN count(*) OVER w >= 7 THEN round(avg(0.5e0 * a + 0.5e0 * b) OVER w, 8) END AS blended_ma7
    FROM a JOIN b USING (day) WINDOW w AS (ORDER BY day ROWS 6 PRECEDING)""",
)
def rate_blend(spark, sf):
    t = ticks(spark, sf).withColumn("day", C.epoch_day("sec"))
    side = lambda s, name, by: t.where(F.col("symbol") == s).groupBy("day").agg((F.avg("price") / by).alias(name))
    both = side("view", "a", 10).join(side("click", "b", 12), "day").select("day", (0.5 * F.col("a") + 0.5 * F.col("b")).alias("blended"))
    return rounded(Series(both, [], ["day"]).frames({"blended_ma7": rolling(F.avg, F.col("blended"), 7)}, before=6), 8)


BREAKDOWNS = [["type"], ["ttl"], ["y"], ["strike_bucket"], ["money"], ["day"], ["hour"], ["status"], ["type", "ttl"]]
BREAKDOWN_COLUMNS = ["type", "ttl", "y", "strike_bucket", "money", "day", "hour", "status"]


@query(
    "d38_failure_breakdowns",
    with_(FAILED) + f""", g AS (SELECT failed, type, CASE WHEN days < 0 THEN 'expired' WHEN days < 365 THEN 'short' ELSE 'long' END AS ttl, year(o_orderdate) AS y, floor(strike / 500) * 500 AS strike_bucket,
      CASE WHEN spot / nullif(strike, 0) < 0.99 THEN 'otm' WHEN spot / nullif(strike, 0) < 1.01 THEN 'atm' WHEN strike <> 0 THEN 'itm' END AS money, sec // 86400 AS day,
      (sec + l_partkey * 31) % 86400 // 3600 AS hour, CASE WHEN days <= 0 THEN 'expired' WHEN bid IS NULL AND ask IS NULL THEN 'no_quote' WHEN bid IS NULL THEN 'no_bid' WHEN ask IS NULL THEN 'no_ask' ELSE 'solved' END AS status FROM f)
    SELECT {', '.join(BREAKDOWN_COLUMNS)}, count(*) AS n, count(*) FILTER (failed) AS failures, round(count(*) FILTER (failed) * 100.0e0 / count(*), 6) AS failure_pct FROM g
    GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in BREAKDOWNS)})""",
)
def failures(spark, sf):
    bid, ask = F.col("bid").isNull(), F.col("ask").isNull()
    status = F.when(F.col("days") <= 0, "expired").when(bid & ask, "no_quote").when(bid, "no_bid").when(ask, "no_ask").otherwise("solved")
    g = option_failures(spark, sf).select(
        "failed", "type", C.bucket("days", [0, 365], ["expired", "short", "long"]).alias("ttl"), F.year("o_orderdate").alias("y"),
        C.round_down("strike", 500.0).alias("strike_bucket"),
        C.bucket(C.ratio("spot", "strike"), [0.99, 1.01], ["otm", "atm", "itm"]).alias("money"), C.epoch_day("sec").alias("day"),
        F.floor((F.col("sec") + F.col("l_partkey") * 31) % 86400 / 3600).alias("hour"), status.alias("status"),
    )
    out = g.groupingSets(BREAKDOWNS, *BREAKDOWN_COLUMNS).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"))
    return out.withColumn("failure_pct", r(C.ratio(F.col("failures") * 100, "n")))


@query(
    "d39_contingency_cube",
    with_(ENRICHED) + "SELECT side, outcome, trade_result, count(*) AS n FROM enriched GROUP BY CUBE (side, outcome, trade_result)",
)
def contingency(spark, sf):
    t = pos.trade_result(pos.with_markets(trades(spark, sf), markets(spark, sf)))
    return t.cube("side", "outcome", "trade_result").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d40_nested_rates",
    with_(TICKS) + """SELECT id, price AS lender_variable, CASE WHEN k % 3 = 0 THEN NULL ELSE price * 1.5e0 END AS borrower_variable, CASE WHEN k = 0 THEN NULL ELSE round(price / k * 100, 8) END AS utilisation FROM ticks""",
)
def nested_rates(spark, sf):
    entry = lambda side, value: F.struct(F.lit(side).alias("side"), F.lit("variable").alias("type"), value.alias("rate"))
    nested = ticks(spark, sf).select(
        "id", "k", "price",
        F.when(F.col("k") % 3 == 0, F.array(entry("lender", F.col("price")))).otherwise(
            F.array(entry("lender", F.col("price")), entry("borrower", F.col("price") * 1.5))
        ).alias("rates"),
    )
    keyed = F.map_from_entries(F.transform("rates", lambda x: F.struct(F.concat_ws("_", x["side"], x["type"]), x["rate"])))
    rates = nested.withColumn("by_key", keyed)
    return rates.select(
        "id", *[F.try_element_at("by_key", F.lit(n)).alias(n) for n in ("lender_variable", "borrower_variable")],
        r(C.ratio("price", "k") * 100, 8).alias("utilisation"),
    )


def _profile_sql(t, c):
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS nulls, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c}) AS min, max({c}) AS max,
    round(quantile_cont({c}, 0.25), 5) AS p25, round(median({c}), 5) AS median, round(quantile_cont({c}, 0.75), 5) AS p75, round(quantile_cont({c}, 0.95), 5) AS p95 FROM {t}"""


@query("d41_column_profile", " UNION ALL ".join(_profile_sql("lineitem", c) for c in FEATURES))
def column_profile(spark, sf):
    return rounded(agg.column_profile(table(spark, sf, "lineitem", *FEATURES), FEATURES), 5)


@query(
    "d42_position_cohorts",
    with_(POSITIONS) + ", c AS (" + " UNION ALL ".join(
        f"SELECT '{s}' AS split, {e} AS cohort, net_pnl, market_volume FROM positions" for s, e in (
            ("closed", "CASE WHEN position_fully_closed THEN 'closed' ELSE 'partial' END"),
            ("trades", "CASE WHEN num_trades = 1 THEN 'single' ELSE 'multi' END"),
            ("result", "CASE WHEN net_pnl > 0 THEN 'winner' WHEN net_pnl < 0 THEN 'loser' ELSE 'flat' END"),
        )
    ) + ") SELECT split, cohort, count(*) AS positions, round(sum(net_pnl), 3) AS pnl, round(avg(net_pnl), 5) AS avg_pnl, round(sum(market_volume), 3) AS volume FROM c GROUP BY 1, 2",
)
def cohorts(spark, sf):
    c = pos.cohorts(closed_positions(spark, sf))
    return c.select("split", "cohort", "positions", r("pnl", 3).alias("pnl"), r("avg_pnl", 5).alias("avg_pnl"), r("volume", 3).alias("volume"))


ACTIVITY = [["strike", "type"], ["expiry"], ["symbol"], ["day"]]


@query(
    "d43_activity_profile",
    with_(OPTIONS) + """, o AS (SELECT strike, type, expiry, l_suppkey AS symbol, sec // 86400 AS day, bid, ask, spot FROM options),
    g AS (SELECT grouping(strike, expiry, symbol, day) AS view_, strike, type, expiry, symbol, day, count(*) AS quotes, count(DISTINCT expiry) AS expiries, round(avg(bid), 12) AS mean_premium, round(avg(ask - bid), 12) AS mean_spread,
    round(avg(abs(spot - strike)), 6) AS mean_distance FROM o GROUP BY GROUPING SETS ((strike, type), (expiry), (symbol), (day)))
    SELECT * EXCLUDE (view_) FROM g QUALIFY row_number() OVER (PARTITION BY view_ ORDER BY quotes DESC, strike, type, expiry, symbol, day) <= 20""",
)
def activity(spark, sf):
    """The twenty busiest strikes by type, expiries, symbols and days."""
    o = options(spark, sf).select("strike", "type", "expiry", F.col("l_suppkey").alias("symbol"), C.epoch_day("sec").alias("day"), "bid", "ask", "spot",
                                  F.col("expiry").alias("due"), F.col("strike").alias("at"))
    names = ["strike", "type", "expiry", "symbol", "day"]
    g = o.groupingSets(ACTIVITY, *names).agg(
        F.grouping_id().alias("view"), F.count(F.lit(1)).alias("quotes"), F.countDistinct("due").alias("expiries"), r(F.avg("bid"), 12).alias("mean_premium"),
        r(F.avg(F.col("ask") - F.col("bid")), 12).alias("mean_spread"), r(F.avg(F.abs(F.col("spot") - F.col("at")))).alias("mean_distance"),
    )
    return agg.top_per_group(g, ["view"], [F.desc("quotes"), *names], 20).drop("view", "rank")
