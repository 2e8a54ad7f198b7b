"""The supplied tables in the shapes the operators expect: trades, markets, ticks, quotes, options, forecasts.

Every shape is given twice, as a DataFrame and as a SQL common table expression for the twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.files import read_table

DAY = 86_400


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", columns or None)


def r(column, digits: int = 6):
    """Round for comparison, keeping the name."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- ticks: events as a tape of five symbols --------------------------------------------------------

TICKS = """ticks AS (
  SELECT event_type AS symbol, epoch_us(ts) AS ts_us, epoch_us(ts) // 1000000 AS sec, event_id AS id,
         value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, value
  FROM events)"""


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.unix_micros("ts").alias("ts_us"), F.unix_seconds("ts").alias("sec"),
        F.col("event_id").alias("id"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id", "value",
    )


# -- trades and markets: line items of orders, parts ------------------------------------------------

TRADES = """trades AS (
  SELECT o_custkey AS trader, l_partkey AS slug, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
         CASE WHEN l_linenumber % 2 = 1 THEN 'Up' ELSE 'Down' END AS outcome, l_quantity AS size,
         LEAST(1.0e0, l_discount * 10) AS price, CAST(epoch(l_shipdate) AS BIGINT) AS ts,
         concat(l_orderkey, '-', l_linenumber) AS tx, l_orderkey, l_linenumber, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

MARKETS = """markets AS (
  SELECT p_partkey AS slug, p_size % 5 <> 0 AS closed,
         CASE WHEN p_size % 2 = 0 THEN '["1","0"]' ELSE '["0","1"]' END AS outcome_prices, p_name AS question,
         p_type AS category, CAST(p_retailprice AS VARCHAR) AS volume, p_size, p_retailprice
  FROM part)"""

SETTLED = MARKETS + """, settled AS (
  SELECT slug, closed AS market_closed, CASE WHEN p_size % 2 = 0 THEN 1.0e0 ELSE 0.0e0 END AS up_price,
         CASE WHEN p_size % 2 = 0 THEN 0.0e0 ELSE 1.0e0 END AS down_price, p_size % 2 = 0 AS up_won, p_size % 2 <> 0 AS down_won
  FROM markets)"""

ENRICHED = TRADES + ", " + SETTLED + """, enriched AS (
  SELECT trades.*, market_closed, up_price, down_price, up_won, down_won,
    CASE WHEN market_closed THEN
      CASE WHEN side = 'BUY' AND ((outcome = 'Up' AND up_won) OR (outcome = 'Down' AND down_won)) THEN (1 - price) * size
           WHEN side = 'BUY' THEN -price * size
           WHEN (outcome = 'Up' AND down_won) OR (outcome = 'Down' AND up_won) THEN price * size
           ELSE (price - 1) * size END END AS pnl,
    CASE WHEN NOT market_closed THEN 'unresolved'
         WHEN (side = 'BUY') = ((outcome = 'Up' AND up_won) OR (outcome = 'Down' AND down_won)) THEN 'won'
         ELSE 'lost' END AS trade_result
  FROM trades LEFT JOIN settled USING (slug))"""

POSITIONS = ENRICHED + """, netted AS (
  SELECT trader, slug,
    sum(CASE WHEN outcome = 'Up' THEN CASE side WHEN 'BUY' THEN size ELSE -size END ELSE 0 END) AS net_up_tokens,
    sum(CASE WHEN outcome = 'Down' THEN CASE side WHEN 'BUY' THEN size ELSE -size END ELSE 0 END) AS net_down_tokens,
    sum(CASE side WHEN 'BUY' THEN -price * size ELSE price * size END) AS net_cash_flow,
    max(up_price) AS up_price, max(down_price) AS down_price, count(*) AS num_trades,
    min(ts) AS first_trade_time, max(ts) AS last_trade_time, sum(price * size) AS market_volume
  FROM enriched WHERE market_closed GROUP BY ALL),
positions AS (
  SELECT *, net_up_tokens * up_price + net_down_tokens * down_price AS final_position_value,
    (last_trade_time - first_trade_time) / 3600.0e0 AS holding_time_hours,
    abs(net_up_tokens) < 0.001 AND abs(net_down_tokens) < 0.001 AS position_fully_closed,
    net_cash_flow + net_up_tokens * up_price + net_down_tokens * down_price AS net_pnl
  FROM netted)"""


def trades(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("trader"), F.col("l_partkey").alias("slug"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.when(F.col("l_linenumber") % 2 == 1, "Up").otherwise("Down").alias("outcome"),
        F.col("l_quantity").alias("size"), F.least(F.lit(1.0), F.col("l_discount") * 10).alias("price"),
        F.unix_seconds("l_shipdate").alias("ts"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    )


def markets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("slug"), (F.col("p_size") % 5 != 0).alias("closed"),
        F.when(F.col("p_size") % 2 == 0, '["1","0"]').otherwise('["0","1"]').alias("outcome_prices"),
        F.col("p_name").alias("question"), F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("string").alias("volume"), "p_size", "p_retailprice",
    )


# -- quotes: bid and ask per supplier and second ----------------------------------------------------

QUOTES = """quotes AS (
  SELECT l_suppkey AS symbol, CAST(epoch(l_shipdate) AS BIGINT)
           + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400 AS sec,
         CASE WHEN (l_orderkey + l_linenumber) % 10 <> 0 THEN l_extendedprice / l_quantity * (1 - l_discount) END AS bid,
         CASE WHEN (l_partkey + l_linenumber) % 12 <> 0 THEN l_extendedprice / l_quantity * (1 + l_tax) END AS ask,
         l_quantity AS bid_amount, l_linenumber * 1.0e0 AS ask_amount,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem)"""

QUOTE_ORDER = ["sec", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    offset = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), (F.unix_seconds("l_shipdate") + offset % DAY).alias("sec"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 10 != 0, price * (1 - F.col("l_discount"))).alias("bid"),
        F.when((F.col("l_partkey") + F.col("l_linenumber")) % 12 != 0, price * (1 + F.col("l_tax"))).alias("ask"),
        F.col("l_quantity").alias("bid_amount"), (F.col("l_linenumber") * 1.0).alias("ask_amount"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


# -- option quotes: order date = quote time, ship date = expiry -------------------------------------

OPTIONS = """options AS (
  SELECT CAST(epoch(o_orderdate) AS BIGINT) AS sec, CAST(epoch(l_shipdate) AS BIGINT) AS expiry,
         CASE WHEN l_linenumber % 2 = 1 THEN 'call' ELSE 'put' END AS type,
         l_extendedprice / l_quantity AS spot, round(l_extendedprice / l_quantity / 100) * 100 AS strike,
         CASE WHEN (l_orderkey + l_linenumber) % 10 <> 0 THEN 0.005e0 + l_discount * 0.5e0 END AS bid,
         CASE WHEN (l_partkey + l_linenumber) % 12 <> 0 THEN (0.005e0 + l_discount * 0.5e0) * (1 + l_tax) + 0.001e0 END AS ask,
         (CAST(epoch(l_shipdate) AS BIGINT) - CAST(epoch(o_orderdate) AS BIGINT)) / 86400.0e0 AS days,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_orderdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def options(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    premium = 0.005 + F.col("l_discount") * 0.5
    quoted, due = F.unix_seconds("o_orderdate"), F.unix_seconds("l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        quoted.alias("sec"), due.alias("expiry"),
        F.when(F.col("l_linenumber") % 2 == 1, "call").otherwise("put").alias("type"),
        price.alias("spot"), (F.round(price / 100) * 100).alias("strike"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 10 != 0, premium).alias("bid"),
        F.when((F.col("l_partkey") + F.col("l_linenumber")) % 12 != 0,
               premium * (1 + F.col("l_tax")) + 0.001).alias("ask"),
        ((due - quoted) / 86400.0).alias("days"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "o_orderdate",
    )


# -- forecasts: probability p, enhanced q, outcome y per event --------------------------------------

FORECASTS = """fc AS (
  SELECT event_id AS id, epoch_us(ts) // 1000000 AS sec, epoch_us(ts) AS ts_us, user_id, event_type AS model, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         (CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5e0) / 100 AS p,
         0.1e0 + 0.8e0 * ((CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5e0) / 100) AS q,
         CASE WHEN (event_id * 7919 + CAST(floor(value * 100) AS BIGINT)) % 100
                   < CAST(json_extract_string(props, '$.k') AS BIGINT) THEN 1 ELSE 0 END AS y,
         user_id * 6 AS time_left, (value - 50) / 500.0e0 AS moneyness,
         (event_id * 104729 % 1000) / 1000.0e0 AS vol, (event_id * 31 % 240) AS staleness
  FROM events)"""


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    noise = (F.col("event_id") * 7919 + F.floor(F.col("value") * 100)) % 100
    p = (k + 0.5) / 100
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.unix_seconds("ts").alias("sec"), F.unix_micros("ts").alias("ts_us"),
        "user_id", F.col("event_type").alias("model"), "value", k.alias("k"), p.alias("p"),
        (0.1 + 0.8 * p).alias("q"), F.when(noise < k, 1).otherwise(0).alias("y"),
        (F.col("user_id") * 6).alias("time_left"), ((F.col("value") - 50) / 500.0).alias("moneyness"),
        (F.col("event_id") * 104729 % 1000 / 1000.0).alias("vol"), (F.col("event_id") * 31 % 240).alias("staleness"),
    )


def with_(*ctes: str) -> str:
    """Open a WITH clause."""
    return "WITH " + ",\n".join(ctes) + "\n"
