"""Sources and sinks, projections and predicates, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import aggregates as agg, grid, joins, positions as pos
from tidemark.plans.registry import query
from tidemark.plans.standins import (
    DAY, ENRICHED, FORECASTS, MARKETS, OPTIONS, POSITIONS, QUOTES, SETTLED, TICKS, TRADES, forecasts, markets, options,
    quotes, r, rounded, table, ticks, trades, with_,
)
from tidemark.session import scratch
from tidemark.sources import calendar, files

# == flagship ========================================================================================


@query(
    "flagship_trader_profit",
    with_(POSITIONS) + """SELECT trader, count(*) AS markets_participated, sum(num_trades)::BIGINT AS total_trades,
      round(sum(net_pnl), 2) AS total_pnl, count(*) FILTER (net_pnl > 0) AS winning_markets,
      round(sum(market_volume), 2) AS total_volume_traded
    FROM positions GROUP BY trader ORDER BY round(sum(net_pnl), 2) DESC, trader LIMIT 100""",
)
def flagship(spark, sf):
    """Which traders made money?"""
    enriched = pos.trade_result(pos.with_markets(trades(spark, sf), markets(spark, sf)))
    p = pos.positions(enriched.where("market_closed"))
    stats = p.groupBy("trader").agg(
        F.count(F.lit(1)).alias("markets_participated"), F.sum("num_trades").alias("total_trades"),
        r(F.sum("net_pnl"), 2).alias("total_pnl"), F.count_if(F.col("net_pnl") > 0).alias("winning_markets"),
        r(F.sum("market_volume"), 2).alias("total_volume_traded"),
    )
    return pos.top_traders(stats, "total_pnl", 100)


# == A: sources and sinks ============================================================================


@query(
    "a01_parquet_scan",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
)
def parquet_scan(spark, sf):
    return files.read_table(
        spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"],
        "l_quantity > 45 and l_returnflag = 'R'",
    )


@query("a02_glob_scan", "SELECT n_nationkey AS key, n_name AS name FROM nation")
def glob_scan(spark, sf):
    return files.read_tree(spark, sf, "nation*.parquet").select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")
    )


def _trade_csv(spark, sf):
    path = scratch(spark, "csv")
    tape = ticks(spark, sf).select(
        F.lit("venue").alias("exchange"), "symbol", F.col("ts_us").alias("timestamp"),
        (F.col("ts_us") + 250).alias("local_timestamp"), F.col("id").cast("string").alias("id"),
        F.when(F.col("k") % 2 == 0, "buy").otherwise("sell").alias("side"), "price", F.col("k").cast("double").alias("amount"),
    )
    tape.write.option("header", "true").option("compression", "gzip").csv(path)
    return path


@query(
    "a03_csv_scan",
    with_(TICKS) + """SELECT symbol, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, count(*) AS n,
      min(ts_us) AS first_us, max(ts_us) AS last_us, round(sum(price), 4) AS price_sum FROM ticks GROUP BY ALL""",
)
def csv_scan(spark, sf):
    tape = files.read_csv(spark, _trade_csv(spark, sf), files.TRADE_CSV)
    return tape.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_us"), F.max("timestamp").alias("last_us"),
        r(F.sum("price"), 4).alias("price_sum"),
    )


def quote_messages(spark, sf):
    """Events as market messages; some are of another type, malformed, crossed or one-sided."""
    k, price = F.col("k"), F.col("price")
    option = F.when(k % 2 == 0, "C").otherwise("P")
    strike = F.floor(price / 10) * 10 + 100
    level = lambda p, a: F.struct(p.alias("price"), a.alias("amount"))
    bids = F.when(k % 7 == 0, F.array().cast("array<struct<price:double,amount:double>>")).otherwise(
        F.array(level(price, k.cast("double")), level(price - 1, k * 2.0))
    )
    asks = F.array(level(F.when(k % 11 == 0, price - 5).otherwise(price + 2), k * 1.5))
    day = F.dayofmonth(F.timestamp_seconds("sec")) % 28 + 1
    return files.spread(ticks(spark, sf)).select(
        F.when(F.col("symbol") == "signup", "book_change").otherwise("quote").alias("type"),
        F.lit("venue").alias("exchange"),
        F.when(k % 13 == 0, "BROKEN").otherwise(F.concat_ws("-", F.lit("BTC"), F.concat(day, F.lit("FEB24")), strike, option)).alias("symbol"),
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("localTimestamp"),
        bids.alias("bids"), asks.alias("asks"),
    )


@query(
    "a04_ndjson_scan",
    with_(TICKS) + """SELECT CASE WHEN symbol = 'signup' THEN 'book_change' ELSE 'quote' END AS type, count(*) AS n,
      count(*) FILTER (k % 7 <> 0) AS with_bids, round(sum(CASE WHEN k % 7 <> 0 THEN price END), 4) AS bid_sum
    FROM ticks GROUP BY ALL""",
)
def ndjson_scan(spark, sf):
    path = scratch(spark, "ndjson")
    quote_messages(spark, sf).write.json(path)
    return files.read_messages(spark, path).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("bids") > 0).alias("with_bids"),
        r(F.sum(F.get("bids", F.lit(0))["price"]), 4).alias("bid_sum"),
    )


TX_ROWS = """pages_in AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS tx, CAST(l_quantity AS VARCHAR) AS size, l_suppkey AS page, l_partkey,
    l_extendedprice FROM lineitem)"""


@query(
    "a05_landed_pages_dedup",
    with_(TX_ROWS) + """SELECT tx, CAST(size AS DOUBLE) AS size, page, l_partkey, l_extendedprice FROM pages_in
    QUALIFY row_number() OVER (PARTITION BY tx ORDER BY page, l_partkey, l_extendedprice) = 1""",
)
def landed_pages(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx"), F.col("l_quantity").cast("string").alias("size"),
        F.col("l_suppkey").alias("page"), "l_partkey", "l_extendedprice",
    )
    path = scratch(spark, "pages")
    lines.write.json(path)
    landed = files.read_messages(spark, path, lines.schema)
    return files.landed_pages(landed, "tx", ["page", "l_partkey", "l_extendedprice"], {"size": "double"})


@query("a06_parquet_sink", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def parquet_sink(spark, sf):
    path = scratch(spark, "sink")
    files.write_parquet(table(spark, sf, "orders"), path)
    back = files.read_table(spark, path, ["o_orderpriority", "o_totalprice"])
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "a07_hour_partitioned_sink",
    "SELECT concat('m', day(ts) % 2) AS market, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n FROM events GROUP BY ALL",
)
def hour_sink(spark, sf):
    path = scratch(spark, "hours")
    events = files.with_hour_parts(table(spark, sf, "events"), F.col("ts"))
    events = events.withColumn("market", F.concat(F.lit("m"), F.dayofmonth("ts") % 2))
    files.write_parquet(events, path, ["market", "date", "hour"])
    back = spark.read.schema("event_id long, market string, date string, hour string").parquet(path)
    return back.groupBy("market", "date", "hour").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a08_calendar_path_sink",
    "SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY ALL",
)
def calendar_sink(spark, sf):
    path = scratch(spark, "days")
    files.write_parquet(files.with_calendar_parts(table(spark, sf, "orders"), F.col("o_orderdate")), path, ["year", "month", "day"])
    back = spark.read.schema("o_orderkey long, year string, month string, day string").parquet(path)
    return back.groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key")
    )


@query(
    "a09_csv_report",
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
)
def csv_report(spark, sf):
    path = scratch(spark, "report")
    best = table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    files.write_csv_report(best, path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query(
    "a10_json_summary",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_id, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
)
def json_summary(spark, sf):
    path = scratch(spark, "summary")
    summary = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), r(F.avg("value")).alias("mean_value")
    )
    files.write_json_summary(summary, path)
    return files.read_messages(spark, path, summary.schema)


@query("a11_compaction", "SELECT event_id, epoch_us(ts) AS ts_us, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def compaction(spark, sf):
    path = scratch(spark, "compact")
    files.compact(table(spark, sf, "events"), ["ts", "event_id"], path)
    back = files.read_table(spark, path).select("event_id", F.unix_micros("ts").alias("ts_us"))
    from tidemark.operators.series import Running, Series

    return Series(back, [], ["ts_us", "event_id"]).running(position=Running("count"))


@query(
    "a12_append_dedup",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) = 1""",
)
def append_dedup(spark, sf):
    """Load a table in two overlapping appends."""
    path = scratch(spark, "append")
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_extendedprice")
    lines = lines.withColumn("key", F.concat_ws("-", "l_returnflag", "l_orderkey", "l_linenumber"))
    order = ["l_partkey", "l_extendedprice"]
    for part in (lines.where("l_returnflag != 'A'"), lines.where("l_returnflag != 'N'")):
        files.append_dedup(spark, path, part, "key", order, "l_returnflag")
    return files.read_table(spark, path).drop("key")


@query(
    "a13_latest_snapshot",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
)
def latest_snapshot(spark, sf):
    return files.latest_snapshot(table(spark, sf, "orders"), "o_orderdate").select("o_orderkey", "o_custkey", "o_totalprice")


@query("a13_newest_file", "SELECT n_regionkey, count(*) AS n, min(n_nationkey) AS first_nation FROM nation GROUP BY 1")
def newest_file(spark, sf):
    """Two snapshots written one after the other; the newer file is read."""
    path = scratch(spark, "snapshots")
    nations = table(spark, sf, "nation")
    for part in (nations.where("n_regionkey = 0"), nations):
        counts = part.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.min("n_nationkey").alias("first_nation"))
        counts.coalesce(1).write.mode("append").parquet(path)  # at most one row per region
    return files.latest_file(spark, path)


@query(
    "a14_healing_union",
    """SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
    UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def healing_union(spark, sf):
    left = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
        F.lit(None).alias("segment"),
    )
    right = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    return files.heal_union(left, right, {"id": "long", "name": "string", "balance": "double", "segment": "string"})


@query(
    "a15_open_closed_split",
    with_(MARKETS) + "SELECT closed, count(*) AS n, count(DISTINCT category) AS categories, round(sum(CAST(volume AS DOUBLE)), 4) AS volume FROM markets GROUP BY closed",
)
def open_closed(spark, sf):
    path = scratch(spark, "split")
    every = markets(spark, sf)
    files.write_parquet(every.where("closed"), f"{path}/closed")
    files.write_parquet(every.where("not closed"), f"{path}/open")
    both = files.read_table(spark, f"{path}/closed").unionByName(files.read_table(spark, f"{path}/open"))
    return both.groupBy("closed").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("categories"),
        r(F.sum(F.col("volume").try_cast("double")), 4).alias("volume"),
    )


SCHEDULE = """span AS (SELECT min(epoch_us(ts) // 1000000) AS lo, max(epoch_us(ts) // 1000000) AS hi FROM events),
contracts AS (SELECT unnest(range(lo // 900 * 900, hi + 1, 900)) AS open_time FROM span)"""


def contracts(spark, sf, length=900):
    span = ticks(spark, sf).agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"))
    return calendar.contracts_between(span, "lo", "hi", length)


@query(
    "a16_contract_schedule",
    with_(SCHEDULE) + """SELECT strftime(to_timestamp(open_time) AT TIME ZONE 'UTC', '%Y%m%d_%H%M') AS contract_id, open_time,
      open_time + 900 AS close_time, strftime(to_timestamp(open_time) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date,
      hour(to_timestamp(open_time) AT TIME ZONE 'UTC') AS hour_of_day, minute(to_timestamp(open_time) AT TIME ZONE 'UTC') AS minute_of_hour,
      isodow(to_timestamp(open_time) AT TIME ZONE 'UTC') - 1 AS day_of_week FROM contracts""",
)
def contract_schedule(spark, sf):
    return contracts(spark, sf).withColumn("date", F.col("date").cast("string"))


@query(
    "a17_local_time_slugs",
    """WITH span AS (SELECT min(epoch_us(ts) // 1000000) AS lo, max(epoch_us(ts) // 1000000) AS hi FROM events),
    hours AS (SELECT unnest(range(lo // 3600 * 3600, hi + 1, 3600)) AS open_time FROM span),
    l AS (SELECT open_time, to_timestamp(open_time) AT TIME ZONE 'America/New_York' AS t FROM hours)
    SELECT open_time, lower(concat('bitcoin-up-or-down-', strftime(t, '%B'), '-', day(t), '-',
      CASE WHEN hour(t) % 12 = 0 THEN 12 ELSE hour(t) % 12 END, CASE WHEN hour(t) < 12 THEN 'am' ELSE 'pm' END, '-et')) AS slug FROM l""",
)
def local_slugs(spark, sf):
    return contracts(spark, sf, 3600).select("open_time", calendar.local_slug(F.col("open_time")).alias("slug"))


@query(
    "a18_run_manifest",
    "SELECT count(*) AS rows, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, true AS has_bytes FROM events",
)
def run_manifest(spark, sf):
    path = scratch(spark, "manifest")
    files.write_parquet(table(spark, sf, "events"), path)
    m = files.manifest(spark, path, "ts")
    return m.agg(
        F.sum("rows").alias("rows"), F.unix_micros(F.min("first_ts")).alias("first_us"),
        F.unix_micros(F.max("last_ts")).alias("last_us"), (F.sum("bytes") > 0).alias("has_bytes"),
    )


@query(
    "a19_rekey_to_utc",
    """SELECT event_id, strftime((strftime(ts, '%Y-%m-%d %H:%M:00')::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC', '%Y%m%d_%H%M') AS label_utc FROM events""",
)
def rekey_utc(spark, sf):
    label = F.date_format("ts", "yyyyMMdd_HHmm")
    utc = files.local_label_to_utc(label, "yyyyMMdd_HHmm", "Europe/Berlin")
    return table(spark, sf, "events").select("event_id", F.date_format(utc, "yyyyMMdd_HHmm").alias("label_utc"))


@query(
    "a20_asset_contexts",
    with_(TICKS) + """SELECT strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, symbol, count(*) AS n, count(*) >= 50 AS complete
    FROM ticks WHERE symbol IN ('click', 'view', 'purchase') GROUP BY ALL""",
)
def asset_contexts(spark, sf):
    path = scratch(spark, "contexts")
    ticks(spark, sf).select(
        F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("symbol").alias("coin"), "price"
    ).write.option("header", "true").csv(path)
    rows = files.read_csv(spark, path, "time string, coin string, price double")
    rows = rows.withColumn("ts", F.try_to_timestamp("time")).where(F.col("coin").isin("click", "view", "purchase"))
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("coin").alias("symbol")).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 50).alias("complete")
    )


# == B: projections, predicates, buckets =============================================================


@query(
    "b01_project_rename",
    "SELECT o_orderkey AS market_id, o_totalprice AS volume, o_custkey AS trader FROM orders",
)
def project(spark, sf):
    return table(spark, sf, "orders").withColumnsRenamed(
        {"o_orderkey": "market_id", "o_totalprice": "volume", "o_custkey": "trader"}
    ).select("market_id", "volume", "trader")


@query(
    "b02_computed_columns",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 8) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 8) AS gross,
    round((l_extendedprice / l_quantity * (1 + l_tax) - l_extendedprice / l_quantity * (1 - l_discount)) / (l_extendedprice / l_quantity) * 10000, 7) AS spread_bps FROM lineitem""",
)
def computed(spark, sf):
    price, unit = F.col("l_extendedprice"), F.col("l_extendedprice") / F.col("l_quantity")
    net = price * (1 - F.col("l_discount"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r(net, 8).alias("net"), r(net * (1 + F.col("l_tax")), 8).alias("gross"),
        r((unit * (1 + F.col("l_tax")) - unit * (1 - F.col("l_discount"))) / unit * 10000, 7).alias("spread_bps"),
    )


@query(
    "b03_conditional_labels",
    with_(ENRICHED) + "SELECT tx, trader, slug, trade_result, round(pnl, 6) AS pnl FROM enriched",
)
def conditional(spark, sf):
    t = pos.trade_result(pos.with_markets(trades(spark, sf), markets(spark, sf)))
    return t.select("tx", "trader", "slug", "trade_result", r("pnl").alias("pnl"))


@query("b04_compound_predicate", with_(QUOTES) + "SELECT symbol, sec, l_orderkey, l_linenumber FROM quotes WHERE (bid IS NOT NULL OR ask IS NOT NULL) AND symbol <> 3")
def compound(spark, sf):
    return quotes(spark, sf).where("(bid is not null or ask is not null) and symbol != 3").select(
        "symbol", "sec", "l_orderkey", "l_linenumber"
    )


@query("b05_range_predicate", with_(OPTIONS) + "SELECT l_orderkey, l_linenumber, spot / strike AS m FROM options WHERE spot / strike BETWEEN 0.97 AND 1.03")
def between(spark, sf):
    m = C.ratio("spot", "strike")
    return options(spark, sf).where(m.between(0.97, 1.03)).select("l_orderkey", "l_linenumber", m.alias("m"))


@query("b06_membership", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def membership(spark, sf):
    return table(spark, sf, "orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F")
    ).select("o_orderkey")


@query(
    "b07_scrub_infinities",
    with_(TICKS) + """SELECT id, CASE WHEN k = 0 OR k % 9 = 0 THEN NULL WHEN price <= 0 THEN NULL ELSE round(ln(price / k), 8) END AS log_ratio,
    k % 9 = 0 AND k <> 0 AS was_nan, k = 0 AS was_inf FROM ticks""",
)
def scrub(spark, sf):
    raw = F.when(F.col("k") == 0, float("inf")).when(F.col("k") % 9 == 0, float("nan")).otherwise(F.ln(F.col("price") / F.nullif("k", F.lit(0))))
    return ticks(spark, sf).withColumn("raw", raw).select(
        "id", r(C.scrub("raw"), 8).alias("log_ratio"), F.coalesce(F.isnan("raw"), F.lit(False)).alias("was_nan"), F.coalesce(F.abs("raw") == float("inf"), F.lit(False)).alias("was_inf")
    )


@query(
    "b08_lenient_cast",
    "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN concat(p_size, 'x') ELSE CAST(p_size AS VARCHAR) END AS BIGINT) AS size FROM part",
)
def lenient_cast(spark, sf):
    text = F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit("x"))).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.try_cast("long").alias("size"))


@query("b09_clip", with_(FORECASTS) + "SELECT id, greatest(0.05e0, least(0.95e0, p + moneyness)) AS prob FROM fc".replace("greatest(0.05e0, least(0.95e0, p + moneyness))", "round(greatest(0.05e0, least(0.95e0, p + moneyness)), 9)"))
def clip(spark, sf):
    return forecasts(spark, sf).select("id", r(C.clip(F.col("p") + F.col("moneyness"), 0.05, 0.95), 9).alias("prob"))


@query("b10_safe_ratio", with_(TICKS) + "SELECT id, CASE WHEN k = 0 THEN NULL ELSE round(price / k, 10) END AS ratio FROM ticks")
def safe_ratio(spark, sf):
    return ticks(spark, sf).select("id", r(C.ratio("price", "k"), 10).alias("ratio"))


SLUGS = """slugs AS (SELECT event_id AS id, CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 9
  WHEN 0 THEN concat('btc-up-or-down-15m-', event_id) WHEN 1 THEN 'bitcoin-up-or-down-june-11-2am-et'
  WHEN 2 THEN 'bitcoin-up-or-down-on-june-11' WHEN 3 THEN 'solana-up-or-down-in-june'
  WHEN 4 THEN 'ethereum-up-or-down-june-3pm-candle' WHEN 5 THEN concat('ethbtc-above-', event_id)
  WHEN 6 THEN 'xrp-up-or-down-on-may-3-noon-2' WHEN 7 THEN 'who-wins-the-cup' ELSE 'eth-up-or-down-15m-x' END AS slug FROM events)"""


@query(
    "b11_market_categories",
    with_(SLUGS) + """SELECT id, slug, CASE WHEN slug LIKE 'btc-up-or-down-15m-%' THEN 'btc_15min' WHEN slug LIKE 'bitcoin%-et' THEN 'bitcoin_hourly'
      WHEN slug LIKE 'bitcoin-up-or-down-on-%' THEN 'bitcoin_daily' WHEN slug LIKE 'solana%in-june' THEN 'solana_aggregated'
      WHEN slug LIKE '%-candle' THEN 'ethereum_hourly_candle' WHEN slug LIKE 'ethbtc%' THEN 'ethbtc'
      WHEN slug LIKE 'xrp%on-%' THEN 'xrp_daily' END AS category FROM slugs""",
)
def categories(spark, sf):
    k, text = F.col("k") % 9, F.col("id").cast("string")
    slug = (
        F.when(k == 0, F.concat(F.lit("btc-up-or-down-15m-"), text)).when(k == 1, "bitcoin-up-or-down-june-11-2am-et")
        .when(k == 2, "bitcoin-up-or-down-on-june-11").when(k == 3, "solana-up-or-down-in-june")
        .when(k == 4, "ethereum-up-or-down-june-3pm-candle").when(k == 5, F.concat(F.lit("ethbtc-above-"), text))
        .when(k == 6, "xrp-up-or-down-on-may-3-noon-2").when(k == 7, "who-wins-the-cup").otherwise("eth-up-or-down-15m-x")
    )
    return ticks(spark, sf).select("id", slug.alias("slug")).withColumn("category", C.categorize("slug"))


@query(
    "b12_keyword_assets",
    """SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%ring%' THEN 'warm' WHEN lower(p_name) LIKE '%blue%' THEN 'cold' ELSE 'other' END AS asset
    FROM part WHERE regexp_matches(p_name, '(?i)ring|bolt|widget')""",
)
def keywords(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").rlike("(?i)ring|bolt|widget")).select(
        "p_partkey", C.tag_assets("p_name", {"warm": ["red", "ring"], "cold": ["blue"]}).alias("asset")
    )


@query("b13_best_mid", with_(QUOTES) + "SELECT l_orderkey, l_linenumber, l_partkey, coalesce((bid + ask) / 2, bid, ask) AS mid FROM quotes")
def best_mid(spark, sf):
    return quotes(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", C.mid_price("bid", "ask").alias("mid"))


@query(
    "b14_breakpoint_buckets",
    with_(FORECASTS) + """SELECT CASE WHEN time_left < 300 THEN 'near' WHEN time_left < 600 THEN 'mid' ELSE 'far' END AS horizon,
      CASE WHEN staleness < 10 THEN 'fresh' WHEN staleness < 60 THEN 'moderate' WHEN staleness < 120 THEN 'stale' ELSE 'very_stale' END AS age,
      count(*) AS n FROM fc GROUP BY ALL""",
)
def breakpoints(spark, sf):
    return forecasts(spark, sf).groupBy(
        C.bucket("time_left", [300, 600], ["near", "mid", "far"]).alias("horizon"),
        C.bucket("staleness", [10, 60, 120], ["fresh", "moderate", "stale", "very_stale"]).alias("age"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b15_equal_width_bins",
    "SELECT CAST(least(greatest(floor((l_quantity - 1) / 4.9e0), 0), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1",
)
def equal_width(spark, sf):
    return table(spark, sf, "lineitem").groupBy(C.equal_width("l_quantity", 1.0, 50.0, 10).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("l_discount")).alias("mean")
    )


DECILES = """edges AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM events)"""


@query(
    "b16_quantile_bins",
    with_(DECILES) + "SELECT event_id, CAST(len(list_filter(e, lambda x: x < value)) AS INTEGER) AS bin FROM events, edges",
)
def quantile_bins(spark, sf):
    events = table(spark, sf, "events", "event_id", "value")
    probs = {f"e{i}": i / 10 for i in range(1, 10)}
    edges = agg.quantiles(events, [], "value", probs)
    cut = agg.attach(events, edges, []).select("event_id", C.cut_points("value", F.array(*probs), 10).alias("bin"))
    return cut


@query(
    "b17_terciles",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.33) AS a, quantile_cont(l_extendedprice, 0.67) AS b FROM lineitem)
    SELECT CASE WHEN l_extendedprice <= a THEN 'low' WHEN l_extendedprice <= b THEN 'medium' ELSE 'high' END AS tercile, count(*) AS n,
    round(avg(l_quantity), 6) AS mean_quantity FROM lineitem, q GROUP BY 1""",
)
def terciles(spark, sf):
    lines = table(spark, sf, "lineitem", "l_extendedprice", "l_quantity")
    edges = agg.quantiles(lines, [], "l_extendedprice", {"a": 0.33, "b": 0.67})
    x = F.col("l_extendedprice")
    label = F.when(x <= F.col("a"), "low").when(x <= F.col("b"), "medium").otherwise("high")
    return agg.attach(lines, edges, []).groupBy(label.alias("tercile")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean_quantity")
    )


@query("b18_feature_selection", "SELECT l_orderkey, l_tax, 'rv_60s,delta' AS missing FROM lineitem")
def feature_selection(spark, sf):
    have, missing = C.select_existing(table(spark, sf, "lineitem"), ["l_orderkey", "rv_60s", "l_tax", "delta"])
    return have.withColumn("missing", F.lit(",".join(missing)))


@query("b19_round_down", "SELECT floor(o_totalprice / 5000) * 5000 AS bucket, count(*) AS n FROM orders GROUP BY 1")
def round_down(spark, sf):
    return table(spark, sf, "orders").groupBy(C.round_down("o_totalprice", 5000.0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("b20_warmup_trim", with_(TICKS) + "SELECT id, sec FROM ticks WHERE sec >= (SELECT min(sec) FROM ticks) + 48 * 3600")
def warmup(spark, sf):
    t = ticks(spark, sf)
    return t.where(F.col("sec") >= t.agg(F.min("sec") + 48 * 3600).scalar()).select("id", "sec")


# == C: joins ========================================================================================

DAILY = """daily AS (SELECT epoch_us(ts) // 86400000000 AS day, avg(value) / 1000 AS rate FROM events GROUP BY 1)"""


def daily_rates(spark, sf):
    return ticks(spark, sf).groupBy(C.epoch_day("sec").alias("day")).agg((F.avg("price") / 1000).alias("rate"))


@query(
    "c01_left_time_join",
    """WITH d AS (SELECT o_orderdate AS t, avg(o_totalprice) AS spot FROM orders GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, round(spot, 8) AS spot FROM lineitem LEFT JOIN d ON l_shipdate = t""",
)
def left_time(spark, sf):
    spot = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("l_shipdate")).agg(
        F.avg("o_totalprice").alias("spot")
    )
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return joins.lookup(lines, spot, ["l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey", r("spot", 8).alias("spot"))


@query(
    "c02_multi_key_join",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, max(l_extendedprice) AS iv FROM lineitem GROUP BY ALL)
    SELECT a.*, round(iv * 1.01e0, 4) AS iv_daily FROM a""",
)
def multi_key(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    left = table(spark, sf, "lineitem").groupBy(*keys).agg(F.max("l_extendedprice").alias("iv"))
    right = left.select(*keys, r(F.col("iv") * 1.01, 4).alias("iv_daily"))
    return left.join(right, keys, "inner")


@query(
    "c03_wide_join_chain",
    with_(TICKS) + """, a AS (SELECT sec // 3600 AS h, avg(price) AS mean_price FROM ticks GROUP BY 1),
    b AS (SELECT sec // 3600 AS h, sum(k) AS volume FROM ticks WHERE symbol = 'click' GROUP BY 1),
    c AS (SELECT sec // 3600 AS h, max(price) AS high FROM ticks WHERE symbol = 'view' GROUP BY 1),
    d AS (SELECT sec // 3600 AS h, count(DISTINCT user_id) AS users FROM ticks WHERE symbol = 'error' GROUP BY 1)
    SELECT h, round(mean_price, 6) AS mean_price, volume::BIGINT AS volume, high, users FROM a LEFT JOIN b USING (h) LEFT JOIN c USING (h) LEFT JOIN d USING (h)""",
)
def wide_chain(spark, sf):
    t = ticks(spark, sf).withColumn("h", F.floor(F.col("sec") / 3600))
    out = t.groupBy("h").agg(r(F.avg("price")).alias("mean_price"))
    parts = [
        t.where("symbol = 'click'").groupBy("h").agg(F.sum("k").alias("volume")),
        t.where("symbol = 'view'").groupBy("h").agg(F.max("price").alias("high")),
        t.where("symbol = 'error'").groupBy("h").agg(F.countDistinct("user_id").alias("users")),
    ]
    for part in parts:  # every side is already partitioned by the key: no further shuffle
        out = out.join(part, "h", "left")
    return out


@query(
    "c04_contract_seconds",
    with_(SCHEDULE) + """SELECT open_time, count(*) AS n, min(open_time + s) AS first_sec, max(open_time + s) AS last_sec
    FROM contracts, range(0, 900) t(s) GROUP BY 1""",
)
def contract_seconds(spark, sf):
    grid_ = contracts(spark, sf).withColumn("sec", F.explode(F.sequence("open_time", F.col("close_time") - 1)))
    return grid_.groupBy("open_time").agg(
        F.count(F.lit(1)).alias("n"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec")
    )


@query(
    "c05_lifecycle_grid",
    with_(TICKS) + """, s AS (SELECT symbol, min(sec // 300 * 300) AS lo, max(sec // 300 * 300) AS hi FROM ticks GROUP BY 1)
    SELECT symbol, unnest(range(lo, hi + 1, 300)) AS sec FROM s""",
)
def lifecycle(spark, sf):
    t = ticks(spark, sf).withColumn("sec", grid.second_of("ts_us", 300))
    return grid.lifecycle_grid(t, ["symbol"], "sec", 300)


CLICKS = TICKS + """, l AS (SELECT id, symbol, sec, price FROM ticks WHERE symbol = 'click'),
rt AS (SELECT id AS rid, sec AS rsec, price AS spot FROM ticks WHERE symbol = 'view')"""


def _sides(spark, sf):
    t = ticks(spark, sf)
    left = t.where("symbol = 'click'").select("id", "sec", "price")
    right = t.where("symbol = 'view'").select(F.col("id").alias("rid"), F.col("sec").alias("rsec"), F.col("price").alias("spot"))
    return left, right


@query(
    "c06_asof_nearest",
    with_(CLICKS) + """, u AS (SELECT rsec, rid, spot FROM rt QUALIFY row_number() OVER (PARTITION BY rsec ORDER BY rid DESC) = 1),
    f AS (SELECT rsec, rid, spot FROM rt QUALIFY row_number() OVER (PARTITION BY rsec ORDER BY rid) = 1),
    b AS (SELECT l.*, u.rsec AS bs, u.spot AS bp FROM l ASOF LEFT JOIN u ON l.sec >= u.rsec),
    n AS (SELECT b.*, f.rsec AS ns, f.spot AS np FROM b ASOF LEFT JOIN f ON b.sec <= f.rsec),
    m AS (SELECT id, sec, price, CASE WHEN ns IS NULL OR sec - bs <= ns - sec THEN bs ELSE ns END AS matched_ts,
      CASE WHEN ns IS NULL OR sec - bs <= ns - sec THEN bp ELSE np END AS spot FROM n)
    SELECT id, sec, price, CASE WHEN abs(matched_ts - sec) <= 600 THEN matched_ts END AS matched_ts,
      CASE WHEN abs(matched_ts - sec) <= 600 THEN spot END AS spot FROM m""",
)
def asof_nearest(spark, sf):
    left, right = _sides(spark, sf)
    return joins.asof(left, right, on=("sec", "rsec"), ids=("id", "rid"), take=["spot"], direction="nearest", tolerance=600)


@query(
    "c07_asof_backward",
    with_(QUOTES, TICKS) + """, l AS (SELECT l_suppkey AS symbol, CAST(epoch(l_shipdate) AS BIGINT) + 43200 AS sec, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS id, l_quantity FROM lineitem),
    rt AS (SELECT symbol, sec AS rsec, bid AS matched_bid FROM quotes WHERE bid IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY symbol, sec ORDER BY l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey DESC) = 1)
    SELECT l.symbol, l.sec, id, l_quantity, rsec AS matched_ts, round(matched_bid, 9) AS matched_bid FROM l ASOF LEFT JOIN rt ON l.symbol = rt.symbol AND l.sec >= rt.rsec""",
)
def asof_backward(spark, sf):
    ident = F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")
    left = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), (F.unix_seconds("l_shipdate") + 43200).alias("sec"), ident.alias("id"), "l_quantity"
    )
    right = quotes(spark, sf).where("bid is not null").select(
        "symbol", F.col("sec").alias("rsec"), ident.alias("rid"), F.col("bid").alias("matched_bid")
    )
    out = joins.asof(left, right, on=("sec", "rsec"), ids=("id", "rid"), by=["symbol"], take=["matched_bid"])
    return out.withColumn("matched_bid", r("matched_bid", 9))


IV_QUOTES = """iv AS (SELECT sec, id AS qid, 0.2e0 + k / 200.0e0 AS iv, (sec // 28800 + 1 + k % 3) * 28800 AS expiry FROM ticks WHERE symbol IN ('purchase', 'view')),
grid AS (SELECT open_time, open_time + 900 AS close_time, unnest(range(open_time, open_time + 900)) AS sec FROM contracts)"""


def iv_quotes(spark, sf):
    t = ticks(spark, sf).where("symbol in ('purchase', 'view')")
    return t.select(
        "sec", F.col("id").alias("qid"), (0.2 + F.col("k") / 200.0).alias("iv"),
        ((F.floor(F.col("sec") / 28800) + 1 + F.col("k") % 3) * 28800).alias("expiry"),
    )


@query(
    "c08_closest_eligible",
    with_(TICKS, SCHEDULE, IV_QUOTES) + """SELECT grid.sec, close_time, iv, expiry FROM grid JOIN iv USING (sec) WHERE expiry > close_time
    QUALIFY row_number() OVER (PARTITION BY grid.sec, close_time ORDER BY expiry - grid.sec, qid) = 1""",
)
def closest(spark, sf):
    quoted = iv_quotes(spark, sf)
    periods = contracts(spark, sf).select("open_time", "close_time")
    at = quoted.select("sec").distinct()
    pairs = joins.interval_lookup(at, "sec", periods, "open_time", "close_time", 900)
    return joins.closest_eligible(
        pairs, quoted, ["sec"], "expiry", "qid", F.col("expiry") > F.col("close_time"), ["sec", "close_time"], ["iv", "expiry"],
    )


@query("c09_semi_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def semi(spark, sf):
    keys = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").join(keys, "o_orderkey", "left_semi")


@query("c10_missing_keys", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark, sf):
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders", "o_orderkey").join(keys, "o_orderkey", "left_anti")


@query(
    "c11_call_put_pairs",
    with_(OPTIONS) + """, c AS (SELECT sec, strike, max(bid IS NOT NULL AND ask IS NOT NULL) AS ok FROM options WHERE type = 'call' GROUP BY 1, 2),
    p AS (SELECT sec, strike, max(bid IS NOT NULL AND ask IS NOT NULL) AS ok FROM options WHERE type = 'put' GROUP BY 1, 2)
    SELECT c.ok AS call_ok, p.ok AS put_ok, count(*) AS n FROM c JOIN p USING (sec, strike) GROUP BY ALL""",
)
def pairs(spark, sf):
    ok = F.bool_or(F.col("bid").isNotNull() & F.col("ask").isNotNull())
    o = options(spark, sf)
    side = lambda t, name: o.where(F.col("type") == t).groupBy("sec", "strike").agg(ok.alias(name))
    return side("call", "call_ok").join(side("put", "put_ok"), ["sec", "strike"]).groupBy("call_ok", "put_ok").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "c12_rate_of_day",
    with_(DAILY, TICKS) + "SELECT id, round(rate, 9) AS rate FROM ticks JOIN daily ON sec // 86400 = day",
)
def rate_of_day(spark, sf):
    rates = daily_rates(spark, sf)
    t = ticks(spark, sf).withColumn("day", C.epoch_day("sec"))
    return joins.with_gap_check(joins.lookup(t, rates, ["day"]), "rate", "a day has no rate").select("id", r("rate", 9).alias("rate"))


@query(
    "c13_strike_and_outcome",
    with_(TICKS) + """, g AS (SELECT sec // 900 AS c, arg_min(price, (sec, id)) AS strike, arg_max(price, (sec, id)) AS close FROM ticks GROUP BY 1)
    SELECT id, c AS contract, strike, close, CAST(close > strike AS INTEGER) AS outcome FROM ticks JOIN g ON sec // 900 = c""",
)
def strike_outcome(spark, sf):
    t = ticks(spark, sf).withColumn("contract", F.floor(F.col("sec") / 900))
    by = F.struct("sec", "id")
    ends = t.groupBy("contract").agg(F.min_by("price", by).alias("strike"), F.max_by("price", by).alias("close"))
    return joins.lookup(t, ends, ["contract"]).select(
        "id", "contract", "strike", "close", (F.col("close") > F.col("strike")).cast("int").alias("outcome")
    )


@query(
    "c14_interval_lookup",
    with_(TICKS, SCHEDULE) + "SELECT id, open_time FROM ticks JOIN contracts ON sec >= open_time AND sec < open_time + 900",
)
def interval(spark, sf):
    periods = contracts(spark, sf).select("open_time", "close_time")
    return joins.interval_lookup(ticks(spark, sf).select("id", "sec"), "sec", periods, "open_time", "close_time", 900).select("id", "open_time")


@query(
    "c15_last_row_dedup_join",
    with_(QUOTES) + """, k AS (SELECT symbol, sec // 86400 AS day, arg_max(bid, (sec, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) FILTER (bid IS NOT NULL) AS bid FROM quotes GROUP BY 1, 2)
    SELECT s_suppkey, day, round(bid, 9) AS bid, s_acctbal FROM k JOIN supplier ON symbol = s_suppkey""",
)
def last_row_join(spark, sf):
    from tidemark.plans.standins import QUOTE_ORDER

    q = quotes(spark, sf).withColumn("day", C.epoch_day("sec"))
    last = grid.last_known(q, ["symbol", "day"], ["bid"], QUOTE_ORDER)
    people = table(spark, sf, "supplier", "s_suppkey", "s_acctbal")
    return joins.lookup(last.withColumnRenamed("symbol", "s_suppkey"), people, ["s_suppkey"], "inner").select(
        "s_suppkey", "day", r("bid", 9).alias("bid"), "s_acctbal"
    )


@query(
    "c16_trade_market_enrichment",
    with_(TRADES, SETTLED) + "SELECT tx, trader, slug, market_closed, up_won FROM trades LEFT JOIN settled USING (slug)",
)
def trade_market(spark, sf):
    return pos.with_markets(trades(spark, sf), markets(spark, sf)).select("tx", "trader", "slug", "market_closed", "up_won")


@query(
    "c17_table_comparison",
    """WITH a AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    b AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    SELECT o_custkey, round(a.v, 2) AS v_old, round(b.v, 2) AS v_new, CASE WHEN a.v IS NULL THEN 'new_only' WHEN b.v IS NULL THEN 'old_only' ELSE 'both' END AS presence,
      round(b.v - a.v, 2) AS v_diff, round(b.v / a.v, 6) AS v_ratio FROM a FULL JOIN b USING (o_custkey)""",
)
def comparison(spark, sf):
    o = table(spark, sf, "orders")
    total = lambda bad: o.where(F.col("o_orderstatus") != bad).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    out = joins.compare_tables(total("P"), total("F"), ["o_custkey"], ["v"])
    return out.select("o_custkey", r("v_old", 2).alias("v_old"), r("v_new", 2).alias("v_new"), "presence",
                      r("v_diff", 2).alias("v_diff"), r("v_ratio").alias("v_ratio"))


@query("c18_mapping_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def mapping(spark, sf):
    nations = table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "c_nationkey", "n_regionkey": "r_regionkey"})
    out = joins.lookup(table(spark, sf, "customer", "c_custkey", "c_nationkey"), nations, ["c_nationkey"], "inner")
    return joins.lookup(out, table(spark, sf, "region"), ["r_regionkey"], "inner").select("c_custkey", "n_name", "r_name")


ROBUST = TICKS + """, """ + SCHEDULE + """, per AS (SELECT sec, sum(price * (k + 1)) / sum(k + 1) AS vwap FROM ticks GROUP BY 1),
near AS (SELECT open_time, vwap, row_number() OVER (PARTITION BY open_time ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY open_time) AS n
  FROM contracts JOIN per ON sec BETWEEN open_time - 300 AND open_time),
wm AS (SELECT open_time, sum(vwap * exp(CASE WHEN n = 1 THEN -1.0e0 ELSE -1.0e0 + i / (n - 1.0e0) END)) / sum(exp(CASE WHEN n = 1 THEN -1.0e0 ELSE -1.0e0 + i / (n - 1.0e0) END)) AS k1 FROM near GROUP BY 1),
bk AS (SELECT open_time, vwap AS k2 FROM contracts ASOF LEFT JOIN per ON open_time >= sec),
fw AS (SELECT open_time, vwap AS k3 FROM contracts ASOF LEFT JOIN per ON open_time <= sec)"""


@query(
    "c19_robust_strike",
    with_(ROBUST) + "SELECT open_time, round(coalesce(k1, k2, k3), 6) AS strike FROM contracts LEFT JOIN wm USING (open_time) LEFT JOIN bk USING (open_time) LEFT JOIN fw USING (open_time)",
)
def robust_strike(spark, sf):
    from tidemark.operators.options import robust_strikes

    amount = F.col("k") + 1
    per_second = ticks(spark, sf).groupBy("sec").agg((F.sum(F.col("price") * amount) / F.sum(amount)).alias("vwap"))
    return robust_strikes(contracts(spark, sf).select("open_time"), per_second, "vwap", 300).withColumn("strike", r("strike"))


@query(
    "c20_current_and_next",
    with_(TICKS, SCHEDULE) + "SELECT id, open_time AS current_open, CASE WHEN open_time < (SELECT max(open_time) FROM contracts) THEN open_time + 900 END AS next_open FROM ticks JOIN contracts ON sec >= open_time AND sec < open_time + 900",
)
def current_next(spark, sf):
    from tidemark.operators.series import Series, lead

    periods = contracts(spark, sf).select("open_time", "close_time")
    ahead = Series(periods, [], ["open_time"]).frames({"next_open": lead("open_time")}, before=0, after=1)
    found = joins.interval_lookup(ticks(spark, sf).select("id", "sec"), "sec", ahead, "open_time", "close_time", 900)
    return found.select("id", F.col("open_time").alias("current_open"), "next_open")
