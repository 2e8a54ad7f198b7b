"""Streaming queries: events are landed as JSON files, streamed into tables, and the tables returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.market import CHANGES, book_changes
from tidemark.plans.registry import query
from tidemark.plans.standins import TICKS, r, ticks, with_
from tidemark.plans.tabular import contracts
from tidemark.session import scratch
from tidemark.sources.files import read_table, write_parquet
from tidemark.streaming import capture

KIND = """CASE symbol WHEN 'click' THEN 'book' WHEN 'view' THEN 'price_change' WHEN 'purchase' THEN 'last_trade_price' WHEN 'signup' THEN 'tick_size_change' ELSE 'book' END"""
MESSAGES = TICKS + f""", msg AS (SELECT *, {KIND} AS event_type, user_id % 7 AS asset, price AS bid0, price - 1 AS bid1, price + 1 + k % 3 AS ask0, price + 4 AS ask1 FROM ticks),
mark AS (SELECT (max(ts_us) // 1000 - 60000) * 1000 AS wm FROM ticks)"""


def messages(spark, sf):
    """Events as capture messages: books, level changes, trades, tick sizes."""
    t, k, p = ticks(spark, sf), F.col("k"), F.col("price")
    kind = F.when(F.col("symbol").isin("click", "error"), "book").when(F.col("symbol") == "view", "price_change").when(
        F.col("symbol") == "purchase", "last_trade_price").otherwise("tick_size_change")
    level = lambda price, size: F.struct(price.alias("price"), size.cast("double").alias("size"))
    side = F.when(F.col("id") % 2 == 0, "BUY").otherwise("SELL")
    change = lambda price, size: F.struct(side.alias("side"), price.alias("price"), size.cast("double").alias("size"))
    return t.select(
        kind.alias("event_type"), (F.col("user_id") % 7).cast("string").alias("asset_id"), F.col("symbol").alias("market"),
        F.concat(F.lit("h"), "id").alias("hash"), F.timestamp_micros("ts_us").alias("event_time"),
        F.timestamp_micros(F.col("ts_us") + k * 1000).alias("received_time"), F.col("id").alias("seq"),
        # worst level first: the reader must not rely on the order
        F.when(kind == "book", F.array(level(p - 1, k + 1), level(p, k))).alias("bids"),
        F.when(kind == "book", F.array(level(p + 4, k + 2), level(p + 1 + k % 3, k))).alias("asks"),
        F.when(kind == "price_change", F.array(change(p, k), change(p + 1, k + 1))).alias("price_changes"),
        side.alias("side"), p.alias("price"), k.cast("double").alias("size"),
    )


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def land(part, path):
    """Write messages as JSON files, as many as the input has partitions."""
    part.write.mode("append").option("timestampFormat", MICROS).json(path)


def weeks(df):
    """Three consecutive slices by time."""
    at = F.col("event_time")
    edges = [F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")]
    return [df.where(at < edges[0]), df.where((at >= edges[0]) & (at < edges[1])), df.where(at >= edges[1])]


def landed(spark, name, parts, run, schema=capture.EVENT_SCHEMA):
    """Land one slice after the other; after each, the stream goes on from its checkpoint over the new files."""
    path = scratch(spark, name)
    table, checkpoint = capture.fresh(spark, name)
    for part in parts:
        land(part, path)
        run(capture.message_stream(spark, path, schema), table, checkpoint)
    return table


def streamed(spark, sf, name, transform, partition_by=()):
    def run(stream, table, checkpoint):
        capture.append_table(transform(stream), table, checkpoint, partition_by)

    return read_table(spark, landed(spark, name, weeks(messages(spark, sf)), run))


@query("l01_message_source", with_(MESSAGES) + "SELECT event_type, count(*) AS n, round(sum(price), 4) AS price_sum FROM msg GROUP BY 1")
def message_source(spark, sf):
    out = streamed(spark, sf, "messages", lambda s: s.select("event_type", "price"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), 4).alias("price_sum"))


@query(
    "l02_route_by_type",
    with_(MESSAGES) + "SELECT CASE event_type WHEN 'last_trade_price' THEN 'trade' WHEN 'tick_size_change' THEN 'tick_size' ELSE event_type END AS route, CASE WHEN event_type = 'price_change' THEN 2 ELSE 1 END * count(*) AS n FROM msg GROUP BY event_type",
)
def routes(spark, sf):
    names = capture.event_routes()
    table = landed(spark, "route", weeks(messages(spark, sf)), lambda stream, table, checkpoint: capture.route(stream, names, table, checkpoint))
    out = None
    for name in names:
        one = read_table(spark, f"{table}/{name}").groupBy(F.lit(name).alias("route")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("l03_flat_book", with_(MESSAGES) + "SELECT id AS seq, CAST(asset AS VARCHAR) AS asset_id, bid0 AS best_bid, k::DOUBLE AS best_bid_size, CASE WHEN ask0 < ask1 THEN ask0 ELSE ask1 END AS best_ask, 2 AS bid_depth FROM msg WHERE event_type = 'book'")
def flat_book(spark, sf):
    out = streamed(spark, sf, "flat", lambda s: capture.flatten_book(s.where("event_type = 'book'")))
    return out.select("seq", "asset_id", "best_bid", "best_bid_size", "best_ask", "bid_depth")


@query("l04_top_levels", with_(MESSAGES) + "SELECT id AS seq, bid0 AS bid_price_1, bid1 AS bid_price_2, least(ask0, ask1) AS ask_price_1, least(ask0, ask1) - bid0 AS spread, NULL::DOUBLE AS bid_price_3 FROM msg WHERE event_type = 'book'")
def top_levels(spark, sf):
    out = streamed(spark, sf, "top", lambda s: capture.top_of_book(s, 3))
    return out.select("seq", "bid_price_1", "bid_price_2", "ask_price_1", "spread", "bid_price_3")


BOOKS = MESSAGES + """, ev AS (SELECT asset, ts_us // 1000 AS ms, id, bid0 AS bid, least(ask0, ask1) AS ask, row_number() OVER (PARTITION BY asset ORDER BY ts_us, id) AS i FROM msg WHERE event_type = 'book'),
sm(asset, i, id, kept, last, bid, ask) AS (SELECT asset, i, id, true, ms, bid, ask FROM ev WHERE i = 1
  UNION ALL SELECT asset, i, id, hit, CASE WHEN hit THEN ms ELSE last END, CASE WHEN hit THEN nb ELSE bid END, CASE WHEN hit THEN na ELSE ask END
  FROM (SELECT sm.asset, ev.i, ev.id, ms, last, sm.bid, sm.ask, ev.bid AS nb, ev.ask AS na, (ms - last >= 7200000 OR (sm.bid > 0 AND abs(ev.bid - sm.bid) / sm.bid > 0.5e0) OR (sm.ask > 0 AND abs(ev.ask - sm.ask) / sm.ask > 0.5e0)) AS hit FROM sm JOIN ev ON ev.asset = sm.asset AND ev.i = sm.i + 1))"""


@query("l05_adaptive_sampler", "WITH RECURSIVE " + BOOKS + " SELECT CAST(asset AS VARCHAR) AS asset_id, id AS seq FROM sm WHERE kept")
def sampler(spark, sf):
    def transform(s):
        flat = capture.flatten_book(s.where("event_type = 'book'")).withColumns({"us": F.unix_micros("event_time"), "ms": F.unix_millis("event_time")})
        return capture.sampled(flat, "asset_id", ["us", "seq"], "ms", "best_bid", "best_ask", interval_ms=7_200_000, move=0.5)

    return streamed(spark, sf, "sampler", transform).select("asset_id", "seq")


def land_days(part, path):
    """One file per day of event time, as a collector that rotates its files does."""
    day = F.date_format("event_time", "yyyy-MM-dd")
    part.withColumn("day", day).repartition("day").write.mode("append").partitionBy("day").option("timestampFormat", MICROS).json(path)


@query("l06_micro_batches", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, min(event_id) AS first_seq, CAST(1 AS BIGINT) AS days FROM events GROUP BY 1")
def micro_batches(spark, sf):
    """A day's file is all that a micro-batch may take: many flushes per landed slice, each with the rows of one day."""
    path = scratch(spark, "flush")
    table, checkpoint = capture.fresh(spark, "flush")
    routes = {"all": lambda d: d.select("seq", F.date_format("event_time", "yyyy-MM-dd").alias("day"))}
    for part in weeks(messages(spark, sf)):
        land_days(part, path)
        capture.route(capture.message_stream(spark, path, files_per_batch=1), routes, table, checkpoint)
    flushed = read_table(spark, f"{table}/all").groupBy("batch").agg(F.min("day").alias("day"), F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"), F.countDistinct("day").alias("days"))
    return flushed.drop("batch")


@query("l07_hour_partitions", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, count(DISTINCT hour(ts)) AS hours FROM events GROUP BY 1")
def hour_partitions(spark, sf):
    out = streamed(spark, sf, "hours", lambda s: capture.by_hour(s, F.col("event_time")).select("seq", "date", "hour"), ["date", "hour"])
    return out.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hour").alias("hours"))


def window_sql(length, step=None):
    step = step or length
    n = length // step
    return f"""w AS (SELECT market, st AS start_us, st + {length}000000 AS end_us, price, spread FROM (SELECT symbol AS market, price, CASE WHEN event_type = 'book' THEN least(ask0, ask1) - bid0 END AS spread, unnest(list_transform(range({n}), lambda i: ts_us // {step}000000 * {step}000000 - i * {step}000000)) AS st FROM msg))
    SELECT market, start_us, end_us, count(*) AS n, round(avg(price), 8) AS mean_price, max(price) AS high, min(price) AS low, round(avg(spread), 8) AS mean_spread, max(spread) AS max_spread, min(spread) AS min_spread FROM w, mark WHERE end_us <= wm GROUP BY ALL"""


def finish(df):
    return df.withColumns({c: r(c, 8) for c in ("mean_price", "mean_spread")})


@query("l08_tumbling_periods", with_(MESSAGES, window_sql(900)))
def tumbling(spark, sf):
    """Market periods that the watermark has closed."""
    return finish(streamed(spark, sf, "tumbling", lambda s: capture.tumbling(s, "15 minutes", ["market"])))


@query("l09_sliding_windows", with_(MESSAGES, window_sql(7200, 3600)))
def sliding(spark, sf):
    return finish(streamed(spark, sf, "sliding", lambda s: capture.sliding(s, "2 hours", "1 hour", ["market"])))


@query(
    "l10_capture_sessions",
    with_(MESSAGES) + """, g AS (SELECT symbol AS market, ts_us, price, CASE WHEN event_type = 'book' THEN least(ask0, ask1) - bid0 END AS spread, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY symbol ORDER BY ts_us) < 3600000000 THEN 0 ELSE 1 END AS f FROM msg), s AS (SELECT *, sum(f) OVER (PARTITION BY market ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS run FROM g),
    a AS (SELECT market, run, min(ts_us) AS start_us, max(ts_us) + 3600000000 AS end_us, count(*) AS n, round(avg(price), 8) AS mean_price, max(price) AS high, min(price) AS low, round(avg(spread), 8) AS mean_spread, max(spread) AS max_spread, min(spread) AS min_spread FROM s GROUP BY 1, 2) SELECT * EXCLUDE (run, wm) FROM a, mark WHERE end_us <= wm""",
)
def sessions(spark, sf):
    return finish(streamed(spark, sf, "sessions", lambda s: capture.sessions(s, "1 hour", ["market"])))


@query("l11_dedup_by_hash", "SELECT event_type AS market, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def dedup(spark, sf):
    """Every tenth message is delivered twice."""
    m = messages(spark, sf)

    def run(stream, table, checkpoint):
        capture.append_table(capture.deduplicated(stream).select("market", "seq"), table, checkpoint)

    table = landed(spark, "dedup", weeks(m.unionByName(m.where("seq % 10 = 0"))), run)
    return read_table(spark, table).groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_id"))


@query(
    "l12_late_events",
    with_(MESSAGES) + """, h AS (SELECT *, ts_us // 3600000000 * 3600000000 AS start_us FROM ticks), m2 AS (SELECT (max(ts_us) // 1000 - 60000) * 1000 AS wm FROM ticks WHERE id % 50 <> 0) SELECT symbol AS market, start_us, count(*) FILTER (id % 50 <> 0) AS n, count(*) FILTER (id % 50 = 0) AS late FROM h, m2 WHERE start_us + 3600000000 <= wm GROUP BY 1, 2 HAVING count(*) FILTER (id % 50 <> 0) > 0""",
)
def late_events(spark, sf):
    """A fiftieth of the events arrive a month late. The stream drops what its watermark has closed; a side output, told by
    the watermark of the run before, keeps those events, and they are counted beside their windows."""
    m = messages(spark, sf)
    path = scratch(spark, "late")
    (table, checkpoint), (side, side_checkpoint) = capture.fresh(spark, "late"), capture.fresh(spark, "late-side")
    mark = None
    for part in [*weeks(m.where("seq % 50 != 0")), m.where("seq % 50 = 0")]:
        land(part, path)
        before = mark if mark is not None else -1
        done = capture.append_table(capture.tumbling(capture.message_stream(spark, path), "1 hour", ["market"]), table, checkpoint)
        late = capture.late_rows(capture.message_stream(spark, path), before, "1 hour")
        capture.append_table(late.select("market", "event_time", "seq"), side, side_checkpoint)
        mark = max(before, capture.watermark_ms(done))
    first = F.floor(F.unix_micros("event_time") / 3_600_000_000) * 3_600_000_000
    missed = read_table(spark, side).groupBy("market", first.alias("start_us")).agg(F.count(F.lit(1)).alias("late"))
    closed = read_table(spark, table)
    return closed.join(missed, ["market", "start_us"], "left").select("market", "start_us", "n", F.coalesce("late", F.lit(0)).alias("late"))


@query("l13_maintained_books", with_(TICKS, CHANGES) + "SELECT * FROM st")
def maintained(spark, sf):
    changes = book_changes(spark, sf).withColumn("event_time", F.timestamp_micros("ts_us"))
    schema = "asset string, seq long, is_snapshot boolean, side string, price double, size double"

    def run(stream, table, checkpoint):
        capture.append_table(capture.maintained_books(stream), table, checkpoint)

    return read_table(spark, landed(spark, "books", weeks(changes), run, schema))


@query("l14_stream_with_schedule", with_(MESSAGES) + "SELECT strftime(to_timestamp(sec // 900 * 900) AT TIME ZONE 'UTC', '%Y%m%d_%H%M') AS contract_id, count(*) AS n FROM msg GROUP BY 1")
def with_schedule(spark, sf):
    periods = contracts(spark, sf).select("open_time", "contract_id")
    out = streamed(spark, sf, "schedule", lambda s: capture.with_schedule(s, periods, 900).select("contract_id", "seq"))
    return out.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l15_capture_latency",
    with_(MESSAGES) + ", delay AS (SELECT ts_us, (ts_us + k * 1000) // 1000 - ts_us // 1000 AS ms FROM ticks) SELECT ts_us // 86400000000 * 86400000000 AS start_us, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, max(ms) AS max_ms, CAST(count(*) FILTER (ms < 0) AS INTEGER) AS errors FROM delay, mark WHERE ts_us // 86400000000 * 86400000000 + 86400000000 <= wm GROUP BY 1",
)
def latency(spark, sf):
    out = streamed(spark, sf, "latency", lambda s: capture.latency(s, "1 day"))
    return out.select("start_us", "n", r("mean_ms").alias("mean_ms"), r("p95_ms").alias("p95_ms"), "max_ms", F.col("errors").cast("int").alias("errors"))


@query(
    "l15_recent_latency",
    with_(MESSAGES) + """, delay AS (SELECT symbol AS market, id AS seq, ts_us, ((ts_us + k * 1000) // 1000 - ts_us // 1000)::DOUBLE AS ms FROM ticks)
    SELECT market, seq, ms, round(avg(ms) OVER w, 6) AS mean_ms, round(quantile_cont(ms, 0.95) OVER w, 6) AS p95_ms, count(*) OVER w AS n FROM delay WINDOW w AS (PARTITION BY market ORDER BY ts_us, seq ROWS 99 PRECEDING)""",
)
def recent_latency(spark, sf):
    """Delay of the last hundred messages of a market, from a list in the stream's state."""
    out = streamed(spark, sf, "recent", lambda s: capture.recent_latency(s))
    return out.select("market", "seq", "ms", r("mean_ms").alias("mean_ms"), r("p95_ms").alias("p95_ms"), "n")


@query("l16_capture_health", "SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(1 AS BIGINT) AS files, CAST(0 AS BIGINT) AS too_small, count(*) > 0 AS as_expected FROM events GROUP BY 1")
def health(spark, sf):
    path = scratch(spark, "health")
    write_parquet(capture.by_hour(messages(spark, sf), F.col("event_time")).select("seq", "date"), path, ["date"])
    return capture.capture_health(spark, path, 1, 0.5, 100).select("date", "files", "too_small", "as_expected")
