"""Window functions, ordering and sampling, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C, pricing
from tidemark.operators import aggregates as agg, features as feat, grid, sampling
from tidemark.operators.series import Running, Series, lag, lead, rolling, rolling_corr
from tidemark.plans.registry import query
from tidemark.plans.standins import (
    FORECASTS, QUOTES, QUOTE_ORDER, TICKS, forecasts, quotes, r, rounded, table, ticks, with_,
)

W = "(PARTITION BY symbol ORDER BY ts_us, id)"
ORDER = ["ts_us", "id"]


def tape(spark, sf):
    return Series(ticks(spark, sf).select("symbol", "ts_us", "sec", "id", "price", "k"), ["symbol"], ORDER)


# == E: windows ======================================================================================


@query("e01_lag_lead", with_(TICKS) + f"SELECT id, lag(price) OVER w AS prev, lag(price, 5) OVER w AS prev5, lead(price) OVER w AS nxt FROM ticks WINDOW w AS {W}")
def lag_lead(spark, sf):
    out = tape(spark, sf).frames({"prev": lag("price"), "prev5": lag("price", 5), "nxt": lead("price")}, before=5, after=1)
    return out.select("id", "prev", "prev5", "nxt")


@query(
    "e02_differences",
    with_(TICKS) + f"SELECT id, round(price - lag(price) OVER w, 6) AS diff, CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN round(ln(price / lag(price) OVER w), 9) END AS log_return, sign(price - lag(price) OVER w)::DOUBLE AS direction FROM ticks WINDOW w AS {W}",
)
def differences(spark, sf):
    p = F.col("price")
    out = tape(spark, sf).frames({"_p": lag("price")}, before=1)
    return out.select("id", r(p - F.col("_p")).alias("diff"), r(F.ln(C.ratio(p, "_p")), 9).alias("log_return"), F.signum(p - F.col("_p")).alias("direction"))


@query("e03_percent_change", with_(TICKS) + f"SELECT id, round(price / nullif(lag(price, 3) OVER w, 0) - 1, 9) AS pct3 FROM ticks WINDOW w AS {W}")
def percent_change(spark, sf):
    return tape(spark, sf).frames({"_p": lag("price", 3)}, before=3).select("id", r(C.ratio("price", "_p") - 1, 9).alias("pct3"))


SPARSE = TICKS + ", sparse AS (SELECT *, CASE WHEN k % 4 = 0 THEN price END AS x FROM ticks)"


def sparse(spark, sf):
    return ticks(spark, sf).withColumn("x", F.when(F.col("k") % 4 == 0, F.col("price")))


@query("e04_forward_fill", with_(SPARSE) + f"SELECT id, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING) AS filled, last_value(x IGNORE NULLS) OVER (ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING) AS filled_all FROM sparse")
def forward_fill(spark, sf):
    per_key = grid.fill(sparse(spark, sf), ["symbol"], ORDER, {"filled": "x"})
    return grid.fill(per_key, [], ORDER, {"filled_all": "x"}).select("id", "filled", "filled_all")


@query("e05_backward_fill", with_(SPARSE) + "SELECT id, first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_us, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM sparse")
def backward_fill(spark, sf):
    return grid.fill(sparse(spark, sf), ["symbol"], ORDER, {"filled": "x"}, backward=True).select("id", "filled")


@query(
    "e06_bounded_fill",
    with_(TICKS) + """, a AS (SELECT symbol, sec // 60 * 60 AS sec, arg_max(price, (ts_us, id)) AS price, count(*) AS quote_count FROM ticks GROUP BY 1, 2),
    s AS (SELECT symbol, min(sec) AS lo, max(sec) AS hi FROM a GROUP BY 1), g AS (SELECT symbol, unnest(range(lo, hi + 1, 60)) AS sec FROM s),
    f AS (SELECT g.symbol, g.sec, coalesce(quote_count, 0) AS quote_count, quote_count IS NULL AS is_forward_filled,
      last_value(price IGNORE NULLS) OVER w AS price, last_value(CASE WHEN quote_count IS NOT NULL THEN g.sec END IGNORE NULLS) OVER w AS seen_at
      FROM g LEFT JOIN a USING (symbol, sec) WINDOW w AS (PARTITION BY g.symbol ORDER BY g.sec ROWS UNBOUNDED PRECEDING))
    SELECT symbol, sec, quote_count, is_forward_filled, sec - seen_at AS seconds_since_last_update, CASE WHEN sec - seen_at <= 600 THEN price END AS price FROM f""",
)
def bounded_fill(spark, sf):
    t = ticks(spark, sf).withColumn("sec", grid.second_of("ts_us", 60))
    rows = grid.last_known(t, ["symbol", "sec"], ["price"], ORDER)
    return grid.fill_grid(rows, ["symbol"], "sec", ["price"], step=60, max_gap=600, zero=["quote_count"])


@query(
    "e07_rolling_aggregates",
    with_(TICKS) + """SELECT id, CASE WHEN count(*) OVER w >= 20 THEN round(avg(price) OVER w, 6) END AS mean20, CASE WHEN count(*) OVER w >= 20 THEN round(stddev_samp(price) OVER w, 6) END AS std20,
    max(price) OVER w AS high20, min(price) OVER w AS low20, CASE WHEN count(*) OVER w >= 5 THEN sum(k) OVER w END::BIGINT AS sum20
    FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, id ROWS 19 PRECEDING)""",
)
def rolling_aggregates(spark, sf):
    p = F.col("price")
    out = tape(spark, sf).frames(
        {"mean20": rolling(F.avg, p, 20), "std20": rolling(F.stddev_samp, p, 20), "high20": rolling(F.max, p, 20, 1),
         "low20": rolling(F.min, p, 20, 1), "sum20": rolling(F.sum, F.col("k"), 20, 5)},
        before=19,
    )
    return out.select("id", r("mean20").alias("mean20"), r("std20").alias("std20"), "high20", "low20", "sum20")


@query(
    "e08_rolling_skew_kurtosis",
    with_(TICKS) + """, m AS (SELECT id, count(*) OVER w AS n, avg(price) OVER w AS m1, avg(price * price) OVER w AS m2, avg(price * price * price) OVER w AS m3, avg(price * price * price * price) OVER w AS m4
      FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, id ROWS 29 PRECEDING))
    SELECT id, CASE WHEN n >= 30 THEN round((m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / ((m2 - m1 * m1) ** 1.5e0), 4) END AS skew,
      CASE WHEN n >= 30 THEN round((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / ((m2 - m1 * m1) ** 2) - 3, 4) END AS kurt FROM m""",
)
def rolling_moments(spark, sf):
    p = F.col("price")
    out = tape(spark, sf).frames({"skew": rolling(F.skewness, p, 30), "kurt": rolling(F.kurtosis, p, 30)}, before=29)
    return out.select("id", r("skew", 4).alias("skew"), r("kurt", 4).alias("kurt"))


@query(
    "e09_rolling_autocorrelation",
    with_(TICKS) + f""", l AS (SELECT *, lag(price, 1) OVER w AS l1, lag(price, 5) OVER w AS l5 FROM ticks WINDOW w AS {W})
    SELECT id, CASE WHEN count(l1) OVER w >= 40 THEN round(corr(price, l1) OVER w, 6) END AS ac1, CASE WHEN count(l5) OVER w >= 40 THEN round(corr(price, l5) OVER w, 6) END AS ac5
    FROM l WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, id ROWS 39 PRECEDING)""",
)
def rolling_autocorrelation(spark, sf):
    p = F.col("price")
    out = tape(spark, sf).frames(
        {"_l1": lag("price", 1), "_l5": lag("price", 5)},
        {"ac1": rolling_corr(p, F.col("_l1"), 40), "ac5": rolling_corr(p, F.col("_l5"), 40)}, before=44,
    )
    return out.select("id", r("ac1").alias("ac1"), r("ac5").alias("ac5"))


@query(
    "e10_rolling_quantile",
    with_(TICKS) + """, h AS (SELECT symbol, sec // 3600 AS hour, avg(price) AS x FROM ticks GROUP BY 1, 2)
    SELECT symbol, hour, round(quantile_cont(x, 0.33) OVER w, 11) AS q33, round(quantile_cont(x, 0.67) OVER w, 11) AS q67, round(quantile_cont(x, 0.95) OVER w, 11) AS q95 FROM h
    WINDOW w AS (PARTITION BY symbol ORDER BY hour RANGE BETWEEN 167 PRECEDING AND CURRENT ROW)""",
)
def rolling_quantile(spark, sf):
    h = ticks(spark, sf).groupBy("symbol", F.floor(F.col("sec") / 3600).alias("hour")).agg(F.avg("price").alias("x"))
    return rounded(feat.rolling_time_quantiles(h, ["symbol"], "hour", "x", 168, {"q33": 0.33, "q67": 0.67, "q95": 0.95}).drop("x"), 11)


EMA = """num AS (SELECT symbol, id, price, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, id) AS i FROM ticks),
ema(symbol, i, n12, d12, n60, d60) AS (SELECT symbol, i, price, 1.0e0, price, 1.0e0 FROM num WHERE i = 1
  UNION ALL SELECT e.symbol, n.i, n.price + n12 * (1 - 2.0e0 / 13), 1 + d12 * (1 - 2.0e0 / 13), n.price + n60 * (1 - 2.0e0 / 61), 1 + d60 * (1 - 2.0e0 / 61)
  FROM ema e JOIN num n ON n.symbol = e.symbol AND n.i = e.i + 1)"""


@query(
    "e10_rolling_sketch",
    with_(TICKS) + """, d AS (SELECT symbol, sec // 86400 AS day, count(price) AS n FROM ticks GROUP BY 1, 2), s AS (SELECT symbol, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY 1)
    SELECT s.symbol, s.day, coalesce(sum(n) OVER (PARTITION BY s.symbol ORDER BY s.day ROWS 6 PRECEDING), 0)::BIGINT AS n, true AS q33_within, true AS q67_within, true AS q95_within FROM s LEFT JOIN d USING (symbol, day)""",
)
def rolling_sketch(spark, sf):
    """Quantiles of the last seven days from one sketch per day; their exact ranks must lie within the sketch's bound."""
    probs = {"q33": 0.33, "q67": 0.67, "q95": 0.95}
    t = ticks(spark, sf).select("symbol", F.floor(F.col("sec") / 86_400).alias("day"), "price")
    limits = feat.rolling_day_quantiles(t, ["symbol"], F.col("day"), "price", 7, probs)
    # exact ranks: every value of a day is counted for the seven days whose windows hold it
    counts = t.groupBy("symbol", "day", "price").agg(F.count(F.lit(1)).alias("c"))
    held = counts.select("symbol", F.explode(F.sequence(F.col("day"), F.col("day") + 6)).alias("day"), "price", "c").join(limits.withColumnRenamed("n", "rows"), ["symbol", "day"])
    ranks = held.groupBy("symbol", "day").agg(F.max("rows").alias("rows"), *[F.sum(F.when(F.col("price") < F.col(n), F.col("c")).otherwise(0)).alias(f"below_{n}") for n in probs], *[F.sum(F.when(F.col("price") <= F.col(n), F.col("c")).otherwise(0)).alias(f"upto_{n}") for n in probs])
    out = limits.select("symbol", "day", "n").join(ranks, ["symbol", "day"], "left")
    # within one value and the bound of the sketch
    return out.select("symbol", "day", "n", *[((F.col(f"below_{n}") <= (p + 0.006) * F.col("rows") + 1) & (F.col(f"upto_{n}") >= (p - 0.006) * F.col("rows") - 1)).alias(f"{n}_within") for n, p in probs.items()])


@query(
    "e11_exponential_means",
    "WITH RECURSIVE " + TICKS + ", " + EMA + " SELECT id, round(n12 / d12, 7) AS ema_12, round(n60 / d60, 7) AS ema_60 FROM ema JOIN num USING (symbol, i)",
)
def exponential_means(spark, sf):
    return rounded(tape(spark, sf).ewm(ema_12=("price", 12), ema_60=("price", 60)).select("id", "ema_12", "ema_60"), 7)


@query("e12_cumulative_sum", with_(TICKS) + "SELECT id, sum(k) OVER (ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_all, sum(k) OVER (PARTITION BY symbol ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM ticks")
def cumulative(spark, sf):
    per_key = tape(spark, sf).running(cum=Running("sum", F.col("k")))
    return Series(per_key, [], ORDER).running(cum_all=Running("sum", F.col("k"))).select("id", "cum_all", "cum")


@query(
    "e13_drawdown",
    with_(TICKS) + """, c AS (SELECT symbol, ts_us, id, sum(k - 50) OVER (PARTITION BY symbol ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS equity FROM ticks),
    h AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING) AS high FROM c)
    SELECT symbol, min(equity - high) AS max_drawdown, max(high) AS peak, count(*) AS n FROM h GROUP BY 1""",
)
def drawdown(spark, sf):
    s = tape(spark, sf)
    cum = s._with(s.running(equity=Running("sum", F.col("k") - 50)))
    high = cum.running(high=Running("max", F.col("equity")))
    return high.groupBy("symbol").agg(
        F.min(F.col("equity") - F.col("high")).alias("max_drawdown"), F.max("high").alias("peak"), F.count(F.lit(1)).alias("n")
    )


@query("e14_ordinal_rank", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def ordinal_rank(spark, sf):
    people = table(spark, sf, "customer", "c_custkey", "c_acctbal").withColumn("_o", -F.col("c_acctbal"))
    return Series(people, [], ["_o", "c_custkey"]).running(rank=Running("count")).select("c_custkey", "rank")


@query(
    "e15_dense_rank_percentile",
    with_(TICKS) + "SELECT id, round(dense_rank() OVER (PARTITION BY sec // 86400 ORDER BY price) / count(*) OVER (PARTITION BY sec // 86400), 9) AS pct FROM ticks",
)
def dense_percentile(spark, sf):
    from tidemark.operators.features import dense_rank_percentile

    t = ticks(spark, sf).withColumn("day", C.epoch_day("sec"))
    return dense_rank_percentile(t, ["day"], "price", "pct").select("id", r("pct", 9).alias("pct"))


@query(
    "e16_average_rank_percentile",
    with_(TICKS) + "SELECT id, round((rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0e0) / count(*) OVER (), 9) AS pct FROM ticks",
)
def average_percentile(spark, sf):
    from tidemark.operators.joins import lookup

    t = ticks(spark, sf).select("id", "price")
    ranks = agg.average_ranks(t, "price", "rank")
    n = t.agg(F.count(F.lit(1)).alias("n"))
    return agg.attach(lookup(t, ranks, ["price"]), n, []).select("id", r(F.col("rank") / F.col("n"), 9).alias("pct"))


@query(
    "e17_partition_zscore",
    with_(TICKS) + "SELECT id, round((price - avg(price) OVER w) / (stddev_samp(price) OVER w + 1e-10), 6) AS z FROM ticks WINDOW w AS (PARTITION BY sec // 604800)",
)
def zscore(spark, sf):
    from tidemark.operators.features import group_zscore

    t = ticks(spark, sf).withColumn("week", F.floor(F.col("sec") / 604800))
    return group_zscore(t, ["week"], "price", "z").select("id", r("z").alias("z"))


@query(
    "e18_partition_thresholds",
    with_(TICKS) + ", q AS (SELECT sec // 2592000 AS b, quantile_cont(price, 0.33) AS lo, quantile_cont(price, 0.67) AS hi FROM ticks GROUP BY 1) SELECT id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ticks JOIN q ON sec // 2592000 = b",
)
def thresholds(spark, sf):
    t = ticks(spark, sf).withColumn("b", F.floor(F.col("sec") / 2592000))
    edges = agg.quantiles(t, ["b"], "price", {"lo": 0.33, "hi": 0.67})
    return rounded(agg.attach(t, edges, ["b"]).select("id", "lo", "hi"))


@query(
    "e19_gap_detection",
    with_(TICKS) + f", g AS (SELECT symbol, sec AS start_ts, lead(sec) OVER w AS end_ts FROM ticks WINDOW w AS {W}) SELECT symbol, start_ts, end_ts, end_ts - start_ts AS gap_seconds, round((end_ts - start_ts) / 3600.0e0, 6) AS gap_hours FROM g WHERE end_ts - start_ts > 3600",
)
def gaps(spark, sf):
    out = tape(spark, sf).frames({"end_ts": lead("sec")}, before=0, after=1).where("end_ts - sec > 3600")
    gap = F.col("end_ts") - F.col("sec")
    return out.select("symbol", F.col("sec").alias("start_ts"), "end_ts", gap.alias("gap_seconds"), r(gap / 3600.0).alias("gap_hours"))


REGIME = TICKS + ", reg AS (SELECT *, CASE WHEN price < 20 THEN 'low' WHEN price < 60 THEN 'medium' ELSE 'high' END AS regime FROM ticks)"


def regimes(spark, sf):
    return ticks(spark, sf).withColumn("regime", C.bucket("price", [20, 60], ["low", "medium", "high"]))


@query(
    "e20_islands",
    with_(REGIME) + f""", c AS (SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER w THEN 1 ELSE 0 END AS flag FROM reg WINDOW w AS {W}),
    i AS (SELECT *, sum(flag) OVER (PARTITION BY symbol ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c)
    SELECT symbol, run, regime, count(*) AS rows, min(sec) AS start_sec, max(sec) AS end_sec FROM i GROUP BY 1, 2, 3""",
)
def islands(spark, sf):
    return grid.islands(regimes(spark, sf), ["symbol"], ORDER, "regime", "sec")


@query(
    "e21_transition_matrix",
    with_(REGIME) + f", t AS (SELECT lag(regime) OVER w AS prev, regime FROM reg WINDOW w AS {W}) SELECT prev, regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY prev), 9) AS share FROM t WHERE prev IS NOT NULL GROUP BY 1, 2",
)
def transitions(spark, sf):
    from tidemark.operators.features import transition_matrix

    return rounded(transition_matrix(regimes(spark, sf), ["symbol"], ORDER, "regime"), 9)


@query(
    "e22_linear_interpolation",
    with_(SPARSE) + """, n AS (SELECT id, ts_us, x, max(CASE WHEN x IS NOT NULL THEN ts_us END) OVER b AS pt, last_value(x IGNORE NULLS) OVER b AS pv, min(CASE WHEN x IS NOT NULL THEN ts_us END) OVER f AS nt, first_value(x IGNORE NULLS) OVER f AS nv FROM sparse
      WINDOW b AS (PARTITION BY symbol ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY symbol ORDER BY ts_us, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT id, round(CASE WHEN x IS NOT NULL THEN x ELSE pv + (nv - pv) * ((ts_us - pt) / (nt - pt)) END, 6) AS x FROM n""",
)
def interpolation(spark, sf):
    filled = grid.interpolate(sparse(spark, sf), ["symbol"], "ts_us", "x", "y")
    return filled.select("id", r("y").alias("x"))


@query(
    "e23_reversal_count",
    with_(TICKS) + f""", a AS (SELECT *, sign(price - lag(price) OVER w) AS s FROM ticks WINDOW w AS {W}), b AS (SELECT *, CASE WHEN s IS NULL OR lag(s) OVER w IS NULL THEN NULL WHEN s <> lag(s) OVER w THEN 1 ELSE 0 END AS rev FROM a WINDOW w AS {W})
    SELECT id, CASE WHEN count(rev) OVER w >= 30 THEN sum(rev) OVER w END::BIGINT AS reversals FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, id ROWS 29 PRECEDING)""",
)
def reversals(spark, sf):
    p = F.col("price")
    out = tape(spark, sf).frames(
        {"_s": lambda w: F.signum(p - F.lag("price").over(w))},
        {"_rev": lambda w: (F.col("_s") != F.lag("_s").over(w)).cast("int")},
        {"reversals": rolling(F.sum, F.col("_rev"), 30)}, before=31,
    )
    return out.select("id", "reversals")


@query("e24_every_nth_row", with_(TICKS) + "SELECT id, i FROM (SELECT id, row_number() OVER (ORDER BY ts_us, id) - 1 AS i FROM ticks) WHERE i % 10 = 0")
def every_nth(spark, sf):
    return sampling.every_nth(ticks(spark, sf), ORDER, 10, "i").select("id", "i")


@query(
    "e25_sortedness",
    with_(TICKS) + "SELECT symbol, count(*) AS rows, count(*) FILTER (sec < prev) AS out_of_order FROM (SELECT symbol, sec, lag(sec) OVER (PARTITION BY symbol ORDER BY k, id) AS prev FROM ticks) GROUP BY 1",
)
def sortedness(spark, sf):
    """Arrival order is (k, id) here, so time runs backwards now and then."""
    out = Series(ticks(spark, sf), ["symbol"], ["k", "id"]).frames({"prev": lag("sec")}, before=1)
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("sec") < F.col("prev")).alias("out_of_order"))


@query(
    "e26_settlement_zscore",
    with_(TICKS) + """, f AS (SELECT id, symbol, ts_us, CAST(sec // 28800 AS BIGINT) AS slot, sec // 28800 % 7 + 0.001e0 * (sec // 28800 % 5) AS rate FROM ticks),
    d AS (SELECT DISTINCT symbol, slot, rate FROM f),
    z AS (SELECT symbol, slot, CASE WHEN count(*) OVER w >= 21 THEN (rate - avg(rate) OVER w) / (stddev_samp(rate) OVER w + 1e-8) END AS z FROM d WINDOW w AS (PARTITION BY symbol ORDER BY slot ROWS 20 PRECEDING))
    SELECT id, round(z, 6) AS z FROM f JOIN z USING (symbol, slot)""",
)
def settlement_zscore(spark, sf):
    slot = F.floor(F.col("sec") / 28800)
    t = ticks(spark, sf).select("id", "symbol", slot.alias("slot"), (slot % 7 + 0.001 * (slot % 5)).alias("rate"))
    return feat.settlement_zscore(t, ["symbol"], "slot", "rate", 21, "z").select("id", r("z").alias("z"))


@query(
    "e27_seconds_since_high",
    with_(TICKS) + """SELECT id, sec - arg_max(sec, (price, sec)) OVER w AS since_high, sec - arg_min(sec, (price, -sec)) OVER w AS since_low FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, id ROWS 199 PRECEDING)""",
)
def since_extreme(spark, sf):
    sec, price = F.col("sec"), F.col("price")
    out = tape(spark, sf).frames({"high": feat.extreme_place(F.max, price, sec, 200), "low": feat.extreme_place(F.min, price, sec, 200)}, before=199)
    return out.select("id", (sec - F.col("high.at")).alias("since_high"), (sec + F.col("low.at")).alias("since_low"))


# == F: order, limits, samples =======================================================================


@query("f01_multi_key_sort", with_(QUOTES) + "SELECT symbol, sec, l_orderkey, l_linenumber, row_number() OVER (ORDER BY symbol, sec, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS position FROM quotes")
def multi_key_sort(spark, sf):
    order = ["symbol", *QUOTE_ORDER]
    out = Series(quotes(spark, sf), [], order).running(position=Running("count"))
    return out.select("symbol", "sec", "l_orderkey", "l_linenumber", "position").orderBy("position")


@query("f02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("f03_top_k_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem QUALIFY rank <= 3")
def top_k_per_group(spark, sf):
    lines = table(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return agg.top_per_group(lines, ["l_suppkey"], order, 3)


@query(
    "f04_head_tail",
    with_(TICKS) + """(SELECT 'head' AS part, id FROM ticks ORDER BY ts_us, id LIMIT 10) UNION ALL (SELECT 'tail', id FROM ticks ORDER BY ts_us DESC, id DESC LIMIT 10)""",
)
def head_tail(spark, sf):
    t = ticks(spark, sf)
    head = t.orderBy("ts_us", "id").limit(10).select(F.lit("head").alias("part"), "id")
    return head.unionByName(t.orderBy(F.desc("ts_us"), F.desc("id")).limit(10).select(F.lit("tail").alias("part"), "id"))


def md5_sql(*keys):
    return f"md5(concat_ws('|', {', '.join(keys)}, 42))"


@query("f05_seeded_sample", f"SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr({md5_sql('o_orderkey')}, 1, 8))::BIGINT / 4294967296.0e0 < 0.1e0")
def seeded_sample(spark, sf):
    return sampling.hash_sample(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), ["o_orderkey"], 0.1, seed=42)


@query("f06_hash_shuffle", with_(TICKS) + f"SELECT id, sec, row_number() OVER (ORDER BY {md5_sql('id')}, id) AS position FROM ticks")
def hash_shuffle(spark, sf):
    return sampling.hash_order(ticks(spark, sf).select("id", "sec"), ["id"], seed=42)


@query("f07_stratified_sample", f"SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {md5_sql('l_orderkey', 'l_linenumber', 'l_partkey')}, l_orderkey, l_linenumber, l_partkey) <= 50")
def stratified(spark, sf):
    return sampling.stratified(table(spark, sf, "lineitem", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey"),
                               ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"], 50, seed=42)


# == G: set operations ===============================================================================


@query("g01_concat", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("g02_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("g03_first_per_key", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_extendedprice) = 1")
def first_per_key(spark, sf):
    kept = agg.first_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "g04_merge_sorted_batches",
    with_(TICKS) + ", m AS (SELECT symbol, sec, id, price FROM ticks WHERE k < 60 UNION ALL SELECT symbol, sec, id, price FROM ticks WHERE k > 30), d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol, sec ORDER BY id) = 1) SELECT symbol, sec, id, price, row_number() OVER (ORDER BY sec, symbol) AS position FROM d",
)
def merge_batches(spark, sf):
    t = ticks(spark, sf).select("symbol", "sec", "id", "price", "k")
    both = t.where("k < 60").unionByName(t.where("k > 30")).drop("k")
    merged = agg.first_per_key(both, ["symbol", "sec"], ["id"])
    return Series(merged, [], ["sec", "symbol"]).running(position=Running("count"))


@query(
    "g05_single_pass_status",
    with_(QUOTES) + "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN bid > 0 AND ask > 0 THEN round(ln(ask / bid), 9) END AS log_spread, CASE WHEN bid > 0 AND ask > 0 THEN 'success' ELSE 'invalid_input' END AS status FROM quotes",
)
def single_pass(spark, sf):
    valid = F.coalesce((F.col("bid") > 0) & (F.col("ask") > 0), F.lit(False))
    return quotes(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", r(F.when(valid, F.ln(F.col("ask") / F.col("bid"))), 9).alias("log_spread"),
        F.when(valid, "success").otherwise("invalid_input").alias("status"),
    )


@query("g06_key_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def key_difference(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query(
    "g07_coverage_intersection",
    """WITH a AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders), b AS (SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem),
    d AS (SELECT o_orderdate AS t FROM orders INTERSECT SELECT l_shipdate FROM lineitem)
    SELECT epoch(greatest(a.lo, b.lo))::BIGINT AS lo, epoch(least(a.hi, b.hi))::BIGINT AS hi, (SELECT count(*) FROM d) AS shared_days FROM a, b""",
)
def coverage_intersection(spark, sf):
    days = [table(spark, sf, "orders").select(F.col("o_orderdate").alias("t")), table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("t"))]
    spans = [d.agg(F.min("t").alias(f"lo{i}"), F.max("t").alias(f"hi{i}")) for i, d in enumerate(days)]
    shared = days[0].intersect(days[1]).agg(F.count(F.lit(1)).alias("shared_days"))
    return agg.attach(agg.attach(spans[0], spans[1], []), shared, []).select(
        F.unix_seconds(F.greatest("lo0", "lo1")).alias("lo"), F.unix_seconds(F.least("hi0", "hi1")).alias("hi"), "shared_days"
    )


@query("g08_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "g09_list_equality",
    """WITH a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')
    SELECT *, only_left = 0 AND only_right = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right)""",
)
def list_equality(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    a, b = (o.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O"))
    only = lambda x, y, name: x.exceptAll(y).agg(F.count(F.lit(1)).alias(name))
    out = agg.attach(only(a, b, "only_left"), only(b, a, "only_right"), [])
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


# == H: scalar functions =============================================================================

SYMBOLS = """sym AS (SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN 'BROKEN' ELSE concat('BTC-', 1 + event_id % 28, 'FEB', 24 + event_id % 3, '-', 40000 + event_id % 50 * 500, '-', CASE WHEN event_id % 2 = 0 THEN 'C' ELSE 'P' END) END AS symbol,
  1 + event_id % 28 AS d, 2024 + event_id % 3 AS y FROM events)"""


def symbols(spark, sf):
    e = F.col("event_id")
    text = F.concat(F.lit("BTC-"), 1 + e % 28, F.lit("FEB"), 24 + e % 3, F.lit("-"), 40000 + e % 50 * 500, F.lit("-"),
                    F.when(e % 2 == 0, "C").otherwise("P"))
    return table(spark, sf, "events").select(e.alias("id"), F.when(e % 17 == 0, "BROKEN").otherwise(text).alias("symbol"))


@query(
    "h01_symbol_parts",
    with_(SYMBOLS) + """SELECT id, CASE WHEN symbol <> 'BROKEN' THEN split_part(symbol, '-', 1) END AS underlying, CASE WHEN symbol <> 'BROKEN' THEN split_part(symbol, '-', 2) END AS expiry_str,
    CASE WHEN symbol <> 'BROKEN' THEN CAST(split_part(symbol, '-', 3) AS DOUBLE) END AS strike_price, CASE WHEN symbol LIKE '%-C' THEN 'call' WHEN symbol LIKE '%-P' THEN 'put' END AS type FROM sym""",
)
def symbol_parts(spark, sf):
    return symbols(spark, sf).withColumns(C.option_symbol("symbol")).drop("symbol")


@query(
    "h02_regex_functions",
    "SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word, len(regexp_extract_all(text, '[0-9]+')) AS numbers, regexp_matches(text, '(?i)the') AS has_the, length(regexp_replace(text, '[^a-z]', '', 'g')) AS letters FROM documents",
)
def regex_functions(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.regexp_extract("text", "([A-Za-z]+)", 1).alias("first_word"),
        F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"), F.col("text").rlike("(?i)the").alias("has_the"),
        F.length(F.regexp_replace("text", "[^a-z]", "")).cast("long").alias("letters"),
    )


@query(
    "h03_text_functions",
    "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, upper(p_name) AS name, concat(lower(p_type), '-', trim(p_brand)) AS label, starts_with(p_name, 'red') AS is_red, ends_with(p_name, 'bolt') AS is_bolt FROM part",
)
def text_functions(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.upper("p_name").alias("name"),
        F.concat(F.lower("p_type"), F.lit("-"), F.trim("p_brand")).alias("label"), F.startswith("p_name", F.lit("red")).alias("is_red"),
        F.endswith("p_name", F.lit("bolt")).alias("is_bolt"),
    )


@query(
    "h04_expiry_epoch",
    with_(SYMBOLS) + "SELECT id, CASE WHEN symbol = 'BROKEN' THEN 2147483647 ELSE CAST(epoch(make_date(y, 2, d)) AS BIGINT) + 28800 END AS expiry FROM sym",
)
def expiry_epoch(spark, sf):
    parts = C.option_symbol("symbol")
    return symbols(spark, sf).select("id", C.expiry_seconds(parts["expiry_str"]).alias("expiry"))


@query(
    "h05_iso_parse",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN epoch_us(ts) ELSE epoch_us(ts) // 1000000 * 1000000 END AS ts_us FROM events",
)
def iso_parse(spark, sf):
    frac, whole = (F.date_format("ts", p) for p in ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    e = F.col("event_id")
    text = F.when(e % 7 == 0, "not a time").when(e % 2 == 0, frac).otherwise(whole)
    return table(spark, sf, "events").select("event_id", F.unix_micros(F.try_to_timestamp(text)).alias("ts_us"))


@query("h06_epoch_casts", "SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 1000000 = epoch_us(date_trunc('second', ts)) // 1000000 AS same FROM events")
def epoch_casts(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts").select("event_id", F.unix_micros("ts").alias("us"), F.unix_millis("ts").alias("ms"), F.unix_seconds("ts").alias("s"))
    return e.withColumns({
        "day": F.to_date(F.timestamp_millis("ms")).cast("string"),
        "same": F.date_trunc("second", F.timestamp_micros("us")) == F.timestamp_seconds("s"),
    })


@query(
    "h07_date_parts",
    "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, isodow(o_orderdate) AS dow, strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS month_start, epoch(o_orderdate)::BIGINT // 604800 * 604800 AS week7 FROM orders",
)
def date_parts(spark, sf):
    d = "o_orderdate"
    return table(spark, sf, "orders", "o_orderkey", d).select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), (F.weekday(d) + 1).alias("dow"),
        F.date_format(F.date_trunc("month", d), "yyyyMMdd").alias("month_start"), (F.floor(F.unix_seconds(d) / 604800) * 604800).alias("week7"),
    )


@query(
    "h08_cyclic_time",
    with_(TICKS) + """SELECT id, sec % 86400 // 3600 AS hour, round(sin(sec % 86400 // 3600 * (2 * pi() / 24)), 9) AS hour_sin, round(cos(sec % 86400 // 3600 * (2 * pi() / 24)), 9) AS hour_cos,
    CAST(sec % 86400 // 3600 BETWEEN 13 AND 20 AS INTEGER) AS is_us_hours, CAST(sec % 86400 // 3600 BETWEEN 0 AND 7 AS INTEGER) AS is_asia_hours, CAST(sec % 86400 // 3600 BETWEEN 7 AND 14 AS INTEGER) AS is_europe_hours FROM ticks""",
)
def cyclic_time(spark, sf):
    return rounded(ticks(spark, sf).select("id", *[c.alias(n) for n, c in C.time_features("sec").items()]), 9)


@query(
    "h09_math",
    "SELECT p_partkey, round(ln(p_retailprice), 9) AS ln, round(exp(p_size / 50.0e0), 9) AS exp, round(sqrt(p_retailprice), 9) AS root, round(pow(p_size, 1.5e0), 6) AS pow, sign(p_size - 25)::DOUBLE AS sign, floor(p_retailprice)::BIGINT AS whole FROM part",
)
def math_functions(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", r(F.ln("p_retailprice"), 9).alias("ln"), r(F.exp(F.col("p_size") / 50.0), 9).alias("exp"), r(F.sqrt("p_retailprice"), 9).alias("root"),
        r(F.pow("p_size", F.lit(1.5))).alias("pow"), F.signum(F.col("p_size") - 25.0).alias("sign"), F.floor("p_retailprice").alias("whole"),
    )


def cdf_sql(x):
    """SQL text of the same rational approximation of the normal distribution function."""

    def horner(coefficients):
        text = f"{coefficients[0]!r}e0"
        for c in coefficients[1:]:
            text = f"({text} * abs({x}) + {c!r}e0)"
        return text

    z, density = f"abs({x})", f"exp(-({x}) * ({x}) / 2.0e0)"
    body = f"{density} * {horner(pricing.TAIL_NUM)} / {horner(pricing.TAIL_DEN)}"
    far = f"{density} / ({z} + 1.0e0 / ({z} + 2.0e0 / ({z} + 3.0e0 / ({z} + 4.0e0 / ({z} + 0.65e0))))) / {pricing.TAIL_SCALE!r}e0"
    tail = f"(CASE WHEN {z} > 37 THEN 0.0e0 WHEN {z} < {pricing.TAIL_SPLIT!r}e0 THEN {body} ELSE {far} END)"
    return f"(CASE WHEN ({x}) > 0 THEN 1.0e0 - {tail} ELSE {tail} END)"


@query("h10_normal_distribution", with_(TICKS) + f", z AS (SELECT id, (price - 50) / 20 AS x FROM ticks) SELECT id, round({cdf_sql('x')}, 10) AS cdf, round(exp(-x * x / 2) / sqrt(2 * pi()), 10) AS pdf FROM z")
def normal_distribution(spark, sf):
    x = (F.col("price") - 50) / 20
    return rounded(ticks(spark, sf).select("id", pricing.norm_cdf(x).alias("cdf"), pricing.norm_pdf(x).alias("pdf")), 10)


@query(
    "h11_arrays",
    "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[2] AS DOUBLE) AS second, CAST(embedding[len(embedding)] AS DOUBLE) AS last FROM embeddings",
)
def arrays(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings", "vec_id", "embedding").select(
        "vec_id", F.element_at(v, 1).cast("double").alias("first"), F.size(v).alias("n"),
        F.element_at(F.slice(v, 2, 3), 1).cast("double").alias("second"), F.element_at(v, -1).cast("double").alias("last"),
    )


@query("h12_structs", "SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders")
def structs(spark, sf):
    packed = table(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("s"))
    return packed.select("o_orderkey", "s.*")


@query(
    "h13_json_text",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 1.0e0 ELSE 0.0e0 END AS up FROM events",
)
def json_text(spark, sf):
    e = F.col("event_id")
    prices = C.outcome_prices(F.when(e % 2 == 0, '["1","0"]').otherwise('["0","1"]'))
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.get(prices, F.lit(0)).alias("up"))


@query("h14_rowwise_sum", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + l_discount + l_tax + l_linenumber, 9) AS total FROM lineitem")
def rowwise(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r(C.total(["l_quantity", "l_discount", "l_tax", "l_linenumber"]), 9).alias("total")
    )


@query("h15_key_hash", f"SELECT o_orderkey, ('0x' || substr({md5_sql('o_orderkey')}, 1, 15))::BIGINT AS hash FROM orders")
def key_hash(spark, sf):
    return table(spark, sf, "orders", "o_orderkey").select("o_orderkey", sampling.key_hash(["o_orderkey"], 42).alias("hash"))


@query(
    "h16_unit_scaling",
    with_(TICKS) + "SELECT id, round(price * 1e24 / 1e27, 12) AS fraction, round(price / 100 * 10000, 6) AS bps, round(pow(1 + price / 1000 / 31536000, 31536000.0e0) - 1, 6) AS apy FROM ticks",
)
def unit_scaling(spark, sf):
    p = F.col("price")
    return ticks(spark, sf).select(
        "id", r(C.from_ray(p * 1e24), 12).alias("fraction"), r(p / 100 * 10000).alias("bps"), r(C.apr_to_apy(p / 1000)).alias("apy")
    )


@query(
    "h17_labels_urls",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN concat('https://example.org/profile/', c_name) ELSE concat('https://example.org/id/', c_custkey) END AS url FROM customer",
)
def labels(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("https://example.org/profile/"), "c_name"))
        .otherwise(F.concat(F.lit("https://example.org/id/"), "c_custkey")).alias("url"),
    )
