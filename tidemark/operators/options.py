"""Option quotes: message cleaning, ATM and liquidity filters, strikes, pricing grids, IV comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import columns as C, pricing
from tidemark.operators import joins
from tidemark.operators.series import ROWS_PER_TASK, Running, Series

# -- fixed values -----------------------------------------------------------------------------------
ATM_BAND = 0.03
MAX_TTL_SECONDS = 3 * 86_400
MIN_PRICE_USD, MAX_SPREAD, MIN_MONEYNESS, MAX_MONEYNESS, MIN_HOURS = 10.0, 0.50, 0.50, 2.00, 1.0
MAX_IV_AGE = 300  # seconds a volatility may be carried forward
SECONDS_PER_CONTRACT = 900


def clean_messages(messages: DataFrame) -> DataFrame:
    """Quote messages to one row per quote: four-part symbols, top of book, no negative or crossed prices."""
    top = {f"{side}_{name}": F.get(f"{side}s", F.lit(0))[name] for side in ("bid", "ask") for name in ("price", "amount")}
    flat = (
        messages.where(F.col("type") == "quote")
        .where(F.size(F.split("symbol", "-")) == 4)
        .withColumns({**C.option_symbol("symbol"), **top, "ts": F.try_to_timestamp("timestamp")})
    )
    priced = F.coalesce("bid_price", "ask_price").isNotNull()
    positive = (F.coalesce("bid_price", F.lit(0.0)) >= 0) & (F.coalesce("ask_price", F.lit(0.0)) >= 0)
    uncrossed = F.coalesce(F.col("bid_price") <= F.col("ask_price"), F.lit(True))
    return flat.where(priced & positive & uncrossed & F.col("ts").isNotNull()).select(
        "exchange", "symbol", F.unix_micros("ts").alias("ts_us"), "underlying", "expiry_str", "strike_price",
        "type", *top,
    )


def atm_filter(quotes: DataFrame, band: float = ATM_BAND, max_ttl: int = MAX_TTL_SECONDS) -> DataFrame:
    """Quotes near the money and near expiry, with moneyness, time to expiry, mid and spread.

    Expects sec, expiry (epoch seconds), spot, strike, bid, ask; rows without any price are dropped first.
    """
    ttl = F.col("expiry") - F.col("sec")
    moneyness = C.ratio("spot", "strike")
    return quotes.where(
        (F.col("bid").isNotNull() | F.col("ask").isNotNull()) & moneyness.between(1.0 - band, 1.0 + band)
        & (ttl > 0) & (ttl <= max_ttl)
    ).withColumns(
        {
            "moneyness": moneyness, "time_to_expiry_seconds": ttl, "time_to_expiry_days": ttl / 86400.0,
            "mid_price": C.mid_price("bid", "ask"), "spread_abs": F.col("ask") - F.col("bid"),
            "has_bid": F.col("bid").isNotNull(), "has_ask": F.col("ask").isNotNull(),
        }
    )


def liquidity_flags() -> dict[str, Column]:
    """Rules a quote must satisfy; null counts as a failure."""
    bid, ask, spot, strike = (F.col(c) for c in ("bid", "ask", "spot", "strike"))
    rules = {
        "price_ok": (bid * spot >= MIN_PRICE_USD) & (ask * spot >= MIN_PRICE_USD),
        "spread_ok": C.ratio(ask, bid) - 1 <= MAX_SPREAD,
        "moneyness_ok": C.ratio(strike, spot).between(MIN_MONEYNESS, MAX_MONEYNESS),
        "time_ok": F.col("days") * 24 >= MIN_HOURS,
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def reject_counts(quotes: DataFrame) -> DataFrame:
    """How many quotes each rule rejects and how many pass all; one pass."""
    flags = liquidity_flags()
    every = F.lit(True)
    for name in flags:
        every = every & F.col(name)
    return quotes.withColumns(flags).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~F.col(name)).alias(name.replace("_ok", "_rejected")) for name in flags],
        F.count_if(every).alias("kept"),
    )


def robust_strikes(contracts: DataFrame, spot: DataFrame, price: str, window: int) -> DataFrame:
    """Strike per contract: exponentially weighted mean of the prices in the ``window`` seconds up to the open,
    else the last price before, else the first after."""
    slot = spot.withColumn("_slot", F.explode(F.array(
        F.floor(F.col("sec") / window), F.floor(F.col("sec") / window) + 1
    )))
    near = contracts.withColumn("_slot", F.floor(F.col("open_time") / window)).join(slot, "_slot").where(
        F.col("sec").between(F.col("open_time") - window, F.col("open_time"))
    )
    by = Window.partitionBy("open_time")  # at most window + 1 rows
    i, n = F.row_number().over(by.orderBy("sec")) - 1, F.count(F.lit(1)).over(by)
    weight = F.exp(F.when(n == 1, -1.0).otherwise(-1.0 + i / F.nullif(n - 1, F.lit(0))))
    mean = near.withColumn("_w", weight).groupBy("open_time").agg(
        (F.sum(F.col(price) * F.col("_w")) / F.sum("_w")).alias("_mean")
    )
    both = contracts.withColumn("_probe", F.lit(1)).unionByName(
        spot.select(F.col("sec").alias("open_time"), F.col(price).alias("_v")), allowMissingColumns=True
    ).withColumn("_side", F.coalesce("_probe", F.lit(0)))
    near_price = Series(both, [], ["open_time", "_side"]).running(
        _back=Running("last", F.col("_v")), _ahead=Running("next", F.col("_v"))
    ).where("_probe = 1")
    return near_price.join(mean, "open_time", "left").select(
        "open_time", F.coalesce("_mean", "_back", "_ahead").alias("strike")
    )


def pricing_grid(
    contracts: DataFrame, spot: DataFrame, iv: DataFrame, rates: DataFrame, max_age: int = MAX_IV_AGE,
    length: int = SECONDS_PER_CONTRACT, rows: int | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Price every contract at every second.

    contracts: contract key ``open_time`` and ``close_time``; spot: gap-free ``sec, S``; iv: ``sec, qid, iv_bid, iv_ask,
    expiry``; rates: ``day, r``.  The volatility is the nearest expiry after the close, carried at most ``max_age``
    seconds inside the contract; the strike is the price at the open, the outcome compares the last price with it.
    """
    periods = contracts.select("open_time", "close_time")
    cells = periods.withColumn("sec", F.explode(F.sequence(F.col("open_time"), F.col("close_time") - 1)))
    at = joins.interval_lookup(iv.select("sec").distinct(), "sec", periods, "open_time", "close_time", length)
    best = joins.closest_eligible(
        at.where("open_time is not null"), iv, ["sec"], "expiry", "qid", F.col("expiry") > F.col("close_time"),
        ["sec", "open_time", "close_time"], ["iv_bid", "iv_ask"],
    )
    prices = joins.interval_lookup(spot.select("sec", "S"), "sec", periods, "open_time", "close_time", length)
    # Cells, prices and quotes meet in one shuffle by contract, which also serves the windows below.
    keys = ["open_time", "close_time", "sec"]
    parts = cells.unionByName(prices.where("open_time is not null"), allowMissingColumns=True).unionByName(
        best.select(*keys, F.col("sec").alias("_at"), "iv_bid", "iv_ask"), allowMissingColumns=True
    )
    count = int(spot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = parts.repartition(count, "open_time").groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("S", "_at", "iv_bid", "iv_ask")]  # one row of each kind per cell
    )
    # A contract has `length` rows, so windows inside it are bounded by construction.
    inside = Window.partitionBy("open_time", "close_time").orderBy("sec")
    filled = full.withColumns(
        {
            "_iv": F.last(F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), "iv_bid", "iv_ask")), True).over(inside),
            "K": F.first("S").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "S_close": F.last("S").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    fresh = (F.col("sec") - F.col("_iv.at")) <= max_age
    out = filled.select(
        "open_time", "close_time", "sec", "S", "K",
        (F.col("close_time") - F.col("sec")).alias("seconds_left"),
        (F.col("sec") - F.col("_iv.at")).alias("iv_staleness_seconds"),
        F.when(fresh, F.col("_iv.iv_bid")).alias("iv_bid"), F.when(fresh, F.col("_iv.iv_ask")).alias("iv_ask"),
        (F.col("S_close") > F.col("K")).cast("int").alias("outcome"),
        C.epoch_day("sec").alias("day"),
    )
    out = joins.lookup(out, rates, ["day"])
    out = out.withColumn("sigma_mid", (F.col("iv_bid") + F.col("iv_ask")) / 2)
    sources = {"prob_bid": "iv_bid", "prob_ask": "iv_ask", "prob_mid": "sigma_mid"}
    return pricing.with_binary_prices(out, "S", "K", "r", "seconds_left", sources)


def term_interpolation(iv: DataFrame, key: str, seconds: str, vol: str, target: float) -> DataFrame:
    """Volatility at a target time to expiry, linear in total variance between the bracketing quotes.

    Needs two expiries per key; outside the quoted range the nearest expiry is used.  The bracket is found by
    min_by / max_by, so a key of any size is aggregated before the shuffle.
    """
    t, v = F.col(seconds), F.col(vol)
    point = F.struct(t.alias("t"), v.alias("v"))
    ends = iv.groupBy(key).agg(
        F.max_by(point, F.when(t < target, F.struct(t, v))).alias("lo"),
        F.min_by(point, F.when(t >= target, F.struct(t, v))).alias("hi"),
        F.count(F.lit(1)).alias("quotes"),
    )
    var = lambda p: F.col(f"{p}.v") * F.col(f"{p}.v") * F.col(f"{p}.t")
    slope = F.try_divide(var("hi") - var("lo"), F.col("hi.t") - F.col("lo.t"))
    between = F.sqrt((var("lo") + slope * (target - F.col("lo.t"))) / target)
    value = F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v")).otherwise(between)
    return ends.where("quotes >= 2").select(key, value.alias("iv_at_target"))


def iv_error(ours: Column, theirs: Column) -> dict[str, Column]:
    error = ours - theirs
    return {"error": error, "abs_error": F.abs(error), "rel_error": C.ratio(error, theirs)}

