"""Feature tables: returns, volatility, momentum, jumps, books, basis, regimes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import columns as C
from tidemark.functions.pricing import SECONDS_PER_YEAR
from tidemark.operators.aggregates import attach, quantiles
from tidemark.operators.series import ROWS_PER_TASK, Running, Series, rolling, rolling_corr
from tidemark.session import cut_lineage

# -- fixed values -----------------------------------------------------------------------------------
RV_WINDOWS = (60, 300, 900, 3600)
MOMENTUM_WINDOWS = (60, 300, 900)
RANGE_WINDOWS = (300, 900)
JUMP_SIGMAS = 3.0
EMA_SPANS = (60, 300, 900, 3600)
HAR_ROWS = (96, 672, 2880)
HAR_WEIGHTS = (0.4, 0.3, 0.2)
HAR_INTERCEPT = 0.05
DECAY = 0.94
MINUTE_SCALE = math.sqrt(252 * 24 * 60)
THIRTY_DAYS = 2_592_000
LOW_Q, HIGH_Q, EXTREME_Q = 0.33, 0.67, 0.95
ATM_DISTANCE = 0.01
NEAR_SECONDS, MID_SECONDS = 300, 600


# -- group statistics attached to rows ---------------------------------------------------------------


def group_zscore(df: DataFrame, keys: Sequence[str], value: str, name: str, epsilon: float = 1e-10) -> DataFrame:
    """(x - mean) / (std + epsilon) of the row's group.  The group statistics are an aggregate, not a window."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    return attach(df, stats, keys).withColumn(name, (F.col(value) - F.col("_mu")) / (F.col("_sd") + epsilon)).drop("_mu", "_sd")


def dense_rank_percentile(df: DataFrame, keys: Sequence[str], value: str, name: str,
                          rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Dense rank of the value in its group over the number of rows of the group."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = Series(counts, keys, [value], rows_per_task, rows=df.count()).running(
        _rank=Running("count"), _n=Running("total", F.col("_c"))
    )
    share = ranks.select(*keys, value, (F.col("_rank") / F.col("_n")).alias(name))
    return attach(df, share, [*keys, value])


def transition_matrix(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str,
                      rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """How often each state follows each other state, and the share of the previous state's exits."""
    pairs = Series(df, keys, order, rows_per_task).frames({"prev": lambda w: F.lag(state).over(w)}, before=1)
    counts = pairs.where(F.col("prev").isNotNull()).groupBy("prev", state).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def settlement_zscore(df: DataFrame, keys: Sequence[str], slot: str, value: str, n: int, name: str,
                      rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """z-score over the last n settlements, computed on the distinct settlements and mapped back."""
    once = df.groupBy(*keys, slot).agg(F.max(value).alias("_x"))
    x = F.col("_x")
    rolled = Series(once, keys, [slot], rows_per_task).frames(
        {"_mu": rolling(F.avg, x, n), "_sd": rolling(F.stddev_samp, x, n)}, before=n - 1
    )
    z = rolled.select(*keys, slot, ((x - F.col("_mu")) / (F.col("_sd") + 1e-8)).alias(name))
    return attach(df, z, [*keys, slot])


def rolling_time_quantiles(df: DataFrame, keys: Sequence[str], t: str, value: str, span: int,
                           probs: Mapping[str, float], relative_error: float | None = None) -> DataFrame:
    """Quantiles of the values in (t - span, t] per key and row.

    Rows are copied into the block of ``span`` units they lie in and the next one, so a task holds two spans of one
    key at most.  Exact by default: cost grows with rows per span, so feed it bars, not ticks.  With
    ``relative_error`` the sketch ``percentile_approx`` is used inside the frame.
    """
    block = F.floor(F.col(t) / span)
    copies = F.array(
        F.struct(block.alias("_block"), F.lit(True).alias("_own")),
        F.struct((block + 1).alias("_block"), F.lit(False).alias("_own")),
    )
    frame = Window.partitionBy(*keys, "_block").orderBy(t).rangeBetween(-(span - 1), 0)
    levels = F.array(*[F.lit(float(p)) for p in probs.values()])
    if relative_error is None:
        q = F.percentile(value, levels).over(frame)
    else:
        q = F.percentile_approx(value, levels, F.lit(int(1 / relative_error))).over(frame)
    out = df.select("*", F.inline(copies)).withColumn("_q", q).where("_own")
    return out.select(*df.columns, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def day_sketches(df: DataFrame, keys: Sequence[str], day: Column, value: str, days: int, k: int) -> DataFrame:
    """(keys, day, n, sketch): a mergeable sketch of the values of the last ``days`` days, for every day of a key's span.

    The rows are read once, into one sketch per day. A window of days is the tail of one run of ``days`` days and the head
    of the next; both are merged as they grow, so every sketch is merged a fixed number of times, whatever the window.
    """
    keys = list(keys)
    own = df.groupBy(*keys, day.alias("day")).agg(F.count(value).alias("_n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("_own"))
    span = own.groupBy(*keys).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    span = span.select(*keys, "_first", F.explode(F.sequence("_first", "_last")).alias("day"))
    place = F.col("day") - F.col("_first")
    daily = span.join(own, [*keys, "day"], "left").withColumn("_run", F.floor(place / days))
    ahead = Window.partitionBy(*keys, "_run").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "_run").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*keys).orderBy("_run", "day")
    daily = daily.withColumns({"_tail": F.kll_merge_agg_double("_own").over(back), "_tail_n": F.sum("_n").over(back)})
    daily = daily.withColumns({"_head": F.kll_merge_agg_double("_own").over(ahead), "_head_n": F.sum("_n").over(ahead)})
    before = place % days < days - 1  # a window that is exactly its run has no tail
    daily = daily.withColumns({f"_tail{c}": F.when(before, F.lag(f"_tail{c}", days - 1).over(along)) for c in ("", "_n")})
    sketch = F.when(F.coalesce("_tail_n", F.lit(0)) == 0, F.col("_head")).when(F.coalesce("_head_n", F.lit(0)) == 0, F.col("_tail")).otherwise(
        F.kll_sketch_merge_double("_head", "_tail"))
    n = F.coalesce("_head_n", F.lit(0)) + F.coalesce("_tail_n", F.lit(0))
    return daily.select(*keys, "day", n.alias("n"), F.when(n > 0, sketch).alias("sketch"))


def rolling_day_quantiles(df: DataFrame, keys: Sequence[str], day: Column, value: str, days: int, probs: Mapping[str, float], k: int = 800) -> DataFrame:
    """Quantiles of the values of the last ``days`` days, the day itself included: (keys, day, n, one column per
    probability), to be joined to rows by key and day.

    Ranks are off by about 2.3 / k ** 0.9 of n at most, whatever the number of rows (0.6 % for k = 800); up to k values
    are exact but for interpolation.
    """
    table = day_sketches(df, keys, day, value, days, k)
    return table.select(*keys, "day", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()])


# -- returns, volatility, momentum -------------------------------------------------------------------


def _frame(df: DataFrame, keys, order, steps, before, rows_per_task, rows=None) -> DataFrame:
    return Series(df, keys, order, rows_per_task, rows=rows).frames(*steps, before=before)


def realized_volatility(df: DataFrame, keys, order, close: str = "close", windows: Sequence[int] = RV_WINDOWS, step: int = 1,
                        rows_per_task: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Annualised standard deviation of log returns per window, window ratios and term slope.

    Windows are seconds; ``step`` is the time between two rows of the gap-free grid.
    """
    if any(n % step for n in windows):
        raise ValueError(f"windows {windows} are no multiples of the step of {step} s")
    steps = [
        {"log_return": log_return(close)},
        {f"rv_{n}s": rolling(F.stddev_samp, F.col("log_return"), n // step) for n in windows},
        {f"rv_{n}s": F.col(f"rv_{n}s") * math.sqrt(SECONDS_PER_YEAR / n) for n in windows},
    ]
    out = _frame(df, keys, order, steps, max(windows) // step, rows_per_task, rows)
    short, long = f"rv_{windows[0]}s", f"rv_{windows[-1]}s"
    ratios = {f"rv_ratio_{b}_{a}": C.ratio(f"rv_{b}s", f"rv_{a}s") for a, b in zip(windows, windows[1:])}
    return out.withColumns({**ratios, "rv_term_structure": C.ratio(F.col(long) - F.col(short), short)})


def log_return(price: str = "close"):
    """Log of the price over the one before; null where either is not positive."""
    return lambda w: F.ln(C.ratio(price, F.lag(price).over(w)))


def momentum_and_range(df: DataFrame, keys, order, windows: Sequence[int] = MOMENTUM_WINDOWS,
                       ranges: Sequence[int] = RANGE_WINDOWS, step: int = 1, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Return over n seconds and (high - low) of the last n seconds relative to the close, on a gap-free grid of ``step``."""
    close = F.col("close")

    def momentum(n):
        return lambda w: C.ratio(close - F.lag("close", n // step).over(w), F.lag("close", n // step).over(w))

    ends = {f"_{side}{n}": rolling(f, F.col(c), n // step) for n in ranges for side, f, c in (("hi", F.max, "high"), ("lo", F.min, "low"))}
    steps = [
        {f"momentum_{n}s": momentum(n) for n in windows} | ends,
        {f"range_{n}s": C.ratio(F.col(f"_hi{n}") - F.col(f"_lo{n}"), close) for n in ranges},
    ]
    return _frame(df, keys, order, steps, max([*windows, *ranges]) // step, rows_per_task).drop(*ends)


def jumps(df: DataFrame, keys, order, rv: str, window: int, min_rows: int = 10, step: int = 1,
          rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Returns beyond three times the volatility of one step of ``step`` seconds: flag, intensity, count, mean signed size."""
    step0 = {"log_return": log_return()}
    per_step = F.col(rv) / math.sqrt(SECONDS_PER_YEAR / step)
    flag = (F.abs("log_return") > JUMP_SIGMAS * per_step).cast("int")
    jumped = F.when(F.col("jump_detected") == 1, F.col("log_return")).otherwise(0.0)
    steps = [
        step0,
        {"jump_detected": flag},
        {"jump_intensity": rolling(F.sum, F.col("jump_detected"), window),
         "jump_count": rolling(F.sum, F.col("jump_detected"), window, min_rows),
         "_signed": rolling(F.sum, jumped, window, min_rows)},
        {"jump_direction": F.col("_signed") / (F.col("jump_count") + 1e-9)},
    ]
    return _frame(df, keys, order, steps, window, rows_per_task).drop("_signed")


def autocorrelations(df: DataFrame, keys, order, lags: Sequence[int], window: int,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rolling correlation of returns with lagged returns, its decay, and the 0.5 + 0.5 rho Hurst proxy."""
    ret = F.col("log_return")
    steps = [
        {"log_return": log_return()},
        {f"_l{n}": (lambda n: lambda w: F.lag("log_return", n).over(w))(n) for n in lags},
        {f"autocorr_lag{n}": rolling_corr(ret, F.col(f"_l{n}"), window) for n in lags},
    ]
    out = _frame(df, keys, order, steps, window + max(lags), rows_per_task).drop(*[f"_l{n}" for n in lags])
    first, last = f"autocorr_lag{lags[0]}", f"autocorr_lag{lags[-1]}"
    return out.withColumns({"autocorr_decay": F.col(first) - F.col(last), "hurst": 0.5 + 0.5 * F.col(first)})


def ema_set(df: DataFrame, keys, order, close: str = "close", spans: Sequence[int] = (12, 60, 300, 900), step: float = 1,
            rows_per_task: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Exponential means, their crossings and the distance from the longest, in percent of price."""
    means = Series(df, keys, order, rows_per_task, rows=rows).ewm(**{f"ema_{n}s": (close, n / step) for n in spans})
    crosses = {
        f"ema_cross_{a}_{b}": C.ratio((F.col(f"ema_{a}s") - F.col(f"ema_{b}s")) * 100, close) for a, b in zip(spans, spans[1:])
    }
    longest = f"ema_{spans[-1]}s"
    return means.withColumns({**crosses, f"price_vs_ema_{spans[-1]}": C.ratio((F.col(close) - F.col(longest)) * 100, longest)})


def extreme_place(agg, value: Column, sec: Column, n: int):
    """The largest (``F.max``) or smallest (``F.min``) of the last ``n`` rows with its latest time, as a struct (x, at).

    Extremes of (value, time) pairs are like any others: long windows take constant work per row.
    """
    at = sec if agg is F.max else -sec
    return rolling(agg, F.when(value.isNotNull(), F.struct(value.alias("x"), at.alias("at"))), n, 1)


def extremes(df: DataFrame, keys, order, sec: str, n: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Distance from the high and low of the last n rows, in percent and in seconds."""
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    step = {"_high": extreme_place(F.max, high, F.col(sec), n), "_low": extreme_place(F.min, low, F.col(sec), n)}
    out = _frame(df, keys, order, [step], n - 1, rows_per_task)
    return out.withColumns({
        "window_high": F.col("_high.x"), "window_low": F.col("_low.x"),
        "time_since_high": F.col(sec) - F.col("_high.at"), "time_since_low": F.col(sec) + F.col("_low.at"),
    }).drop("_high", "_low").withColumns(
        {
            "drawdown_from_high": C.ratio((F.col("window_high") - close) * 100, "window_high"),
            "runup_from_low": C.ratio((close - F.col("window_low")) * 100, "window_low"),
        }
    )


def asymmetry(df: DataFrame, keys, order, price: str, windows: Sequence[int] = MOMENTUM_WINDOWS, step: int = 1, rows_per_task: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Per window of n seconds: semi-deviations of returns over n seconds, their ratio, skewness and the fourth-moment
    kurtosis, on a gap-free grid of ``step`` seconds."""
    p = F.col(price)
    returns = {f"_ret_{n}": (lambda n: lambda w: C.ratio(p, F.lag(price, n // step).over(w)) - 1)(n) for n in windows}
    rolled, roots = {}, {}
    for n in windows:
        ret = F.col(f"_ret_{n}")
        square, known = ret * ret, ret.isNotNull()
        rolled |= {
            f"downside_vol_{n}": rolling(F.avg, F.when(known, F.when(ret < 0, square).otherwise(0.0)), n // step),
            f"upside_vol_{n}": rolling(F.avg, F.when(known, F.when(ret > 0, square).otherwise(0.0)), n // step),
            f"_skew_{n}": rolling(F.skewness, ret, n // step), f"_m4_{n}": rolling(F.avg, square * square, n // step), f"_m2_{n}": rolling(F.avg, square, n // step),
            f"_most_{n}": rolling(F.max, ret, n // step), f"_least_{n}": rolling(F.min, ret, n // step),
        }
        roots |= {f"{side}_vol_{n}": F.sqrt(f"{side}_vol_{n}") for side in ("downside", "upside")}
    out = _frame(df, keys, order, [returns, rolled], 2 * max(windows) // step, rows_per_task, rows).withColumns(roots)
    for n in windows:
        out = out.withColumns({
            f"vol_asymmetry_ratio_{n}": F.col(f"downside_vol_{n}") / (F.col(f"upside_vol_{n}") + 1e-10),
            f"realized_kurtosis_{n}": F.col(f"_m4_{n}") / (F.col(f"_m2_{n}") * F.col(f"_m2_{n}") + 1e-10) - 3,
            # equal returns have no skewness, whatever rounding leaves of their variance
            f"realized_skewness_{n}": F.when(F.col(f"_most_{n}") > F.col(f"_least_{n}"), F.col(f"_skew_{n}")),
        })
    return out.drop(*returns, *[c for c in rolled if c.startswith("_")])


def iv_minus_semi_volatility(iv, suffix: str = "") -> dict[str, Column]:
    """Implied volatility less the downside and the upside one."""
    return {f"iv_minus_{side}_vol": F.col(iv) - F.col(f"{side}_vol{suffix}") for side in ("downside", "upside")}


def vol_clustering(df: DataFrame, keys, order, short: str, long: str, window: int, min_rows: int,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Persistence, acceleration, volatility of volatility, and the 0.94 / 0.06 forecast."""
    v = F.col(short)
    steps = [
        {"_prev": lambda w: F.lag(short).over(w)},
        {"vol_persistence_ar1": rolling_corr(v, F.col("_prev"), window, min_rows), "vol_of_vol": rolling(F.stddev_samp, v, window, min_rows)},
    ]
    out = _frame(df, keys, order, steps, window, rows_per_task).drop("_prev")
    s, l = F.col(short), F.col(long)
    return out.withColumns(
        {
            "vol_acceleration": (s - l) / (l + 1e-9) * 100,
            "vol_forecast": F.sqrt(DECAY * l * l + (1 - DECAY) * s * s),
        }
    )


def har_forecast(df: DataFrame, keys, order, rv: str, rows: Sequence[int] = HAR_ROWS,
                 rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Forecast from daily, weekly and monthly mean volatility with fixed weights and a mean-scaled intercept."""
    x = F.col(rv)
    step = {f"_h{i}": rolling(F.avg, x, n) for i, n in enumerate(rows)}
    out = _frame(df, keys, order, [step], max(rows) - 1, rows_per_task)
    level = df.groupBy(*keys).agg((F.avg(rv) * HAR_INTERCEPT).alias("_level"))
    forecast = F.col("_level") + C.total([w * F.col(f"_h{i}") for i, w in enumerate(HAR_WEIGHTS)])
    return attach(out, level, keys).withColumn("rv_forecast", forecast).drop("_level", *step)


# -- order books -------------------------------------------------------------------------------------


def book_columns(levels: int = 5) -> list[dict[str, Column]]:
    """Spread, imbalance, depth and weighted mid of a book flattened to ``bid_price_0`` ... columns."""
    def side(name, what):
        return [F.col(f"{name}_{what}_{i}") for i in range(levels)]

    worth = C.total([p * a for s in ("bid", "ask") for p, a in zip(side(s, "price"), side(s, "amount"))])
    bid, ask = F.col("total_bid_volume"), F.col("total_ask_volume")
    bid0, ask0 = F.col("bid_amount_0"), F.col("ask_amount_0")
    mid = (F.col("bid_price_0") + F.col("ask_price_0")) / 2
    return [
        {
            "mid_price": mid,
            "bid_ask_spread_bps": C.ratio((F.col("ask_price_0") - F.col("bid_price_0")) * 10000, mid),
            "bid_ask_imbalance": C.ratio(bid0 - ask0, bid0 + ask0),
            "total_bid_volume": C.total(side("bid", "amount")),
            "total_ask_volume": C.total(side("ask", "amount")),
        },
        {
            "bid_volume_ratio": C.ratio("bid_amount_0", bid),
            "ask_volume_ratio": C.ratio("ask_amount_0", ask),
            "depth_imbalance": C.ratio(bid - ask, bid + ask),
            "weighted_mid_price": C.ratio(worth, bid + ask),
        },
    ]


def with_steps(df: DataFrame, steps) -> DataFrame:
    for step in steps:
        df = df.withColumns(dict(step))
    return df


def book_slope(side: str, levels: int = 5) -> Column:
    """Sample covariance of price with the volume ahead of the level over the population variance of that volume."""
    prices = [F.col(f"{side}_price_{i}") for i in range(levels)]
    amounts = [F.col(f"{side}_amount_{i}") for i in range(levels)]
    ahead = [F.lit(0.0)]
    for amount in amounts[:-1]:
        ahead.append(ahead[-1] + amount)
    n = float(levels)
    mean_v, mean_p = C.total(ahead) / n, C.total(prices) / n
    cov = C.total([(v - mean_v) * (p - mean_p) for v, p in zip(ahead, prices)]) / (n - 1)
    var = C.total([(v - mean_v) * (v - mean_v) for v in ahead]) / n
    return F.when(var < 1e-10, 0.0).otherwise(F.try_divide(cov, F.nullif(var, F.lit(0.0))))


def smoothed(df: DataFrame, keys, order, columns: Mapping[str, str], spans: Sequence[int], vol_windows: Sequence[int],
             rows_per_task: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """Exponential means and rolling deviations of several columns: {column: name prefix}."""
    series = Series(df, keys, order, rows_per_task, rows=rows)
    numbered = series if series.has_places else series.numbered()  # once, for the means and the deviations
    means = numbered.ewm(**{f"{p}_ema_{n}s": (c, n) for c, p in columns.items() for n in spans})
    step = {f"{p}_vol_{n}s": rolling(F.stddev_samp, F.col(c), n) for c, p in columns.items() for n in vol_windows}
    out = numbered._with(means).frames(step, before=max(vol_windows)) if step else means
    return out if series.has_places else out.drop("__rn")


def basis_and_interest(df: DataFrame, keys, order, n: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Basis in basis points, open-interest change, momentum and z-score, price and interest divergence."""
    oi = F.col("open_interest")
    step = {
        "oi_change": lambda w: oi - F.lag("open_interest").over(w),
        "oi_momentum": lambda w: C.ratio(oi, F.lag("open_interest", n).over(w)) - 1,
        "_p": lambda w: C.ratio(F.col("mark_price"), F.lag("mark_price", n).over(w)) - 1,
        "_mu": rolling(F.avg, oi, n),
        "_sd": rolling(F.stddev_samp, oi, n),
    }
    out = _frame(df, keys, order, [step], n, rows_per_task)
    basis = {f"{a}_{b}_basis_bps": C.ratio((F.col(f"{a}_price") - F.col(f"{b}_price")) * 10000, f"{b}_price")
             for a, b in (("mark", "index"), ("mark", "last"), ("index", "last"))}
    return out.withColumns(
        {
            **basis,
            "oi_zscore": (oi - F.col("_mu")) / (F.col("_sd") + 1e-8),
            "price_oi_divergence": F.signum("_p") - F.signum("oi_momentum"),
        }
    ).drop("_p", "_mu", "_sd")


def vol_normalized_book() -> dict[str, Column]:
    rv = F.col("rv")
    drift = F.col("weighted_mid_price") - F.col("weighted_mid_ema")
    return {
        "spread_vol_normalized": F.col("bid_ask_spread_bps") / (rv * 10000 + 1e-10),
        "depth_imbalance_vol_normalized": F.col("depth_imbalance") / (rv + 1e-10),
        "weighted_mid_velocity_normalized": drift / (F.col("weighted_mid_ema") * rv + 1e-10),
    }


# -- regimes -----------------------------------------------------------------------------------------


def extreme_conditions(short: str, long: str, limit: str) -> list[dict[str, Column]]:
    """Volatility spike flag and the position scale that goes with it."""
    ratio = F.col("rv_ratio")
    return [
        {"rv_ratio": F.col(short) / (F.col(long) + 1e-10)},
        {
            "is_extreme_condition": F.coalesce((ratio > 3) | (F.col(long) > F.col(limit)), F.lit(False)),
            "position_scale": F.when(ratio > 3, 0.5).otherwise(1.0),
        },
    ]


def temporal_regime(seconds_left) -> Column:
    return C.bucket(seconds_left, [NEAR_SECONDS, MID_SECONDS], ["near", "mid", "far"])


def regime_columns(vol: str, low: str, high: str, margin: float = 0.1) -> list[dict[str, Column]]:
    """Volatility regime with a margin, market regime with moneyness, and the combined label.

    Expects moneyness_distance and temporal_regime columns.
    """
    v, lo, hi, d = F.col(vol), F.col(low), F.col(high), F.col("moneyness_distance")
    return [
        {
            "volatility_regime": F.when(v < lo * (1 - margin), "low").when(v > hi * (1 + margin), "high").otherwise("medium"),
            "market_regime": F.when(v < lo, F.when(d < ATM_DISTANCE, "low_vol_atm").otherwise("low_vol_otm"))
            .when(v > hi, F.when(d < ATM_DISTANCE, "high_vol_atm").otherwise("high_vol_otm")).otherwise("medium_vol"),
        },
        {"combined_regime": F.concat_ws("_", "temporal_regime", F.when(v <= hi, "low_vol").otherwise("high_vol"))},
    ]


def bucket_thresholds(df: DataFrame, bucket: Column, value: str, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of the row's calendar bucket attached to every row."""
    keyed = df.withColumn("_bucket", bucket)
    limits = cut_lineage(quantiles(keyed, ["_bucket"], value, probs))
    # one row per bucket of time; sent to the rows, which would all meet in a few buckets otherwise
    limits = F.broadcast(limits) if limits.count() <= 100_000 else limits
    return keyed.join(limits, "_bucket", "left").drop("_bucket")


def hysteresis(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, low: Column, high: Column,
               margin: float, name: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """State kept until the band is crossed: only rows clearly outside it speak, the others repeat the last."""
    v = F.col(value)
    spoken = F.when(v > high * (1 + margin), "high").when(v < low * (1 - margin), "low").when(
        (v > low * (1 + margin)) & (v < high * (1 - margin)), "medium"
    )
    return Series(df, keys, order, rows_per_task).running(**{name: Running("last", spoken)})


def moneyness_features(df: DataFrame, spot: str, strike: str, sec: str, seconds_left: str, vol: str | None = None) -> DataFrame:
    """Log, powers, 7-day z-score, daily dense-rank percentile and interactions of spot over strike."""
    m = C.ratio(spot, strike)
    out = df.withColumns({"_m": m, "_week": F.floor(F.col(sec) / 604800), "_day": C.epoch_day(sec)})
    out = group_zscore(out, ["_week"], "_m", "standardized_moneyness")
    out = dense_rank_percentile(out, ["_day"], "_m", "moneyness_percentile")
    d = F.col("_m") - 1
    columns = {
        "log_moneyness": F.ln("_m"), "moneyness_squared": d * d, "moneyness_cubed": d * d * d,
        "moneyness_x_time": d * F.col(seconds_left), "moneyness_distance": F.abs(d),
    }
    if vol:
        columns["moneyness_x_vol"] = d * F.col(vol)
    return out.withColumns(columns).drop("_m", "_week", "_day")
