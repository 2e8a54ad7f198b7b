"""Normal distribution, binary and vanilla option prices, Greeks, implied volatility."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.columns import ColumnLike, clip, col, ratio

# -- fixed values -----------------------------------------------------------------------------------
SECONDS_PER_YEAR = 31_557_600.0  # 365.25 days
EPSILON = 1e-8
MIN_OPTION_PRICE = 0.00001  # in units of the underlying
MIN_HOURS_TO_EXPIRY = 0.5
VOL_LOW, VOL_HIGH, BISECTIONS = 1e-4, 10.0, 60
# Rational approximation of the normal tail in double precision (Hart 1968, as given by West 2005).
TAIL_NUM = [
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
TAIL_DEN = [
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
TAIL_SPLIT, TAIL_END, TAIL_SCALE = 7.07106781186547, 37.0, 2.506628274631


def _horner(coefficients, x):
    value = coefficients[0]
    for c in coefficients[1:]:
        value = value * x + c
    return value


def norm_pdf(x: ColumnLike) -> Column:
    x = col(x)
    return F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)


def norm_cdf(x: ColumnLike) -> Column:
    """Standard normal distribution function to about 1e-15."""
    x = col(x)
    z = F.abs(x)
    density = F.exp(-z * z / 2.0)
    body = density * _horner([F.lit(c) for c in TAIL_NUM], z) / _horner([F.lit(c) for c in TAIL_DEN], z)
    fraction = z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65))))
    tail = F.when(z > TAIL_END, 0.0).when(z < TAIL_SPLIT, body).otherwise(density / fraction / TAIL_SCALE)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def student_p(t: ColumnLike, freedom: ColumnLike) -> Column:
    """Two-sided p-value of Student's t.

    Up to 20 degrees of freedom the incomplete beta function by its continued fraction, beyond that the normal tail at
    Hill's transformed value (1970), which is exact to about 1e-9 there.
    """
    t, v = col(t), col(freedom)
    # I_x(v / 2, 1 / 2) with x = v / (v + t^2), or its complement, whichever fraction converges
    a, b, x = v / 2, F.lit(0.5), v / (v + t * t)
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + F.ln((a + i) / (a + 0.5 + i)))
    far = a + 10.0
    gammas = shift + 0.5 * F.ln(far) - 1 / (8 * far) + 1 / (192 * far * far * far)  # ln Gamma(a + 1/2) - ln Gamma(a)
    front = F.exp(gammas - 0.5 * math.log(math.pi) + a * F.ln(x) + b * F.ln(1 - x))

    def fraction(p: Column, q: Column, z: Column) -> Column:
        def step(s: Column, m: Column) -> Column:
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            d = 1 / (1 + even * s["d"])
            c = 1 + even / s["c"]
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d2, c2 = 1 / (1 + odd * d), 1 + odd / c
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d * c * d2 * c2).alias("h"))

        d0 = 1 / (1 - (p + q) * z / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step)["h"]

    small = F.when(x < (a + 1) / (a + 2.5), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)
    w = v - 0.5
    y = F.sqrt(w * F.ln(1 + t * t / v))
    y2, k = y * y, 48 * w * w
    z = y + (y * y2 + 3 * y) / k - y * (((4 * y2 + 33) * y2 + 240) * y2 + 855) / (10 * k * (k + 0.8 * y2 * y2 + 100))
    return F.when(t == 0, 1.0).when(v <= 20, F.when(v <= 20, small)).otherwise(2 * norm_cdf(-z))


def norm_cdf_array(x: np.ndarray) -> np.ndarray:
    """The same approximation on an array, for use inside tasks."""
    z = np.minimum(np.abs(x), TAIL_END)
    density = np.exp(-z * z / 2.0)
    body = density * _horner(TAIL_NUM, z) / _horner(TAIL_DEN, z)
    fraction = z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65))))
    tail = np.where(z < TAIL_SPLIT, body, density / fraction / TAIL_SCALE)
    return np.where(x > 0, 1.0 - tail, tail)


# -- binary (cash-or-nothing) options ---------------------------------------------------------------


def binary_d2(spot, strike, rate, sigma, seconds) -> Column:
    """d2 of a contract that pays 1 if spot ends above strike; +-1e10 where no time value is left."""
    spot, strike, rate, sigma = col(spot), col(strike), col(rate), col(sigma)
    years = col(seconds) / SECONDS_PER_YEAR
    spread = sigma * F.sqrt(years)
    drift = (rate - 0.5 * sigma * sigma) * years
    return (
        F.when(spread.isNotNull() & (spot <= 0) & (strike > 0), F.lit(-1e10))
        .when(spread.isNotNull() & (spot > 0) & (strike <= 0), F.lit(1e10))
        .when(spread > 1e-10, F.try_divide(F.ln(ratio(spot, strike)) + drift, spread))
        .when(spread.isNotNull() & (spot > strike), F.lit(1e10))
        .when(spread.isNotNull() & (spot <= strike), F.lit(-1e10))
    )


def discount(rate, seconds) -> Column:
    return F.exp(-col(rate) * (col(seconds) / SECONDS_PER_YEAR))


def with_binary_prices(df: DataFrame, spot, strike, rate, seconds, volatilities: Mapping[str, ColumnLike],
                       keep: bool = False) -> DataFrame:
    """Add one price per volatility: {price column: volatility}.

    d2 gets its own projection: the distribution function mentions its argument many times, and inlining d2
    there would push the generated code over the JVM's method limit.  ``keep`` leaves ``d2_`` and ``prob_`` columns.
    """
    d2 = {f"d2_{name}": binary_d2(spot, strike, rate, sigma, seconds) for name, sigma in volatilities.items()}
    probabilities = {
        f"prob_{name}": F.when(F.col(f"d2_{name}").isNotNull(), norm_cdf(f"d2_{name}")) for name in volatilities
    }
    prices = {name: discount(rate, seconds) * F.col(f"prob_{name}") for name in volatilities}
    out = df.withColumns(d2).withColumns(probabilities).withColumns(prices)
    return out if keep else out.drop(*d2, *probabilities)


def binary_greeks(s="S", k="K", sigma="sigma_mid", years="T_years", r="r", prob="prob_mid") -> list[dict[str, Column]]:
    """Greeks of the binary contract in steps; later steps use the columns of earlier ones."""
    S, K, sd, T, rate = col(s), col(k), col(sigma), col(years), col(r)
    root = F.sqrt(T + EPSILON)
    scale = sd * root
    disc = F.exp(-rate * T)
    d1 = (F.ln(S / (K + EPSILON)) + (rate + sd * sd / 2.0) * T) / (scale + EPSILON)
    flow = disc * F.col("phi_d2")
    return [
        {"d1": d1},
        {"d2": F.col("d1") - scale},
        {"phi_d2": norm_pdf("d2")},
        {
            "delta": flow / ((S + EPSILON) * scale + EPSILON),
            "gamma": -flow * F.col("d1") / ((S + EPSILON) * (S + EPSILON) * (sd * sd * T + EPSILON)),
            "vega": -flow * F.col("d2") * root / (sd + EPSILON),
            "theta": rate * disc * col(prob)
            - flow * (sd / (2.0 * root + EPSILON) + rate * F.col("d2") / (sd * root + EPSILON)),
            "vanna": -flow * F.col("d2") / (sd + EPSILON),
            "charm": flow * (rate / (sd * root + EPSILON) - F.col("d1") / (2.0 * T + EPSILON)),
        },
        {"volga": F.col("vega") * F.col("d1") * F.col("d2") / (sd + EPSILON)},
    ]


def greek_transforms(years="T_years") -> dict[str, Column]:
    """Log, root, ratio and interaction forms of the Greeks."""
    T = col(years)
    g = {name: F.col(name) for name in ("delta", "gamma", "vega", "theta", "vanna", "volga", "charm")}
    size = {name: F.abs(c) for name, c in g.items()}
    out = {f"log_abs_{n}": F.ln(size[n] + EPSILON) for n in ("delta", "gamma", "vega")}
    out |= {f"sqrt_abs_{n}": F.sqrt(size[n] + EPSILON) for n in ("gamma", "vega")}
    out |= {f"{n}_sign": F.signum(g[n]) for n in ("delta", "theta")}
    out |= {
        f"{top}_{bottom}_ratio": g[top] / (size[bottom] + EPSILON)
        for top, bottom in (("gamma", "delta"), ("vega", "delta"), ("vanna", "vega"))
    }
    out |= {f"{a}_vega_product": g[a] * g["vega"] for a in ("delta", "gamma")}
    return out | {
        "delta_squared": g["delta"] * g["delta"],
        "theta_per_day": g["theta"] / (T + EPSILON),
        "vega_time_weighted": g["vega"] * F.sqrt(T),
        "inverse_gamma": 1.0 / (size["gamma"] + EPSILON),
        "greek_stability": size["vanna"] + size["volga"] + size["charm"],
        "convexity_measure": size["gamma"] / (size["delta"] + EPSILON),
    }


# -- vanilla options and implied volatility ---------------------------------------------------------


def vanilla_price(spot, strike, rate, sigma, years, is_call) -> Column:
    """Black-Scholes price of a call or put."""
    spot, strike, rate, sigma, years = (col(c) for c in (spot, strike, rate, sigma, years))
    scale = sigma * F.sqrt(years)
    d1 = F.try_divide(F.ln(ratio(spot, strike)) + (rate + 0.5 * sigma * sigma) * years, F.nullif(scale, F.lit(0.0)))
    sign = F.when(col(is_call), 1.0).otherwise(-1.0)
    return sign * (spot * norm_cdf(sign * d1) - strike * F.exp(-rate * years) * norm_cdf(sign * (d1 - scale)))


def _vanilla_array(s, k, disc, drift, sigma, root, sign):
    """Price and its derivative by the volatility."""
    scale = sigma * root
    d1 = (np.log(s / k) + drift) / scale + 0.5 * scale
    price = sign * (s * norm_cdf_array(sign * d1) - k * disc * norm_cdf_array(sign * (d1 - scale)))
    return price, s * root * np.exp(-0.5 * d1 * d1) / math.sqrt(2.0 * math.pi)


def _solve(price, s, k, rate, years, is_call) -> np.ndarray:
    """Volatility by Newton steps inside a shrinking bracket; NaN where no volatility gives the price.

    A step that leaves the bracket is replaced by its middle; rows that have converged are not touched again.
    """
    root, sign, disc = np.sqrt(years), np.where(is_call, 1.0, -1.0), np.exp(-rate * years)
    data = np.stack([price, s, k, disc, rate * years, root, sign])
    out = np.full(price.shape, np.nan)

    def at(sigma, rows):
        return _vanilla_array(*rows[1:5], sigma, *rows[5:])

    ends = [at(np.full(price.shape, v), data)[0] for v in (VOL_LOW, VOL_HIGH)]
    left = np.flatnonzero((price > ends[0]) & (price < ends[1]))
    lo, hi = np.full(left.size, VOL_LOW), np.full(left.size, VOL_HIGH)
    sigma = np.clip(2.5 * price[left] / (s[left] * root[left]), 0.05, 2.0)
    for _ in range(BISECTIONS):
        if not left.size:
            break
        value, vega = at(sigma, data[:, left])
        miss = value - price[left]
        lo, hi = np.where(miss < 0, sigma, lo), np.where(miss < 0, hi, sigma)
        step = sigma - miss / np.maximum(vega, 1e-300)
        new = np.where((step > lo) & (step < hi), step, 0.5 * (lo + hi))
        done = np.abs(new - sigma) < 1e-13
        out[left] = new
        left, lo, hi, sigma = left[~done], lo[~done], hi[~done], new[~done]
    return out


def _solved(price, s, k, rate, years, is_call) -> np.ndarray:
    """The solver on the rows that have all inputs; NaN, which Arrow turns to null, elsewhere."""
    numbers = [np.asarray(c, float) for c in (price, s, k, rate, years)]
    known = np.all([~np.isnan(c) for c in numbers], axis=0) & ~pd.isna(np.asarray(is_call, object))
    ok = known & np.all([c > 0 for c in (numbers[0], numbers[1], numbers[2], numbers[4])], axis=0)
    out = np.full(len(ok), np.nan)
    if ok.any():
        with np.errstate(all="ignore"):
            out[ok] = _solve(*[c[ok] for c in numbers], np.asarray(is_call, object)[ok].astype(bool))
    return out


@F.pandas_udf(T.DoubleType())
def implied_vol(
    price: pd.Series, spot: pd.Series, strike: pd.Series, rate: pd.Series, years: pd.Series, is_call: pd.Series
) -> pd.Series:
    """Implied volatility of a vanilla option, null where there is none.

    Spark has no root finder; this runs on whole Arrow batches inside the tasks.
    """
    return pd.Series(_solved(price, spot, strike, rate, years, is_call))


@F.pandas_udf(T.StructType([T.StructField(side, T.DoubleType()) for side in ("bid", "ask")]))
def implied_vols(
    bid: pd.Series, ask: pd.Series, spot: pd.Series, strike: pd.Series, rate: pd.Series, years: pd.Series, is_call: pd.Series
) -> pd.DataFrame:
    """Implied volatilities of both sides of a quote in one call."""
    twice = [np.concatenate([c.to_numpy(), c.to_numpy()]) for c in (spot, strike, rate, years, is_call)]
    both = _solved(np.concatenate([bid.to_numpy(float), ask.to_numpy(float)]), *twice)
    return pd.DataFrame({"bid": both[: len(bid)], "ask": both[len(bid) :]})


def implied_vol_columns(bid, ask, spot, strike, rate, days, is_call) -> list[dict[str, Column]]:
    """implied_vol_bid / _ask of quotes in units of the underlying, and the status of each row; ``_iv`` is left over.

    One pass: rows that fail the input rules reach the solver as nulls, so nothing is split and unioned.
    """
    bid, ask, spot, strike, days = (col(c) for c in (bid, ask, spot, strike, days))
    valid = (
        (bid > MIN_OPTION_PRICE) & (ask > MIN_OPTION_PRICE) & (days > MIN_HOURS_TO_EXPIRY / 24.0)
        & (spot > 0) & (strike > 0)
    )
    valid = F.coalesce(valid, F.lit(False))
    quotes = [F.when(valid, quote * spot) for quote in (bid, ask)]
    missing = F.col("implied_vol_bid").isNull() | F.col("implied_vol_ask").isNull()
    return [
        {"_iv": implied_vols(*quotes, spot, strike, col(rate), days / 365.25, col(is_call))},
        {"implied_vol_bid": F.col("_iv.bid"), "implied_vol_ask": F.col("_iv.ask")},
        {"iv_calc_status": F.when(~valid, "invalid_input").when(missing, "failed").otherwise("success")},
    ]


# -- volatility choice ------------------------------------------------------------------------------

FRESH, MODERATE, STALE = 10.0, 60.0, 120.0  # seconds since the quote


def adaptive_vol(iv, staleness, rv60, rv300, rv900, seconds_left) -> dict[str, Column]:
    """Blend of implied and realised volatility by quote age, and the name of the rule used."""
    iv, age, left = col(iv), col(staleness), col(seconds_left)
    short, middle, long = col(rv60), col(rv300), col(rv900)
    rv = (
        F.when(left < 180, F.coalesce(short, middle, long))
        .when(left < 600, F.coalesce(middle, short, long))
        .otherwise(F.coalesce(long, middle, short))
    )
    weight = (
        F.when(rv.isNull() | (age < FRESH), F.lit(1.0))
        .when(age < MODERATE, 0.8 - (age - FRESH) / (MODERATE - FRESH) * 0.3)
        .when(age < STALE, 0.5 - (age - MODERATE) / (STALE - MODERATE) * 0.3)
        .otherwise(F.greatest(F.lit(0.1), 0.2 - (age - STALE) / 1000 * 0.1))
    )
    method = (
        F.when(rv.isNull(), "iv_only_no_rv").when(age < FRESH, "fresh_iv").when(age < MODERATE, "blend_moderate")
        .when(age < STALE, "blend_stale").otherwise("rv_dominant")
    )
    return {
        "sigma_adaptive": F.when(weight == 1.0, iv).otherwise(weight * iv + (1.0 - weight) * rv),
        "blend_method": method,
    }


def vol_quality(iv, staleness, rv, samples) -> Column:
    """Score in [0, 1] from freshness, agreement of the two volatilities and sample size."""
    iv, age, rv, n = col(iv), col(staleness), col(rv), col(samples)
    fresh = F.when(age < FRESH, 0.4).when(age < MODERATE, 0.3).when(age < STALE, 0.2).otherwise(0.1)
    agree = F.when(iv > 0, rv / iv).otherwise(1.0)

    def within(margin):
        return (agree > 1.0 - margin) & (agree < 1.0 + margin)

    agreement = F.when(within(0.1), 0.4).when(within(0.2), 0.3).when(within(0.3), 0.2).otherwise(0.1)
    size = F.when(n >= 300, 0.2).when(n >= 100, 0.15).when(n >= 50, 0.1).when(n.isNotNull(), 0.05).otherwise(0.1)
    return F.when(iv.isNull() | rv.isNull(), 0.3).otherwise(F.least(F.lit(1.0), fresh + agreement + size))


def smile_vol(iv, moneyness, years, skew: float, kurtosis: float, term_skew: float) -> Column:
    """Volatility times a smile factor in log-moneyness, the factor kept in [0.8, 1.3]."""
    m, t = col(moneyness), col(years)
    log_m = F.when(m > 0, F.ln(m)).otherwise(0.0)
    factor = 1 + skew * log_m * F.sqrt(t) + kurtosis * log_m * log_m + term_skew * log_m * t
    return col(iv) * clip(factor, 0.8, 1.3)
