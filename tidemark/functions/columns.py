"""Column expressions shared by the operators: ratios, buckets, parsing, the normal distribution."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

ColumnLike = Column | str

# -- fixed values: breakpoints and formats users rely on ------------------------------------------
FAR_FUTURE = 2147483647  # expiry of a symbol whose date cannot be read
EXPIRY_HOUR_SECONDS = 8 * 3600  # options settle at 08:00 UTC
US_HOURS, ASIA_HOURS, EUROPE_HOURS = (13, 21), (0, 8), (7, 15)  # sessions, UTC

# Market categories of the feed and the patterns of their names, first match wins.
MARKET_PATTERNS = [
    ("btc_15min", r"^btc-up-or-down-15m-\d+$"),
    ("eth_15min", r"^eth-up-or-down-15m-\d+$"),
    ("bitcoin_hourly", r"^bitcoin-up-or-down-(?!on-)(?!.*candle).+-et(-\d+)?$"),
    ("ethereum_hourly", r"^ethereum-up-or-down-(?!on-)(?!.*candle).+-et(-\d+)?$"),
    ("solana_hourly", r"^solana-up-or-down-(?!on-)(?!.*candle).+-et(-\d+)?$"),
    ("xrp_hourly", r"^xrp-up-or-down-(?!on-)(?!.*candle).+-et(-\d+)?$"),
    ("bitcoin_daily", r"^bitcoin-up-or-down-on-[a-z]+-\d+(-[a-z]+)?(-\d+)?$"),
    ("ethereum_daily", r"^ethereum-up-or-down-on-[a-z]+-\d+(-[a-z]+)?(-\d+)?$"),
    ("solana_daily", r"^solana-up-or-down-on-[a-z]+-\d+(-[a-z]+)?(-\d+)?$"),
    ("xrp_daily", r"^xrp-up-or-down-on-[a-z]+-\d+(-[a-z]+)?(-\d+)?$"),
    ("bitcoin_hourly_candle", r"^bitcoin-up-or-down-.*-candle$"),
    ("ethereum_hourly_candle", r"^ethereum-up-or-down-.*-candle$"),
    ("bitcoin_dominance", r"^bitcoin-dominance-.*$"),
    ("ethbtc", r"^ethbtc-.*$"),
    ("soleth", r"^soleth-.*$"),
    ("bitcoin_aggregated", r"^bitcoin-up-or-down-(in-|this-).*$"),
    ("ethereum_aggregated", r"^ethereum-up-or-down-(in-|this-).*$"),
    ("solana_aggregated", r"^solana-up-or-down-(in-|this-).*$"),
    ("xrp_aggregated", r"^xrp-up-or-down-(in-|this-).*$"),
]


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- arithmetic -------------------------------------------------------------------------------------


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den, null where the denominator is zero or missing."""
    return F.try_divide(col(num).cast("double"), F.nullif(col(den).cast("double"), F.lit(0.0)))


def correlation(x: ColumnLike, y: ColumnLike, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Pearson correlation of the pairs where both are known; null where one of them does not vary.

    The built-in ``corr`` raises on a constant column in ANSI mode.  ``over`` turns each aggregate into a window column.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = over(F.stddev_pop(x)) * over(F.stddev_pop(y))
    return F.try_divide(over(F.covar_pop(x, y)), F.nullif(spread, F.lit(0.0)))


def clip(x: ColumnLike, lo: float, hi: float) -> Column:
    """x limited to [lo, hi]; null stays null."""
    x = col(x)
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def scrub(x: ColumnLike) -> Column:
    """NaN and infinities become null."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def total(columns: Sequence[ColumnLike]) -> Column:
    """Row-wise sum of several columns."""
    return reduce(add, [col(c) for c in columns])


def mid_price(bid: ColumnLike, ask: ColumnLike) -> Column:
    """Mean of both sides, else the side that is there, else null."""
    bid, ask = col(bid), col(ask)
    return F.coalesce((bid + ask) / 2.0, bid, ask)


def from_ray(x: ColumnLike) -> Column:
    """27-decimal fixed point to a fraction."""
    return col(x).cast("double") / 1e27


def apr_to_apy(apr: ColumnLike, periods: float = 31_536_000) -> Column:
    """Per-second compounding of a yearly rate given as a fraction."""
    return F.pow(1 + col(apr) / periods, F.lit(float(periods))) - 1


# -- buckets ----------------------------------------------------------------------------------------


def bucket(x: ColumnLike, edges: Sequence[float], labels: Sequence[str], right_closed: bool = False) -> Column:
    """Label by ascending breakpoints: ``len(labels) == len(edges) + 1``."""
    x = col(x)
    out = None
    for edge, label in zip(edges, labels):
        hit = x <= edge if right_closed else x < edge
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.when(x.isNotNull(), F.lit(labels[-1]))


def equal_width(x: ColumnLike, lo: ColumnLike | float, hi: ColumnLike | float, n: int) -> Column:
    """Bin 0..n-1 of equal width over [lo, hi]; the top edge belongs to the last bin."""
    x = col(x)
    lo, hi = (F.lit(v) if isinstance(v, (int, float)) else col(v) for v in (lo, hi))
    raw = F.floor(ratio(x - lo, (hi - lo) / float(n)))
    return F.when(x.isNotNull(), F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1)).cast("int"))


def round_down(x: ColumnLike, step: float) -> Column:
    return F.floor(col(x) / step) * step


def cut_points(x: ColumnLike, edges: Column, n: int) -> Column:
    """Bin 0..n-1: how many of the interior edges of the array lie below x."""
    x = col(x)
    return F.least(F.size(F.filter(edges, lambda e: e < x)), F.lit(n - 1))


# -- text, dates, symbols -------------------------------------------------------------------------


def categorize(slug: ColumnLike, patterns: Sequence[tuple[str, str]] = MARKET_PATTERNS) -> Column:
    """Name of the first pattern the text matches, else null."""
    slug = col(slug)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in patterns:
        out = out.when(slug.rlike(pattern), F.lit(name))
    return out


def tag_assets(text: ColumnLike, keywords: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """First asset with a keyword in the text, case-insensitive."""
    text = F.lower(col(text))
    out = None
    for asset, words in keywords.items():
        hit = text.rlike("|".join(words))
        out = F.when(hit, asset) if out is None else out.when(hit, asset)
    return out.otherwise(default)


def option_symbol(symbol: ColumnLike) -> dict[str, Column]:
    """Parts of ``BTC-5FEB24-50000-C``; null where the symbol has not four parts."""
    parts = F.split(col(symbol), "-")
    ok = F.size(parts) == 4
    part = [F.get(parts, F.lit(i)) for i in range(4)]
    side = part[3]
    return {
        "underlying": F.when(ok, part[0]),
        "expiry_str": F.when(ok, part[1]),
        "strike_price": F.when(ok, part[2].try_cast("double")),
        "type": F.when(ok & (side == "C"), "call").when(ok & (side == "P"), "put"),
    }


def expiry_seconds(expiry: ColumnLike, hour_seconds: int = EXPIRY_HOUR_SECONDS) -> Column:
    """Epoch second an expiry such as ``5FEB24`` settles; a far-future mark if it cannot be read."""
    stamp = F.try_to_timestamp(F.initcap(F.regexp_replace(col(expiry), "([A-Z]{3})", "-$1-")), F.lit("d-MMM-yy"))
    return F.coalesce(F.unix_seconds(stamp) + hour_seconds, F.lit(FAR_FUTURE).cast("long"))


def outcome_prices(text: ColumnLike) -> Column:
    """``'["1","0"]'`` to an array of doubles."""
    return F.transform(F.from_json(col(text), "array<string>"), lambda v: v.try_cast("double"))


def epoch_day(seconds: ColumnLike) -> Column:
    return F.floor(col(seconds) / 86400)


def time_features(seconds: ColumnLike) -> dict[str, Column]:
    """Hour, cyclic hour encoding and trading-session flags of an epoch second."""
    hour = F.floor(F.pmod(col(seconds), F.lit(86400)) / 3600)
    angle = hour * (2 * math.pi / 24)

    def within(span):
        return ((hour >= span[0]) & (hour < span[1])).cast("int")

    return {
        "hour": hour,
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "is_us_hours": within(US_HOURS),
        "is_asia_hours": within(ASIA_HOURS),
        "is_europe_hours": within(EUROPE_HOURS),
    }


def select_existing(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep the wanted columns that exist; also return the names that do not."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have]), [c for c in wanted if c not in have]
