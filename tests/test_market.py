"""Grids, books, prices, positions: hand-made rows and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C, pricing
from tidemark.operators import book, features as feat, grid, intervals, options as opt, positions as pos


# -- grids -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [2, 10**6])
def test_fill_limit_is_exact(spark, size):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 10, None), ("a", 12, 2.0), ("b", 5, 7.0)], "k string, sec long, v double")
    got = {(r["k"], r["sec"]): r for r in grid.fill_grid(rows, ["k"], "sec", ["v"], max_gap=4, rows_per_task=size).collect()}
    assert len(got) == 13 + 1
    assert got["a", 4]["v"] == 1.0 and got["a", 5]["v"] is None  # the limit, and one second past it
    assert got["a", 10]["v"] == 1.0 and not got["a", 10]["is_forward_filled"]  # a row without a value keeps the last one
    assert got["a", 11]["seconds_since_last_update"] == 1
    assert got["b", 5]["v"] == 7.0


@pytest.mark.parametrize("size", [2, 10**6])
def test_fixed_calendar_starts_empty_and_runs_to_the_end(spark, size):
    rows = spark.createDataFrame([(20, 1.0), (40, 2.0), (90, 3.0)], "sec long, v double")
    got = [(r["sec"], r["v"]) for r in grid.fill_grid(rows, [], "sec", ["v"], step=10, start=0, end=70, rows_per_task=size).orderBy("sec").collect()]
    assert got == [(0, None), (10, None), (20, 1.0), (30, 1.0), (40, 2.0), (50, 2.0), (60, 2.0)]


def test_long_gap_crosses_generation_chunks(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 200_000, 2.0)], "k string, sec long, v double")
    out = grid.fill_grid(rows, ["k"], "sec", ["v"])
    assert out.count() == 200_001 and out.select("sec").distinct().count() == 200_001


def test_impute_by_gap_chooses_the_method(spark):
    hour, day = 3600, 86400
    known = [0, 1800, 1800 + 2 * day, 1800 + 12 * day, 1800 + 60 * day]
    data = [(t, float(i)) for i, t in enumerate(known)] + [(900, None), (hour, None), (5 * day, None), (30 * day, None)]
    df = spark.createDataFrame([("a", t, v) for t, v in data], "k string, sec long, v double")
    got = {r["sec"]: (r["v_imputed"], r["imputation_method"], r["is_structural_break"]) for r in grid.impute_by_gap(df, ["k"], "sec", "v").collect()}
    assert got[900] == (0.5, "linear", False)
    assert got[hour] == (1.0, "forward", False)
    assert got[5 * day] == (3.0, "backward", False)
    assert got[30 * day] == (None, "none", True)


# -- books -------------------------------------------------------------------------------------------


def changes(n, seed):
    rng = random.Random(seed)
    for seq in range(1, n + 1):
        side = rng.choice(["BUY", "SELL"])
        price = float(rng.randrange(1, 9) + (0 if side == "BUY" else 10))
        yield ("hot" if seq % 3 else "x", seq, rng.random() < 0.02, side, price, float(rng.choice([0, 0, 3, 5, 8])))


@pytest.mark.parametrize("top", [0, 2, 8])
def test_book_replay_equals_levels_kept_by_hand(spark, top):
    data = list(changes(400, 6))
    df = spark.createDataFrame(data, "asset string, seq long, is_snapshot boolean, side string, price double, size double")
    got = {(r["asset"], r["seq"]): tuple(r[c] for c in ("best_bid", "best_ask", "bid_levels", "ask_levels", "bid_volume")) for r in
           book.replay(df, rows_per_task=50 if top < 8 else 10**6, top=top).collect()}
    books = {}
    for asset, seq, reset, side, price, size in data:
        if reset:
            books[asset] = {}
        levels = books.setdefault(asset, {})
        if size:
            levels[side, price] = size
        else:
            levels.pop((side, price), None)
        bids = {p: s for (sd, p), s in levels.items() if sd == "BUY"}
        asks = {p: s for (sd, p), s in levels.items() if sd == "SELL"}
        want = (max(bids, default=None), min(asks, default=None), len(bids), len(asks), float(sum(bids.values())))
        assert tuple(None if isinstance(v, float) and math.isnan(v) else v for v in got[asset, seq]) == want, (asset, seq)
    assert len(got) == len(data)
    final = {(r["asset"], r["side"], r["price"]): r["size"] for r in book.state_at(df, F.lit(True)).collect()}
    assert final == {(a, *k): s for a, levels in books.items() for k, s in levels.items()}


@pytest.mark.parametrize("top", [0, 1, 3, 8])
def test_units_of_an_interval_are_disjoint_and_few(spark, top):
    rng = random.Random(top)
    pairs = [(a, a + rng.choice([0, 1, 3, 17, 300])) for a in (rng.randrange(500) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", intervals.units_of_interval(F.col("a"), F.col("b"), top).alias("units"))
    for row in df.collect():
        held = [p for u in row["units"] for p in range(u["unit"] * 4 ** u["level"], (u["unit"] + 1) * 4 ** u["level"])]
        assert sorted(held) == list(range(row["a"], row["b"]))
        assert len(row["units"]) <= 6 * (top + 1) + (row["b"] - row["a"]) // 4**top
    point = spark.range(1).select(intervals.units_of_point(F.lit(77), top).alias("u")).first()["u"]
    assert [(u["level"], u["unit"]) for u in point] == [(j, 77 // 4**j) for j in range(top + 1)]


# -- prices ------------------------------------------------------------------------------------------


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -7.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.2, 7.2, 9.0, 1e10]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", pricing.norm_cdf("x").alias("c")).collect():
        assert math.isclose(r["c"], 0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-15)


def test_implied_vol_round_trip_and_status(spark):
    data = [(s, k, days, iv, call) for s in (90.0, 100.0, 110.0) for k in (95.0, 105.0) for days in (90.0, 400.0) for iv in (0.3, 0.9) for call in (True, False)]
    df = spark.createDataFrame(data, "spot double, strike double, days double, iv double, call boolean").withColumn("r", F.lit(0.02))
    price = pricing.vanilla_price("spot", "strike", "r", "iv", F.col("days") / 365.25, "call")
    quoted = df.withColumn("bid", price / F.col("spot")).withColumn("ask", F.col("bid"))
    out = feat.with_steps(quoted, pricing.implied_vol_columns("bid", "ask", "spot", "strike", "r", "days", "call")).collect()
    assert all(r["iv_calc_status"] == "success" and math.isclose(r["implied_vol_bid"], r["iv"], rel_tol=1e-5) for r in out)
    bad = spark.createDataFrame([(None, 0.1, 1.0), (0.05, 0.06, 30.0), (0.1, 0.1, 0.0), (1.5, 1.6, 30.0)], "bid double, ask double, days double")
    bad = bad.withColumns({"spot": F.lit(100.0), "strike": F.lit(100.0), "r": F.lit(0.0), "call": F.lit(False)})
    out = feat.with_steps(bad, pricing.implied_vol_columns("bid", "ask", "spot", "strike", "r", "days", "call")).collect()
    assert [r["iv_calc_status"] for r in out] == ["invalid_input", "success", "invalid_input", "failed"]


def test_binary_price_limits(spark):
    df = spark.createDataFrame([(100.0, 100.0, 600), (101.0, 100.0, 0), (99.0, 100.0, 0), (0.0, 100.0, 600)], "S double, K double, left long")
    out = pricing.with_binary_prices(df, "S", "K", F.lit(0.0), "left", {"p": F.lit(0.4)}).orderBy("S").collect()
    assert [round(r["p"], 2) for r in out] == [0.0, 0.0, 0.5, 1.0]


def test_adaptive_volatility_rules(spark):
    df = spark.createDataFrame([(0.55, 5.0, 0.6, 600), (0.5, 10.0, 0.4, 600), (0.5, 60.0, 0.4, 600), (0.5, 1200.0, 0.4, 600), (0.5, 99.0, None, 600)], "iv double, age double, rv double, left long")
    out = df.withColumns(pricing.adaptive_vol("iv", "age", "rv", "rv", "rv", "left")).collect()
    want = [(0.55, "fresh_iv"), (0.8 * 0.5 + 0.2 * 0.4, "blend_moderate"), (0.45, "blend_stale"), (0.1 * 0.5 + 0.9 * 0.4, "rv_dominant"), (0.5, "iv_only_no_rv")]
    assert [(round(r["sigma_adaptive"], 9), r["blend_method"]) for r in out] == [(round(v, 9), m) for v, m in want]


def test_symbols_and_expiries(spark):
    df = spark.createDataFrame([("BTC-5FEB24-50000-C",), ("ETH-29DEC23-1800-P",), ("BTC-PERPETUAL",), ("BTC-99XYZ24-1-C",)], "symbol string")
    out = df.withColumns(C.option_symbol("symbol")).withColumn("at", C.expiry_seconds("expiry_str")).collect()
    assert [(r["strike_price"], r["type"], r["at"]) for r in out] == [
        (50000.0, "call", 1707120000), (1800.0, "put", 1703836800), (None, None, C.FAR_FUTURE), (1.0, "call", C.FAR_FUTURE)]


def test_regime_needs_the_band_to_be_crossed(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.5, 2.05, 2.3, 1.95, 1.7, 0.95, 0.8])], "t long, v double")
    out = feat.hysteresis(df, [], ["t"], "v", F.lit(1.0), F.lit(2.0), 0.1, "regime").orderBy("t").collect()
    assert [r["regime"] for r in out] == [None, "medium", "medium", "high", "high", "medium", "medium", "low"]


def test_term_interpolation_is_linear_in_variance(spark):
    df = spark.createDataFrame([(1, 600, 0.5), (1, 1200, 0.4), (2, 1000, 0.3), (3, 100, 0.2), (3, 200, 0.25)], "k long, t long, v double")
    got = {r["k"]: r["iv_at_target"] for r in opt.term_interpolation(df, "k", "t", "v", 900).collect()}
    a, b = 0.25 * 600, 0.16 * 1200
    assert math.isclose(got[1], math.sqrt((a + (b - a) * 0.5) / 900)) and 2 not in got and got[3] == 0.25


# -- positions ---------------------------------------------------------------------------------------


def test_position_profit_equals_trade_profit(spark):
    rng = random.Random(1)
    data = [(rng.randrange(5), rng.randrange(4), rng.choice(["BUY", "SELL"]), rng.choice(["Up", "Down"]), float(rng.randrange(1, 9)), rng.random(), i) for i in range(300)]
    trades = spark.createDataFrame(data, "trader long, slug long, side string, outcome string, size double, price double, ts long")
    markets = spark.createDataFrame([(i, True, '["1","0"]' if i % 2 else '["0","1"]') for i in range(4)], "slug long, closed boolean, outcome_prices string")
    enriched = pos.trade_result(pos.with_markets(trades, markets))
    p = pos.positions(enriched)
    by_trade, by_position = enriched.agg(F.sum("pnl")).first()[0], p.agg(F.sum("net_pnl")).first()[0]
    assert math.isclose(by_trade, by_position, rel_tol=1e-9)
    small, blocked = (sorted(tuple(r) for r in pos.trader_statistics(p, rows_per_task=n).select("trader", F.round("median_pnl_per_market", 9), "win_rate", "total_trades").collect()) for n in (10**6, 3))
    assert small == blocked


def test_unresolved_market_has_no_profit(spark):
    trades = spark.createDataFrame([(1, 1, "BUY", "Up", 2.0, 0.4, 0), (1, 2, "SELL", "Down", 2.0, 0.4, 0), (1, 9, "BUY", "Up", 1.0, 0.5, 0)], "trader long, slug long, side string, outcome string, size double, price double, ts long")
    markets = spark.createDataFrame([(1, False, '["0","0"]'), (2, True, '["0","1"]')], "slug long, closed boolean, outcome_prices string")
    out = {r["slug"]: (r["pnl"], r["trade_result"]) for r in pos.trade_result(pos.with_markets(trades, markets)).collect()}
    assert out[1] == (None, "unresolved") and out[9] == (None, "unresolved")
    assert math.isclose(out[2][0], -1.2) and out[2][1] == "lost"


@pytest.mark.parametrize("lengths", [(900,), (900, 3600), (3600, 900)])
def test_contracts_of_one_open_time_do_not_mix(spark, lengths):
    """A quarter of an hour that ends above its strike wins, whatever happens to the hour that opens with it."""
    contracts = spark.createDataFrame([(0, n) for n in lengths], "open_time long, close_time long")
    spot = spark.range(0, 3600).select(F.col("id").alias("sec"), F.when(F.col("id") < 900, 100 + F.col("id") / 100).otherwise(50.0).alias("S"))
    iv = spark.createDataFrame([(5, 1, 0.5, 0.6, 9000)], "sec long, qid long, iv_bid double, iv_ask double, expiry long")
    rates = spark.sql("SELECT 0L AS day, 0.01D AS r")
    for length in lengths:
        cells = opt.pricing_grid(contracts, spot, iv, rates, length=3600).where(F.col("close_time") == length)
        row = cells.agg(F.count("*"), F.min("outcome"), F.max("outcome"), F.min("K")).first()
        assert tuple(row) == (length, int(length == 900), int(length == 900), 100.0)
