"""Blocked computation against the plain one-task window, with blocks far shorter than the data."""

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators.series import Moving, Running, Series, lag, rolling, rolling_corr

SIZES = [7, 50, 10_000]


@pytest.fixture(scope="module")
def ticks(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 else f"k{i % 11}"  # one key holds two thirds of the rows
        rows.append((key, rng.randrange(0, 900), i, rng.choice([None, rng.random() * 10]), rng.random()))
    return spark.createDataFrame(rows, "key string, ts long, id long, x double, y double").cache()


def rows_of(df, names):
    return sorted(tuple(r) for r in df.select("id", *names).collect())


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def assert_same(left, right, names):
    a, b = rows_of(left, names), rows_of(right, names)
    assert len(a) == len(b)
    for p, q in zip(a, b):
        assert all(close(x, y) for x, y in zip(p, q)), (p, q)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("keys", [["key"], []])
def test_running(ticks, size, keys):
    got = Series(ticks, keys, ["ts", "id"], size).running(
        n=Running("count"), s=Running("sum", F.col("x")), hi=Running("max", F.col("x")), lo=Running("min", F.col("x")),
        prev=Running("last", F.col("x")), nxt=Running("next", F.col("x")), tot=Running("total", F.col("x")), aft=Running("after", F.col("id")), aftx=Running("after", F.col("x")),
    )
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = ticks.withColumns({
        "n": F.count(F.lit(1)).over(up), "s": F.sum("x").over(up), "hi": F.max("x").over(up), "lo": F.min("x").over(up),
        "prev": F.last("x", True).over(up),
        "nxt": F.first("x", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "tot": F.sum("x").over(Window.partitionBy(*keys)), "aft": F.lead("id").over(w), "aftx": F.lead("x").over(w),
    })
    assert_same(got, want, ["n", "s", "hi", "lo", "prev", "nxt", "tot", "aft", "aftx"])


@pytest.mark.parametrize("size", SIZES)
def test_frames(ticks, size):
    x, y = F.col("x"), F.col("y")
    steps = [
        {"p1": lag("y", 1)},
        {"m5": rolling(F.avg, y, 5), "s3": rolling(F.sum, x, 3, 1), "c9": rolling_corr(y, F.col("p1"), 9),
         "ahead": lambda w: F.lead("y", 2).over(w)},
    ]
    got = Series(ticks, ["key"], ["ts", "id"], size).frames(*steps, before=10, after=2)
    want = Series(ticks, ["key"], ["ts", "id"], 10**9).frames(*steps, before=10, after=2)
    assert_same(got, want, ["p1", "m5", "s3", "c9", "ahead"])


@pytest.mark.parametrize("size", [40, 10_000])
def test_ewm_matches_pandas(ticks, size):
    got = {r["id"]: (r["fast"], r["slow"]) for r in
           Series(ticks, ["key"], ["ts", "id"], size).ewm(fast=("x", 3), slow=("y", 60)).collect()}
    pdf = ticks.toPandas().sort_values(["key", "ts", "id"])
    fast = pdf.groupby("key")["x"].transform(lambda s: s.ewm(span=3, min_periods=1).mean())
    slow = pdf.groupby("key")["y"].transform(lambda s: s.ewm(span=60).mean())
    for ident, f, s in zip(pdf["id"], fast, slow):
        a, b = got[ident]
        assert close(a, None if f != f else f)
        assert abs(b - s) < 1e-9


@pytest.mark.parametrize("size", [30, 10_000])
@pytest.mark.parametrize("n,need", [(7, 7), (5, 2), (20, 1), (1, 1)])
def test_moving_matches_sliding_frames(ticks, size, n, need):
    x, y = F.col("x"), F.col("y")
    kinds = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    fast = {f"{k}_{c}": Moving(k, F.col(c), n, need) for k in kinds for c in ("x", "y")}
    slow = {f"{k}_{c}": rolling(f, F.col(c), n, need) for k, f in kinds.items() for c in ("x", "y")}
    got = Series(ticks, ["key"], ["ts", "id"], size).frames(fast, before=n)
    want = Series(ticks, ["key"], ["ts", "id"], 10**9).frames(slow, before=n)
    assert_same(got, want, list(fast))


@pytest.mark.parametrize("size", [30, 10_000])
@pytest.mark.parametrize("n", [6, 25])
def test_moving_moments_match_sliding_frames(ticks, size, n):
    x, y = F.col("x"), F.col("y")
    base = ticks.withColumn("z", F.when(F.col("ts") % 3 == 0, y).otherwise(0.5))  # runs of a constant
    kinds = {"skew": F.skewness, "kurt": F.kurtosis}
    fast = {f"{k}_{c}": Moving(k, F.col(c), n, 3) for k in kinds for c in ("x", "y", "z")} | {"corr": Moving("corr", x, n, 3, y)}
    slow = {f"{k}_{c}": rolling(f, F.col(c), n, 3) for k, f in kinds.items() for c in ("x", "y", "z")}

    def corr(w):
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(x).over(frame) >= 3, F.corr(x, y).over(frame))

    got = Series(base, ["key"], ["ts", "id"], size).frames(fast, before=n)
    want = Series(base, ["key"], ["ts", "id"], 10**9).frames(slow | {"corr": corr}, before=n)
    for left, right in zip(rows_of(got, list(fast)), rows_of(want, list(fast))):
        assert all((a is None) == (b is None or b != b) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)) for a, b in zip(left, right)), (left, right)


def test_moving_is_chosen_for_long_windows(ticks):
    long = rolling(F.avg, F.col("y"), 300, 1)
    assert isinstance(long, Moving)
    got = Series(ticks, ["key"], ["ts", "id"], 400).frames({"m": long}, before=300)
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(-299, 0)
    assert_same(got, ticks.withColumn("m", F.avg("y").over(w)), ["m"])
