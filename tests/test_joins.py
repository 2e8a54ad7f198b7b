"""Joins against brute force, with the size limits turned down so that every path is taken."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    left = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}" if i % 50 else None) for i in range(600)]
    right = [(f"k{i}", i * 1.5) for i in range(30)] + [("hot", -1.0)]
    return spark.createDataFrame(left, "id long, key string"), spark.createDataFrame(right, "key string, v double")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_with_a_hot_key(spark, sides, how):
    left, right = sides
    want = rows(left.join(F.broadcast(right), "key", how))
    assert rows(joins.lookup(left, right, ["key"], how)) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(joins.lookup(left, right, ["key"], how)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        joins.lookup(left, right, ["key"], "full")


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("size", [25, 10**6])
def test_asof_brute_force(spark, direction, size):
    rng = random.Random(9)
    left = [(i, "a" if i % 4 else "b", rng.randrange(500)) for i in range(200)]
    right = [(i, "a" if i % 3 else "b", rng.randrange(500), float(i)) for i in range(120)]
    got = {
        r["id"]: (r["at"], r["v"])
        for r in joins.asof(
            spark.createDataFrame(left, "id long, s string, t long"), spark.createDataFrame(right, "rid long, s string, rt long, v double"),
            on=("t", "rt"), ids=("id", "rid"), by=["s"], take=["v"], direction=direction, tolerance=40, matched_at="at", rows_per_task=size,
        ).collect()
    }
    for ident, s, t in left:
        near = [(rt, rid, v) for rid, rs, rt, v in right if rs == s and abs(rt - t) <= 40]
        behind = max((r for r in near if r[0] <= t), key=lambda r: (r[0], r[1]), default=None)
        ahead = min((r for r in near if r[0] >= t), key=lambda r: (r[0], r[1]), default=None)
        if direction == "backward":
            best = behind
        elif direction == "forward":
            best = ahead
        else:
            best = behind if behind and (not ahead or t - behind[0] <= ahead[0] - t) else ahead
        assert got[ident] == ((best[0], best[2]) if best else (None, None)), (ident, s, t)


@pytest.mark.parametrize("size", [2, 10**6])
def test_asof_ties_by_long_ids(spark, size):
    head = "0x" + "f" * 62
    right = spark.createDataFrame([(head + c, 10, c) for c in "bda"], "rid string, rt long, v string")
    left = spark.createDataFrame([(7, 10), (8, 12), (9, 8)], "id long, t long")
    for direction, want in (("backward", {7: "d", 8: "d", 9: None}), ("forward", {7: "a", 8: None, 9: "a"})):
        out = joins.asof(left, right, on=("t", "rt"), ids=("id", "rid"), take=["v"], direction=direction, rows_per_task=size)
        assert {r["id"]: r["v"] for r in out.collect()} == want


def test_closest_eligible(spark):
    rng = random.Random(4)
    left = [(s, s // 10 * 10 + 10) for s in range(0, 200, 3)]
    right = [(rng.randrange(200), q, rng.random(), rng.randrange(0, 260, 5)) for q in range(400)]
    got = joins.closest_eligible(
        spark.createDataFrame(left, "sec long, close long"), spark.createDataFrame(right, "sec long, qid long, iv double, expiry long"),
        ["sec"], "expiry", "qid", F.col("expiry") > F.col("close"), ["sec", "close"], ["iv", "expiry"],
    )
    want = []
    for sec, close in left:
        fit = sorted((e, q, iv) for s, q, iv, e in right if s == sec and e > close)
        if fit:
            want.append((sec, close, fit[0][2], fit[0][0]))
    assert rows(got) == sorted(want, key=repr)


def test_interval_lookup_with_long_and_missing_periods(spark):
    periods = spark.createDataFrame([(0, 900, "a"), (900, 4000, "b"), (5000, 5100, "c")], "s long, e long, name string")
    points = spark.createDataFrame([(0,), (899,), (900,), (3999,), (4000,), (5099,), (5100,)], "t long")
    got = {r["t"]: r["name"] for r in joins.interval_lookup(points, "t", periods, "s", "e", 900).collect()}
    assert got == {0: "a", 899: "a", 900: "b", 3999: "b", 4000: None, 5099: "c", 5100: None}


def test_gap_check_fails_the_job(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id long, rate double")
    with pytest.raises(Exception, match="no rate"):
        joins.with_gap_check(df, "rate", "no rate").collect()
