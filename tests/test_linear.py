"""Ridge fits from sufficient statistics against Spark ML, sketches against exact quantiles and joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as feat, learn, linear, quality


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)) * [1.0, 50.0, 0.01] + [0.0, 1000.0, 3.0]
    y = x @ [0.5, -0.02, 4.0] + rng.normal(size=600)
    data = [(i, i // 100, float(a), float(b), float(c), 7.0, float(v)) for i, ((a, b, c), v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, day long, a double, b double, c double, same double, residual double")


@pytest.mark.parametrize("penalty", [0.0, 1.0, 25.0])
def test_weights_equal_spark_ml(rows, penalty):
    features = ["a", "b", "c"]
    model = learn.ridge(rows, features, reg=penalty)
    want = {r["id"]: r["prediction"] for r in model.transform(rows).collect()}
    got = {r["id"]: r["prediction"] for r in learn.ridge_scored(rows, rows, features, reg=penalty).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-8


def test_every_fold_and_left_out_group_equals_its_own_fit(rows):
    features, folds = ["a", "b", "c", "same"], [(1, 2, 3), (3, 4, 5)]
    got = {(r["fold"], r["penalty"], r["dropped"]): r for r in linear.validated(rows, "day", folds, features, "residual", [0.1, 5.0], {"b": ["b", "same"]}).collect()}
    assert len(got) == 8
    for (fold, penalty, dropped), r in got.items():
        last, lo, hi = folds[fold - 1]
        kept = ["a", "b", "c"] if dropped == "none" else ["a", "c"]
        train, val = rows.where(F.col("day") <= last), rows.where(F.col("day").between(lo, hi))
        scored = learn.ridge_scored(train, val, kept, reg=penalty)
        error = scored.agg(F.avg(F.pow(F.col("residual") - F.col("prediction"), F.lit(2)))).first()[0]
        assert (r["n_train"], r["n_val"]) == (100 * (last + 1), 100 * (hi - lo + 1)) and abs(r["mse"] - error) < 1e-9


def test_moments_add_up():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3)) + 1e6
    parts = [linear.Moments(len(p), p.mean(axis=0), (p - p.mean(axis=0)).T @ (p - p.mean(axis=0))) for p in (x[:7], x[7:8], x[8:])]
    total = parts[0] + parts[1] + parts[2] + linear.Moments(0, np.zeros(3), np.zeros((3, 3)))
    assert total.n == 50 and np.allclose(total.cross, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), rtol=1e-7)


def test_a_failed_job_is_named(spark):
    assert learn.concurrently(spark, {"a": lambda: 1, "b": lambda: 2}) == {"a": 1, "b": 2}
    with pytest.raises(RuntimeError, match="bad: division"):
        learn.concurrently(spark, {"good": lambda: 1, "bad": lambda: 1 / 0})


@pytest.mark.parametrize("days", [1, 3, 7])
def test_day_sketches_keep_their_bound(spark, days):
    rng = random.Random(days)
    data = [("a" if i % 3 else "b", rng.choice([5, 6, 7, 8, 11, 12, 20]), rng.gauss(0, 1)) for i in range(6000)] + [("c", 1, None), ("c", 2, 1.0)]
    df = spark.createDataFrame(data, "k string, day long, v double")
    got = feat.rolling_day_quantiles(df, ["k"], F.col("day"), "v", days, {"q": 0.9}, k=200).collect()
    assert {r["day"] for r in got if r["k"] == "a"} == set(range(5, 21))
    for r in got:
        held = [v for k, d, v in data if k == r["k"] and r["day"] - days < d <= r["day"] and v is not None]
        assert r["n"] == len(held) and (r["q"] is None) == (not held)
        if held:
            assert abs(sum(v <= r["q"] for v in held) / len(held) - 0.9) < 0.02 + 1 / len(held)


def test_key_overlaps_without_a_join(spark):
    left, right, none = spark.range(0, 1000), spark.range(500, 3000), spark.range(0)
    got = {(r["left_key"], r["right_key"]): r for r in quality.key_overlaps({"l": (left, "id"), "r": (right, "id"), "n": (none, "id")}, 14).collect()}
    assert len(got) == 6
    assert (got["l", "r"]["left_keys"], got["l", "r"]["right_keys"], got["l", "r"]["matched"], got["l", "r"]["match_rate"]) == (1000, 2500, 500, 0.5)
    assert got["n", "l"]["matched"] == 0 and got["n", "l"]["match_rate"] is None
    many = {(r["left_key"], r["right_key"]): r for r in quality.key_overlaps({"l": (spark.range(0, 200_000), "id"), "r": (spark.range(100_000, 300_000), "id")}, 12).collect()}
    assert abs(many["l", "r"]["matched"] - 100_000) < 300_000 * 2 / 2**6
