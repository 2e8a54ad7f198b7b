"""Distributed exact aggregates against NumPy and pandas."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import aggregates as agg, evaluate as ev, features as feat


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 else f"g{i % 4}", float(rng.randrange(40)), rng.random(), i, rng.randrange(2)) for i in range(900)]
    data.append(("g1", None, None, 900, 0))
    return spark.createDataFrame(data, "g string, x double, y double, id long, o int").cache()


@pytest.mark.parametrize("size", [20, 10**6])
def test_quantiles(table, size):
    got = {r["g"]: r for r in agg.quantiles(table, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 0.9}, rows_per_task=size).collect()}
    pdf = table.toPandas().dropna()
    for g, part in pdf.groupby("g"):
        for name, p in (("a", 0.05), ("b", 0.5), ("c", 0.9)):
            assert math.isclose(got[g][name], np.quantile(part["x"], p), abs_tol=1e-9)


@pytest.mark.parametrize("size", [30, 10**6])
def test_spearman_with_ties(table, size):
    pdf = table.toPandas().dropna()
    want = pdf["x"].rank().corr(pdf["y"].rank())
    assert math.isclose(agg.spearman(table, "x", "y", size).first()["spearman"], want, rel_tol=1e-9)


@pytest.mark.parametrize("size", [30, 10**6])
def test_gini(table, size):
    got = {r["g"]: r["gini"] for r in agg.gini(table, ["g"], "x", size).collect()}
    for g, part in table.toPandas().dropna().groupby("g"):
        x = np.sort(part["x"].to_numpy())
        n = len(x)
        assert math.isclose(got[g], 2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n, rel_tol=1e-9)


@pytest.mark.parametrize("size", [30, 10**6])
def test_dense_rank_percentile(table, size):
    known = table.where("x is not null")
    got = {r["id"]: r["p"] for r in feat.dense_rank_percentile(known, ["g"], "x", "p", size).collect()}
    pdf = known.toPandas()
    want = pdf.groupby("g")["x"].rank("dense") / pdf.groupby("g")["x"].transform("count")
    assert all(math.isclose(got[i], w) for i, w in zip(pdf["id"], want))


@pytest.mark.parametrize("size", [30, 10**6])
def test_deciles_match_ntile(table, size):
    known = table.where("x is not null")
    got = {r["decile"]: r["n"] for r in ev.deciles(known, "x", "o", ["id"], rows_per_task=size).collect()}
    assert got == {i: 90 for i in range(1, 11)}
    odd = {r["decile"]: r["n"] for r in ev.deciles(known.where("id < 897"), "x", "o", ["id"], rows_per_task=size).collect()}
    assert [odd[i] for i in range(1, 11)] == [90] * 7 + [89] * 3


@pytest.mark.parametrize("size", [30, 10**6])
def test_auc_counts_ties_half(table, size):
    known = table.where("x is not null")
    got = ev.areas(ev.score_curve(known, [], "x", "o", size), []).first()["auc"]
    pdf = known.toPandas()
    pos, neg = pdf[pdf["o"] == 1]["x"].to_numpy(), pdf[pdf["o"] == 0]["x"].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert math.isclose(got, want, rel_tol=1e-9)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    assert agg.correlation_pairs(df, ["a", "b"]).first()["corr"] is None


def test_histogram_and_equal_width_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,), (None,)], "p double")
    got = {r["bin"]: r["n"] for r in agg.histogram(df, "p", 0.0, 1.0, 10).collect()}
    assert got == {0: 1, 1: 1, 9: 1}


def test_rolling_time_quantiles(spark):
    rng = random.Random(8)
    data = [("a", t, rng.random()) for t in range(0, 120, 2)]
    df = spark.createDataFrame(data, "k string, t long, v double")
    got = {r["t"]: r["q"] for r in feat.rolling_time_quantiles(df, ["k"], "t", "v", 25, {"q": 0.33}).collect()}
    for _, t, _ in data:
        window = [v for _, u, v in data if t - 24 <= u <= t]
        assert math.isclose(got[t], np.quantile(window, 0.33), abs_tol=1e-12)


def test_moments_in_moving_features(spark):
    pdf = pd.DataFrame({"s": "a", "sec": range(400), "close": np.cumsum(np.random.default_rng(1).normal(size=400)) + 500})
    df = spark.createDataFrame(pdf)
    got = feat.realized_volatility(df, ["s"], ["sec"], windows=(10, 150), rows_per_task=10**6).toPandas().sort_values("sec")
    ret = np.log(pdf["close"]).diff()
    for n in (10, 150):
        want = ret.rolling(n).std() * math.sqrt(31_557_600.0 / n)
        assert np.allclose(got[f"rv_{n}s"].astype(float), want, equal_nan=True, rtol=1e-9)
