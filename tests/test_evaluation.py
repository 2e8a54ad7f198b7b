"""Scores, folds and routing on hand-made rows."""

import ast
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions.pricing import student_p
from tidemark.operators import evaluate as ev, features as feat, learn, quality as q
from tidemark.plans import assurance

D = dt.date


@pytest.fixture(scope="module")
def ten(spark):
    p = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    y = [0, 0, 1, 0, 1, 0, 1, 1, 1, 1]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(p, y))], "id long, p double, y int")


def test_scores(spark, ten):
    r = ev.model_scores(ten.withColumn("q", F.col("y").cast("double")), [], "p", "q", "y").first()
    assert r["brier_model"] == 0 and r["brier_improvement_pct"] == 100 and r["n_samples"] == 10
    assert math.isclose(r["brier_baseline"], sum((a["p"] - a["y"]) ** 2 for a in ten.collect()) / 10)
    assert r["log_loss"] < 1e-12


def test_calibration(ten):
    curve = ev.reliability(ten, [], "p", "y")
    assert {r["bin"]: r["n"] for r in curve.collect()}[9] == 2  # 0.9 and the closed upper edge
    r = ev.calibration_errors(curve, []).first()
    assert 0 <= r["ece"] <= r["mce"] and r["ece"] <= r["rms_calibration_error"] + 1e-12
    assert math.isclose(r["uncertainty"], 0.24)


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(4000).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("x"))
    a = ev.bootstrap(df, [], ["id"], {"x": F.col("x")}).first()
    b = ev.bootstrap(df.repartition(7), [], ["id"], {"x": F.col("x")}).first()
    assert all(math.isclose(u, v, rel_tol=1e-9) for u, v in zip(a, b))  # the same whatever the partitions
    assert a["x_lower"] < a["x_mean"] < a["x_upper"]
    half = 1.96 * 28.87 / math.sqrt(4000)
    assert abs((a["x_upper"] - a["x_lower"]) / 2 - half) < 0.35 * half


def test_poisson_weights(spark):
    w = spark.range(20000).select(ev.poisson_weight(F.col("id") / 20000.0).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(w[0] - 1) < 0.01 and abs(w[1] - 1) < 0.02


def test_smoothing_weights_and_regime_edges(spark):
    df = spark.createDataFrame([(t,) for t in (0, 269, 270, 300, 330, 569, 570, 600, 630, 900)], "t long")
    df = df.withColumns({"a": F.lit(1.0), "b": F.lit(0.0), "c": F.lit(2.0)})
    got = {r["t"]: r["v"] for r in df.select("t", learn.boundary_blend("t", "a", "b", "c").alias("v")).collect()}
    assert got == {0: 1.0, 269: 1.0, 270: 1.0, 300: 0.5, 330: 0.0, 569: 0.0, 570: 0.0, 600: 1.0, 630: 2.0, 900: 2.0}
    edges = {r["t"]: r["r"] for r in df.select("t", feat.temporal_regime("t").alias("r")).collect()}
    assert (edges[269], edges[300], edges[600]) == ("near", "mid", "far")


def test_walk_forward_windows(spark):
    span = spark.createDataFrame([(D(2023, 1, 1), D(2024, 12, 17))], "lo date, hi date")
    rows = learn.walk_forward_windows(span, 6, 2, 3, 2, 3).orderBy("window").collect()
    assert rows[0]["train_end"] == D(2023, 6, 30) and rows[0]["val_start"] == D(2023, 7, 3) and rows[0]["val_end"] == D(2023, 9, 2)
    assert [r["train_end"] for r in rows[:3]] == [D(2023, 6, 30), D(2023, 9, 30), D(2023, 12, 30)]  # a clamped month end stays
    assert all(r["val_end"] < r["holdout_start"] == D(2024, 10, 1) for r in rows)
    assert all((r["val_start"] - r["train_end"]).days == 3 and r["train_start"] == D(2023, 1, 1) for r in rows)


@pytest.mark.parametrize("size", [4, 10**6])
def test_chronological_split(spark, size):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(10)], "k string, t long")
    got = learn.chronological_split(df, ["t"], ["k"], rows_per_task=size).groupBy("k", "split").agg(F.min("t"), F.count("t")).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == {
        ("a", "train"): (0, 16), ("a", "val"): (16, 2), ("a", "test"): (18, 2), ("b", "train"): (0, 8), ("b", "val"): (8, 1), ("b", "test"): (9, 1)}


def test_residual_rows_drop_what_cannot_be_used(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(0.5, 1.0, 1.0), (0.5, None, 1.0), (0.5, 1.0, inf), (0.5, 0.0, nan), (None, 1.0, 2.0)], "p double, y double, x double")
    assert [r["residual"] for r in learn.residual_rows(df, "p", "y", ["x"]).collect()] == [0.5]


def test_routing_leaves_unknown_regimes_unscored(spark):
    df = spark.createDataFrame([("near", float(i), 2.0 * i) for i in range(30)] + [("far", 1.0, 0.0), (None, 1.0, 0.0)], "r string, x double, residual double")
    models = learn.per_regime(df, "r", ["near", "far", "mid"], lambda d: learn.ridge(d, ["x"], reg=0.0), min_rows=5)
    assert list(models) == ["near"]
    out = learn.routed(df, models, "r", ["r", "x"])
    assert out.count() == 32 and out.where("prediction is null").count() == 2
    assert all(math.isclose(r["prediction"], 2 * r["x"], abs_tol=1e-6) for r in out.where("r = 'near'").collect())


def test_quality_reports(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (2, 1.5)], "id long, price double")
    got = {r["check"]: (r["passed"], r["value"]) for r in q.table_checks(df, ["price"], 1, 10, 0.2).collect()}
    assert got["row_count"] == (True, 3.0) and not got["null_rate:price"][0]
    rules = {r["check"]: r["value"] for r in q.trade_rules(df.withColumn("ts", -F.col("id")), "id", ["id", "price"], "ts", "price").collect()}
    assert rules == {"duplicate_hashes": 1.0, "out_of_order": 1.0, "price_out_of_range": 1.0}  # a missing price is counted by the null check
    fold = spark.createDataFrame([("f", "train", 10), ("f", "val", 12), ("g", "train", 10), ("g", "val", 20)], "f string, s string, d long")
    assert {r["check"]: r["passed"] for r in q.leakage(fold, "f", "s", "d", 3).collect()} == {"embargo:f": False, "embargo:g": True}


@pytest.mark.parametrize(("t", "freedom", "p"), [
    (1.0, 1, 0.5), (1.0, 5, 0.36321746764912255), (2.0, 10, 0.07338803477074034), (-3.5, 20, 0.002255123153), (2.0, 30, 0.054625044963),
    (0.1, 1000, 0.920364369024), (0.0, 3, 1.0), (40.0, 5000, 0.0),
])
def test_student_p(spark, t, freedom, p):
    got = spark.range(1).select(student_p(F.lit(t), F.lit(float(freedom))).alias("p")).first()["p"]
    assert abs(got - p) < 1e-7


def test_importances_cover_every_horizon(spark):
    rows = entry.queries()["k13_feature_importance"](spark, "/root/testdata/sf0.01").collect()  # smaller tables have one horizon
    assert {r["feature"] for r in rows} == set(assurance.FEATURES)
    for h in assurance.HORIZONS:
        assert abs(sum(r[h] for r in rows) - 1) < 1e-6


def test_search_tries_a_grid_of_two_parameters(spark, sf):
    rows = [(ast.literal_eval(r["params"]), r["folds"], r["mean_mse"]) for r in entry.queries()["k12_parameter_search"](spark, sf).collect()]
    assert len(rows) == 9 and all(folds == 3 and error > 0 for _, folds, error in rows)
    assert all(len({p[k] for p, _, _ in rows}) == 3 for k in ("trees", "depth"))
