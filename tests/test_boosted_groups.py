"""Boosted trees grow on groups of rows with equal bins, once per depth and fold."""

import math

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import learn


def watched(monkeypatch):
    sizes, fit = [], GBTRegressor.fit

    def told(self, rows, *args):
        sizes.append(rows.count())
        return fit(self, rows, *args)

    monkeypatch.setattr(GBTRegressor, "fit", told)
    return sizes


def test_fit_reads_groups_and_keeps_the_order_of_bins(spark, monkeypatch):
    sizes = watched(monkeypatch)
    df = spark.range(20_000).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") < 5, 1.0).otherwise(0.0).alias("rare"))
    df = df.withColumn("residual", F.col("a") + 100 * F.col("rare"))
    model = learn.boosted(df, ["a", "rare"], trees=5, depth=4)
    assert sizes and sizes[0] <= 7 * 2 * 4
    assert "not in" not in model.stages[-1].toDebugString
    got = {(r["a"], r["rare"]): r["prediction"] for r in model.transform(df).select("a", "rare", "prediction").distinct().collect()}
    assert all(got[a, 0.0] < got[a + 1, 0.0] for a in map(float, range(6))) and got[1.0, 1.0] > 50


def test_search_fits_once_per_depth_and_fold(spark, sf, monkeypatch):
    sizes = watched(monkeypatch)
    assert entry.queries()["k12_parameter_search"](spark, sf).count() == 9 and len(sizes) == 9


def test_search_errors_are_those_of_separate_fits(spark):
    df = spark.range(3000).select((F.col("id") % 10).alias("day"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    df = df.withColumn("residual", F.sin(F.col("a") * 6) + F.col("b")).localCheckpoint()
    found = {r["params"]: r["mean_mse"] for r in learn.search(df, "day", [(5, 6, 9)], [{"trees": t, "depth": 2} for t in (2, 6)], ["a", "b"]).collect()}
    train, val = df.where("day <= 5"), df.where("day > 5")
    bins = learn.bucketed(train, ["a", "b"])
    rows = df.select("day", "a", "b", "residual", learn.part_of(df).alias("_rows"))
    with learn.kept_groups(learn.grouped(rows.where("day <= 5"), bins, "residual", F.col("_rows"))) as groups:
        for t in (2, 6):
            error = learn.mse(learn.boosted_groups(groups, bins, "residual", t, 2).transform(val))
            assert math.isclose(found[str({"trees": t, "depth": 2})], error, rel_tol=1e-9)


def test_thresholds():
    assert learn.thresholds([0.0] * 9990 + [1.0] * 6 + [2.0] * 4) == [0.5, 1.5]
    even = learn.thresholds([float(i) for i in range(3200)])
    assert len(even) == 31 and all(90 <= b - a <= 110 for a, b in zip(even, even[1:]))
    assert len(learn.thresholds([0.0] * 9000 + [float(i) for i in range(1000)])) == 31 and learn.thresholds([3.0, 3.0]) == []
