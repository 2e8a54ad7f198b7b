"""Learning jobs, data-quality jobs and the user-function surface."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.functions import columns as C, pricing
from tidemark.functions.register import normal_cdf_batch, register_functions
from tidemark.operators import aggregates as agg, features as feat, learn, linear, options as opt, quality as q
from tidemark.plans.market import BIN, GREEK, binary_inputs, greeks
from tidemark.plans.registry import query
from tidemark.plans.standins import (
    DAY, FORECASTS, OPTIONS, QUOTES, TICKS, TRADES, forecasts, options, quotes, r, rounded, table, ticks, trades, with_,
)
from tidemark.plans.windows import SYMBOLS, cdf_sql, symbols
from tidemark.session import cut_lineage, scratch
from tidemark.sources import files

FEATURES = ["value", "moneyness", "vol", "staleness"]
HORIZONS = ["near", "mid", "far"]


def training(spark, sf):
    f = forecasts(spark, sf).withColumn("horizon", feat.temporal_regime("time_left"))
    return learn.residual_rows(f, "p", "y", FEATURES).withColumn("day", C.epoch_day("sec"))


def halves(df):
    """Training and test part by time."""
    split = learn.chronological_split(df, ["ts_us", "id"])
    return split.where("split = 'train'"), split.where("split != 'train'")


# == K: learning =====================================================================================


@query("k01_standard_scaling", with_(FORECASTS) + "SELECT id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 7) AS value_scaled, round((vol - avg(vol) OVER ()) / stddev_samp(vol) OVER (), 7) AS vol_scaled FROM fc")
def scaling(spark, sf):
    return rounded(learn.scaled(forecasts(spark, sf), ["value", "vol"]).select("id", "value_scaled", "vol_scaled"), 7)


@query("k01_standard_scaler_model", with_(FORECASTS) + "SELECT id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 7) AS value_scaled, round((vol - avg(vol) OVER ()) / stddev_samp(vol) OVER (), 7) AS vol_scaled FROM fc")
def scaler_model(spark, sf):
    out = learn.centred(training(spark, sf), ["value", "vol"])
    return rounded(out.select("id", "value_scaled", "vol_scaled"), 7)


@query("k02_residual_target", with_(FORECASTS) + "SELECT id, round(y - p, 9) AS residual FROM fc WHERE k % 8 <> 0")
def residual_target(spark, sf):
    f = forecasts(spark, sf)
    hole = F.when(F.col("k") % 8 != 0, F.col("value")).otherwise(float("nan"))
    return learn.residual_rows(f.withColumn("value", hole), "p", "y", FEATURES).select("id", r("residual", 9).alias("residual"))


CV = "d AS (SELECT *, sec // 86400 AS day FROM fc), sp AS (SELECT min(day) AS lo, max(day) AS hi FROM d), f AS (SELECT i, lo + (hi - lo) * i // 4 AS te, lo + (hi - lo) * (i + 1) // 4 AS ve FROM sp, (SELECT unnest([1, 2, 3]) AS i))"


def cv_folds(df):
    """Three expanding folds by day, the last one to the end."""
    lo, hi = df.agg(F.min("day"), F.max("day")).first()
    return [(lo + (hi - lo) * i // 4, lo + (hi - lo) * i // 4 + 1, lo + (hi - lo) * (i + 1) // 4) for i in (1, 2, 3)]


RESIDUALS = FORECASTS + ", z AS (SELECT *, y - p AS residual, sec // 86400 AS day FROM fc), o AS (SELECT *, row_number() OVER (ORDER BY ts_us, id) - 1 AS i, count(*) OVER () AS n FROM z)"


def predicted_sql(features):
    return "b + " + " + ".join(f"w{i} * {f}" for i, f in enumerate(features))


@query(
    "k03_ridge_residual_model",
    with_(RESIDUALS, "tr AS (SELECT * FROM o WHERE i < floor(n * 0.8e0))", linear.ridge_sql("tr", FEATURES, "residual", "1.0e0")) + f"SELECT id, residual, round({predicted_sql(FEATURES)}, 6) AS prediction FROM o, fit WHERE i >= floor(n * 0.8e0)",
)
def ridge(spark, sf):
    train, test = halves(training(spark, sf))
    return learn.ridge_scored(train, test, FEATURES).select("id", "residual", r("prediction").alias("prediction"))


FOLD_ROWS = "fr AS (SELECT z.*, f.i AS fold, te, ve FROM z JOIN f ON day <= ve)"


@query(
    "k03_ridge_time_series_cv",
    with_(RESIDUALS, CV, FOLD_ROWS, "tr AS (SELECT * FROM fr WHERE day <= te)", linear.ridge_sql("tr", FEATURES, "residual", "10.0e0", keys=["fold"]))
    + f"""SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (day <= te) AS n_train, count(*) FILTER (day > te) AS n_val, round(avg((residual - ({predicted_sql(FEATURES)})) ** 2) FILTER (day > te), 9) AS mse,
    round(avg(residual ** 2) FILTER (day > te), 8) AS mse_zero FROM fr JOIN fit USING (fold) GROUP BY fold""",
)
def ridge_cv(spark, sf):
    df = training(spark, sf)
    out = learn.time_series_cv(df, "day", cv_folds(df), FEATURES, reg=10.0)
    return out.select("fold", "n_train", "n_val", r("mse", 9).alias("mse"), r("mse_zero", 8).alias("mse_zero"))


REGIMES = [f"{h}_{v}_{m}" for h in HORIZONS for v in ("low_vol", "high_vol") for m in ("atm", "otm")]
REGIME_SQL = "CASE WHEN time_left < 300 THEN 'near' WHEN time_left < 600 THEN 'mid' ELSE 'far' END || CASE WHEN vol <= 0.5e0 THEN '_low_vol' ELSE '_high_vol' END || CASE WHEN abs(moneyness) < 0.05 THEN '_atm' ELSE '_otm' END"


def by_regime(df):
    return df.withColumn("regime", F.concat_ws("_", "horizon", F.when(F.col("vol") <= 0.5, "low_vol").otherwise("high_vol"), F.when(F.abs("moneyness") < 0.05, "atm").otherwise("otm")))


@query(
    "k04_boosted_residual_models",
    with_(FORECASTS) + f", o AS (SELECT *, row_number() OVER (ORDER BY ts_us, id) - 1 AS i, count(*) OVER () AS n, {REGIME_SQL} AS regime FROM fc) SELECT regime, count(*) AS n, round(avg((p - y) ** 2), 8) AS brier_baseline, count(*) AS scored, true AS in_range FROM o WHERE i >= floor(n * 0.8e0) GROUP BY 1",
)
def boosted(spark, sf):
    """One boosted model for each of twelve regimes, horizon by volatility by moneyness."""
    train, test = (cut_lineage(by_regime(part)) for part in halves(training(spark, sf)))
    models = learn.per_regime(train, "regime", REGIMES, lambda d: learn.boosted(d, FEATURES, trees=10))
    scored = learn.routed(test, models, "regime", ["id", "regime", "p", "y"])
    p, q = F.col("p") - F.col("y"), learn.final_probability("p", "prediction")
    return scored.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(p * p), 8).alias("brier_baseline"), F.count("prediction").alias("scored"),
        (F.min(q) >= 0).__and__(F.max(q) <= 1).alias("in_range"))


ORDER_SPAN = "sp AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders)"
WINDOWS = ORDER_SPAN + """, hold AS (SELECT lo, hi, CAST(date_trunc('month', hi) - INTERVAL 2 MONTH AS DATE) AS h FROM sp),
wf(i, te) AS (SELECT 1, CAST(lo + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) FROM sp UNION ALL SELECT i + 1, CAST(te + INTERVAL 6 MONTH AS DATE) FROM wf WHERE i < 40),
wins AS (SELECT i, lo, te, te + 4 AS vs, CAST(te + 4 + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ve, h FROM wf, hold WHERE CAST(te + 4 + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) < h)"""


@query(
    "k05_walk_forward_windows",
    "WITH RECURSIVE " + WINDOWS + """SELECT CAST(i AS INTEGER) AS "window", strftime(lo, '%Y-%m-%d') AS train_start, strftime(te, '%Y-%m-%d') AS train_end, strftime(vs, '%Y-%m-%d') AS val_start, strftime(ve, '%Y-%m-%d') AS val_end, strftime(h, '%Y-%m-%d') AS holdout_start,
    (SELECT count(*) FROM orders WHERE o_orderdate >= lo AND o_orderdate <= te) AS n_train, (SELECT count(*) FROM orders WHERE o_orderdate >= vs AND o_orderdate <= ve) AS n_val,
    (SELECT count(*) FROM orders WHERE o_orderdate >= lo AND o_orderdate <= te) < 3000 OR (SELECT count(*) FROM orders WHERE o_orderdate >= vs AND o_orderdate <= ve) < 100 AS skipped FROM wins""",
)
def walk_forward(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    span = o.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    windows = learn.walk_forward_windows(span, 12, 3, 6, 3, 3)
    out = learn.fold_sizes(o, "day", windows, 3000, 100)
    return out.withColumns({c: F.col(c).cast("string") for c in ("train_start", "train_end", "val_start", "val_end", "holdout_start")})


FOLDS = [("f1", "1995-01-01", "1996-12-31", "1997-01-01", "1997-06-30"), ("f2", "1995-01-01", "1997-12-31", "1998-01-01", "1998-06-30"), ("f3", "1995-01-01", "1998-12-31", "1999-01-01", "1999-12-31")]


@query("k06_fixed_folds", " UNION ALL ".join(
    f"SELECT '{n}' AS fold, count(*) FILTER (o_orderdate <= DATE '{te}') AS n_train, count(*) FILTER (o_orderdate BETWEEN DATE '{vs}' AND DATE '{ve}') AS n_val, false AS skipped FROM orders" for n, ts, te, vs, ve in FOLDS))
def fixed_folds(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return learn.fold_sizes(o, "day", learn.fixed_folds(spark, FOLDS), 1, 1).select("fold", "n_train", "n_val", "skipped")


@query(
    "k07_chronological_split",
    with_(FORECASTS) + "SELECT id, model, CASE WHEN i < floor(n * 0.8e0) THEN 'train' WHEN i < floor(n * 0.9e0) THEN 'val' ELSE 'test' END AS split FROM (SELECT id, model, row_number() OVER (PARTITION BY model ORDER BY ts_us, id) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM fc)",
)
def split(spark, sf):
    return learn.chronological_split(forecasts(spark, sf), ["ts_us", "id"], ["model"]).select("id", "model", "split")


HORIZON = "CASE WHEN time_left < 300 THEN 'near' WHEN time_left < 600 THEN 'mid' ELSE 'far' END"


@query("k08_stratify_by_regime", with_(FORECASTS) + f"SELECT {HORIZON} AS horizon, CASE WHEN vol <= 0.5e0 THEN 'low_vol' ELSE 'high_vol' END AS regime, count(*) AS n, round(sum(p), 6) AS p_sum FROM fc GROUP BY 1, 2")
def stratify(spark, sf):
    path = scratch(spark, "strata")
    f = forecasts(spark, sf).select("id", "p", feat.temporal_regime("time_left").alias("horizon"), F.when(F.col("vol") <= 0.5, "low_vol").otherwise("high_vol").alias("regime"))
    files.write_parquet(f, path, ["horizon", "regime"])
    return files.read_table(spark, path).groupBy("horizon", "regime").agg(F.count(F.lit(1)).alias("n"), r(F.sum("p")).alias("p_sum"))


@query("k09_routed_scoring", with_(FORECASTS) + f", o AS (SELECT *, row_number() OVER (ORDER BY ts_us, id) - 1 AS i, count(*) OVER () AS n FROM fc) SELECT {HORIZON} AS horizon, count(*) AS n, count(*) FILTER (time_left < 600) AS scored FROM o WHERE i >= floor(n * 0.8e0) GROUP BY 1")
def routed(spark, sf):
    train, test = halves(training(spark, sf))
    models = learn.per_regime(train, "horizon", ["near", "mid"], lambda d: learn.ridge(d, FEATURES))
    out = learn.routed(test, models, "horizon", ["id", "horizon"])
    return out.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("scored"))


@query(
    "k10_boundary_smoothing",
    with_(FORECASTS) + """SELECT id, time_left, round(CASE WHEN time_left >= 270 AND time_left < 330 THEN (1 - (time_left - 270) / 60.0e0) * p + (time_left - 270) / 60.0e0 * q WHEN time_left >= 570 AND time_left < 630 THEN (1 - (time_left - 570) / 60.0e0) * q + (time_left - 570) / 60.0e0 * vol
    WHEN time_left < 300 THEN p WHEN time_left < 600 THEN q ELSE vol END, 10) AS prediction FROM fc""",
)
def smoothing(spark, sf):
    return forecasts(spark, sf).select("id", "time_left", r(learn.boundary_blend("time_left", "p", "q", "vol"), 10).alias("prediction"))


@query("k11_final_probability", with_(FORECASTS) + "SELECT id, round(greatest(0.0e0, least(1.0e0, p + (value - 50) / 100)), 9) AS prob FROM fc")
def final_probability(spark, sf):
    f = forecasts(spark, sf).withColumn("residual_pred", (F.col("value") - 50) / 100)
    return f.select("id", r(learn.final_probability("p", "residual_pred"), 9).alias("prob"))


SEARCH_GRID = [{"trees": trees, "depth": depth} for trees in (5, 10, 20) for depth in (2, 3, 4)]


@query("k12_parameter_search")
def search(spark, sf):
    df = training(spark, sf)
    return learn.search(df, "day", cv_folds(df), SEARCH_GRID, FEATURES)


@query("k13_feature_importance")
def importance(spark, sf):
    models = learn.per_regime(training(spark, sf), "horizon", HORIZONS, lambda d: learn.boosted(d, FEATURES))
    rows = learn.importances(spark, models, FEATURES)
    top = rows.groupBy("feature").agg(F.max_by("model", F.struct("importance", "model")).alias("top_model"))
    spread = agg.gini(rows, ["feature"], "importance")
    wide = rows.groupBy("feature").pivot("model", HORIZONS).agg(F.first("importance"))
    return wide.join(top, "feature").join(spread, "feature")


DROPPED = {"price": ["value", "moneyness"], "quote": ["staleness"]}


def ablation_sql():
    parts = {"none": FEATURES, **{name: [f for f in FEATURES if f not in dropped] for name, dropped in DROPPED.items()}}
    fits = [linear.ridge_sql("tr", kept, "residual", "1.0e0", f"fit_{name}") for name, kept in parts.items()]
    errors = " UNION ALL ".join(f"SELECT '{name}' AS dropped, avg((residual - ({predicted_sql(kept)})) ** 2) AS mse FROM te, fit_{name}" for name, kept in parts.items())
    return [*fits, f"er AS ({errors})"]


@query(
    "k14_feature_ablation",
    with_(RESIDUALS, "tr AS (SELECT * FROM o WHERE i < floor(n * 0.8e0))", "te AS (SELECT * FROM o WHERE i >= floor(n * 0.8e0))", *ablation_sql())
    + "SELECT dropped, round(mse - (SELECT mse FROM er WHERE dropped = 'none'), 9) AS delta, round(mse, 9) AS mse FROM er",
)
def ablation(spark, sf):
    """What leaving out a feature group costs; every model from one aggregate per part."""
    split = learn.chronological_split(training(spark, sf), ["ts_us", "id"])
    part = split.withColumn("part", F.when(F.col("split") == "train", 0).otherwise(1))
    return rounded(learn.ablation(part, "part", FEATURES, DROPPED), 9)


PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)


@query(
    "k12_ridge_search",
    with_(RESIDUALS, CV, FOLD_ROWS, f"h AS (SELECT *, {HORIZON} AS horizon FROM fr), pen AS (SELECT unnest([{', '.join(f'{x}e0' for x in PENALTIES)}]) AS penalty), hp AS (SELECT * FROM h, pen), tr AS (SELECT * FROM hp WHERE day <= te)",
          linear.ridge_sql("tr", FEATURES, "residual", "any_value(penalty)", keys=["horizon", "penalty", "fold"]))
    + f""", er AS (SELECT horizon, penalty, fold, avg((residual - ({predicted_sql(FEATURES)})) ** 2) AS mse FROM hp JOIN fit USING (horizon, penalty, fold) WHERE day > te GROUP BY ALL)
    SELECT horizon, penalty, count(*) AS folds, round(avg(mse), 8) AS mean_mse FROM er GROUP BY 1, 2""",
)
def ridge_search(spark, sf):
    """Five penalties over three folds and three horizons, from one pass over the table."""
    df = training(spark, sf)
    out = learn.ridge_search(df, "day", cv_folds(df), FEATURES, PENALTIES, by="horizon")
    return out.select("horizon", "penalty", "folds", r("mean_mse", 8).alias("mean_mse"))


@query(
    "k15_prune_suggestions",
    with_(FORECASTS) + """, c AS (SELECT 'value' AS l, 'moneyness' AS r, corr(value, moneyness) AS c FROM fc UNION ALL SELECT 'p', 'q', corr(p, q) FROM fc UNION ALL SELECT 'p', 'k', corr(p, k) FROM fc UNION ALL SELECT 'q', 'k', corr(q, k) FROM fc),
    w AS (SELECT unnest(['value', 'moneyness', 'p', 'q', 'k', 'vol']) AS f, unnest([6, 5, 4, 3, 2, 1]) AS i)
    SELECT CASE WHEN a.i < b.i THEN l ELSE r END AS "drop", count(*) AS pairs, round(max(abs(c)), 7) AS max_corr FROM c JOIN w a ON a.f = l JOIN w b ON b.f = r WHERE abs(c) > 0.9e0 GROUP BY 1""",
)
def prune(spark, sf):
    names = ["value", "moneyness", "p", "q", "k", "vol"]
    pairs = agg.correlation_pairs(forecasts(spark, sf), names)
    weights = spark.createDataFrame([(n, float(6 - i)) for i, n in enumerate(names)], "feature string, importance double")
    return rounded(learn.prune_suggestions(pairs, weights), 7)


@query("k16_clusters")
def clusters(spark, sf):
    return learn.clusters(training(spark, sf), ["value", "vol", "p"], 4, ["y"])


@query("k16_cluster_check", with_(FORECASTS) + "SELECT CAST(4 AS BIGINT) AS clusters, count(*) AS rows, round(avg(value), 7) AS mean_value, round(avg(vol), 7) AS mean_vol, round(avg(p), 7) AS mean_p, round(avg(y), 7) AS mean_y, true AS separated FROM fc")
def cluster_check(spark, sf):
    return rounded(learn.cluster_check(training(spark, sf), ["value", "vol", "p"], 4, ["y"]), 7)


@query("k17_fold_metric_rollup", with_(FORECASTS) + "SELECT model, count(*) AS folds, round(avg(b), 8) AS mean_brier, round(stddev_samp(b), 8) AS std_brier, round(min(b), 8) AS min_brier, round(max(b), 8) AS max_brier, round(avg(CAST(b < 0.17e0 AS INTEGER)), 8) AS share_good FROM (SELECT model, sec // 604800 AS w, avg((p - y) ** 2) AS b FROM fc GROUP BY 1, 2) GROUP BY 1")
def fold_rollup(spark, sf):
    err = F.col("p") - F.col("y")
    folds = forecasts(spark, sf).groupBy("model", F.floor(F.col("sec") / 604800).alias("w")).agg(F.avg(err * err).alias("b"))
    out = folds.groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("b").alias("mean_brier"), F.stddev_samp("b").alias("std_brier"), F.min("b").alias("min_brier"),
        F.max("b").alias("max_brier"), F.avg((F.col("b") < 0.17).cast("double")).alias("share_good"))
    return rounded(out, 8)


# == N: data quality =================================================================================


def check_sql(name, value, ok, expected, source):
    return f"SELECT '{name}' AS \"check\", {ok} AS passed, CAST({value} AS DOUBLE) AS value, '{expected}' AS expected FROM {source}"


@query(
    "n01_table_checks",
    with_(QUOTES) + ", a AS (SELECT count(*) AS n, (count(*) - count(bid)) / count(*) AS nb, (count(*) - count(ask)) / count(*) AS na, count(*) FILTER (isnan(bid) OR isinf(bid)) AS fb, count(*) FILTER (isnan(ask) OR isinf(ask)) AS fa, max(len(json_keys(to_json(quotes)))) AS c FROM quotes) " + " UNION ALL ".join([
        check_sql("row_count", "n", "n BETWEEN 1000 AND 10000000", "1000 .. 1e+07", "a"), check_sql("column_count", "c", "c >= 2", "2 .. ", "a"), check_sql("duplicate_columns", "0", "true", "= 0", "a"),
        check_sql("null_rate:bid", "round(nb, 9)", "nb <= 0.08", "0 .. 0.08", "a"), check_sql("not_finite:bid", "fb", "fb = 0", "= 0", "a"),
        check_sql("null_rate:ask", "round(na, 9)", "na <= 0.08", "0 .. 0.08", "a"), check_sql("not_finite:ask", "fa", "fa = 0", "= 0", "a")]),
)
def table_checks(spark, sf):
    return rounded(q.table_checks(quotes(spark, sf), ["bid", "ask"], 1000, 10_000_000, 0.08), 9)


COV = TICKS + ", a AS (SELECT count(DISTINCT sec // 3600) AS c, max(sec // 3600) - min(sec // 3600) + 1 AS e FROM ticks)"


@query(
    "n02_time_coverage",
    with_(COV) + " UNION ALL ".join([check_sql("steps_seen", "c", "c >= 1", "1 .. ", "a"), check_sql("steps_expected", "e", "e >= 1", "1 .. ", "a"), check_sql("coverage_pct", "round(c * 100.0e0 / e, 6)", "c * 100.0e0 / e >= 99", "99 .. 100", "a")]),
)
def time_coverage(spark, sf):
    return rounded(q.time_coverage(ticks(spark, sf), "sec", 3600, 99.0))


@query(
    "n02_table_overlap",
    "WITH a AS (SELECT epoch(least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)))::BIGINT - epoch(greatest((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)))::BIGINT AS v) " + check_sql("overlap_seconds", "v", "v >= 1", "1 .. ", "a"),
)
def table_overlap(spark, sf):
    return q.overlap({
        "orders": table(spark, sf, "orders").select(F.unix_seconds("o_orderdate").alias("sec")), "lines": table(spark, sf, "lineitem").select(F.unix_seconds("l_shipdate").alias("sec")),
    }, "sec")


@query(
    "n03_join_match_rate",
    "WITH a AS (SELECT count(*) AS n, sum(CASE WHEN l_shipdate IN (SELECT o_orderdate FROM orders) THEN 1 ELSE 0 END) AS h FROM lineitem) " + " UNION ALL ".join([check_sql("left_rows", "n", "n >= 1", "1 .. ", "a"), check_sql("match_pct", "round(h * 100.0e0 / n, 6)", "h * 100.0e0 / n >= 95", "95 .. 100", "a")]),
)
def join_match(spark, sf):
    left = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("t"))
    right = table(spark, sf, "orders").select(F.col("o_orderdate").alias("t"))
    return rounded(q.match_rate(left, right, ["t"], 95.0))


KEY_COLUMNS = {"l_orderkey": "lineitem", "o_orderkey": "orders", "o_custkey": "orders", "c_custkey": "customer", "l_partkey": "lineitem", "p_partkey": "part", "l_suppkey": "lineitem", "s_suppkey": "supplier", "c_nationkey": "customer", "n_nationkey": "nation"}


@query(
    "n03_key_overlap_sketches",
    "WITH k AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS name, {c}::BIGINT AS k FROM {t} WHERE {c} IS NOT NULL" for c, t in KEY_COLUMNS.items()) + """), n AS (SELECT name, count(*) AS n FROM k GROUP BY 1),
    b AS (SELECT l.name AS lname, r.name AS rname, count(*) AS both_ FROM k l JOIN k r ON l.k = r.k AND l.name <> r.name GROUP BY 1, 2)
    SELECT l.name AS left_key, r.name AS right_key, l.n AS left_keys, r.n AS right_keys, coalesce(both_, 0) AS matched, round(coalesce(both_, 0)::DOUBLE / l.n, 8) AS match_rate FROM n l JOIN n r ON l.name <> r.name LEFT JOIN b ON lname = l.name AND rname = r.name""",
)
def key_overlaps(spark, sf):
    """All ordered pairs of ten key columns, from sketches up to 262,144 distinct keys, from the distinct keys beyond; always exact."""
    out = q.key_overlaps({c: (table(spark, sf, t, c), c) for c, t in KEY_COLUMNS.items()}, lg_entries=18)
    return rounded(out, 8)


@query(
    "n04_trade_rules",
    with_(TRADES) + ", a AS (SELECT count(*) - count(DISTINCT tx) AS d FROM trades), b AS (SELECT count(*) FILTER (ts < prev) AS o FROM (SELECT ts, lag(ts) OVER (ORDER BY l_orderkey, l_linenumber, slug, l_extendedprice) AS prev FROM trades)) " + " UNION ALL ".join([check_sql("duplicate_hashes", "d", "d = 0", "= 0", "a"), check_sql("out_of_order", "o", "o = 0", "= 0", "b"), check_sql("price_out_of_range", "0", "true", "= 0", "a")]),
)
def trade_rules(spark, sf):
    return q.trade_rules(trades(spark, sf), "tx", ["l_orderkey", "l_linenumber", "slug", "l_extendedprice"], "ts", "price")


@query(
    "n05_rate_rules",
    with_(TICKS) + ", d AS (SELECT sec // 86400 AS day, avg(price) FILTER (symbol = 'view') AS supply, avg(price) FILTER (symbol = 'click') AS borrow, avg(k) AS u FROM ticks GROUP BY 1), l AS (SELECT *, lag(day) OVER (ORDER BY day) AS pd, lag(supply) OVER (ORDER BY day) AS ps FROM d), a AS (SELECT coalesce(sum(day - pd - 1), 0) AS m, count(*) FILTER (supply / ps - 1 > 1 OR supply / ps - 1 < -0.5) AS j, count(*) FILTER (borrow < supply) AS b FROM l) " + " UNION ALL ".join([check_sql("missing_days", "m", "m = 0", "= 0", "a"), check_sql("jumps", "j", "j = 0", "= 0", "a"), check_sql("utilisation_out_of_range", "0", "true", "= 0", "a"), check_sql("borrow_below_supply", "b", "b = 0", "= 0", "a")]),
)
def rate_rules(spark, sf):
    p = F.col("price")
    daily = ticks(spark, sf).groupBy(C.epoch_day("sec").alias("day")).agg(
        F.avg(F.when(F.col("symbol") == "view", p)).alias("supply"), F.avg(F.when(F.col("symbol") == "click", p)).alias("borrow"), F.avg("k").alias("u"))
    return q.rate_rules(daily, "day", "supply", "borrow", "u")


@query(
    "n06_filter_rules",
    with_(OPTIONS) + ", a AS (SELECT count(*) AS n FROM options WHERE strike > 0 AND (bid IS NOT NULL OR ask IS NOT NULL) AND spot / strike BETWEEN 1.0e0 - 0.03e0 AND 1.0e0 + 0.03e0 AND expiry > sec AND expiry - sec <= 30 * 86400) " + " UNION ALL ".join([check_sql("rows", "n", "n >= 1", "1 .. ", "a"), check_sql("moneyness_outside", "0", "true", "= 0", "a"), check_sql("ttl_outside", "0", "true", "= 0", "a")]),
)
def filter_rules(spark, sf):
    return q.filter_rules(opt.atm_filter(options(spark, sf), max_ttl=30 * DAY), opt.ATM_BAND, 30 * DAY)


@query(
    "n07_greek_bounds",
    with_(TICKS, GREEK) + ", a AS (SELECT count(*) FILTER (delta < 0 OR delta > 1) AS d, count(*) FILTER (vega < -1 OR vega > 1) AS v FROM gv) " + " UNION ALL ".join([check_sql("bounds:delta", "d", "d = 0", "= 0", "a"), check_sql("bounds:vega", "v", "v = 0", "= 0", "a"), check_sql("recompute:d2", "0", "true", "0 .. 1e-06", "a")]),
)
def greek_bounds(spark, sf):
    g = greeks(spark, sf)
    scale = F.col("sigma_mid") * F.sqrt(F.col("T_years") + pricing.EPSILON)
    return rounded(q.bounds_and_recompute(g, {"delta": (0.0, 1.0), "vega": (-1.0, 1.0)}, {"d2": F.col("d1") - scale}, 1e-6))


@query(
    "n08_regime_samples",
    with_(FORECASTS) + ", e AS (SELECT unnest(['near', 'mid', 'far', 'expired']) AS horizon), c AS (SELECT CASE WHEN time_left < 300 THEN 'near' WHEN time_left < 600 THEN 'mid' ELSE 'far' END AS horizon, count(*) AS n FROM fc GROUP BY 1) SELECT concat('regime:', horizon) AS \"check\", coalesce(n, 0) >= 500 AS passed, CAST(coalesce(n, 0) AS DOUBLE) AS value, '500 .. ' AS expected FROM e LEFT JOIN c USING (horizon)",
)
def regime_samples(spark, sf):
    f = forecasts(spark, sf).withColumn("horizon", feat.temporal_regime("time_left"))
    return q.regime_samples(f, "horizon", [*HORIZONS, "expired"], 500)


@query(
    "n09_leakage",
    with_(FORECASTS) + ", s AS (SELECT model, sec // 86400 AS day, CASE WHEN sec // 86400 < 19740 THEN 'train' WHEN sec // 86400 >= 19742 + length(model) % 2 THEN 'val' END AS split FROM fc) SELECT concat('embargo:', model) AS \"check\", min(day) FILTER (split = 'val') - max(day) FILTER (split = 'train') - 1 >= 3 AS passed, CAST(min(day) FILTER (split = 'val') - max(day) FILTER (split = 'train') - 1 AS DOUBLE) AS value, '3 .. ' AS expected FROM s GROUP BY model",
)
def leakage(spark, sf):
    day = C.epoch_day("sec")
    s = forecasts(spark, sf).select("model", day.alias("day"), F.when(day < 19740, "train").when(day >= 19742 + F.length("model") % 2, "val").alias("split"))
    return q.leakage(s, "model", "split", "day", 3)


@query(
    "n10_leaderboard_rules",
    "WITH a AS (SELECT count(*) AS n, count(*) - count(DISTINCT c_custkey) AS d, count(*) FILTER (c_name IS NULL) AS m, count(*) FILTER (c_acctbal < -1000 OR c_acctbal > 10000) AS o FROM customer) " + " UNION ALL ".join([check_sql("rows", "n", "n >= 10", "10 .. ", "a"), check_sql("duplicate_users", "d", "d = 0", "= 0", "a"), check_sql("missing_names", "m", "m = 0", "= 0", "a"), check_sql("pnl_out_of_range", "o", "o = 0", "= 0", "a")]),
)
def leaderboard_rules(spark, sf):
    return q.report(table(spark, sf, "customer"), {
        "rows": q.Check(F.count(F.lit(1)), 10), "duplicate_users": q.Check(F.count(F.lit(1)) - F.countDistinct("c_custkey"), 0, 0),
        "missing_names": q.Check(q.count_of(F.col("c_name").isNull()), 0, 0), "pnl_out_of_range": q.Check(q.count_of(~F.col("c_acctbal").between(-1000, 10000)), 0, 0)})


@query(
    "n11_update_pattern",
    with_(TICKS) + ", v AS (SELECT symbol, ts_us, id, sec, k % 3 AS v FROM ticks), s AS (SELECT *, lag(v) OVER (PARTITION BY symbol ORDER BY ts_us, id) AS p FROM v), c AS (SELECT symbol, sec - lag(sec) OVER (PARTITION BY symbol ORDER BY ts_us, id) AS gap FROM s WHERE v IS DISTINCT FROM p), r AS (SELECT symbol, avg(CAST(v IS NOT DISTINCT FROM p AS INTEGER)) AS rs FROM s GROUP BY 1) SELECT symbol, round(max(rs), 9) AS repeat_share, round(avg(gap), 6) AS mean_gap, max(gap) AS longest_gap FROM c JOIN r USING (symbol) GROUP BY 1",
)
def update_pattern(spark, sf):
    v = ticks(spark, sf).withColumn("v", F.col("k") % 3)
    out = q.update_pattern(v, ["symbol"], ["ts_us", "id"], "v", "sec")
    return out.select("symbol", r("repeat_share", 9).alias("repeat_share"), r("mean_gap").alias("mean_gap"), "longest_gap")


@query(
    "n12_capture_continuity",
    with_(TICKS) + ", g AS (SELECT user_id, ts_us // 1000 - lag(ts_us // 1000) OVER (PARTITION BY user_id ORDER BY ts_us // 1000) AS gap FROM ticks) SELECT user_id, count(*) AS rows, count(*) FILTER (gap = 0) AS duplicates, count(*) FILTER (gap > 3600000) AS gaps_over_3600000ms, count(*) FILTER (gap > 86400000) AS gaps_over_86400000ms FROM g GROUP BY 1",
)
def continuity(spark, sf):
    t = ticks(spark, sf).select("user_id", F.floor(F.col("ts_us") / 1000).alias("ms"))
    return q.capture_continuity(t, ["user_id"], "ms", (3_600_000, 86_400_000))


@query(
    "n13_regenerated_table",
    "WITH a AS (SELECT count(*) / (SELECT count(*) FROM orders) AS v, max(list_contains(json_keys(to_json(lineitem)), 'l_orderkey')::INT + list_contains(json_keys(to_json(lineitem)), 'l_quantity')::INT + list_contains(json_keys(to_json(lineitem)), 'l_shipdate')::INT) AS c FROM lineitem) " + " UNION ALL ".join([check_sql("rows_vs_expected", "round(v, 9)", "v BETWEEN 3.5 AND 4.5", "3.5 .. 4.5", "a"), check_sql("required_columns", "c", "c = 3", "= 3", "a")]),
)
def regenerated(spark, sf):
    expected = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("expected"))
    lines = table(spark, sf, "lineitem")
    have = len({"l_orderkey", "l_quantity", "l_shipdate"} & set(lines.columns))
    return rounded(q.report(agg.attach(lines, expected, []), {
        "rows_vs_expected": q.Check(F.count(F.lit(1)) / F.max("expected"), 3.5, 4.5), "required_columns": q.Check(F.max(F.lit(have)), 3, 3)}), 9)


# == M: user functions ===============================================================================


@query(
    "m01_scalar_expressions",
    with_(SYMBOLS) + "SELECT id, (CASE WHEN symbol = 'BROKEN' THEN 2147483647 ELSE CAST(epoch(make_date(y, 2, d)) AS BIGINT) + 28800 END - 1704067200) / 31557600.0e0 AS years FROM sym",
)
def scalar_expressions(spark, sf):
    expiry = C.expiry_seconds(C.option_symbol("symbol")["expiry_str"])
    return symbols(spark, sf).select("id", ((expiry - 1704067200) / pricing.SECONDS_PER_YEAR).alias("years"))


@query("m02_batch_function", with_(TICKS) + f", z AS (SELECT id, (price - 50) / 20 AS x FROM ticks) SELECT id, round({cdf_sql('x')}, 10) AS cdf FROM z")
def batch_function(spark, sf):
    """The distribution function as a batch function, to compare with the Column form."""
    return ticks(spark, sf).select("id", r(normal_cdf_batch((F.col("price") - 50) / 20), 10).alias("cdf"))


@query("m06_registered_functions", with_(TICKS, BIN) + f"SELECT id, round({cdf_sql('d2')}, 9) AS prob, round(exp(-rate * t) * {cdf_sql('d2')}, 9) AS price FROM d")
def registered(spark, sf):
    """Binary prices in SQL through the registered functions."""
    register_functions(spark)
    binary_inputs(spark, sf).withColumnRenamed("left", "seconds").createOrReplaceTempView("tidemark_binary_inputs")
    return spark.sql("""
        SELECT id, round(norm_cdf(d2), 9) AS prob, round(binary_price(S, K, r, sigma, CAST(seconds AS DOUBLE)), 9) AS price
        FROM (SELECT *, CASE WHEN sigma * sqrt(seconds / 31557600D) > 1e-10D
                THEN try_divide(ln(S / K) + (r - 0.5D * sigma * sigma) * (seconds / 31557600D), sigma * sqrt(seconds / 31557600D))
                WHEN S > K THEN 1e10D ELSE -1e10D END AS d2
              FROM tidemark_binary_inputs)""")


@query("m06_calendar_table_function", with_(TICKS) + "SELECT unnest(range(min(sec) // 86400 * 86400, max(sec) // 86400 * 86400 + 86400, 900)) AS open_time FROM ticks")
def calendar_function(spark, sf):
    register_functions(spark)
    span = ticks(spark, sf).agg((F.floor(F.min("sec") / DAY) * DAY).alias("lo"), (F.floor(F.max("sec") / DAY) * DAY + DAY).alias("hi"))
    span.createOrReplaceTempView("tidemark_span")
    return spark.sql("SELECT c.open_time FROM tidemark_span, LATERAL calendar(lo, hi, 900L) AS c")


