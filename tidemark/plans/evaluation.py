"""Forecast evaluation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import aggregates as agg, evaluate as ev, features as feat, learn
from tidemark.operators.series import Series, lead
from tidemark.plans.registry import query
from tidemark.plans.standins import FORECASTS, forecasts, r, rounded, with_
from tidemark.plans.windows import cdf_sql

CURVE = """cur AS (SELECT model, CAST(least(greatest(floor(q / 0.1e0), 0), 9) AS INTEGER) AS bin, count(*) AS n, avg(q) AS mean_pred, avg(y) AS observed FROM fc GROUP BY 1, 2)"""


def curve(spark, sf, p="q"):
    return ev.reliability(forecasts(spark, sf), ["model"], p, "y")


@query(
    "j01_brier_score",
    with_(FORECASTS) + "SELECT model, count(*) AS n, round(avg((p - y) ** 2), 8) AS brier_baseline, round(avg((q - y) ** 2), 8) AS brier_model, round((avg((p - y) ** 2) - avg((q - y) ** 2)) * 100 / avg((p - y) ** 2), 6) AS improvement_pct FROM fc GROUP BY 1",
)
def brier(spark, sf):
    s = ev.model_scores(forecasts(spark, sf), ["model"], "p", "q", "y")
    return s.select("model", F.col("n_samples").alias("n"), r("brier_baseline", 8).alias("brier_baseline"), r("brier_model", 8).alias("brier_model"), r("brier_improvement_pct").alias("improvement_pct"))


@query("j02_log_loss", with_(FORECASTS) + "SELECT model, round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, q))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, q))))), 8) AS log_loss FROM fc GROUP BY 1")
def log_loss(spark, sf):
    return forecasts(spark, sf).groupBy("model").agg(r(ev.log_loss(F.col("q"), F.col("y")), 8).alias("log_loss"))


@query("j03_reliability_curve", with_(FORECASTS, CURVE) + "SELECT model, bin, n, round(mean_pred, 8) AS mean_pred, round(observed, 8) AS observed FROM cur")
def reliability(spark, sf):
    return rounded(curve(spark, sf), 8)


@query("j04_ece_mce", with_(FORECASTS, CURVE) + "SELECT model, sum(n)::BIGINT AS n, round(sum(n * abs(mean_pred - observed)) / sum(n), 8) AS ece, round(max(abs(mean_pred - observed)), 8) AS mce FROM cur GROUP BY 1")
def ece(spark, sf):
    return rounded(ev.calibration_errors(curve(spark, sf), ["model"]).select("model", "n", "ece", "mce"), 8)


@query("j05_rms_calibration", with_(FORECASTS, CURVE) + "SELECT model, round(sqrt(sum(n * (mean_pred - observed) ** 2) / sum(n)), 8) AS rms_calibration_error FROM cur GROUP BY 1")
def rms(spark, sf):
    return rounded(ev.calibration_errors(curve(spark, sf), ["model"]).select("model", "rms_calibration_error"), 8)


@query(
    "j06_brier_decomposition",
    with_(FORECASTS, CURVE) + ", b AS (SELECT model, avg(y) AS base FROM fc GROUP BY 1) SELECT model, round(sum(n * (mean_pred - observed) ** 2) / sum(n), 8) AS reliability, round(sum(n * (observed - base) ** 2) / sum(n), 8) AS resolution, round(max(base) * (1 - max(base)), 8) AS uncertainty FROM cur JOIN b USING (model) GROUP BY 1",
)
def decomposition(spark, sf):
    return rounded(ev.calibration_errors(curve(spark, sf), ["model"]).select("model", "reliability", "resolution", "uncertainty"), 8)


def _newton_sql(steps):
    """Newton steps of the logistic fit, each an aggregate over the log-odds."""
    text = ", n0 AS (SELECT 0.0e0 AS a, 1.0e0 AS b)"
    for i in range(steps):
        text += f""", s{i} AS (SELECT a, b, c, x, y, 1 / (1 + exp(-(a + b * x))) AS s FROM lo, n{i}), g{i} AS (SELECT a, b, sum(c * (y - s)) AS g0, sum(c * x * (y - s)) AS g1, sum(c * s * (1 - s)) AS h0, sum(c * x * s * (1 - s)) AS h1, sum(c * x * x * s * (1 - s)) AS h2 FROM s{i} GROUP BY 1, 2),
        n{i + 1} AS (SELECT a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM g{i})"""
    return text


@query("j07_calibration_slope", with_(FORECASTS) + ", lo AS (SELECT ln(p / (1 - p)) AS x, y, count(*) AS c FROM fc GROUP BY ALL)" + _newton_sql(8) + " SELECT round(b, 5) AS slope, round(a, 5) AS intercept FROM n8")
def calibration_slope(spark, sf):
    return rounded(learn.calibration_slope(forecasts(spark, sf), "p", "y"), 5)


@query("j08_residual_errors", with_(FORECASTS) + "SELECT model, round(avg((y - q) ** 2), 8) AS mse, round(sqrt(avg((y - q) ** 2)), 8) AS rmse, round(avg(abs(y - q)), 8) AS mae FROM fc GROUP BY 1")
def residual_errors(spark, sf):
    s = ev.model_scores(forecasts(spark, sf), ["model"], "p", "q", "y")
    return s.select("model", r("residual_mse", 8).alias("mse"), r("residual_rmse", 8).alias("rmse"), r("residual_mae", 8).alias("mae"))


@query(
    "j09_information_coefficient",
    with_(FORECASTS) + ", rk AS (SELECT value, y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0e0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0e0 AS b FROM fc), s AS (SELECT corr(a, b) AS s, corr(value, y) AS p, count(*) AS n FROM rk), t AS (SELECT *, abs(s * sqrt((n - 2) / (1 - s * s))) AS t FROM s) SELECT round(s, 7) AS spearman_ic, round(p, 7) AS pearson_ic, n, round(2 * (1 - " + cdf_sql("t") + "), 6) AS ic_pvalue FROM t",
)
def information(spark, sf):
    out = ev.information(forecasts(spark, sf), "value", "y")
    return out.select(r("spearman_ic", 7).alias("spearman_ic"), r("pearson_ic", 7).alias("pearson_ic"), "n", r("ic_pvalue").alias("ic_pvalue"))


TERC = """vq AS (SELECT quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.67) AS hi FROM fc), ft AS (SELECT fc.*, CASE WHEN vol <= lo THEN 'low' WHEN vol <= hi THEN 'medium' ELSE 'high' END AS tercile FROM fc, vq)"""


def by_tercile(spark, sf):
    f = forecasts(spark, sf)
    edges = agg.quantiles(f, [], "vol", {"lo": 0.33, "hi": 0.67})
    return agg.attach(f, edges, []).withColumn("tercile", F.when(F.col("vol") <= F.col("lo"), "low").when(F.col("vol") <= F.col("hi"), "medium").otherwise("high"))


SCORES = """sc AS (SELECT tercile, q AS score, sum(y) AS pos, count(*) - sum(y) AS neg FROM ft GROUP BY 1, 2), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY tercile) AS pp, sum(neg) OVER (PARTITION BY tercile) AS nn FROM sc WINDOW w AS (PARTITION BY tercile ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "j10_roc_auc",
    with_(FORECASTS, TERC, SCORES) + "SELECT tercile, round(sum(neg * (tp - pos + pos / 2.0e0)) / (max(pp) * max(nn)), 8) AS auc FROM cu GROUP BY 1",
)
def roc_auc(spark, sf):
    return rounded(ev.areas(ev.score_curve(by_tercile(spark, sf), ["tercile"], "q", "y"), ["tercile"]).select("tercile", "auc"), 8)


@query(
    "j11_precision_recall",
    with_(FORECASTS, TERC, SCORES) + "SELECT tercile, round(score, 8) AS score, round(fp / nn, 8) AS fpr, round(tp / pp, 8) AS tpr, round(tp / (tp + fp), 8) AS precision FROM cu",
)
def precision_recall(spark, sf):
    return rounded(ev.roc(ev.score_curve(by_tercile(spark, sf), ["tercile"], "q", "y"), ["tercile"]), 8)


@query(
    "j11_average_precision",
    with_(FORECASTS, TERC, SCORES) + "SELECT tercile, round(sum(pos * tp / (tp + fp)) / max(pp), 8) AS average_precision FROM cu GROUP BY 1",
)
def average_precision(spark, sf):
    return rounded(ev.areas(ev.score_curve(by_tercile(spark, sf), ["tercile"], "q", "y"), ["tercile"]).select("tercile", "average_precision"), 8)


@query(
    "j12_gain_lift",
    with_(FORECASTS) + ", n AS (SELECT q, y, ntile(10) OVER (ORDER BY q DESC, id) AS decile FROM fc), a AS (SELECT decile, count(*) AS n, sum(y)::BIGINT AS positives, avg(q) AS mean_pred, avg(y) AS rate FROM n GROUP BY 1) SELECT decile, n, positives, round(mean_pred, 8) AS mean_pred, round(rate, 8) AS rate, round(sum(positives) OVER (ORDER BY decile) / sum(positives) OVER (), 8) AS captured, round(rate / (sum(positives) OVER () / sum(n) OVER ()), 8) AS lift FROM a",
)
def gain_lift(spark, sf):
    return rounded(ev.deciles(forecasts(spark, sf), "q", "y", ["id"]), 8)


MONEY = "CAST(least(greatest(floor((moneyness - -0.1e0) / ((1.0e0 - -0.1e0) / 20.0e0)), 0), 19) AS INTEGER)"


@query("j13_win_rate_grid", with_(FORECASTS) + f"SELECT CAST(least(greatest(floor((time_left - 0.0e0) / (900.0e0 / 6.0e0)), 0), 5) AS INTEGER) AS tbin, {MONEY} AS mbin, count(*) AS n, round(avg(y), 8) AS win_rate FROM fc GROUP BY 1, 2 HAVING count(*) >= 10")
def win_grid(spark, sf):
    return forecasts(spark, sf).groupBy(C.equal_width("time_left", 0.0, 900.0, 6).alias("tbin"), C.equal_width("moneyness", -0.1, 1.0, 20).alias("mbin")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("y"), 8).alias("win_rate")).where("n >= 10")


HORIZON = "CASE WHEN time_left < 300 THEN 'near' WHEN time_left < 600 THEN 'mid' ELSE 'far' END"


REGIME = "CASE WHEN vol <= 0.5e0 THEN 'low_vol' ELSE 'high_vol' END || CASE WHEN abs(moneyness) < 0.05 THEN '_atm' ELSE '_otm' END"
ROLLUP = "count(*) AS n_models, sum(n)::BIGINT AS n_samples, round(sum(n * a) / sum(n), 8) AS brier_baseline, round(sum(n * b) / sum(n), 8) AS brier_model, round(sum(n * ((a - b) * 100 / a)) / sum(n), 6) AS brier_improvement_pct"


@query(
    "j14_regime_rollup",
    with_(FORECASTS) + f", m AS (SELECT {HORIZON} AS horizon, {REGIME} AS regime, count(*) AS n, avg((p - y) ** 2) AS a, avg((q - y) ** 2) AS b FROM fc GROUP BY 1, 2) SELECT 'bucket' AS by, horizon AS name, {ROLLUP} FROM m GROUP BY horizon UNION ALL SELECT 'regime', regime, {ROLLUP} FROM m GROUP BY regime",
)
def regime_rollup(spark, sf):
    """Twelve models, horizon by regime, rolled up to the three horizons and to the four regimes."""
    regime = F.concat(F.when(F.col("vol") <= 0.5, "low_vol").otherwise("high_vol"), F.when(F.abs("moneyness") < 0.05, "_atm").otherwise("_otm"))
    f = forecasts(spark, sf).withColumns({"horizon": feat.temporal_regime("time_left"), "regime": regime})
    scores = ev.model_scores(f, ["horizon", "regime"], "p", "q", "y")
    metrics = ["brier_baseline", "brier_model", "brier_improvement_pct"]
    parts = [ev.weighted_rollup(scores, [c], metrics).select(F.lit(by).alias("by"), F.col(c).alias("name"), "n_models", "n_samples", *metrics)
             for by, c in (("bucket", "horizon"), ("regime", "regime"))]
    s = parts[0].unionByName(parts[1])
    return s.select("by", "name", "n_models", "n_samples", r("brier_baseline", 8).alias("brier_baseline"), r("brier_model", 8).alias("brier_model"), r("brier_improvement_pct").alias("brier_improvement_pct"))


AGE = "CASE WHEN staleness < 10 THEN 'fresh' WHEN staleness < 60 THEN 'moderate' WHEN staleness < 120 THEN 'stale' ELSE 'very_stale' END"
MONEY3 = "CASE WHEN moneyness < -0.05 THEN 'otm' WHEN moneyness < 0.05 THEN 'atm' ELSE 'itm' END"


@query(
    "j15_performance_by_bucket",
    with_(FORECASTS) + ", b AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variable, {e} AS bin, p, q, y FROM fc" for v, e in (("time", HORIZON), ("age", AGE), ("money", MONEY3))) + ") SELECT variable, bin, count(*) AS n, round(avg((p - y) ** 2), 11) AS brier_p, round(avg((q - y) ** 2), 11) AS brier_q FROM b GROUP BY 1, 2",
)
def by_bucket(spark, sf):
    bins = {
        "time": feat.temporal_regime("time_left"), "age": C.bucket("staleness", [10, 60, 120], ["fresh", "moderate", "stale", "very_stale"]),
        "money": C.bucket("moneyness", [-0.05, 0.05], ["otm", "atm", "itm"]),
    }
    return rounded(ev.profiles(forecasts(spark, sf), bins, {"brier_p": (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")), "brier_q": (F.col("q") - F.col("y")) * (F.col("q") - F.col("y"))}), 11)


@query(
    "j16_performance_over_time",
    with_(FORECASTS) + ", b AS (SELECT 'day' AS variable, CAST(sec // 86400 AS VARCHAR) AS bin, p, y FROM fc UNION ALL SELECT 'week', CAST(sec // 604800 AS VARCHAR), p, y FROM fc UNION ALL SELECT 'quarter', CAST(CAST(least(floor((sec // 86400 - (SELECT min(sec // 86400) FROM fc)) * 4 / ((SELECT max(sec // 86400) FROM fc) - (SELECT min(sec // 86400) FROM fc) + 1)), 3) AS INTEGER) AS VARCHAR), p, y FROM fc) SELECT variable, bin, count(*) AS n, round(avg((p - y) ** 2), 8) AS brier FROM b GROUP BY 1, 2",
)
def over_time(spark, sf):
    f = forecasts(spark, sf).withColumn("day", C.epoch_day("sec"))
    span = f.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    quarter = F.least(F.floor((F.col("day") - F.col("lo")) * 4 / (F.col("hi") - F.col("lo") + 1)), F.lit(3))
    bins = {"day": F.col("day"), "week": F.floor(F.col("sec") / 604800), "quarter": quarter}
    return rounded(ev.profiles(agg.attach(f, span, []), bins, {"brier": (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))}), 8)


def _poisson_sql(u):
    text, mass, total = "CASE", math.exp(-1), 0.0
    for k in range(12):
        total += mass
        text += f" WHEN {u} < {total!r}e0 THEN {k}"
        mass /= k + 1
    return text + " ELSE 12 END"


@query(
    "j17_bootstrap_intervals",
    with_(FORECASTS) + ", c0 AS (SELECT model, (q - y) ** 2 AS m, (p - y) ** 2 - (q - y) ** 2 AS i, b, xor(('0x' || substr(md5(concat_ws('|', id, 42)), 1, 8))::BIGINT, (b * 2654435761) & 4294967295) AS x0 FROM fc, (SELECT unnest(range(1, 201)) AS b)), c1 AS (SELECT *, (xor(x0, x0 >> 16) * 73244475) & 4294967295 AS x1 FROM c0), c2 AS (SELECT *, (xor(x1, x1 >> 16) * 73244475) & 4294967295 AS x2 FROM c1), c AS (SELECT *, xor(x2, x2 >> 16) / 4294967296.0e0 AS u FROM c2), w AS (SELECT *, "
    + _poisson_sql("u") + """ AS w FROM c), s AS (SELECT model, b, sum(w * m) / sum(w) AS m, sum(w * i) / sum(w) AS i FROM w GROUP BY 1, 2), t AS (SELECT model, avg((q - y) ** 2) AS mm, avg((p - y) ** 2 - (q - y) ** 2) AS im FROM fc GROUP BY 1)
    SELECT model, round(max(mm), 8) AS brier_mean, round(quantile_cont(m, 0.025), 8) AS brier_lower, round(quantile_cont(m, 0.975), 8) AS brier_upper, round(max(im), 8) AS improvement_mean, round(quantile_cont(i, 0.025), 8) AS improvement_lower, round(quantile_cont(i, 0.975), 8) AS improvement_upper
    FROM s JOIN t USING (model) GROUP BY 1""",
)
def bootstrap(spark, sf):
    base, model = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")), (F.col("q") - F.col("y")) * (F.col("q") - F.col("y"))
    return rounded(ev.bootstrap(forecasts(spark, sf), ["model"], ["id"], {"brier": model, "improvement": base - model}), 8)


def _student_sql(t, freedom):
    """Hill's transformed value; the tables are far beyond 20 degrees of freedom."""
    w, y = f"({freedom} - 0.5e0)", f"sqrt(({freedom} - 0.5e0) * ln(1 + ({t}) ** 2 / ({freedom})))"
    k = f"(48 * {w} ** 2)"
    return f"{y} + ({y} ** 3 + 3 * {y}) / {k} - (4 * {y} ** 7 + 33 * {y} ** 5 + 240 * {y} ** 3 + 855 * {y}) / (10 * {k} * ({k} + 0.8e0 * {y} ** 4 + 100))"


T_VALUES = {"paired": "n - 1", "welch": "welch_df", "one_sample": "n - 1", "one_sample_b": "n - 1"}


@query(
    "j18_t_tests",
    with_(FORECASTS) + """, e AS (SELECT (p - y) ** 2 AS a, (q - y) ** 2 AS b FROM fc),
    m AS (SELECT count(*) AS n, avg(a - b) AS md, stddev_samp(a - b) AS sd, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb FROM e),
    s AS (SELECT n, md, md * sqrt(n) / sd AS paired, (ma - mb) / sqrt((va + vb) / n) AS welch, (va + vb) ** 2 * (n - 1) / (va ** 2 + vb ** 2) AS welch_df, ma * sqrt(n) / sqrt(va) AS one_sample, mb * sqrt(n) / sqrt(vb) AS one_sample_b, (ma - mb) / sqrt((va + vb) / 2) AS cohens_d FROM m),
    h AS (SELECT *, """ + ", ".join(f"-({_student_sql(t, v)}) AS z_{t}" for t, v in T_VALUES.items()) + """ FROM s)
    SELECT n, round(md, 8) AS mean_difference, round(paired, 5) AS paired_t, round(welch, 6) AS welch_t, round(one_sample, 5) AS one_sample_t, round(one_sample_b, 5) AS one_sample_t_b, round(cohens_d, 7) AS cohens_d, """
    + ", ".join(f"round(2 * {cdf_sql(f'z_{t}')}, 9) AS {t.replace('one_sample_b', 'one_sample_p_b') if t.endswith('_b') else t + '_p'}" for t in T_VALUES) + " FROM h",
)
def t_tests(spark, sf):
    out = ev.t_tests(forecasts(spark, sf), (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")), (F.col("q") - F.col("y")) * (F.col("q") - F.col("y")))
    digits = {"mean_difference": 8, "paired_t": 5, "welch_t": 6, "one_sample_t": 5, "one_sample_t_b": 5, "cohens_d": 7, "paired_p": 9, "welch_p": 9, "one_sample_p": 9, "one_sample_p_b": 9}
    return out.select("n", *[r(c, d).alias(c) for c, d in digits.items()])


@query(
    "j19_residual_profiles",
    with_(FORECASTS) + ", b AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({e} AS VARCHAR) AS bin, y - p AS residual FROM fc" for v, e in (
        ("moneyness", MONEY), ("time", "CAST(least(greatest(floor((time_left - 0.0e0) / (900.0e0 / 15.0e0)), 0), 14) AS INTEGER)"), ("vol", "CAST(least(greatest(floor((vol - 0.0e0) / (1.0e0 / 10.0e0)), 0), 9) AS INTEGER)"), ("hour", "sec % 86400 // 3600"))) + ") SELECT variable, bin, count(*) AS n, round(avg(residual), 7) AS residual FROM b GROUP BY 1, 2 HAVING count(*) >= 100",
)
def residual_profiles(spark, sf):
    bins = {
        "moneyness": C.equal_width("moneyness", -0.1, 1.0, 20), "time": C.equal_width("time_left", 0.0, 900.0, 15), "vol": C.equal_width("vol", 0.0, 1.0, 10),
        "hour": C.time_features("sec")["hour"],
    }
    return rounded(ev.profiles(forecasts(spark, sf), bins, {"residual": F.col("y") - F.col("p")}, min_rows=100), 7)


# Standard normal quantiles (fixed values).
NORMAL = {"q05": (0.05, -1.6448536269514722), "q25": (0.25, -0.6744897501960817), "q50": (0.5, 0.0), "q75": (0.75, 0.6744897501960817), "q95": (0.95, 1.6448536269514722)}


@query(
    "j20_residual_distribution",
    with_(FORECASTS) + ", m AS (SELECT avg(y - p) AS mu, stddev_samp(y - p) AS sd FROM fc), c AS (SELECT mu, sd, avg((y - p - mu) ** 2) AS m2, avg((y - p - mu) ** 3) AS m3, avg((y - p - mu) ** 4) AS m4 FROM fc, m GROUP BY 1, 2) "
    + " UNION ALL ".join(f"SELECT {p}e0 AS prob, round((SELECT quantile_cont(y - p, {p}) FROM fc), 8) AS observed, round(mu + {z!r}e0 * sd, 8) AS normal, round(mu, 8) AS mean, round(sd, 8) AS std, round(m3 / m2 ** 1.5e0, 8) AS skewness, round(m4 / m2 ** 2 - 3, 8) AS kurtosis FROM c" for p, z in NORMAL.values()),
)
def residual_distribution(spark, sf):
    return rounded(ev.residual_quantiles(forecasts(spark, sf).withColumn("residual", F.col("y") - F.col("p")), "residual", NORMAL), 8)


SIGNALS = "sg AS (SELECT *, CASE WHEN q > 0.6e0 THEN 1 WHEN q < 0.4e0 THEN -1 ELSE 0 END AS signal FROM fc), tr AS (SELECT model, ts_us, id, signal * (y - p) AS pnl FROM sg WHERE signal <> 0), eq AS (SELECT *, sum(pnl) OVER (PARTITION BY model ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING) AS equity FROM tr), pk AS (SELECT *, max(equity) OVER (PARTITION BY model ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING) AS peak FROM eq)"


@query(
    "j21_signal_pnl",
    with_(FORECASTS, SIGNALS) + "SELECT model, count(*) AS trades, round(avg(CAST(pnl > 0 AS INTEGER)), 8) AS hit_rate, round(sum(pnl), 6) AS pnl, round(avg(pnl) / stddev_samp(pnl), 7) AS sharpe, round(min(equity - peak), 6) AS max_drawdown FROM pk GROUP BY 1",
)
def signal_pnl(spark, sf):
    trades = ev.signal_pnl(forecasts(spark, sf), "q", "p", "y", 0.6, 0.4)
    out = ev.equity_summary(trades, ["model"], ["ts_us", "id"])
    return out.select("model", "trades", r("hit_rate", 8).alias("hit_rate"), r("pnl").alias("pnl"), r("sharpe", 7).alias("sharpe"), r("max_drawdown").alias("max_drawdown"))


THRESHOLDS = (0.01, 0.02, 0.05, 0.08)


@query(
    "j22_edge_thresholds",
    with_(FORECASTS) + " UNION ALL ".join(f"SELECT {t}e0 AS threshold, count(*) FILTER (q - p > {t}e0) AS n_long, count(*) FILTER (q - p < -{t}e0) AS n_short, round(avg(y) FILTER (q - p > {t}e0), 8) AS long_win_rate, round(avg(1 - y) FILTER (q - p < -{t}e0), 8) AS short_win_rate FROM fc" for t in THRESHOLDS),
)
def edge_thresholds(spark, sf):
    return rounded(ev.threshold_table(forecasts(spark, sf), F.col("q") - F.col("p"), F.col("y"), THRESHOLDS), 8)


@query("j23_edge_confidence", with_(FORECASTS) + "SELECT CAST(least(greatest(floor((abs(q - p) - 0.0e0) / ((0.1e0 - 0.0e0) / 5.0e0)), 0), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(abs(q - p)), 8) AS mean_edge, round(avg((q - y) ** 2), 8) AS brier FROM fc GROUP BY 1")
def edge_confidence(spark, sf):
    edge = F.abs(F.col("q") - F.col("p"))
    return forecasts(spark, sf).groupBy(C.equal_width(edge, 0.0, 0.1, 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(edge), 8).alias("mean_edge"), r(ev.brier(F.col("q"), F.col("y")), 8).alias("brier"))


@query(
    "j24_empirical_delta_gamma",
    with_(FORECASTS) + f", b AS (SELECT {MONEY} AS bin, avg(moneyness) AS m, avg(y) AS w FROM fc GROUP BY 1), d AS (SELECT *, (lead(w) OVER (ORDER BY bin) - w) / (lead(m) OVER (ORDER BY bin) - m) AS delta FROM b) SELECT bin, round(m, 8) AS m, round(w, 8) AS w, round(delta, 5) AS delta, round((lead(delta) OVER (ORDER BY bin) - delta) / (lead(m) OVER (ORDER BY bin) - m), 3) AS gamma FROM d",
)
def empirical_greeks(spark, sf):
    bins = forecasts(spark, sf).groupBy(C.equal_width("moneyness", -0.1, 1.0, 20).alias("bin")).agg(F.avg("moneyness").alias("m"), F.avg("y").alias("w"))
    step = Series(bins, [], ["bin"], rows=20).frames(
        {"_m": lead("m"), "_w": lead("w")}, {"delta": C.ratio(F.col("_w") - F.col("w"), F.col("_m") - F.col("m"))}, {"_d": lead("delta")}, before=0, after=2)
    return step.select("bin", r("m", 8).alias("m"), r("w", 8).alias("w"), r("delta", 5).alias("delta"), r(C.ratio(F.col("_d") - F.col("delta"), F.col("_m") - F.col("m")), 3).alias("gamma"))


@query("j25_time_decay", with_(FORECASTS) + f"SELECT {MONEY3} AS money, time_left < 60 AS last_minute, count(*) AS n, round(avg(abs(y - p)), 8) AS mean_error, round(regr_slope(abs(y - p), time_left), 9) AS slope FROM fc GROUP BY 1, 2")
def time_decay(spark, sf):
    error = F.abs(F.col("y") - F.col("p"))
    return forecasts(spark, sf).groupBy(C.bucket("moneyness", [-0.05, 0.05], ["otm", "atm", "itm"]).alias("money"), (F.col("time_left") < 60).alias("last_minute")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(error), 8).alias("mean_error"), r(F.regr_slope(error, F.col("time_left")), 9).alias("slope"))


@query(
    "j26_outcome_asymmetry",
    with_(FORECASTS) + ", b AS (SELECT CAST(least(greatest(floor(abs(moneyness) / 0.05e0), 0), 9) AS INTEGER) AS bin, moneyness < 0 AS otm, avg(y) AS w, avg(p) AS pred, count(*) AS n FROM fc GROUP BY 1, 2) SELECT a.bin, a.n AS n_otm, c.n AS n_itm, round(a.w, 8) AS otm_rate, round(c.w, 8) AS itm_rate, round(a.w - (1 - c.w), 8) AS asymmetry FROM b a JOIN b c ON a.bin = c.bin AND a.otm AND NOT c.otm",
)
def asymmetry(spark, sf):
    f = forecasts(spark, sf).withColumns({"bin": C.equal_width(F.abs("moneyness"), 0.0, 0.5, 10), "otm": F.col("moneyness") < 0})
    half = lambda flag, side: f.where(F.col("otm") == flag).groupBy("bin").agg(F.count(F.lit(1)).alias(f"n_{side}"), F.avg("y").alias(f"{side}_rate"))
    both = half(True, "otm").join(half(False, "itm"), "bin")
    return rounded(both.withColumn("asymmetry", F.col("otm_rate") - (1 - F.col("itm_rate"))), 8)


@query(
    "j27_conditional_errors",
    with_(FORECASTS) + ", c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variable, CASE WHEN {e} THEN 'yes' ELSE 'no' END AS bin, (p - y) ** 2 AS err FROM fc" for n, e in (("jump", "value > 150"), ("high_vol", "vol > 0.5e0"), ("stale", "staleness >= 60"))) + ") SELECT variable, bin, count(*) AS n, round(avg(err), 8) AS err FROM c GROUP BY 1, 2",
)
def conditional_errors(spark, sf):
    yes = lambda c: F.when(c, "yes").otherwise("no")
    bins = {"jump": yes(F.col("value") > 150), "high_vol": yes(F.col("vol") > 0.5), "stale": yes(F.col("staleness") >= 60)}
    return rounded(ev.profiles(forecasts(spark, sf), bins, {"err": (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))}), 8)


@query(
    "j28_confidence_slices",
    with_(FORECASTS) + "SELECT CASE WHEN p BETWEEN 0.4e0 AND 0.6e0 THEN 'uncertain' WHEN (p > 0.6e0) = (y = 1) THEN 'confident_right' ELSE 'confident_wrong' END AS slice, count(*) AS n, round(avg(p), 8) AS mean_p, min(arg) AS first_id FROM (SELECT *, id AS arg FROM fc) GROUP BY 1",
)
def slices(spark, sf):
    label = F.when(F.col("p").between(0.4, 0.6), "uncertain").when((F.col("p") > 0.6) == (F.col("y") == 1), "confident_right").otherwise("confident_wrong")
    return forecasts(spark, sf).groupBy(label.alias("slice")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("p"), 8).alias("mean_p"), F.min("id").alias("first_id"))


FEATS = {"value": "price", "time_left": "time", "moneyness": "price", "vol": "vol", "staleness": "quote"}


@query(
    "j29_feature_correlation_ranking",
    with_(FORECASTS) + ", c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, '{c}' AS category, corr({f}, q) AS rho FROM fc" for f, c in FEATS.items()) + ") SELECT feature, category, round(rho, 8) AS rho, row_number() OVER (ORDER BY round(abs(rho), 8) DESC, feature) AS rank FROM c",
)
def feature_ranking(spark, sf):
    wide = forecasts(spark, sf).agg(*[C.correlation(f, "q").alias(f) for f in FEATS])
    long = agg.unpivot_row(wide, {f: {"category": F.lit(c), "rho": r(F.col(f), 8)} for f, c in FEATS.items()}, "feature")
    ordered = long.withColumn("_o", -F.abs("rho"))
    from tidemark.operators.series import Running

    return Series(ordered, [], ["_o", "feature"], rows=len(FEATS)).running(rank=Running("count")).drop("_o")


@query(
    "j30_model_comparison",
    with_(FORECASTS) + " UNION ALL ".join(f"SELECT '{n}' AS model_name, count(*) AS n, round(avg(({e} - y) ** 2), 8) AS brier, round(avg(-(y * ln({e}) + (1 - y) * ln(1 - {e}))), 8) AS log_loss, round(avg(abs({e} - y)), 8) AS mae FROM fc" for n, e in (("baseline", "p"), ("linear", "q"), ("boosted", "((p + q) / 2)"))),
)
def model_comparison(spark, sf):
    f = forecasts(spark, sf)
    models = {"baseline": F.col("p"), "linear": F.col("q"), "boosted": (F.col("p") + F.col("q")) / 2}
    long = f.select("y", F.inline(F.array(*[F.struct(F.lit(n).alias("model_name"), c.alias("pred")) for n, c in models.items()])))
    pred = F.col("pred")
    return long.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), r(ev.brier(pred, F.col("y")), 8).alias("brier"), r(ev.log_loss(pred, F.col("y")), 8).alias("log_loss"), r(F.avg(F.abs(pred - F.col("y"))), 8).alias("mae"))


@query(
    "j31_reliability_intervals",
    with_(FORECASTS, CURVE) + "SELECT model, bin, n, round(observed, 8) AS observed, round(greatest(0, observed - 1.959963984540054e0 * sqrt(observed * (1 - observed) / n)), 8) AS lower, round(least(1, observed + 1.959963984540054e0 * sqrt(observed * (1 - observed) / n)), 8) AS upper FROM cur",
)
def intervals(spark, sf):
    return rounded(ev.with_interval(curve(spark, sf)).drop("mean_pred"), 8)


@query(
    "j32_null_prediction_causes",
    with_(FORECASTS) + ", n AS (SELECT CASE WHEN k % 6 = 0 THEN NULL ELSE value END AS value, CASE WHEN id % 9 = 0 THEN NULL ELSE vol END AS vol, CASE WHEN k % 6 = 0 OR id % 9 = 0 THEN NULL ELSE q END AS pred FROM fc) SELECT 'value' AS feature, round(avg(CAST(value IS NULL AS INTEGER)) FILTER (pred IS NULL), 8) AS null_rate_when_missing, round(avg(CAST(value IS NULL AS INTEGER)) FILTER (pred IS NOT NULL), 8) AS null_rate_when_known FROM n UNION ALL SELECT 'vol', round(avg(CAST(vol IS NULL AS INTEGER)) FILTER (pred IS NULL), 8), round(avg(CAST(vol IS NULL AS INTEGER)) FILTER (pred IS NOT NULL), 8) FROM n",
)
def null_causes(spark, sf):
    f = forecasts(spark, sf)
    k6, i9 = F.col("k") % 6 == 0, F.col("id") % 9 == 0
    n = f.select(F.when(~k6, F.col("value")).alias("value"), F.when(~i9, F.col("vol")).alias("vol"), F.when(~(k6 | i9), F.col("q")).alias("pred"))
    return rounded(ev.null_causes(n, ["value", "vol"], "pred"), 8)


@query("j33_iv_surface", with_(FORECASTS) + f"SELECT CAST(least(greatest(floor((time_left - 0.0e0) / (900.0e0 / 9.0e0)), 0), 8) AS INTEGER) AS tbin, {MONEY} AS mbin, count(*) AS n, round(avg(0.2e0 + vol / 2), 8) AS mean_iv FROM fc GROUP BY 1, 2")
def iv_surface(spark, sf):
    return forecasts(spark, sf).groupBy(C.equal_width("time_left", 0.0, 900.0, 9).alias("tbin"), C.equal_width("moneyness", -0.1, 1.0, 20).alias("mbin")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(0.2 + F.col("vol") / 2), 8).alias("mean_iv"))
