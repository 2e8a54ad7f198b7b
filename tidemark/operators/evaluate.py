"""Scores of probability forecasts.  p is the forecast, y the 0/1 outcome; tables in, tables out."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import columns as C
from tidemark.functions.pricing import norm_cdf, student_p
from tidemark.operators.aggregates import attach, quantiles, spearman
from tidemark.operators.sampling import first_bits, repeated_uniform
from tidemark.operators.series import ROWS_PER_TASK, Running, Series

LOG_CLIP = 1e-15
BINS = 10


# -- point scores ------------------------------------------------------------------------------------


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column) -> Column:
    q = C.clip(p, LOG_CLIP, 1 - LOG_CLIP)
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def model_scores(df: DataFrame, keys: Sequence[str], base: str, pred: str, y: str) -> DataFrame:
    """Brier of baseline and model, improvement, log loss and residual errors per group."""
    b, p, o = F.col(base), F.col(pred), F.col(y)
    left = (o - b) - (p - b)
    out = df.where(b.isNotNull() & p.isNotNull() & o.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), brier(b, o).alias("brier_baseline"), brier(p, o).alias("brier_model"),
        log_loss(p, o).alias("log_loss"), F.avg(left * left).alias("residual_mse"), F.sqrt(F.avg(left * left)).alias("residual_rmse"),
        F.avg(F.abs(left)).alias("residual_mae"),
    )
    return out.withColumn(
        "brier_improvement_pct", C.ratio((F.col("brier_baseline") - F.col("brier_model")) * 100, "brier_baseline")
    )


def weighted_rollup(scores: DataFrame, by: Sequence[str], metrics: Sequence[str], weight: str = "n_samples") -> DataFrame:
    """Sample-weighted mean of per-model metrics."""
    w = F.col(weight)
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_models"), F.sum(w).alias(weight),
        *[C.ratio(F.sum(w * F.col(m)), F.sum(w)).alias(m) for m in metrics],
    )


# -- calibration -------------------------------------------------------------------------------------


def reliability(df: DataFrame, keys: Sequence[str], p: str, y: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins of the forecast: count, mean forecast, observed rate; the last bin is closed."""
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*keys, C.equal_width(p, 0.0, 1.0, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("observed")
    )


def calibration_errors(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected, maximum and root-mean-square calibration error, and the Brier decomposition of the bins."""
    n, gap = F.col("n"), F.abs(F.col("mean_pred") - F.col("observed"))
    base = F.sum(n * F.col("observed")) / F.sum(n)
    out = curve.groupBy(*keys).agg(
        F.sum(n).alias("n"), (F.sum(n * gap) / F.sum(n)).alias("ece"), F.max(gap).alias("mce"),
        F.sqrt(F.sum(n * gap * gap) / F.sum(n)).alias("rms_calibration_error"),
        (F.sum(n * gap * gap) / F.sum(n)).alias("reliability"),
        (F.sum(n * F.col("observed") * F.col("observed")) / F.sum(n) - base * base).alias("resolution"),
        (base * (1 - base)).alias("uncertainty"),
    )
    return out


def with_interval(curve: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Binomial normal interval of the observed rate per bin."""
    half = z * F.sqrt(F.col("observed") * (1 - F.col("observed")) / F.col("n"))
    return curve.withColumns({"lower": F.greatest(F.lit(0.0), F.col("observed") - half),
                              "upper": F.least(F.lit(1.0), F.col("observed") + half)})


# -- ranking -----------------------------------------------------------------------------------------


def score_curve(df: DataFrame, keys: Sequence[str], p: str, y: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per distinct score, descending: cumulative true and false positives and the totals."""
    counts = df.groupBy(*keys, F.col(p).alias("score")).agg(
        F.sum(y).cast("double").alias("pos"), (F.count(F.lit(1)) - F.sum(y)).cast("double").alias("neg")
    ).withColumn("_down", -F.col("score"))
    return Series(counts, keys, ["_down"], rows_per_task, rows=df.count()).running(
        tp=Running("sum", F.col("pos")), fp=Running("sum", F.col("neg")),
        P=Running("total", F.col("pos")), N=Running("total", F.col("neg")),
    ).drop("_down")


def roc(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of the ROC and precision-recall curves."""
    return curve.select(
        *keys, "score", C.ratio("fp", "N").alias("fpr"), C.ratio("tp", "P").alias("tpr"),
        C.ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
    )


def areas(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision."""
    before_tp = F.col("tp") - F.col("pos")
    return curve.groupBy(*keys).agg(
        C.ratio(F.sum(F.col("neg") * (before_tp + F.col("pos") / 2)), F.max("P") * F.max("N")).alias("auc"),
        C.ratio(F.sum(F.col("pos") * C.ratio("tp", F.col("tp") + F.col("fp"))), F.max("P")).alias("average_precision"),
    )


def deciles(df: DataFrame, p: str, y: str, ids: Sequence[str], bins: int = 10, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Gain and lift per equal-count bin of the forecast, highest first."""
    ordered = Series(df.withColumn("_down", -F.col(p)), [], ["_down", *ids], rows_per_task).running(
        _rank=Running("count"), _n=Running("total", F.lit(1))
    )
    size, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
    wide = extra * (size + 1)  # the first bins take one row more when the table does not divide evenly
    rank = F.col("_rank") - 1
    tile = F.when(rank < wide, F.floor(rank / (size + 1))).otherwise(extra + F.floor((rank - wide) / F.greatest(size, F.lit(1))))
    binned = ordered.groupBy((tile + 1).alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.avg(p).alias("mean_pred"), F.avg(y).alias("rate")
    )
    whole = Window.partitionBy()  # at most `bins` rows
    upto = whole.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    base = C.ratio(F.sum("positives").over(whole), F.sum("n").over(whole))
    return binned.withColumns(
        {
            "captured": C.ratio(F.sum("positives").over(upto), F.sum("positives").over(whole)),
            "lift": C.ratio("rate", base),
        }
    )


def information(df: DataFrame, x: str, y: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Spearman and Pearson correlation with the two-sided p-value of the rank correlation (normal limit)."""
    pearson = df.agg(C.correlation(x, y).alias("pearson_ic"))
    both = attach(spearman(df, x, y, rows_per_task).withColumnRenamed("spearman", "spearman_ic"), pearson, [])
    rho = F.col("spearman_ic")
    t = rho * F.sqrt(C.ratio(F.col("n") - 2, 1 - rho * rho))
    return both.withColumn("_t", F.abs(t)).withColumn("ic_pvalue", 2 * (1 - norm_cdf("_t"))).drop("_t")


# -- tests and intervals -----------------------------------------------------------------------------


def t_tests(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Paired, Welch and one-sample statistics of two error columns with their two-sided p-values, and Cohen's d.

    One aggregate; the one-sample tests ask whether each error's mean is zero.
    """
    d = a - b
    m = df.agg(
        F.count(d).alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"),
        F.avg(d).alias("md"), F.stddev_samp(d).alias("sd"),
    )
    n, va, vb = F.col("n"), F.col("va"), F.col("vb")
    out = m.select(
        "n", F.col("md").alias("mean_difference"), C.ratio(F.col("md") * F.sqrt(n), "sd").alias("paired_t"),
        C.ratio(F.col("ma") - F.col("mb"), F.sqrt((va + vb) / n)).alias("welch_t"),
        C.ratio((va + vb) * (va + vb) * (n - 1), va * va + vb * vb).alias("welch_df"),
        C.ratio(F.col("ma") * F.sqrt(n), F.sqrt("va")).alias("one_sample_t"), C.ratio(F.col("mb") * F.sqrt(n), F.sqrt("vb")).alias("one_sample_t_b"),
        C.ratio(F.col("ma") - F.col("mb"), F.sqrt((va + vb) / 2)).alias("cohens_d"),
    )
    own = {"paired_t": n - 1, "welch_t": F.col("welch_df"), "one_sample_t": n - 1, "one_sample_t_b": n - 1}
    return out.withColumns({name.replace("_t", "_p", 1): student_p(F.col(name), freedom.cast("double")) for name, freedom in own.items()})


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count from one of 2 ** 32 uniform values, by the inverse distribution function: no draw exceeds 12."""
    edges, mass, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += mass
        edges.append(total)
        mass /= k + 1
    out = None
    for k, edge in enumerate(edges):
        out = F.when(u < edge, k) if out is None else out.when(u < edge, k)
    return out.otherwise(len(edges))


def bootstrap(df: DataFrame, keys: Sequence[str], ids: Sequence[str], measures: Mapping[str, Column], replicates: int = 200,
              level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile intervals of means by a Poisson bootstrap.

    Weights come from a hash of the row id, so a retried task draws the same sample.  Replicates are summed before
    the shuffle: what moves is replicates times groups, whatever the number of rows.
    """
    rows = df.select(*keys, first_bits(ids, seed).alias("_first"), *[c.alias(n) for n, c in measures.items()])
    copies = rows.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_weight(F.col("_u"))
    copies = copies.withColumn("_u", repeated_uniform(F.col("_first"), F.col("_b").cast("long")))
    sums = copies.withColumn("_w", w).groupBy(*keys, "_b").agg(
        *[C.ratio(F.sum(F.col("_w") * F.col(n)), F.sum(F.when(F.col(n).isNotNull(), F.col("_w")))).alias(n) for n in measures]
    )
    tail = (1 - level) / 2
    spans = sums.groupBy(*keys).agg(
        *[F.percentile(n, F.array(F.lit(tail), F.lit(1 - tail))).alias(n) for n in measures]  # `replicates` rows per group
    )
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"{n}_mean") for n, c in measures.items()])
    out = means.join(spans, list(keys)) if keys else attach(means, spans, [])
    return out.select(
        *keys, *[c for n in measures for c in (F.col(f"{n}_mean"), F.col(n)[0].alias(f"{n}_lower"), F.col(n)[1].alias(f"{n}_upper"))]
    )


# -- profiles ----------------------------------------------------------------------------------------


def profiles(df: DataFrame, bins: Mapping[str, Column], measures: Mapping[str, Column], min_rows: int = 1) -> DataFrame:
    """Means per bin of several variables in one pass: {variable: bin label as text}."""
    labels = F.array(*[F.struct(F.lit(n).alias("variable"), b.cast("string").alias("bin")) for n, b in bins.items()])
    long = df.select(*[c.alias(n) for n, c in measures.items()], F.inline(labels))
    return long.where(F.col("bin").isNotNull()).groupBy("variable", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in measures]
    ).where(F.col("n") >= min_rows)


def residual_quantiles(df: DataFrame, value: str, normal: Mapping[str, tuple[float, float]],
                       rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Quantiles of a column beside those of the normal with its mean and deviation: {name: (prob, z)}; its moments
    (skewness and excess kurtosis of the population) in every row."""
    q = quantiles(df, [], value, {n: p for n, (p, _) in normal.items()}, rows_per_task=rows_per_task)
    m = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    rows = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.col(n).alias("observed"), (F.col("mean") + z * F.col("std")).alias("normal"))
        for n, (p, z) in normal.items()
    ])
    return attach(q, m, []).select("mean", "std", "skewness", "kurtosis", F.inline(rows))


def signal_pnl(df: DataFrame, p: str, price: str, y: str, high: float, low: float) -> DataFrame:
    """Trade on the forecast: buy above ``high``, sell below ``low``; profit per contract at settlement."""
    side = F.when(F.col(p) > high, 1).when(F.col(p) < low, -1).otherwise(0)
    return df.withColumn("signal", side).withColumn("pnl", F.col("signal") * (F.col(y) - F.col(price)))


def equity_summary(trades: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Trades, hit rate, profit, Sharpe ratio per trade and maximum drawdown of an ordered trade list."""
    taken = trades.where("signal != 0")
    series = Series(taken, keys, order, rows_per_task, rows=trades.count())
    equity = series._with(series.running(equity=Running("sum", F.col("pnl"))))
    high = equity.running(peak=Running("max", F.col("equity")))
    return high.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"), F.sum("pnl").alias("pnl"),
        C.ratio(F.avg("pnl"), F.stddev_samp("pnl")).alias("sharpe"), F.min(F.col("equity") - F.col("peak")).alias("max_drawdown"),
    )


def threshold_table(df: DataFrame, edge: Column, y: Column, thresholds: Sequence[float]) -> DataFrame:
    """Signals beyond each edge threshold: counts and win rates of both sides, one pass over the table."""
    aggs = []
    for i, t in enumerate(thresholds):
        long, short = edge > t, edge < -t
        aggs += [F.count_if(long).alias(f"_l{i}"), F.count_if(short).alias(f"_s{i}"),
                 F.avg(F.when(long, y)).alias(f"_wl{i}"), F.avg(F.when(short, 1 - y)).alias(f"_ws{i}")]
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_l{i}").alias("n_long"), F.col(f"_s{i}").alias("n_short"),
                 F.col(f"_wl{i}").alias("long_win_rate"), F.col(f"_ws{i}").alias("short_win_rate"))
        for i, t in enumerate(thresholds)
    ])
    return df.agg(*aggs).select(F.inline(rows))


def null_causes(df: DataFrame, features: Sequence[str], prediction: str) -> DataFrame:
    """Per feature: share of nulls where the prediction is missing and where it is not."""
    gone = F.col(prediction).isNull()
    flags = {f: F.col(f).isNull().cast("double") for f in features}
    wide = df.agg(*[c.alias(n) for f, x in flags.items() for n, c in (
        (f"_m{f}", F.avg(F.when(gone, x))), (f"_k{f}", F.avg(F.when(~gone, x))))])
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"_m{f}").alias("null_rate_when_missing"), F.col(f"_k{f}").alias("null_rate_when_known"))
        for f in features
    ])
    return wide.select(F.inline(rows))
