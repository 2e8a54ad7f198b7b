"""Learning jobs on Spark ML: residual models, walk-forward folds, routed scoring, importances."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from functools import reduce
from itertools import pairwise

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import columns as C
from tidemark.operators import linear
from tidemark.operators.aggregates import attach
from tidemark.operators.evaluate import LOG_CLIP
from tidemark.operators.series import ROWS_PER_TASK, Running, Series

SEED = 42
BINS = 32  # of a feature: as many as Spark's trees tell apart
PARTS = 4  # of the rows of equal bins, so that a tree's share of the rows is not one of whole cells
GROUPS_PER_TASK = 50_000
RANKS = 1_000  # places asked of a feature's order; each costs a call to the JVM


# -- preparation -------------------------------------------------------------------------------------


def scaled(df: DataFrame, features: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / std per column from one aggregate; constant columns become 0."""
    stats = df.agg(*[a.alias(n) for f in features for n, a in ((f"_m_{f}", F.avg(f)), (f"_s_{f}", F.stddev_samp(f)))])
    out = attach(df, stats, [])
    new = {f + suffix: F.coalesce(C.ratio(F.col(f) - F.col(f"_m_{f}"), f"_s_{f}"), F.lit(0.0)) for f in features}
    return out.withColumns(new).drop(*[f"{p}_{f}" for f in features for p in ("_m", "_s")])


def residual_rows(df: DataFrame, prob: str, outcome: str, features: Sequence[str]) -> DataFrame:
    """Rows usable for training: residual target, no null, NaN or infinite input.  Null outcomes are dropped, not replaced."""
    clean = df.withColumns({f: C.scrub(F.col(f).cast("double")) for f in features})
    clean = clean.withColumn("residual", F.col(outcome) - F.col(prob))
    return clean.dropna(subset=["residual", *features])


def assembled(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name).transform(df)


# -- folds -------------------------------------------------------------------------------------------


def walk_forward_windows(span: DataFrame, train_months: int, val_months: int, step_months: int, embargo_days: int,
                         holdout_months: int) -> DataFrame:
    """Expanding training windows with an embargo before validation, ending before the hold-out months.

    ``span`` is one row with ``lo`` and ``hi`` dates; the result has a row per window.
    """
    holdout = F.add_months(F.trunc("hi", "month"), 1 - holdout_months)
    ordinal = F.explode(F.sequence(F.lit(0), F.greatest(F.months_between("hi", "lo").cast("int"), F.lit(0)), F.lit(step_months)))
    base = span.select("lo", holdout.alias("holdout_start"), ordinal.alias("_m"))
    train_end = F.date_sub(F.add_months("lo", F.lit(train_months)), 1)
    # One step at a time from the window before: a month end once clamped stays clamped.
    steps = F.when(F.col("_m") > 0, F.sequence(F.lit(step_months), F.col("_m"), F.lit(step_months))).otherwise(F.array().cast("array<int>"))
    windows = base.withColumn("train_end", F.aggregate(steps, train_end, lambda day, _: F.add_months(day, F.lit(step_months))))
    windows = windows.withColumn("val_start", F.date_add("train_end", embargo_days + 1))
    windows = windows.withColumn("val_end", F.date_sub(F.add_months("val_start", F.lit(val_months)), 1))
    return windows.where(F.col("val_end") < F.col("holdout_start")).select(
        (F.col("_m") / step_months + 1).cast("int").alias("window"), F.col("lo").alias("train_start"), "train_end", "val_start", "val_end", "holdout_start",
    )


def fold_sizes(df: DataFrame, day: str, windows: DataFrame, min_train: int, min_val: int) -> DataFrame:
    """Rows per window and whether it is used.  Rows are counted per day first; windows list their days, so that days
    and windows meet by equality."""
    daily = df.groupBy(F.col(day).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    days = windows.withColumn("_day", F.explode(F.sequence("train_start", "val_end")))
    joined = days.join(daily, "_day", "left")
    n_train = F.sum(F.when(F.col("_day") <= F.col("train_end"), F.col("_n")))
    n_val = F.sum(F.when(F.col("_day") >= F.col("val_start"), F.col("_n")))
    out = joined.groupBy(*windows.columns).agg(*[F.coalesce(n, F.lit(0)).alias(name) for n, name in ((n_train, "n_train"), (n_val, "n_val"))])
    return out.withColumn("skipped", (F.col("n_train") < min_train) | (F.col("n_val") < min_val))


def fixed_folds(spark: SparkSession, folds: Sequence[tuple]) -> DataFrame:
    """Literal expanding folds: (name, train_start, train_end, test_start, test_end)."""
    return spark.createDataFrame(list(folds), "fold string, train_start string, train_end string, val_start string, val_end string").select(
        "fold", *[F.to_date(c).alias(c) for c in ("train_start", "train_end", "val_start", "val_end")]
    )


def chronological_split(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), shares=(0.8, 0.1),
                        rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """train / val / test by position in time, overall or inside each group."""
    placed = Series(df, keys, order, rows_per_task).running(_i=Running("count"), _n=Running("total", F.lit(1)))
    position = F.col("_i") - 1
    first, second = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * (shares[0] + shares[1]))
    label = F.when(position < first, "train").when(position < second, "val").otherwise("test")
    return placed.withColumn("split", label).drop("_i", "_n")


# -- models ------------------------------------------------------------------------------------------


def calibration_slope(df: DataFrame, p: str, y: str) -> DataFrame:
    """Slope and intercept of a logistic fit of the outcome on the forecast's log-odds; ideal is 1 and 0."""
    q = C.clip(F.col(p), LOG_CLIP, 1 - LOG_CLIP)
    rows = df.select(F.ln(q / (1 - q)).alias("logit"), F.col(y).cast("double").alias("label"))
    # Equal pairs are counted and weighted: the solver iterates over far fewer rows.
    rows = rows.groupBy("logit", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    fit = LogisticRegression(regParam=0.0, standardization=False, maxIter=100, tol=1e-12, weightCol="weight").fit(assembled(rows, ["logit"]))
    return df.sparkSession.createDataFrame([(float(fit.coefficients[0]), float(fit.intercept))], "slope double, intercept double")


def ridge(train: DataFrame, features: Sequence[str], label: str = "residual", reg: float = 1.0) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=reg, solver="normal"),
    ]
    return Pipeline(stages=stages).fit(train)


def ridge_scored(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str = "residual", reg: float = 1.0) -> DataFrame:
    """Rows with the prediction of a ridge model, fitted from one aggregate of the training rows."""
    fit = linear.coefficients(train, features, label, reg)
    return attach(rows, fit, []).withColumn("prediction", linear.prediction(features, F.col("weights"), F.col("intercept"))).drop("weights", "intercept")


def time_series_cv(df: DataFrame, day: str, folds: Sequence[tuple], features: Sequence[str], label: str = "residual", reg: float = 1.0) -> DataFrame:
    """Expanding-window validation of the ridge model: rows and squared error beside that of no correction.  Folds are
    (train_end, val_start, val_end); all of them come from one pass over the table."""
    return linear.validated(df, day, folds, features, label, [reg]).select("fold", "n_train", "n_val", "mse", "mse_zero")


def ridge_search(df: DataFrame, day: str, folds: Sequence[tuple], features: Sequence[str], penalties: Sequence[float], label: str = "residual", by: str | None = None) -> DataFrame:
    """Mean validation error of every penalty over time folds, per value of ``by`` on request, from one pass."""
    fits = linear.validated(df, day, folds, features, label, penalties, by=by)
    return fits.groupBy(*([by] if by else []), "penalty").agg(F.count("mse").alias("folds"), F.avg("mse").alias("mean_mse"))


def thresholds(values: Sequence[float], bins: int = BINS) -> list[float]:
    """At most ``bins`` - 1 cuts between the distinct ones of ordered values: all of them if that is enough, otherwise
    cuts with about equally many values between them; a value that is more than its share stays alone."""
    counts = sorted(Counter(values).items())
    cuts, start, below = [], 0, 0
    for (value, n), (following, m) in pairwise(counts):
        below += n
        if len(counts) <= bins or (len(cuts) < bins - 1 and below - start + m / 2 > (len(values) - start) / (bins - len(cuts))):
            middle = (value + following) / 2
            cuts.append(middle if middle > value else following)
            start = below
    return cuts


def bucketed(train: DataFrame, features: Sequence[str]) -> Bucketizer:
    """The bin of every feature, from the order of all training rows."""
    orders = train.approxQuantile(list(features), [i / RANKS for i in range(RANKS + 1)], 1 / RANKS)
    # a constant feature has one bin above its value
    splits = [[-math.inf, *(thresholds(values) or values[:1] or [0.0]), math.inf] for values in orders]
    return Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=[f"_bin_{f}" for f in features])


def part_of(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))


def grouped(rows: DataFrame, bins: Bucketizer, label: str, part: Column) -> DataFrame:
    """Rows of equal bins as one: their mean label, number and variance.

    To trees that split by these bins on squared errors the group is its rows: what varies inside it no split removes.
    There are at most ``BINS ** features * PARTS`` groups, however many rows.
    """
    # a sum drops the note that the bins are categories: their order counts
    keys = [(F.col(b) + 0.0).alias(b) for b in bins.getOutputCols()]
    return bins.transform(rows).groupBy(*keys, part.alias("_part")).agg(
        F.avg(label).alias(label), F.count(F.lit(1)).cast("double").alias("_weight"), F.var_pop(label).alias("_var"))


def boosted_groups(groups: DataFrame, bins: Bucketizer, label: str, trees: int, depth: int) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features"),
        GBTRegressor(labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth, maxBins=BINS, stepSize=0.1, subsamplingRate=0.8, seed=SEED, cacheNodeIds=True),
    ]
    return PipelineModel(stages=[bins, *Pipeline(stages=stages).fit(groups).stages])


def boosted(train: DataFrame, features: Sequence[str], label: str = "residual", trees: int = 10, depth: int = 3) -> PipelineModel:
    """Boosted trees.  The rows are read twice, for the bins and for the groups; all trees grow on the groups."""
    bins = bucketed(train, features)
    with kept_groups(grouped(train, bins, label, part_of(train))) as groups:
        return boosted_groups(groups, bins, label, trees, depth)


def concurrently(spark: SparkSession, jobs: Mapping[str, Callable[[], object]], threads: int = 8) -> dict[str, object]:
    """Results of independent jobs, run side by side, each in a scheduler pool of its own; every job that fails is named.

    Fits of small parts leave cores idle between their stages. With ``spark.scheduler.mode`` FAIR the pools share the
    cluster evenly; otherwise later jobs take what earlier ones leave.
    """
    def run(name: str):
        context = spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
        try:
            return jobs[name]()
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    done, failed = {}, {}
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(jobs)))) as pool:
        started = {name: pool.submit(inheritable_thread_target(spark)(run), name) for name in jobs}
        for name, future in started.items():
            try:
                done[name] = future.result()
            except Exception as error:  # noqa: BLE001 - told with its name below
                failed[name] = error
    if failed:
        raise RuntimeError("; ".join(f"{name}: {error}" for name, error in failed.items())) from next(iter(failed.values()))
    return done


@contextmanager
def kept_groups(groups: DataFrame) -> Iterator[DataFrame]:
    """Groups held for several fits, in as few partitions as their number asks for: a fit runs hundreds of short stages."""
    with kept(groups) as held:
        yield held.coalesce(math.ceil(max(held.count(), 1) / GROUPS_PER_TASK))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Rows computed once and held in memory and on disk for several fits."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def per_regime(train: DataFrame, regime: str, values: Sequence[str], fit, min_rows: int = 1) -> dict[str, PipelineModel]:
    """One model per regime of the configuration, fitted side by side over rows that are read once; a regime with fewer
    than ``min_rows`` rows gets none."""
    with kept(train.where(F.col(regime).isin(*values))) as rows:
        sizes = {r[0]: r[1] for r in rows.groupBy(regime).count().collect()}  # one row per configured regime
        jobs = {v: (lambda v=v: fit(rows.where(F.col(regime) == v))) for v in values if sizes.get(v, 0) >= min_rows}
        return concurrently(train.sparkSession, jobs)


def routed(df: DataFrame, models: Mapping[str, PipelineModel], regime: str, keep: Sequence[str]) -> DataFrame:
    """Score every row with the model of its regime; rows without one get a null prediction."""
    parts = [m.transform(df.where(F.col(regime) == v)).select(*keep, F.col("prediction")) for v, m in models.items()]
    scored = F.coalesce(F.col(regime).isin(*models), F.lit(False)) if models else F.lit(False)
    rest = df.where(~scored).select(*keep, F.lit(None).cast("double").alias("prediction"))
    out = rest
    for part in parts:
        out = out.unionByName(part)
    return out


def final_probability(prob: str, residual: str) -> Column:
    return C.clip(F.col(prob) + F.col(residual), 0.0, 1.0)


def boundary_blend(seconds: str, near: str, mid: str, far: str, half_width: int = 30, edges=(300, 600)) -> Column:
    """Prediction by horizon with linear weights across the boundaries."""
    t = F.col(seconds)
    out = None
    for edge, (left, right) in zip(edges, ((near, mid), (mid, far))):
        w = (t - (edge - half_width)) / (2.0 * half_width)
        inside = (t >= edge - half_width) & (t < edge + half_width)
        blend = (1 - w) * F.col(left) + w * F.col(right)
        out = F.when(inside, blend) if out is None else out.when(inside, blend)
    return out.when(t < edges[0], F.col(near)).when(t < edges[1], F.col(mid)).otherwise(F.col(far))


def mse(df: DataFrame, label: str = "residual") -> float:
    return df.agg(F.avg((F.col(label) - F.col("prediction")) * (F.col(label) - F.col("prediction")))).first()[0]


def search(df: DataFrame, day: str, folds: Sequence[tuple], grid: Sequence[Mapping], features: Sequence[str], label: str = "residual") -> DataFrame:
    """Mean validation error of boosted trees with every number of ``trees`` and ``depth`` over time folds: (train_end,
    val_start, val_end).

    The first trees of a long boosting are a short one, so there is one fit per depth and fold, and its error is taken
    after every tree. A fold's rows are grouped once for all its fits, which run side by side.
    """
    longest = {depth: max(p["trees"] for p in grid if p["depth"] == depth) for depth in {p["depth"] for p in grid}}
    spark = df.sparkSession
    with kept(df.select(day, *features, label, part_of(df).alias("_rows"))) as rows, ExitStack() as held:
        def prepare(fold):
            train_end, val_start, val_end = fold
            train, val = rows.where(F.col(day) <= F.lit(train_end)), rows.where(F.col(day).between(F.lit(val_start), F.lit(val_end)))
            bins = bucketed(train, features)
            train, val = (held.enter_context(kept_groups(grouped(part, bins, label, F.col("_rows")))) for part in (train, val))
            # what a group's one prediction leaves open in any case
            inside = val.agg(F.sum(F.col("_weight") * F.col("_var")) / F.sum("_weight")).first()[0]
            return bins, train, val, inside

        def errors(fold, depth):
            bins, train, val, inside = fold
            *_, assembler, model = boosted_groups(train, bins, label, longest[depth], depth).stages
            return [float(e + inside) for e in model.evaluateEachIteration(assembler.transform(val), "squared")]

        ready = concurrently(spark, {str(j): (lambda f=fold: prepare(f)) for j, fold in enumerate(folds)})
        jobs = {f"{depth}-{j}": (lambda d=depth, f=fold: errors(f, d)) for depth in sorted(longest, reverse=True) for j, fold in ready.items()}
        after = concurrently(spark, jobs)
    means = [(str(dict(p)), len(folds), sum(after[f"{p['depth']}-{j}"][p["trees"] - 1] for j in ready) / len(folds)) for p in grid]
    return spark.createDataFrame(means, "params string, folds int, mean_mse double")


def importances(spark: SparkSession, models: Mapping[str, PipelineModel], features: Sequence[str]) -> DataFrame:
    """Feature importance of every model as rows."""
    rows = [
        (name, feature, float(value))
        for name, model in models.items()
        for feature, value in zip(features, model.stages[-1].featureImportances.toArray())
    ]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def ablation(rows: DataFrame, part: str, features: Sequence[str], groups: Mapping[str, Sequence[str]], label: str = "residual", reg: float = 1.0) -> DataFrame:
    """Change of the test error when a feature group is left out.  ``part`` is 0 for training rows and 1 for test rows;
    all models come from one pass over both."""
    fits = linear.validated(rows, part, [(0, 1, 1)], features, label, [reg], groups)
    full = F.max(F.when(F.col("dropped") == "none", F.col("mse"))).over(Window.partitionBy("fold"))  # one row per group
    return fits.select("dropped", (F.col("mse") - full).alias("delta"), "mse")


def prune_suggestions(pairs: DataFrame, weights: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Of every pair of features correlated beyond the threshold, drop the less important."""
    strong = pairs.where(F.abs("corr") > threshold)
    left = weights.select(F.col("feature").alias("left"), F.col("importance").alias("_l"))
    right = weights.select(F.col("feature").alias("right"), F.col("importance").alias("_r"))
    both = strong.join(left, "left").join(right, "right")
    drop = F.when(F.col("_l") < F.col("_r"), F.col("left")).otherwise(F.col("right"))
    return both.groupBy(drop.alias("drop")).agg(F.count(F.lit(1)).alias("pairs"), F.max(F.abs("corr")).alias("max_corr"))


def clusters(df: DataFrame, features: Sequence[str], k: int, measures: Sequence[str]) -> DataFrame:
    """K-means on standardised features and the profile of each cluster."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        KMeans(k=k, seed=SEED, maxIter=20),
    ]
    labelled = Pipeline(stages=stages).fit(df).transform(df)
    return labelled.groupBy(F.col("prediction").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in [*features, *measures]]
    )


def cluster_check(df: DataFrame, features: Sequence[str], k: int, measures: Sequence[str]) -> DataFrame:
    """What holds for any clustering: rows are neither lost nor doubled, cluster means average to the table's, and on
    standardised features the spread inside clusters is smaller than the whole."""
    parts = clusters(df, features, k, measures)
    whole = df.agg(F.count(F.lit(1)).alias("rows"), *[F.stddev_samp(f).alias(f"_s_{f}") for f in features], *[F.avg(f).alias(f"_m_{f}") for f in features])
    joined = attach(parts, whole, [])
    n = F.col("n")
    between = F.sum(n * reduce(Column.__add__, [C.ratio(F.col(f"mean_{f}") - F.col(f"_m_{f}"), f"_s_{f}") ** 2 for f in features])) / F.sum(n)
    return joined.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum(n).alias("rows"), *[(F.sum(n * F.col(f"mean_{m}")) / F.sum(n)).alias(f"mean_{m}") for m in [*features, *measures]],
        between.between(0.1 * len(features), len(features)).alias("separated"),
    )


def centred(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """StandardScaler output as plain columns."""
    raw = assembled(df, features, "_raw")
    out = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True).fit(raw).transform(raw)
    values = vector_to_array("_scaled")
    return out.withColumns({f"{f}_scaled": values[i] for i, f in enumerate(features)}).drop("_raw", "_scaled")
