"""Aggregates that need more than one built-in: exact quantiles, profiles, matrices, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import correlation, equal_width, ratio
from tidemark.operators.series import ROWS_PER_TASK, Running, Series


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    rows: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per entry of ``probs``.

    Up to ``rows_per_task`` rows the built-in ``percentile`` is used.  Beyond that its per-group state may not
    fit one task, so equal values are counted first and ranks come from a blocked running count.
    """
    keys = list(keys)
    df = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = df.count() if rows is None else rows
    if rows <= rows_per_task:
        grouped = df.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_q"))
        return grouped.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    counts = df.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = Series(counts, keys, ["_v"], rows_per_task, rows=rows).running(
        _upto=Running("sum", F.col("_c")), _n=Running("total", F.col("_c"))
    )
    start = F.col("_upto") - F.col("_c")
    aggs = []
    for i, p in enumerate(probs.values()):
        position = (F.col("_n") - 1) * float(p)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggs.append(F.max(F.when((start <= rank) & (rank < F.col("_upto")), F.col("_v"))).alias(f"_{side}{i}"))
        aggs.append(F.max(position - F.floor(position)).alias(f"_f{i}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name)
            for i, name in enumerate(probs)
        ],
    )


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct value: a scalar subquery, evaluated once, no join."""
    return df.select(F.struct(*df.columns)).scalar()


def attach(df: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give every row the values of its group; without keys the one row becomes constants."""
    if not keys:
        return df.withColumn("_one", one_row(per_group)).select(*df.columns, "_one.*")
    from tidemark.operators.joins import lookup

    return lookup(df, per_group, keys)


def unpivot_row(df: DataFrame, groups: Mapping[str, Mapping[str, Column]], label: str) -> DataFrame:
    """Turn wide aggregate columns into one row per name: {name: {output column: column}}."""
    rows = F.array(
        *[F.struct(F.lit(name).alias(label), *[c.alias(k) for k, c in out.items()]) for name, out in groups.items()]
    )
    return df.select(F.inline(rows))


def null_profile(df: DataFrame, columns: Sequence[str], ts: str | None = None) -> DataFrame:
    """Per column: rows, nulls, null share and first time it is known; one pass over the table."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        aggs.append(F.count(c).alias(f"_k{i}"))
        first = F.min(F.when(F.col(c).isNotNull(), F.col(ts))) if ts else F.lit(None).cast("long")
        aggs.append(first.alias(f"_t{i}"))
    wide = df.agg(*aggs)
    return unpivot_row(
        wide,
        {
            c: {
                "rows": F.col("_n"),
                "nulls": F.col("_n") - F.col(f"_k{i}"),
                "null_rate": ratio(F.col("_n") - F.col(f"_k{i}"), "_n"),
                "first_known": F.col(f"_t{i}"),
            }
            for i, c in enumerate(columns)
        },
        "feature",
    )


def column_profile(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """Per column: count, nulls, mean, deviation, min, quartiles and p95, max."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"_c{i}"), F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}"),
            F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}"),
        ]
    wide = df.agg(*aggs)
    long = unpivot_row(
        wide,
        {
            c: {
                "count": F.col(f"_c{i}"), "nulls": F.col("_n") - F.col(f"_c{i}"), "mean": F.col(f"_m{i}"),
                "std": F.col(f"_s{i}"), "min": F.col(f"_lo{i}"), "max": F.col(f"_hi{i}"),
            }
            for i, c in enumerate(columns)
        },
        "column",
    )
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])))
    rows = (df.count() if rows is None else rows) * len(columns)
    spots = quantiles(values, ["column"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, rows)
    return long.join(F.broadcast(spots), "column", "left")  # one row per column of the table


def correlation_pairs(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of columns in one aggregate, unpivoted to rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.groupBy(*keys).agg(*[correlation(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*keys, F.inline(rows))


def average_ranks(df: DataFrame, value: str, name: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Distinct values with their average rank in the table: equal values share one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    upto = Series(counts, [], [value], rows_per_task, rows=df.count()).running(_upto=Running("sum", F.col("_c")))
    return upto.select(value, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(name))


def spearman(df: DataFrame, x: str, y: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rank correlation with average ranks for ties; equal (x, y) pairs are counted before the joins."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(x, y).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    ranked = pairs.join(average_ranks(both, x, "_rx", rows_per_task), x).join(
        average_ranks(both, y, "_ry", rows_per_task), y
    )
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * b).alias("ab"),
        F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"),
    )
    n = F.col("n")
    top = n * F.col("ab") - F.col("a") * F.col("b")
    bottom = F.sqrt((n * F.col("aa") - F.col("a") * F.col("a")) * (n * F.col("bb") - F.col("b") * F.col("b")))
    return sums.select(ratio(top, bottom).alias("spearman"), n.cast("long").alias("n"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin with share and cumulative share."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, equal_width(value, lo, hi, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = Window.partitionBy(*keys)  # at most `bins` rows per group
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(whole)
    return counts.select(
        *keys, "bin", "n", ratio("n", total).alias("share"), ratio(F.sum("n").over(upto), total).alias("cdf")
    )


def exceedance(df: DataFrame, values: Mapping[str, tuple[Column, Sequence[float]]], keys: Sequence[str] = ()) -> DataFrame:
    """How many rows exceed each threshold, for several measures in one pass: {kind: (value, thresholds)}."""
    cells = [(kind, value, t, f"_{kind}_{i}") for kind, (value, levels) in values.items() for i, t in enumerate(levels)]
    wide = df.groupBy(*keys).agg(
        *[F.count(value).alias(f"_n_{kind}") for kind, (value, _) in values.items()],
        *[F.count_if(value > t).alias(name) for _, value, t, name in cells],
    )
    rows = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(float(t)).alias("threshold"), F.col(name).alias("n_above"),
                 ratio(F.col(name) * 100, f"_n_{kind}").alias("pct_above"))
        for kind, _, t, name in cells
    ])
    return wide.select(*keys, F.inline(rows))


def gini(df: DataFrame, keys: Sequence[str], value: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Gini coefficient per group from counted values, so no group has to be sorted in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = Series(counts, list(keys), [value], rows_per_task, rows=df.count()).running(_upto=Running("sum", F.col("_c")))
    x, c = F.col(value), F.col("_c")
    ranks = c * (2 * F.col("_upto") - c + 1) / 2.0  # sum of the ranks of the equal values
    out = upto.groupBy(*keys).agg(
        F.sum(x * ranks).alias("_ix"), F.sum(x * c).alias("_x"), F.sum(c).alias("_n")
    )
    n = F.col("_n")
    return out.select(*keys, (ratio(2 * F.col("_ix"), n * F.col("_x")) - (n + 1) / n).alias("gini"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group.  Spark limits each task to k rows per group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in a total order."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    return top_per_group(df, keys, by, 1, "_first").drop("_first")


def ranked(df: DataFrame, order: Sequence[Column], name: str, descending: str | None = None,
           ids: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Ordinal rank over a whole table; ``descending`` names a numeric column, ``ids`` break ties."""
    keyed = df.withColumn("_o", -F.col(descending) if descending else order[0])
    return Series(keyed, [], ["_o", *ids], rows_per_task).running(**{name: Running("count")}).drop("_o")
