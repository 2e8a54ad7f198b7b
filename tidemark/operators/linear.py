"""Linear models from sufficient statistics: one pass over the table, any number of fits.

A ridge fit needs only counts, means and centred cross products of its columns. They are aggregated once per slot (a day,
a regime, a part of a split); the statistics of any set of slots are a sum of theirs, so every fold, penalty, left-out
feature group and regime is a small solve, and so is its validation error. The table is never read again.

The number of aggregates grows with the square of the number of columns: meant for a few dozen features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MOMENTS = "n long, mean array<double>, cross array<double>"


def pair_places(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def moments(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, means and centred cross products (upper triangle, row by row) of the columns per group."""
    n = F.count(F.lit(1))
    pairs = [F.covar_pop(columns[i], columns[j]) for i, j in pair_places(len(columns))]
    sums = df.groupBy(*groups).agg(n.alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*pairs).alias("cross"))
    return sums.withColumn("cross", F.transform("cross", lambda c: c * F.col("n")))


@dataclass
class Moments:
    """Count, means and centred cross products of columns; the label is the last."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @staticmethod
    def of(rows: pd.DataFrame, d: int) -> "Moments":
        """The statistics of all rows of a moments table together."""
        out = Moments(0, np.zeros(d), np.zeros((d, d)))
        for n, mean, cross in zip(rows["n"], rows["mean"], rows["cross"]):
            square = np.zeros((d, d))
            for (i, j), value in zip(pair_places(d), cross):
                square[i, j] = square[j, i] = value
            out = out + Moments(int(n), np.asarray(mean, float), square)
        return out

    def __add__(self, other: "Moments") -> "Moments":
        if not self.n or not other.n:
            return other if not self.n else self
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.cross + other.cross + np.outer(d, d) * (self.n * other.n / n))

    def ridge(self, penalty: float, kept: Sequence[int]) -> "Fit":
        """Weights of the kept columns for the last one. The penalty is on columns of unit spread; a constant column has
        weight 0."""
        d = len(self.mean) - 1
        weights = np.zeros(d)
        variance = np.diag(self.cross) / max(self.n, 1)
        # rounding leaves a constant a spread of about 1e-16 of its size
        kept = [i for i in kept if variance[i] > 1e-24 * self.mean[i] ** 2]
        if kept and variance[d] > 0:
            spread, label = np.sqrt(variance[kept]), np.sqrt(variance[d])
            inner = self.cross[np.ix_(kept, kept)] / self.n / np.outer(spread, spread)
            outer = self.cross[kept, d] / self.n / spread / label
            weights[kept] = np.linalg.solve(inner + penalty / label * np.eye(len(kept)), outer) * label / spread
        return Fit(weights, float(self.mean[d] - weights @ self.mean[:d]) if self.n else 0.0)


@dataclass
class Fit:
    weights: np.ndarray
    intercept: float

    def mse(self, on: Moments) -> float | None:
        """Mean squared error on the rows behind some statistics."""
        if not on.n:
            return None
        d = len(self.weights)
        w = np.append(-self.weights, 1.0)  # error = label - weights x - intercept
        return float(w @ on.cross @ w / on.n + (w @ on.mean - self.intercept) ** 2) if d else None


def coefficients(df: DataFrame, features: Sequence[str], label: str, penalty: float) -> DataFrame:
    """One row: weights (array) and intercept of a ridge fit over the table."""
    d = len(features) + 1

    def solve(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fit = Moments.of(rows, d).ridge(penalty, range(d - 1))
        return pd.DataFrame({"weights": [fit.weights.tolist()], "intercept": [fit.intercept]})

    table = moments(df.withColumn("_all", F.lit(1)), ["_all"], [*features, label])
    return table.groupBy("_all").applyInPandas(solve, "weights array<double>, intercept double")


def prediction(features: Sequence[str], weights: Column, intercept: Column) -> Column:
    total = intercept
    for i, feature in enumerate(features):
        total = total + F.get(weights, F.lit(i)) * F.col(feature)
    return total


FITS = "fold int, penalty double, dropped string, n_train long, n_val long, mse double, mse_zero double"


def validated(df: DataFrame, slot: str, folds: Sequence[tuple], features: Sequence[str], label: str, penalties: Sequence[float] = (1.0,),
              without: Mapping[str, Sequence[str]] | None = None, by: str | None = None) -> DataFrame:
    """Error of every ridge fit on its fold's validation rows, beside that of no correction: by fold, penalty and left-out
    feature group, and per value of ``by``.

    ``slot`` is an ordered column of few values, such as a day. Folds are (last training slot, first and last validation
    slot). The table is read once; what remains is a row per slot, and one small task per value of ``by``.
    """
    d = len(features) + 1
    groups = {"none": (), **(without or {})}
    kept = {name: [i for i, f in enumerate(features) if f not in dropped] for name, dropped in groups.items()}

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for fold, (last, first_val, last_val) in enumerate(folds, 1):
            train = Moments.of(rows[rows["_slot"] <= last], d)
            val = Moments.of(rows[(rows["_slot"] >= first_val) & (rows["_slot"] <= last_val)], d)
            zero = Fit(np.zeros(d - 1), 0.0).mse(val)
            for penalty in penalties:
                for name, columns in kept.items():
                    error = train.ridge(penalty, columns).mse(val) if train.n else None
                    out.append((key[0], fold, float(penalty), name, train.n, val.n, error, zero))
        names = ["_by", *[c.split()[0] for c in FITS.split(", ")]]
        return pd.DataFrame(out, columns=names).astype({"mse": "float64", "mse_zero": "float64"})

    keyed = df.withColumns({"_by": F.col(by).cast("string") if by else F.lit("all"), "_slot": F.col(slot)})
    table = moments(keyed, ["_by", "_slot"], [*features, label])
    out = table.groupBy("_by").applyInPandas(solve, f"_by string, {FITS}")
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")


# -- the same in SQL, for twins ------------------------------------------------------------------------


def ridge_sql(source: str, features: Sequence[str], label: str, penalty: str, name: str = "fit", keys: Sequence[str] = ()) -> str:
    """Common table expressions that end in ``name`` with columns w0, w1, ... and b per ``keys``: moments of ``source``,
    elimination column by column, and substitution back. ``penalty`` is a number or an aggregate."""
    d, by = len(features), ", ".join(keys)
    head, group = (f"{by}, ", f" GROUP BY {by}") if keys else ("", "")
    cols = [f"sqrt(var_pop({f})) AS s{i}, avg({f}) AS m{i}" for i, f in enumerate(features)]
    cols += [f"corr({features[i]}, {features[j]}) AS a{i}_{j}" for i in range(d) for j in range(i + 1, d)] + [f"corr({f}, {label}) AS r{i}" for i, f in enumerate(features)]
    out = f"{name}_m AS (SELECT {head}sqrt(var_pop({label})) AS sy, avg({label}) AS my, {penalty} AS lam, {', '.join(cols)} FROM {source}{group})"
    diagonal = ", ".join(f"1 + lam / sy AS a{i}_{i}" for i in range(d))
    out += f", {name}_0 AS (SELECT *, {diagonal} FROM {name}_m)"
    for k in range(d - 1):
        new = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, d) for j in range(i, d)] + [f"r{i} - a{k}_{i} * r{k} / a{k}_{k} AS r{i}" for i in range(k + 1, d)]
        out += f", {name}_{k + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {name}_{k})"
    last = f"{name}_{d - 1}"
    for i in reversed(range(d)):
        rest = "".join(f" - a{i}_{j} * z{j}" for j in range(i + 1, d))
        out += f", {name}_z{i} AS (SELECT *, (r{i}{rest}) / a{i}_{i} AS z{i} FROM {last})"
        last = f"{name}_z{i}"
    weights = [f"z{i} * sy / s{i}" for i in range(d)]
    return out + f", {name} AS (SELECT {head}{', '.join(f'{w} AS w{i}' for i, w in enumerate(weights))}, my - ({' + '.join(f'{w} * m{i}' for i, w in enumerate(weights))}) AS b FROM {last})"
