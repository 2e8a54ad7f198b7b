"""Ordered computation over keyed series of any length.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole series in one task, so a series that
holds a third of all rows decides the run time.  ``Series`` splits long series into ordered blocks
of bounded size and carries the state between blocks:

* ``running``  - unbounded frames (fill, cumulative sum / max / count, totals) in two phases: one small
  aggregate per block, then local windows combined with the state carried in from earlier blocks;
* ``frames``   - finite row frames (lag, rolling mean, ...): blocks overlap by the frame length;
* ``ewm``      - exponentially weighted means: local scaled sums plus the carry of the block before.

A table with a column ``__rn``, the zero-based place of each row in its series, is taken as numbered: ``frames`` and
``ewm`` then need no pass to number rows, no count and no checkpoint, and keep the column.

The order columns must be a total order inside a key.  ``rows`` may give an upper bound of the size, which saves
counting a derived table.  Inputs up to ``rows_per_task`` rows are
computed by the plain window directly; the size is counted, never assumed.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import correlation
from tidemark.session import cut_lineage

ROWS_PER_TASK = int(os.environ.get("TIDEMARK_ROWS_PER_TASK", 1_000_000))  # lowered to test the blocked paths
BROADCAST_BLOCKS = 4096  # carries, at most two rows per block, are broadcast up to this many blocks

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Running:
    """One computation over a whole series.

    sum, count, max, min, last: over the rows up to this one; next: first known value from this row on;
    after: value of the row that follows; total: sum over the series.
    """

    kind: str
    value: Column | None = None


@dataclass(frozen=True)
class Moving:
    """An aggregate of the last ``n`` rows, null until ``need`` values are known, in constant work per row.

    Spark evaluates a sliding frame from scratch for every row.  Here rows are numbered into chunks of ``n``: a window
    is the tail of one chunk plus the head of the next, both of which are growing frames.
    """

    kind: str  # sum, mean, std, skew, kurt, corr, max or min
    value: Column
    n: int
    need: int
    other: Column | None = None  # for corr

    def pieces(self, window) -> Column:
        x, y = self.value, self.other
        if self.kind == "corr":  # pairs only
            x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        frame = window.rowsBetween(FIRST, 0)
        out = {"c": F.count(x)}
        if self.kind in ("sum", "mean"):
            out["s"] = F.sum(x)
        elif self.kind in ("max", "min"):
            out["x"] = {"max": F.max, "min": F.min}[self.kind](x)
        else:
            out |= {"m": F.avg(x), "v": F.var_pop(x)}
            if self.kind in ("skew", "kurt"):
                out |= {"g": F.skewness(x), "k": F.kurtosis(x)}
            elif self.kind == "corr":
                out |= {"my": F.avg(y), "vy": F.var_pop(y), "cov": F.covar_pop(x, y)}
        return F.struct(*[agg.over(frame).alias(name) for name, agg in out.items()])

    def _moments(self, head: Column, tail: Column) -> Column:
        """Central moments of two parts together, from their counts, means and moments."""
        a, b = head["c"].cast("double"), F.coalesce(tail["c"], F.lit(0)).cast("double")
        n, known = F.nullif(a + b, F.lit(0.0)), lambda part, name: F.coalesce(part[name], F.lit(0.0))
        d = F.coalesce(tail["m"] - head["m"], F.lit(0.0))

        def square(part, size, name="v"):
            return size * known(part, name)

        m2 = square(head, a) + square(tail, b) + d * d * a * b / n
        if self.kind == "std":
            return F.when(n > 1, F.sqrt(m2 / F.nullif(n - 1, F.lit(0.0))))
        if self.kind == "corr":
            dy = F.coalesce(tail["my"] - head["my"], F.lit(0.0))
            m2y = square(head, a, "vy") + square(tail, b, "vy") + dy * dy * a * b / n
            both = square(head, a, "cov") + square(tail, b, "cov") + d * dy * a * b / n
            return F.when((m2 > 0) & (m2y > 0), both / F.sqrt(F.nullif(m2 * m2y, F.lit(0.0))))

        def cube(part, size):
            v = square(part, size)
            return F.coalesce(known(part, "g") * v * F.sqrt(v) / F.sqrt(F.nullif(size, F.lit(0.0))), F.lit(0.0))

        def fourth(part, size):
            v = square(part, size)
            return F.when(v > 0, (known(part, "k") + 3) * v * v / F.nullif(size, F.lit(0.0))).otherwise(0.0)

        va, vb, ca, cb = square(head, a), square(tail, b), cube(head, a), cube(tail, b)
        if self.kind == "skew":
            m3 = ca + cb + d * d * d * a * b * (a - b) / (n * n) + 3 * d * (a * vb - b * va) / n
            return F.when(m2 > 0, F.sqrt(n) * m3 / F.nullif(m2 * F.sqrt(m2), F.lit(0.0)))
        m4 = (fourth(head, a) + fourth(tail, b) + d * d * d * d * a * b * (a * a - a * b + b * b) / (n * n * n)
              + 6 * d * d * (a * a * vb + b * b * va) / (n * n) + 4 * d * (a * cb - b * ca) / n)
        return F.when(m2 > 0, n * m4 / F.nullif(m2 * m2, F.lit(0.0)) - 3)

    def combined(self, head: Column, tail: Column) -> Column:
        c2 = F.coalesce(tail["c"], F.lit(0))
        count = head["c"] + c2
        if self.kind in ("sum", "mean"):
            total = F.when(head["s"].isNull(), tail["s"]).when(tail["s"].isNull(), head["s"]).otherwise(head["s"] + tail["s"])
            value = total if self.kind == "sum" else F.try_divide(total, count)
        elif self.kind in ("max", "min"):
            value = {"max": F.greatest, "min": F.least}[self.kind](head["x"], tail["x"])
        else:
            value = self._moments(head, tail)
        return F.when(count >= self.need, value)


def _same(names: Sequence[str], left: str, right: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition &= F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


class Series:
    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        rows_per_task: int = ROWS_PER_TASK,
        rows: int | None = None,
    ):
        self.df = df
        self.keys = list(keys)
        self.order = list(order)
        self.rows_per_task = rows_per_task
        self._rows = rows

    # -- layout ---------------------------------------------------------------------------------

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    @property
    def small(self) -> bool:
        return self.rows <= self.rows_per_task

    @property
    def has_places(self) -> bool:
        return "__rn" in self.df.columns

    def _with(self, df: DataFrame) -> "Series":
        """The same rows with more columns: the size stays valid."""
        return Series(df, self.keys, self.order, self.rows_per_task, self._rows)

    def _blocked(self, df: DataFrame) -> DataFrame:
        """Rows dealt by ranges of (keys, order), with the number of the range as ``__block``.

        The checkpoint makes the ranges the same for everything that reads them, and the input is computed once.
        """
        blocks = math.ceil(self.rows / self.rows_per_task)
        ranged = df.repartitionByRange(blocks, *self.keys, *self.order)
        return cut_lineage(ranged.withColumn("__block", F.spark_partition_id()))

    # -- unbounded frames -----------------------------------------------------------------------

    def running(self, **exprs: Running) -> DataFrame:
        """Add one column per keyword, each over the whole series up to (or, for next, from) the row."""
        if self.small:
            ways = _both_ways(self.keys, self.order)
            return self.df.withColumns({name: _over(e, *ways) for name, e in exprs.items()})

        # The value of the row after may be null, so it travels in a struct that is not.
        inputs = {
            f"_in_{name}": F.struct(e.value.alias("v")) if e.kind == "after" else e.value
            for name, e in exprs.items() if e.value is not None
        }
        df = self._blocked(self.df.withColumns(inputs))
        ordering = F.struct(*self.order)
        summary = df.groupBy(*self.keys, "__block").agg(
            *[_summary(name, e, ordering) for name, e in exprs.items()]
        )
        by_block = Window.partitionBy(*self.keys).orderBy("__block")
        carries = summary.withColumns(
            {
                **{f"_carry_{name}": _carry(name, e, by_block) for name, e in exprs.items()},
                "_blocks": F.count(F.lit(1)).over(Window.partitionBy(*self.keys)),
            }
        )
        # Only series that span a cut need a carry: at most two rows per block.
        carries = carries.where("_blocks > 1").select(
            *self.keys, "__block", *[f"_carry_{name}" for name in exprs]
        )
        ways = _both_ways([*self.keys, "__block"], self.order)
        df = df.withColumns(
            {
                f"_local_{name}": _over(Running(e.kind, None if e.value is None else F.col(f"_in_{name}")), *ways)
                for name, e in exprs.items()
            }
        )
        names = self.keys + ["__block"]
        few = math.ceil(self.rows / self.rows_per_task) <= BROADCAST_BLOCKS
        carries = F.broadcast(carries) if few else carries
        joined = df.alias("l").join(carries.alias("r"), _same(names, "l", "r"), "left")
        return joined.select(
            *[F.col(f"l.{name}") for name in self.df.columns],
            *[
                _combine(e.kind, F.col(f"r._carry_{name}"), F.col(f"l._local_{name}")).alias(name)
                for name, e in exprs.items()
            ],
        )

    def numbered(self, name: str = "__rn") -> "Series":
        """Add the zero-based position of each row inside its series."""
        return self._with(
            self.running(**{name: Running("count")}).withColumn(name, F.col(name) - 1)
        )

    # -- finite frames --------------------------------------------------------------------------

    def frames(
        self,
        *steps: Mapping[str, Callable[[Window], Column] | Column],
        before: int,
        after: int = 0,
    ) -> DataFrame:
        """Evaluate window columns that look at most ``before`` rows back and ``after`` ahead.

        Each step is a mapping of column name to a function of the ordered window; later steps may
        use the columns of earlier ones, so ``before`` is the sum of the depths.
        """
        if not self.has_places and self.small:
            return _apply(self.df, steps, self.keys, self.order)

        df = self.df if self.has_places else self.numbered().df
        size = max(self.rows_per_task, before + after + 1)
        block, offset = F.floor(F.col("__rn") / size), F.col("__rn") % size
        copies = F.filter(
            F.array(
                F.struct(block.alias("__block"), F.lit(True).alias("__own")),
                F.when(offset >= size - before, F.struct((block + 1).alias("__block"), F.lit(False).alias("__own"))),
                F.when(offset < after, F.struct((block - 1).alias("__block"), F.lit(False).alias("__own"))),
            ),
            lambda copy: copy.isNotNull(),
        )
        df = df.select("*", F.inline(copies))
        done = _apply(df, steps, [*self.keys, "__block"], ["__rn"])
        return done.where("__own").drop("__block", "__own", *([] if self.has_places else ["__rn"]))

    # -- exponentially weighted means -------------------------------------------------------------

    def ewm(self, **columns: tuple[str, float]) -> DataFrame:
        """Adjusted exponential means; each keyword is (value column, span).

        With d = 1 - 2 / (span + 1), y_t = sum(d^i x_{t-i}) / sum(d^i).  A missing input adds nothing but
        still advances the position.  A block spans 40 to 600 e-foldings of the weight: short enough
        for d^-i to stay finite, long enough that only the block before still counts in a double.
        """
        df = self.df if self.has_places else self.numbered().df
        for size, group in _ewm_groups(columns, self.rows_per_task):
            df = self._ewm_group(df, size, group)
        return df if self.has_places else df.drop("__rn")

    def _ewm_group(self, df: DataFrame, size: int, group: Mapping[str, tuple[str, float]]) -> DataFrame:
        """Columns that share a block size: one window pass and at most one join for the carries."""
        columns = df.columns
        df = df.withColumns({"__blk": F.floor(F.col("__rn") / size), "__off": F.col("__rn") % size})
        window = Window.partitionBy(*self.keys, "__blk").orderBy("__rn").rowsBetween(FIRST, 0)
        local, ends = {}, []
        for name, (value, rate) in group.items():
            x, grow = F.col(value).cast("double"), F.exp(F.col("__off") * rate)
            fade = F.exp((F.col("__off") - (size - 1)) * rate)
            local[f"_num_{name}"] = F.sum(x * grow).over(window) / grow
            local[f"_den_{name}"] = F.sum(F.when(x.isNotNull(), grow)).over(window) / grow
            ends += [F.sum(x * fade).alias(f"_num_in_{name}"), F.sum(F.when(x.isNotNull(), fade)).alias(f"_den_in_{name}")]
        out = df.withColumns(local)
        if self.has_places or self.rows > size:
            carry = df.groupBy(*self.keys, (F.col("__blk") + 1).alias("__blk")).agg(*ends)
            out = out.alias("l").join(carry.alias("r"), _same(self.keys + ["__blk"], "l", "r"), "left")
            decay = {n: F.exp(-(F.col("l.__off") + 1) * rate) for n, (_, rate) in group.items()}
            part = {
                side: {n: _zero(F.col(f"l._{side}_{n}")) + _zero(F.col(f"r._{side}_in_{n}") * decay[n]) for n in group}
                for side in ("num", "den")
            }
            kept = [F.col(f"l.`{c}`") for c in columns]
        else:
            part = {side: {n: F.col(f"_{side}_{n}") for n in group} for side in ("num", "den")}
            kept = [F.col(f"`{c}`") for c in columns]
        return out.select(*kept, *[F.when(part["den"][n] > 0, part["num"][n] / part["den"][n]).alias(n) for n in group])


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _ewm_groups(columns: Mapping[str, tuple[str, float]], rows_per_task: int) -> list[tuple[int, dict]]:
    """Spans whose valid block sizes overlap share one size: fewer passes over the table."""
    groups: list[tuple[int, dict]] = []
    low = high = 0.0
    for name, (value, span) in sorted(columns.items(), key=lambda item: item[1][1]):
        rate = -math.log(1.0 - 2.0 / (span + 1.0))
        if groups and 40.0 / rate <= high:
            low = max(low, 40.0 / rate)
        else:
            groups.append((0, {}))
            low, high = 40.0 / rate, 600.0 / rate
        groups[-1][1][name] = (value, rate)
        groups[-1] = (max(math.ceil(low), min(rows_per_task, int(high))), groups[-1][1])
    return groups


# -- pieces of the two phases ---------------------------------------------------------------------


def _both_ways(keys: Sequence[str], order: Sequence[str]):
    """The same partition in ascending and in exactly reversed order."""
    part = Window.partitionBy(*keys)
    return part.orderBy(*order), part.orderBy(*[F.col(o).desc() for o in order])


def _over(e: Running, window, reverse) -> Column:
    upto = window.rowsBetween(FIRST, 0)
    if e.kind == "count":
        return F.count(F.lit(1) if e.value is None else e.value).over(upto)
    if e.kind == "last":
        return F.last(e.value, ignorenulls=True).over(upto)
    if e.kind == "next":  # in reversed order the frame only grows; one that shrinks is recomputed per row
        return F.last(e.value, ignorenulls=True).over(reverse.rowsBetween(FIRST, 0))
    if e.kind == "after":
        return F.lead(e.value).over(window)
    if e.kind == "total":
        return F.sum(e.value).over(window.rowsBetween(FIRST, LAST))
    return {"sum": F.sum, "max": F.max, "min": F.min}[e.kind](e.value).over(upto)


def _summary(name: str, e: Running, ordering: Column) -> Column:
    value = F.lit(1) if e.value is None else F.col(f"_in_{name}")
    known = F.when(value.isNotNull(), ordering)
    agg = {
        "count": lambda: F.count(value),
        "sum": lambda: F.sum(value),
        "total": lambda: F.sum(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "last": lambda: F.max_by(value, known),
        "next": lambda: F.min_by(value, known),
        "after": lambda: F.min_by(value, ordering),
    }[e.kind]()
    return agg.alias(f"_sum_{name}")


def _carry(name: str, e: Running, window) -> Column:
    value, past, later = F.col(f"_sum_{name}"), window.rowsBetween(FIRST, -1), window.rowsBetween(1, LAST)
    if e.kind in ("count", "sum"):
        return F.sum(value).over(past)
    if e.kind == "max":
        return F.max(value).over(past)
    if e.kind == "min":
        return F.min(value).over(past)
    if e.kind == "last":
        return F.last(value, ignorenulls=True).over(past)
    if e.kind in ("next", "after"):
        return F.first(value, ignorenulls=e.kind == "next").over(later)
    return F.coalesce(F.sum(value).over(past), F.sum(value).over(later)) + F.when(
        F.sum(value).over(past).isNotNull() & F.sum(value).over(later).isNotNull(), F.sum(value).over(later)
    ).otherwise(F.lit(0))


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("count", "sum", "total"):
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "after":
        return F.coalesce(local, carry)["v"]
    return F.coalesce(local, carry)


def _apply(df: DataFrame, steps, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    for step in steps:
        moving = {name: f for name, f in step.items() if isinstance(f, Moving)}
        plain = {name: f for name, f in step.items() if name not in moving}
        if plain:
            df = df.withColumns({name: f(window) if callable(f) else f for name, f in plain.items()})
        for n in sorted({m.n for m in moving.values()}):
            df = _move(df, {name: m for name, m in moving.items() if m.n == n}, n, keys, order, window)
    return df


def _move(df: DataFrame, items: Mapping[str, Moving], n: int, keys: Sequence[str], order: Sequence[str], window) -> DataFrame:
    """Tail of the chunk before and head of the own chunk, for windows of one length."""
    columns = df.columns
    # numbered rows need no pass of their own for their place
    place = F.col("__rn") if list(order) == ["__rn"] else F.row_number().over(window) - 1
    df = df.withColumn("__pos", place).withColumn("__chunk", F.floor(F.col("__pos") / n))
    ahead, back = _both_ways([*keys, "__chunk"], order)
    # backwards first: the frames ahead and the look back at the tails then share one order of the rows
    df = df.withColumns({f"_tail_{name}": m.pieces(back) for name, m in items.items()})
    df = df.withColumns({f"_head_{name}": m.pieces(ahead) for name, m in items.items()})
    along = Window.partitionBy(*keys).orderBy("__chunk", *order)
    # A window that is exactly its chunk has no tail.
    partial = F.col("__pos") % n < n - 1
    df = df.withColumns({f"_tail_{name}": F.when(partial, F.lag(f"_tail_{name}", n - 1).over(along)) for name in items})
    return df.select(
        *columns, *[m.combined(F.col(f"_head_{name}"), F.col(f"_tail_{name}")).alias(name) for name, m in items.items()]
    )


MOVING_ROWS = 48  # from this length on a sliding frame costs more than two growing ones
_MOVING_KINDS = {F.sum: "sum", F.avg: "mean", F.stddev_samp: "std", F.max: "max", F.min: "min", F.skewness: "skew", F.kurtosis: "kurt"}


# -- column helpers for finite frames -------------------------------------------------------------


def rolling(agg: Callable[[Column], Column], value: Column, n: int, min_rows: int | None = None):
    """Aggregate of the last ``n`` rows, null until ``min_rows`` (default ``n``) values are known.

    A step value for ``Series.frames``; long windows of common aggregates become ``Moving``.
    """
    need = n if min_rows is None else min_rows
    if n >= MOVING_ROWS and agg in _MOVING_KINDS:
        return Moving(_MOVING_KINDS[agg], value, n, need)

    def column(window) -> Column:
        frame = window.rowsBetween(-(n - 1), 0)
        return F.when(F.count(value).over(frame) >= need, agg(value).over(frame))

    return column


def rolling_corr(left: Column, right: Column, n: int, min_rows: int | None = None):
    """Correlation of two columns over the last ``n`` rows, null until ``min_rows`` (default ``n``) pairs are known."""
    need = n if min_rows is None else min_rows
    if n >= MOVING_ROWS:
        return Moving("corr", left, n, need, right)

    def column(window) -> Column:
        frame = window.rowsBetween(-(n - 1), 0)
        pairs = F.count(F.when(left.isNotNull() & right.isNotNull(), 1)).over(frame)
        return F.when(pairs >= need, correlation(left, right, lambda c: c.over(frame)))

    return column


def lag(value: str | Column, n: int = 1):
    return lambda window: F.lag(value, n).over(window)


def lead(value: str | Column, n: int = 1):
    return lambda window: F.lead(value, n).over(window)
