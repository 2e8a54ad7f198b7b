"""Nearest vectors by multiprobe p-stable hashing.

Vectors are scaled to length one, where the nearest by distance is the nearest by cosine. A table hashes a vector to
the cell of `functions` random projections, each cut into steps of `width`. A neighbour at the usual distance lies in a
nearby cell with a probability the normal law gives from the query's place in its own cell; cells are probed in falling
order of it until their sum reaches `success`. Cells of all tables are searched in blocks, and each block returns its
nearest by the exact cosine of the original vectors. Equal vectors are searched once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import written

BLOCK = 1024  # vectors, and queries, of a cell that meet in one task
SLACK = 1e-9  # cosines of unit vectors by matrix product are this exact at least


class Hash:
    def __init__(self, dims: int, tables: int, functions: int, width: float, radius: float, success: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.project = rng.normal(size=(tables, dims, functions))
        self.shift = rng.uniform(0, width, size=(tables, functions))
        self.width, self.radius, self.success = width, radius, success
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=functions)))

    def cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells of unit vectors and their places within them, 0 to 1."""
        at = (x @ self.project[table] + self.shift[table]) / self.width
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    @staticmethod
    def key(cell: np.ndarray) -> np.ndarray:
        """One number per cell; steps are far fewer than 4096 either way, as projections of unit vectors are normal."""
        out = np.zeros(cell.shape[:-1], np.int64)
        for j in range(cell.shape[-1]):
            out = out * 8209 + cell[..., j] + 4096
        return out

    def probes(self, place: np.ndarray) -> list[np.ndarray]:
        """For each query the moves to take, likeliest first, until `success` is reached."""
        step = self.width / self.radius
        normal = np.vectorize(lambda v: 0.5 * math.erfc(-v / 2**0.5))
        below, above = normal(-place * step), normal(-(1 - place) * step)
        chance = np.stack([below, 1 - below - above, above])  # by move -1, 0, 1
        weight = np.ones((place.shape[0], len(self.moves)))
        for j in range(place.shape[1]):
            weight *= chance[self.moves[:, j] + 1, :, j].T
        order = np.argsort(-weight, axis=1, kind="stable")
        total = np.cumsum(np.take_along_axis(weight, order, axis=1), axis=1)
        return [order[i, : np.searchsorted(total[i], self.success * total[i, -1]) + 1] for i in range(len(order))]


def unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(rows).astype(float)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of vectors that are not null, zero or holding null or non-finite components, of the commonest length."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def usual_distance(distinct: DataFrame, n: int, sample: int) -> float:
    """Median distance to the fifth nearest among about `sample` unit vectors, picked by a hash."""
    draw = F.pmod(F.xxhash64("rep", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    rows = sorted((r["rep"], r["v"]) for r in distinct.where(draw < sample / max(n, 1)).collect())
    if len(rows) < 7:
        return 1.0
    _, x = unit([r[1] for r in rows])
    nearest = np.sort(x @ x.T, axis=1)[:, -6]
    return float(max(0.05, np.median(np.sqrt(np.maximum(2 - 2 * nearest, 0)))))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, tables: int = 6, functions: int = 4, width: float = 1.5, success: float = 0.42, sample: int = 2000,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found for every row whose id is divisible by `every`, by cosine.

    Ties go to the smaller id; a query never finds its own row, but equal vectors under other ids. Null ids, vectors
    without a direction and vectors of another length than the commonest take no part; repeated rows of one id and vector count once, of one id with different vectors
    each. A query that meets fewer vectors than it could is searched in all cells, so `k` rows come back wherever the
    table has as many others.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vec_col).distinct(), "vectors")
    # the k + 1 smallest ids of every distinct vector are all a query can need of it
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    reps = ranked.where("r = 1").select(F.col("vec_id").alias("rep"), "v")
    distinct = written(reps, "distinct")
    n = distinct.count()
    first = distinct.first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashing = Hash(len(first["v"]), tables, functions, width, usual_distance(distinct, n, sample), success)
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = written(distinct.join(queries.select("v").distinct(), "v", "left_semi"), "asked")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, x = unit(batch.column("v").to_pylist())
                for t in range(tables):
                    key = hashing.key(hashing.cells(x, t)[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(key), batch.column("rep"), batch.column("v")], names=["t", "key", "rep", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, x = unit(batch.column("v").to_pylist())
                for t in range(tables):
                    cell, place = hashing.cells(x, t)
                    chosen = hashing.probes(place)
                    who = np.repeat(np.arange(len(x)), [c.size for c in chosen])
                    key = hashing.key(cell[who] + hashing.moves[np.concatenate(chosen)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(who.size, t, np.int32)), pa.array(key), batch.column("rep").take(pa.array(who))], names=["t", "key", "q"])

    indexed = written(distinct.mapInArrow(index, "t int, key long, rep long, v array<double>"), "index")
    cells = written(indexed.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "cells")
    vector_of = asked.select(F.col("rep").alias("q"), F.col("v").alias("qv"))

    def search(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "rep": [], "score": []})
        a, ua = unit(left["qv"].tolist())
        b, ub = unit(right["v"].tolist())
        # all that may be among the nearest, so that exact scores and ids decide between equals
        take, rep = min(k + 1, len(b)), right["rep"].to_numpy()
        near = ua @ ub.T
        least = np.partition(near, len(b) - take, axis=1)[:, len(b) - take]
        qi, ri = np.nonzero(near >= least[:, None] - SLACK)
        dots = (a[qi] * b[ri]).sum(axis=1)
        score = dots / (np.sqrt((a * a).sum(axis=1))[qi] * np.sqrt((b * b).sum(axis=1))[ri])
        order = np.lexsort((rep[ri], -score, qi))
        order = order[np.arange(order.size) - np.searchsorted(qi[order], qi[order], side="left") < take]
        return pd.DataFrame({"q": left["q"].to_numpy()[qi[order]], "rep": rep[ri[order]], "score": score[order]})

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def searched(probes: DataFrame) -> DataFrame:
        """Vectors and queries of every probed cell meet block by block."""
        probes = written(probes, "probes")
        asked_cells = probes.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).alias("asking"))
        grid = written(cells.join(asked_cells, ["t", "key"]), "grid")
        left = probes.join(grid, ["t", "key"]).withColumn("c", F.pmod(F.xxhash64("q"), "asking")).withColumn("b", upto("blocks")).join(vector_of, "q")
        right = indexed.join(grid, ["t", "key"]).withColumn("b", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("c", upto("asking"))
        keys = ["t", "key", "b", "c"]
        pairs = left.select(*keys, "q", "qv").groupBy(*keys).cogroup(right.select(*keys, "rep", "v").groupBy(*keys)).applyInPandas(search, "q long, rep long, score double")
        return pairs.groupBy("q", "rep").agg(F.max("score").alias("score"))

    # the nearest k + 1 distinct vectors, the query's own among them
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = written(searched(asked.mapInArrow(probe, "t int, key long, q long")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"), "best")
    short = asked.select(F.col("rep").alias("q")).join(best.groupBy("q").count(), "q", "left").where(F.coalesce("count", F.lit(0)) < min(k + 1, n)).select("q", F.lit(0).alias("t"))
    short = written(short, "short")
    if not short.isEmpty():
        rest = searched(short.join(cells.where("t = 0").select("t", "key"), "t"))  # every vector is in one cell of the first table
        best = best.join(short, "q", "left_anti").unionByName(rest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"))

    ids = ranked.select(F.col("vec_id"), F.first("vec_id").over(Window.partitionBy("v").orderBy("vec_id")).alias("rep"))
    asking = queries.select(F.col("vec_id").alias("query_id"), "v").join(asked.select("v", F.col("rep").alias("q")), "v").select("query_id", "q")
    found = best.join(ids, "rep").select("q", "vec_id", "score").groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("all"))
    mine = asking.join(found, "q").select("query_id", F.slice(F.filter("all", lambda e: e["vec_id"] != F.col("query_id")), 1, k).alias("all"))
    out = mine.select("query_id", F.posexplode("all").alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
