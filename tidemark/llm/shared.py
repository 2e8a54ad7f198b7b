"""Helpers the operators of this package share: tables, worker caches, byte-level words and their hashes."""

from __future__ import annotations

import gc
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import configure, scratch

ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings; rows hold whole texts, so few of them make a batch for Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: later jobs start from files, not from the history."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def among(df: DataFrame, ids: DataFrame, column: str, inside: bool = True, most: int = 2_000_000) -> DataFrame:
    """Rows of `df` whose `column` is (or is not) among `ids`, a written table of that one column.

    The ids are sent to all tasks if they were counted to be `most` at most (16 MB); otherwise both sides are shuffled.
    """
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, column, "left_semi" if inside else "left_anti")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def per_worker(kind: str, key: object, make: Callable[[], object]) -> object:
    """A value kept by the Python worker between tasks. Task functions travel by value, so their globals do not.

    Workers outlive queries: values of one `kind` make room when another kind is asked for.
    """
    store = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    if getattr(store, "kind", None) != kind:
        store.kind, store.kept = kind, {}
        gc.collect()
    if key not in store.kept:
        store.kept[key] = make()
    return store.kept[key]


def shared_object(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a bounded object; the function returned gives it to tasks, unpacked once per worker.

    Workers outlive queries, so a worker keeps the two objects it used last.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    name = uuid.uuid4().hex

    def get() -> object:
        kept = per_worker("model", "shared", dict)
        if name not in kept:
            while len(kept) > 1:
                del kept[next(iter(kept))]
            kept[name] = cloudpickle.loads(sent.value)
        return kept[name]

    return get


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalising mixer over unsigned 64-bit values; a bijection for every seed."""
    with np.errstate(over="ignore"):
        z = x + ODD * np.uint64(2 * seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, by doubling; the first four million are kept per worker."""
    kept = per_worker("model", ("powers", base), lambda: [np.ones(1, np.uint64)])
    powers = kept[0]
    while powers.size <= n:
        with np.errstate(over="ignore"):
            powers = np.concatenate([powers, powers * (powers[-1] * np.uint64(base))])
        if powers.size <= 1 << 22:
            kept[0] = powers
    return powers[: n + 1]


BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)


class Words:
    """The words of a run of texts: maximal runs of other bytes than ASCII white space, A-Z in lower case.

    `doc` is the text each word belongs to, `start` and `end` its place in `data`, the cleaned bytes in which words of
    one text are separated by one space and texts by nothing.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        blank = SPACE[data]
        edge = np.zeros(data.size + 1, bool)  # a text starts here
        edge[offsets[:-1]] = True
        solid = ~blank
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        first = solid & (~before | edge[:-1])
        starts = np.flatnonzero(first)
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        last = solid & (~after | edge[1:])
        ends = np.flatnonzero(last) + 1
        doc = np.searchsorted(offsets, starts, side="right") - 1
        sizes = ends - starts
        # words closed up with one space behind each
        out_start = np.zeros(starts.size, np.int64)
        np.cumsum(sizes[:-1] + 1, out=out_start[1:])
        keep = solid.copy()
        total = int((sizes + 1).sum())
        clean = np.full(total, 32, np.uint8)
        target = np.ones(total, bool)
        target[out_start + sizes] = False
        clean[target] = data[keep]
        self.n_texts = offsets.size - 1
        self.data, self.doc, self.start, self.end = clean, doc, out_start, out_start + sizes

        values = clean.astype(np.uint64) + np.uint64(1)
        self._sums = np.zeros(values.size + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * _powers(values.size, BASE)[:-1], out=self._sums[1:])

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges of `data`."""
        with np.errstate(over="ignore"):
            raw = (self._sums[end] - self._sums[start]) * _powers(self.data.size, INVERSE)[start] + (end - start).astype(np.uint64) * ODD
        return mix(raw)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of `width` words of a text; of all its words, if it has fewer."""
        n = max(0, self.start.size - width + 1)
        first = np.flatnonzero(self.doc[:n] == self.doc[width - 1 : width - 1 + n])
        counts = np.bincount(self.doc, minlength=self.n_texts)
        ends = np.cumsum(counts)
        short = np.flatnonzero((counts > 0) & (counts < width))
        begin = np.concatenate([first, ends[short] - counts[short]])
        last = np.concatenate([first + width - 1, ends[short] - 1])
        return self.doc[begin], self.hash_of(self.start[begin], self.end[last])


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about `most` units together; one larger row is a range of its own."""
    lo, total = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += int(size)
    if lo < len(sizes):
        yield lo, len(sizes)


def text_blocks(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column in blocks of about `most` bytes; null counts as empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    for lo, hi in blocks(np.diff(offsets), most):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def rows_out(schema: pa.Schema, columns: Iterable[object]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema, strict=True)], schema=schema)


def tree_sum(df: DataFrame, key: str, value: str, numpy_type: str, fan_in: int = 64) -> DataFrame:
    """Sum arrays kept as bytes: rows (task, `key`, `value`), added up by `fan_in` tasks at a time, so that no group
    grows with the number of tasks. Returns (key, value)."""

    def add(pdf):
        total = np.frombuffer(pdf[value].iloc[0], numpy_type).copy()
        for other in pdf[value].iloc[1:]:
            total += np.frombuffer(other, numpy_type)
        return pdf.iloc[:1].assign(**{value: [total.tobytes()]})

    tasks = (df.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        df = df.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).select("task", key, value)
        df = df.groupBy("task", key).applyInPandas(add, df.schema)
        tasks = -(-tasks // fan_in)
        if tasks <= 1:
            return df.select(key, value)
