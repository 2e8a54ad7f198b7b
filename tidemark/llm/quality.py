"""Text quality from random-indexing word vectors and a two-layer network with calibrated probabilities.

Every word has a sparse ternary index vector drawn from its hash. A word's vector is the sum of the index vectors of
its neighbours, two words to each side, over the whole corpus. Words share a table of `rows` vectors by their hash, so
the table is as large for any corpus; tasks fill their own and the tables are added up. A document is the mean and the
spread of its words' vectors and of the likeness of neighbouring ones. The network is trained on a bounded sample of labelled documents, and its logits are
divided by the temperature that fits held-back labels best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, mix, rows_out, shared_object, text_blocks, tree_sum, written

REACH = 2
NONZERO = 4


def index_entries(hashes: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of the words' index vectors, one row each."""
    drawn = np.stack([mix(hashes, 20 + s) for s in range(NONZERO)])
    return (drawn % np.uint64(dims)).astype(np.int64), 1.0 - 2.0 * ((drawn >> np.uint64(40)) & np.uint64(1)).astype(float)


def neighbour_sums(w: Words, rows: int, dims: int) -> np.ndarray:
    """Sum of the neighbours' index vectors by table row."""
    hashes = w.hash_of(w.start, w.end)
    row = (hashes % np.uint64(rows)).astype(np.int64) * dims
    place, sign = index_entries(hashes, dims)
    total = np.zeros(rows * dims)
    for step in range(1, REACH + 1):
        left = np.flatnonzero(w.doc[:-step] == w.doc[step:])
        right = left + step
        for s in range(NONZERO):
            total += np.bincount(row[left] + place[s][right], sign[s][right], rows * dims)
            total += np.bincount(row[right] + place[s][left], sign[s][left], rows * dims)
    return total


def word_vectors(docs: DataFrame, rows: int, dims: int, text_col: str) -> np.ndarray:
    """The table of word vectors, centred and scaled to length one; `rows` x `dims` whatever the corpus."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch, "text"):
                part = neighbour_sums(Words(data, offsets), rows, dims)
                total = part if total is None else total + part
        if total is not None:
            cuts = np.array_split(total.astype("<f4"), 16)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * 16, pa.int32()), pa.array(range(16), pa.int32()),
                                              pa.array([c.tobytes() for c in cuts], pa.binary())], names=["task", "piece", "sums"])

    partial = written(docs.select(F.col(text_col).alias("text")).mapInArrow(fill, "task int, piece int, sums binary"), "word-vectors")
    pieces = sorted(tree_sum(partial, "piece", "sums", "<f4").collect())
    table = np.concatenate([np.frombuffer(p["sums"], "<f4") for p in pieces]).reshape(rows, dims) if pieces else np.zeros((rows, dims), np.float32)
    table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    table = table - table.mean(axis=0)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def n_features(table: np.ndarray) -> int:
    return 2 * table.shape[1] + 2


def pooled(w: Words, table: np.ndarray) -> np.ndarray:
    """Mean and spread of every text's word vectors, and of the likeness of neighbours; zeros for a text without words."""
    out = np.zeros((w.n_texts, n_features(table)), np.float32)
    counts = np.bincount(w.doc, minlength=w.n_texts)
    some = np.flatnonzero(counts)
    if some.size:
        vectors = table[(w.hash_of(w.start, w.end) % np.uint64(len(table))).astype(np.int64)]
        starts = (np.cumsum(counts) - counts)[some]
        mean = np.add.reduceat(vectors, starts, axis=0) / counts[some, None]
        square = np.add.reduceat(vectors * vectors, starts, axis=0) / counts[some, None]
        alike = np.zeros(w.doc.size, np.float32)  # of a word and the one before; 0 for a text's first
        alike[1:] = (vectors[1:] * vectors[:-1]).sum(axis=1) * (w.doc[1:] == w.doc[:-1])
        close = np.add.reduceat(alike, starts) / counts[some]
        varied = np.sqrt(np.maximum(np.add.reduceat(alike * alike, starts) / counts[some] - close**2, 0))
        out[some] = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), close[:, None], varied[:, None]], axis=1)
    return out


class Network:
    """Inputs scaled to unit spread, one hidden layer, one logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.spread
        width = x.shape[1]
        weights = [rng.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 256):
                at = order[lo : lo + 256]
                raw = x[at] @ weights[0] + weights[1]
                act = np.maximum(raw, 0)
                error = (1 / (1 + np.exp(-np.clip(act @ weights[2] + weights[3][0], -30, 30))) - y[at]) / at.size
                back = error[:, None] * weights[2] * (raw > 0)
                grads = [x[at].T @ back + 1e-4 * weights[0], back.sum(axis=0), act.T @ error, error.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    weights[k] = weights[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = weights, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum((x - self.mean) / self.spread @ a + b, 0) @ c + d[0]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss, by golden-section search over its logarithm."""
        z = self.logits(x)

        def loss(t: float) -> float:
            return float(np.logaddexp(0, np.where(y > 0, -z, z) / np.exp(t)).mean())

        lo, hi, ratio = -2.0, 4.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def labelled_features(docs: DataFrame, labels: DataFrame, table: np.ndarray, most: int, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about `most` labelled documents, picked by a hash of their id."""
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    n = named.count()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    chosen = named.where(draw < (most / n if n else 0))
    shared = shared_object(docs.sparkSession, table)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch, "text"):
                x = pooled(Words(data, offsets), shared())
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())],
                                                 names=["id", "label", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen.select(F.col(id_col).cast("long").alias(id_col), F.col("label").cast("int"))), id_col)
    found = sorted((r["id"], r["x"], r["label"]) for r in rows.mapInArrow(pool, "id long, label int, x binary").collect())  # about `most` rows
    x = np.stack([np.frombuffer(r[1], np.float32) for r in found]).astype(float) if found else np.zeros((0, n_features(table)))
    return x, np.array([r[2] for r in found], float)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = 8192, dims: int = 64, most_labels: int = 20_000, hidden: int = 32, epochs: int = 25,
                  limit: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    `held_out` is a condition on the id; labels of those rows are not used. A null or empty text has a pooled vector of
    zeros and is scored like any other; labels that are null or neither 0 nor 1 are ignored, of several labels of one id
    the larger counts. With fewer than two classes among the labels every score is the share of label 1 (0.5 without
    labels). Null ids are kept; repeated rows are scored each.
    """
    table = word_vectors(docs, rows, dims, text_col)
    x, y = labelled_features(docs, labels.where(~held_out), table, most_labels, id_col, text_col, label_col)
    network, prior = None, float(y.mean()) if y.size else 0.5
    if 0 < y.sum() < y.size:
        back = np.random.default_rng(4).permutation(y.size) % 5 == 0
        network = Network(x[~back], y[~back], hidden, epochs)
        network.calibrate(x[back], y[back])
    shared = shared_object(docs.sparkSession, (table, network))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared()
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch, "text"):
                p = net.probability(pooled(Words(data, offsets), vectors)) if net else np.full(hi - lo, prior)
                yield rows_out(OUT, [batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), p, (p >= limit).astype(np.int32)])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    return texts.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
