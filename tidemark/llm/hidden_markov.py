"""A hidden Markov language model: word classes emitted by latent states, Baum-Welch over the whole training corpus.

Texts become sequences of word classes (hashes of words modulo `classes`; the end of a text is a class of its own). A
text's probability is that of its class sequence under the hidden Markov model, by the scaled forward recursion over
the whole text, times that of each word within its class, from the training counts plus one, with one unknown word per
class. The sum over all texts is one.

The corpus is read once. Every task cuts its words into chunks of about a million and a half, written as codes into the chunk's
own dictionary. Word counts are the dictionaries shuffled by word and sent back by chunk; expected counts of each
iteration are added up over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import Words, blocks, shared_object, text_blocks, tree_sum, written

END = np.uint64(0x1D872B41F3C9A5E7)
CHUNK_DDL = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, codes binary, words array<long>, train array<int>"
CHUNK = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()),
                   ("words", pa.list_(pa.int64())), ("train", pa.list_(pa.int32()))])


def chunks(docs: DataFrame, held_out: Column, size: int, id_col: str, text_col: str) -> DataFrame:
    """Words of whole texts, each text closed by the end: per chunk the dictionary, its training counts and the codes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, held, lengths, words = [], [], [], []

        def flush() -> pa.RecordBatch:
            every, n, out = np.concatenate(words), np.concatenate(lengths), np.concatenate(held)
            found, codes, counts = np.unique(every, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # small codes for common words compress
            rank = np.empty(order.size, "<u4")
            rank[order] = np.arange(order.size, dtype="<u4")
            codes = rank[codes]
            train = np.bincount(codes[np.repeat(~out, n)], minlength=order.size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (np.concatenate(ids), out, n.astype(np.int32), found[order].view(np.int64), train)]
            chunk = pa.array([(part << 24) + seq], pa.int64())
            return pa.RecordBatch.from_arrays([chunk, *lists[:3], pa.array([codes.tobytes()], pa.binary()), *lists[3:]], schema=CHUNK)

        for batch in batches:
            doc_ids = batch.column("doc_id")
            flags = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in text_blocks(batch, "text", 1_000_000):
                w = Words(data, offsets)
                counts = np.bincount(w.doc, minlength=hi - lo) + 1
                rows = np.full(int(counts.sum()), END)
                stops = np.cumsum(counts) - 1
                inside = np.ones(rows.size, bool)
                inside[stops] = False
                rows[inside] = w.hash_of(w.start, w.end)
                ids.append(doc_ids.slice(lo, hi - lo))
                held.append(flags[lo:hi])
                lengths.append(counts)
                words.append(rows)
                if sum(x.size for x in words) >= size:
                    ids = [np.array(pa.concat_arrays(ids).to_pylist(), object)] if any(i.null_count for i in ids) else [pa.concat_arrays(ids).to_numpy()]
                    yield flush()
                    seq += 1
                    ids, held, lengths, words = [], [], [], []
        if ids:
            ids = [np.array(pa.concat_arrays(ids).to_pylist(), object)] if any(i.null_count for i in ids) else [pa.concat_arrays(ids).to_numpy()]
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    return written(rows.mapInArrow(cut, CHUNK_DDL), "chunks", "zstd")


class Lanes:
    """Sequences side by side, longest first: `rows[at[t] : at[t + 1]]` are the t-th tokens of those that have one."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.order = np.argsort(-length, kind="stable")
        first, length = first[self.order], length[self.order]
        self.steps = int(length[0]) if length.size else 0
        active = np.searchsorted(-length, -np.arange(self.steps), side="left")
        self.at = np.concatenate([[0], np.cumsum(active)])
        lane = np.repeat(np.arange(length.size), length)
        nth = np.arange(lane.size) - np.repeat(np.cumsum(length) - length, length)
        self.rows = np.empty(lane.size, np.int64)
        self.rows[self.at[nth] + lane] = first[lane] + nth


class Model:
    """start (K), move (K, K) and emit (classes, K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(counts: np.ndarray, states: int) -> Model:
        """Class frequencies bent a little differently in every state, and states that last."""
        bend = np.exp(0.7 * np.random.default_rng(5).standard_normal((counts.size, states)))
        emit = (counts[:, None] + 1.0) * bend
        move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @staticmethod
    def of_counts(counts: np.ndarray, states: int, classes: int) -> Model:
        """The most likely model under expected counts, each plus a little."""
        start, move, emit = np.split(counts, [states, states + states * states])
        start, move, emit = start + 0.1, move.reshape(states, states) + 0.1, emit.reshape(classes, states) + 0.01
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10_likelihood(self, seq: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of every sequence, by the scaled forward recursion over all of it."""
        lanes = Lanes(first, length)
        total, seen = np.zeros(length.size), seq[lanes.rows]
        alpha = np.broadcast_to(self.start, (length.size, self.start.size))
        for t in range(lanes.steps):
            lo, hi = lanes.at[t], lanes.at[t + 1]
            alpha = (alpha[: hi - lo] @ self.move if t else alpha) * self.emit[seen[lo:hi]]
            scale = alpha.sum(axis=1)
            alpha = alpha / scale[:, None]
            total[: hi - lo] += np.log10(scale)
        out = np.empty(length.size)
        out[lanes.order] = total
        return out

    def expected_counts(self, seq: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Baum-Welch counts of starts, moves and emissions, one after the other."""
        states, classes = self.start.size, self.emit.shape[0]
        lanes = Lanes(first, length)
        seen = seq[lanes.rows]
        emitted = self.emit[seen]
        forward, scales = np.empty_like(emitted), np.empty(seen.size)
        for t in range(lanes.steps):
            lo, hi = lanes.at[t], lanes.at[t + 1]
            alpha = (forward[lanes.at[t - 1] : lanes.at[t - 1] + hi - lo] @ self.move if t else self.start[None, :]) * emitted[lo:hi]
            scales[lo:hi] = alpha.sum(axis=1)
            forward[lo:hi] = alpha / scales[lo:hi, None]
        moves, gamma, after = np.zeros((states, states)), forward, None
        beta = np.ones((0, states))
        for t in range(lanes.steps - 1, -1, -1):
            lo, hi = lanes.at[t], lanes.at[t + 1]
            now = np.ones((hi - lo, states))
            if t + 1 < lanes.steps:
                a, b = lanes.at[t + 1], lanes.at[t + 2]
                after = emitted[a:b] * beta / scales[a:b, None]
                moves += forward[lo : lo + b - a].T @ after
                now[: b - a] = after @ self.move.T
            beta = now
            gamma[lo:hi] = forward[lo:hi] * now  # the forward row is not needed any more
        moves *= self.move
        emits = np.stack([np.bincount(seen, gamma[:, k], classes) for k in range(states)], axis=1)
        starts = gamma[: lanes.at[1]].sum(axis=0) if lanes.steps else np.zeros(states)
        return np.concatenate([starts, moves.ravel(), emits.ravel()])


def unpacked(row: dict, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, class per code, first, length, held) of a chunk."""
    words = np.array(row["words"], np.int64).view(np.uint64)
    of_code = np.where(words == END, classes - 1, (words % np.uint64(classes - 1)).astype(np.int64))
    length = np.array(row["lengths"], np.int64)
    return np.frombuffer(row["codes"], "<u4"), of_code, np.cumsum(length) - length, length, np.array(row["held"], bool)


def windows(first: np.ndarray, length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences cut into consecutive windows of at most `most` tokens."""
    per = -(-length // most)
    owner = np.repeat(np.arange(length.size), per)
    nth = np.arange(owner.size) - np.repeat(np.cumsum(per) - per, per)
    return first[owner] + nth * most, np.minimum(most, length[owner] - nth * most)


def train(pieces: DataFrame, states: int, classes: int, rounds: int, window: int) -> tuple[Model, np.ndarray]:
    """The model, and class counts of the training texts. Training sequences are cut into windows of `window` tokens."""
    spark = pieces.sparkSession
    training = pieces.select("held", "lengths", "codes", "words")

    def gathered(of_chunk) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for i in range(batch.num_rows):
                    part = of_chunk(batch.slice(i, 1).to_pylist()[0])
                    total = part if total is None else total + part
            if total is not None:
                cuts = np.array_split(total, 16)
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * 16, pa.int32()), pa.array(range(16), pa.int32()),
                                                  pa.array([c.tobytes() for c in cuts], pa.binary())], names=["task", "piece", "counts"])

        partial = written(training.mapInArrow(run, "task int, piece int, counts binary"), "counts")
        rows = sorted(tree_sum(partial, "piece", "counts", "<f8").collect())  # states * (classes + states + 1) numbers
        return np.concatenate([np.frombuffer(r["counts"], "<f8") for r in rows]) if rows else None

    def class_counts(row: dict) -> np.ndarray:
        codes, of_code, _, length, held = unpacked(row, classes)
        return np.bincount(of_code[codes[np.repeat(~held, length)]], minlength=classes).astype(float)

    counts = gathered(class_counts)
    counts = np.zeros(classes) if counts is None else counts
    model = Model.first(counts, states)
    for _ in range(rounds if counts.sum() else 0):
        shared = shared_object(spark, model)

        def expected(row: dict, shared=shared) -> np.ndarray:
            codes, of_code, first, length, held = unpacked(row, classes)
            seq, total = of_code.astype(np.int32)[codes], 0.0
            first, length = windows(first[~held], length[~held], window)
            for lo, hi in blocks(length, 250_000):
                total = total + shared().expected_counts(seq, first[lo:hi], length[lo:hi])
            return total if length.size else np.zeros(states + states * states + classes * states)

        model = Model.of_counts(gathered(expected), states, classes)
    return model, counts


OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held_out: Column, states: int = 6, classes: int = 8193, rounds: int = 3, window: int = 256, chunk: int = 1_500_000,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text, learned from those that are not held out.

    base_score is the add-one unigram log10 probability. A null text is an empty one: the end alone. Rows with null or
    repeated ids are scored each. Without training texts every word is unknown and the model is its start.
    """
    pieces = chunks(docs, held_out, chunk, id_col, text_col)
    model, class_counts = train(pieces, states, classes, rounds, window)
    entries = pieces.select("chunk", F.posexplode(F.arrays_zip("words", "train")).alias("code", "e")).select("chunk", "code", "e.words", "e.train")
    by_word = Window.partitionBy("words")
    counted = entries.select("chunk", "code", F.sum("train").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("is_first"))
    # one list per chunk, as long as its dictionary
    known = written(counted.groupBy("chunk").agg(F.collect_list(F.struct("code", "c", "is_first")).alias("known")), "known", "zstd")
    joined = pieces.join(known, "chunk")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes)
        for batch in batches:
            for i in range(batch.num_rows):
                codes, c, is_first = lists(batch.column("known").slice(i, 1))
                words = batch.column("words").slice(i, 1).flatten().to_numpy().view(np.uint64)
                of_code = np.where(words == END, classes - 1, (words % np.uint64(classes - 1)).astype(np.int64))
                total += np.bincount(of_code[codes[is_first & (c > 0)]], minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         names=["task", "piece", "counts"])

    rows = tree_sum(written(joined.select("words", "known").mapInArrow(distinct, "task int, piece int, counts binary"), "distinct"), "piece", "counts", "<f8").collect()
    class_words = np.frombuffer(rows[0]["counts"], "<f8") if rows else np.zeros(classes)
    shared = shared_object(docs.sparkSession, (model, class_counts, class_words))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, n_class, v_class = shared()
        n, v = n_class.sum(), v_class.sum()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                fields = row.select(["doc_ids", "held", "lengths", "codes", "words"]).to_pylist()[0]
                codes, of_code, first, length, held = unpacked(fields, classes)
                at, c, _ = lists(row.column("known"))
                count = np.zeros(of_code.size)
                count[at] = c
                base = np.log10((count + 1) / (n + v + 1))
                within = np.log10((count + 1) / (n_class + v_class + 1)[of_code])
                add = np.add.reduceat
                likelihood = hmm.log10_likelihood(of_code.astype(np.int32)[codes], first, length)
                columns = [pa.array(fields["doc_ids"], pa.int64()), pa.array(held), pa.array(length), pa.array(add((count > 0).astype(np.int64)[codes], first)),
                           pa.array(np.full(length.size, int(n))), pa.array(add(base[codes], first)), pa.array(add(within[codes], first) + likelihood)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.drop("train").mapInArrow(score, OUT_DDL)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fields of a one-row column of lists of (code, count, is_first)."""
    entries = column.flatten()
    return tuple(entries.field(k).to_numpy(zero_copy_only=False) for k in range(3))
