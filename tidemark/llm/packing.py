"""Packing documents into fixed windows by minimum bin slack.

Whole windows are cut off the front of every document; what remains is one piece shorter than a window. Only the
number of pieces of each length matters for filling windows, and that histogram has at most `window` rows, whatever
the corpus. A bitset subset-sum over it finds the multiset of lengths that leaves the least slack, the counts are
backtracked, and the pattern is used as often as its scarcest length allows. Pieces learn their place from their rank
among the pieces of their length, which is a sum of per-task counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import crc32, rows_out, strings, written
from tidemark.llm.tokens import TOKENIZER, encoder

PIECE = pa.schema([("part", pa.int32()), ("k", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECE_DDL = "part int, k long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to `room` from below: {length: how many}.

    reach holds bit s if some multiset of the lengths so far sums to s. Longest lengths come first, and the search ends
    as soon as the room is filled exactly.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        left, chunk = min(counts[length], room // length), 1
        while left:  # bounded multiplicity in binary portions
            take = min(chunk, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> target & 1:
            target -= length
            n += 1
        if n:
            used[length] = n
    return used


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces per window}) patterns that use up the histogram, longest piece first."""
    counts = {length: n for length, n in histogram.items() if n}
    plan = []
    while counts:
        longest = max(counts)
        rest = {**counts, longest: counts[longest] - 1}
        if not rest[longest]:
            del rest[longest]
        used = best_fill(rest, window - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in used.items())
        plan.append((times, used))
        for length, n in used.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
    return plan


def cut_pieces(docs: DataFrame, window: int, tokenizer: str, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every encoded document; k numbers the pieces of one length within a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text"), strict=True):
                data = enc.encode(text) + end
                n = len(data) // 4
                for start in range(0, n, window):
                    ids = data[4 * start : 4 * (start + window)]
                    length = len(ids) // 4
                    rows.append((part, int(seen[length]), doc_id, start, length, crc32(ids), n, ids if with_ids else None))
                    seen[length] += 1
            if rows:
                yield rows_out(PIECE, list(zip(*rows, strict=True)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE_DDL)


def pack(docs: DataFrame, window: int = 2048, tokenizer: str = TOKENIZER, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Place every token of every document in windows of at most `window` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). A null text
    is an empty one and consists of the end id alone; rows with one id, or a null one, are packed one by one; an empty
    table gives no rows. Sequence ids count from 0 without gaps, offsets within a sequence too.
    """
    pieces = written(cut_pieces(docs, window, tokenizer, end_id, with_ids, id_col, text_col), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    # rank intervals of every length: [from, ...) belongs to a pattern that uses `each` of them from `offset` on
    taken, table, sequence = dict.fromkeys(histogram, 0), {length: [] for length in histogram}, 0
    for times, used in plan_windows(histogram, window):
        offset = 0
        for length in sorted(used, reverse=True):
            table[length].append((taken[length], used[length], sequence, offset))
            taken[length] += used[length] * times
            offset += used[length] * length
        sequence += times
    intervals = {length: np.array(rows, np.int64).reshape(-1, 4) for length, rows in table.items()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("k")).drop("part", "k", "base")
    fields = [f for f in ranked.schema.fields if with_ids or f.name != "ids"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields if f.name != "rank") + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequences, offsets = np.zeros(lengths.size, np.int64), np.zeros(lengths.size, np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                rows = intervals[int(length)]
                row = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
                nth = ranks[at] - row[:, 0]
                sequences[at] = row[:, 2] + nth // row[:, 1]
                offsets[at] = row[:, 3] + nth % row[:, 1] * length
            keep = [f.name for f in fields if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequences), pa.array(offsets)], names=[*keep, "sequence_id", "offset"])

    return ranked.select(*(f.name for f in fields)).mapInArrow(place, schema)
