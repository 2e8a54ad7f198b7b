"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words that equals itself moved by its period, for two periods at least, and that no neighbour
extends. Periods below `SHORTEST` are found by comparing the text with itself at every such lag. Longer ones are found
scale by scale, each scale twice the one before. At the scale of periods lo to 2 lo - 1, every window of lo/2 places
elects the smallest hash of the lo/4 words that start there. Inside a run, a window and its copy one period on hold
the same words and elect the same place, so pairs of places with equal words at a distance of that scale are seeds; a
seed is extended word by word to the whole stretch.

Words that are periodic themselves, with a period of at most half their length, elect nothing, or a repeated word would
elect every place. What that leaves out are runs both of whose periods lie within such a short run each, with the same
short period, one beginning where the other ends; their lags follow from the two runs and are tried one by one. So all
runs are found, and each is confirmed on the words themselves, not on hashes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import mix, text_blocks

SHORTEST = 32  # the first period that minimizers look for
NONE = np.uint64(2**64 - 1)
BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 4_000_000


def word_codes(data: bytes, codes: defaultdict[bytes, int]) -> np.ndarray:
    """Codes of a text's words; a long text is cut into pieces between words, so that only one piece's words are held."""
    parts, lo = [], 0
    while lo < len(data) or not parts:
        cut = BLANK.search(data, lo + PIECE) if len(data) - lo > PIECE else None
        hi = cut.end() if cut else len(data)
        parts.append(np.array([codes[w] for w in data[lo:hi].split()], np.int32))
        lo = max(hi, lo + 1)
    return np.concatenate(parts)


def stretches(x: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of at least `least` (4 or more) places that equal those `lag` on."""
    same = x[:-lag] == x[lag:]
    four = same[:-1] & same[1:]
    four = four[:-2] & four[2:]
    at = np.flatnonzero(four)
    if not at.size:
        return at, at
    breaks = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [at.size - 1]])] + 4
    long = last - first >= least
    return first[long], last[long]


def extend(x: np.ndarray, place: int, lag: int) -> tuple[int, int]:
    """The stretch of places around `place` that equal those `lag` on; empty if `place` does not."""
    hi, step = place, 64
    while hi + lag < x.size:
        end = min(hi + step, x.size - lag)
        same = x[hi:end] == x[hi + lag : end + lag]
        if not same.all():
            hi += int(same.argmin())
            break
        hi, step = end, 2 * step
    lo, step = place, 64
    while lo > 0 and hi > place:
        start = max(0, lo - step)
        same = x[start:lo] == x[start + lag : lo + lag]
        if not same.all():
            lo -= int(same[::-1].argmin())
            break
        lo, step = start, 2 * step
    return lo, hi


class Runs:
    """(text, start, end, period) of the runs found so far, places within their text; of one stretch the smallest period."""

    def __init__(self):
        self.rows = np.zeros((0, 4), np.int64)

    def add(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([text, start, end, period], axis=1)])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        self.rows = rows[np.concatenate([[True], (np.diff(rows[:, :3], axis=0) != 0).any(axis=1)])] if len(rows) else rows


def seeds(h: np.ndarray, window: int, lo: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lag, place) of pairs of elected places with equal hashes, lo to 2 lo - 1 apart."""
    if h.size < window:
        return
    least, size = h, 1
    while size < window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    pad = np.zeros(window - 1, np.uint64)
    most, size = np.concatenate([pad, least, pad]), 1
    while size < window:
        most = np.maximum(most[:-size], most[size:])
        size *= 2
    place = np.flatnonzero((h == most) & (h != NONE))
    order = np.argsort(h[place], kind="stable")
    place, key = place[order], h[place[order]]
    for j in range(1, place.size):
        lag = place[j:] - place[:-j]
        near = (key[j:] == key[:-j]) & (lag < 2 * lo)
        if not near.any():
            return
        near &= lag >= lo
        yield lag[near], place[:-j][near]


def junctions(x: np.ndarray, rows: np.ndarray, start_of: np.ndarray, lo: int) -> Iterator[tuple[int, int]]:
    """(lag, place) where a run of a short period is followed by one of the same period that begins before it ends."""
    short = rows[(rows[:, 3] <= lo // 8) & (rows[:, 2] - rows[:, 1] >= lo)]
    short = short[np.lexsort((short[:, 1], short[:, 3], short[:, 0]))]
    follow = np.flatnonzero((short[1:, 0] == short[:-1, 0]) & (short[1:, 3] == short[:-1, 3]) & (short[1:, 1] <= short[:-1, 2])) if len(short) else []
    for i in follow:
        (text, b1, e1, r), (_, b2, e2, _) = short[i].tolist(), short[i + 1].tolist()
        b1, e1, b2, e2 = (int(start_of[text]) + v for v in (b1, e1, b2, e2))
        last, first = x[e1 - r : e1].tobytes(), x[b2 : b2 + 2 * r - 1].tobytes()
        at = first.find(last)
        while at >= 0 and at % x.itemsize:
            at = first.find(last, at + 1)
        if at >= 0:
            lag = b2 + at // x.itemsize - (e1 - r)
            lag += -(-(lo - lag) // r) * r  # the first of this rest from lo on
            for d in range(lag, min(2 * lo, e1 - b1 + 1, e2 - b2 + 1), r):
                yield d, max(b1, b2 - d)


def find_runs(texts: list[np.ndarray], least: int) -> np.ndarray:
    """Rows (text, start, end, period) of all runs of at least `least` words, by text, start and period."""
    ids, runs = np.arange(len(texts)), Runs()
    sizes = np.array([t.size for t in texts], np.int64)
    # texts closed up, each with an end that equals nothing else
    x = np.concatenate([np.append(t, np.int32(-1 - i)) for i, t in enumerate(texts)]) if texts else np.zeros(0, np.int32)
    start = np.cumsum(sizes + 1) - sizes - 1
    for lag in range(1, min(SHORTEST, (int(sizes.max(initial=0)) // 2) + 1)):
        lo, hi = stretches(x, lag, max(8 - lag, lag))
        text = np.searchsorted(start, lo, side="right") - 1
        runs.add(text, lo - start[text], hi + lag - start[text], np.full(lo.size, lag))
    lo = SHORTEST
    h, width = mix(x.astype(np.int64).view(np.uint64)), 1
    while 2 * lo <= sizes.max(initial=0):
        keep = sizes >= 2 * lo
        if not keep.all():
            chosen = np.repeat(keep, sizes + 1)
            x, h, ids, sizes = x[chosen], h[chosen], ids[keep], sizes[keep]
            start = np.cumsum(sizes + 1) - sizes - 1
        while width < lo // 4:
            with np.errstate(over="ignore"):
                h[: h.size - width] = mix(h[: h.size - width] * np.uint64(0xD6E8FEB86659FD93) + h[width:])
            width *= 2
        start_of = np.full(len(texts), -1, np.int64)
        start_of[ids] = start
        known = runs.rows[start_of[runs.rows[:, 0]] >= 0]
        own = known[(known[:, 3] <= width // 2) & (known[:, 2] - known[:, 1] >= width)]
        depth = np.zeros(x.size + 1, np.int32)
        np.add.at(depth, start_of[own[:, 0]] + own[:, 1], 1)
        np.add.at(depth, start_of[own[:, 0]] + own[:, 2] - width + 1, -1)
        usable = np.where(np.cumsum(depth[:-1]) > 0, NONE, h)
        pairs = [*seeds(usable, lo // 2, lo)]
        more = np.array([*junctions(x, known, start_of, lo)], np.int64).reshape(-1, 2)
        lags, places = np.concatenate([*(p[0] for p in pairs), more[:, 0]]), np.concatenate([*(p[1] for p in pairs), more[:, 1]])
        order = np.lexsort((places, lags))
        found, last, end = [], -1, 0
        for lag, place in zip(lags[order].tolist(), places[order].tolist(), strict=True):
            if lag == last and place < end:
                continue
            first, end = extend(x, place, lag)
            last = lag
            if end - first >= lag:
                found.append((first, end + lag, lag))
        if found:
            rows = np.array(found, np.int64)
            text = np.searchsorted(start, rows[:, 0], side="right") - 1
            runs.add(ids[text], rows[:, 0] - start[text], rows[:, 1] - start[text], rows[:, 2])
        lo *= 2
    rows = runs.rows[runs.rows[:, 2] - runs.rows[:, 1] >= np.maximum(least, 2 * runs.rows[:, 3])]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words (long), runs (array of start, length, period, by start and period), collapsed (string): the runs of
    every whole text and its words without those that a run repeats, joined by one space.

    Words are what lies between ASCII white space, compared byte by byte. A word that any run holds behind its first
    period goes. A null, empty or blank text has no words, no runs and an empty `collapsed`. Runs of equal length stand
    in the order of their start and period. Rows with null or repeated ids are searched each. Other columns are not
    read. A text of any length is searched whole, in one task; it takes some 40 bytes a word. An empty table gives an
    empty one.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch, "text"):
                codes: defaultdict[bytes, int] = defaultdict()
                codes.default_factory = codes.__len__
                raw = data.tobytes()
                texts = [word_codes(raw[a:b], codes) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                rows, names = find_runs(texts, least), list(codes)
                ends = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
                collapsed = []
                for i, text in enumerate(texts):
                    own = rows[ends[i] : ends[i + 1]]
                    if len(own):
                        depth = np.zeros(text.size + 1, np.int64)
                        np.add.at(depth, own[:, 1] + own[:, 3], 1)
                        np.add.at(depth, own[:, 2], -1)
                        text = text[np.cumsum(depth[:-1]) == 0]
                    collapsed.append(b" ".join([names[c] for c in text.tolist()]))
                found = pa.StructArray.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2] - rows[:, 1]), pa.array(rows[:, 3])], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array([t.size for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
                     pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_period(docs: DataFrame, draw: Column, text_col: str = "text") -> DataFrame:
    """`docs` with periodic texts where `draw` is divisible by ten and there are words: the words from a on repeat the
    first p of them, where a and p follow from `draw`. Other texts stay as they are."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # columns of their own, as the words are looked up from within a lambda
    rows = docs.withColumn("__words", F.when(draw % 10 == 0, words)).withColumn("__n", F.size(F.coalesce("__words", F.array().cast("array<string>"))))
    rows = rows.withColumn("__g", F.floor(draw / 10)).withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    rows = rows.withColumn("__p", (F.lit(1) + F.floor((F.col("__n") - F.col("__a")) / (F.lit(3) + F.col("__g") % 8))).cast("int"))
    turned = F.transform("__words", lambda w, i: F.when(i < F.col("__a"), w).otherwise(F.get("__words", F.col("__a") + (i - F.col("__a")) % F.col("__p"))))
    return rows.withColumn(text_col, F.when(F.col("__n") > 0, F.array_join(turned, " ")).otherwise(F.col(text_col))).select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
    start, length, period = -F.col("top.back"), F.col("top.length"), -F.col("top.short")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256", "n_words")
