"""Ranked lexical search: range-maximum tables over posting lists, documents by best-first intervals.

Documents are indexed in blocks, each by one task, in the order of their ids. A block keeps a posting list for every
term that is asked for, and a sparse table over each list's impacts: the largest impact of any range of documents, and
the document that has it, in two look-ups. For a query, an interval of documents can score no more than the sum of its
terms' largest impacts within it. The interval with the highest such bound comes first; it is split at the document
with the largest single impact, which is scored, and the parts to its left and right get bounds of their own. A part
that cannot beat the k-th best document found so far is never opened. Intervals of all queries are handled together.

A first pass over all blocks opens a few intervals each; the k-th best document it finds anywhere is where the second
pass starts from, so most intervals of most blocks fall at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import blocks, shared_object, text_blocks, written

TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
DOC_BITS = 20  # documents of a block
WAVE = 16  # intervals of a query opened together
BLOCK_SCHEMA = "n_docs long, n_terms long, ids binary, nulls binary, sizes binary, term binary, doc binary, tf binary"


def terms_of(data: bytes) -> list[bytes]:
    """Runs of letters a-z (A-Z in lower case), digits and characters beyond ASCII."""
    return data.translate(TERM).split()


class Queries:
    """Terms of a bounded set of items: `vocabulary` gives each its number, `terms` and `times` the terms of each item and
    how often it has them, padded with -1."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        counted: dict[int, dict[int, int]] = {}
        for item_id, text in items:
            counts = counted.setdefault(item_id, {})
            for term in terms_of((text or "").encode("utf-8", "surrogatepass")):
                code = self.vocabulary.setdefault(term, len(self.vocabulary))
                counts[code] = counts.get(code, 0) + 1
        self.items = np.array(list(counted), np.int64)
        width = max(map(len, counted.values()), default=0)
        self.terms, self.times = np.full((len(counted), width), -1, np.int64), np.zeros((len(counted), width), np.int64)
        for row, counts in enumerate(counted.values()):
            self.terms[row, : len(counts)] = list(counts)
            self.times[row, : len(counts)] = list(counts.values())

    def parts(self, cells: int = 8192) -> Iterator[np.ndarray]:
        """Rows of `terms` in parts of about `cells` terms."""
        step = max(1, cells // max(1, self.terms.shape[1]))
        for lo in range(0, len(self.items), step):
            yield np.arange(lo, min(lo + step, len(self.items)))


def index(docs: DataFrame, vocabulary: dict[bytes, int], block_docs: int, block_postings: int, id_col: str, text_col: str) -> DataFrame:
    """One row per block of documents: ids, sizes and the postings (term, document, times) of the vocabulary's terms."""
    known = shared_object(docs.sparkSession, vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_of = known()
        ids, nulls, sizes, postings, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            # by id, rows without one last, so that of equal scores the first place is the smaller id
            order = np.lexsort((np.array(ids, np.int64), np.array(nulls, bool)))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            term, doc, tf = (np.concatenate([p[i] for p in postings]) for i in range(3))
            by = np.lexsort((place[doc], term))
            size = np.array(sizes, np.int64)
            row = [[int((size > 0).sum())], [int(size.sum())], [np.array(ids, np.int64)[order].tobytes()], [np.array(nulls, bool)[order].tobytes()],
                   [size[order].tobytes()], [term[by].astype(np.int32).tobytes()], [place[doc][by].astype(np.int32).tobytes()], [tf[by].astype(np.int32).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(row)],
                                              names=["n_docs", "n_terms", "ids", "nulls", "sizes", "term", "doc", "tf"])

        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch, "text"):
                raw = data.tobytes()
                for doc_id, a, b in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = terms_of(raw[a:b])
                    codes = [c for c in map(codes_of.get, words) if c is not None]
                    term, tf = np.unique(np.array(codes, np.int64), return_counts=True)
                    postings.append((term, np.full(term.size, len(ids), np.int64), tf))
                    ids.append(doc_id or 0)
                    nulls.append(doc_id is None)
                    sizes.append(len(words))
                    held += term.size
                    if len(ids) == block_docs or held >= block_postings:
                        yield block()
                        ids, nulls, sizes, postings, held = [], [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(build, BLOCK_SCHEMA)


class Block:
    """Posting lists of one block with the impact of every posting, and their range-maximum tables."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, weight: np.ndarray):
        self.ids, self.nulls = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
        self.n = self.ids.size
        term, doc, tf = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("term", "doc", "tf"))
        m = 75 + 25 * np.frombuffer(row["sizes"], np.int64) * n_docs // max(n_terms, 1)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        self.key = term * (self.n + 1) + doc  # ascending
        self.impact = impact
        # a packed maximum tells the impact and, of equal ones, the first document
        top = impact << DOC_BITS | ((1 << DOC_BITS) - 1 - doc)
        self.levels = [top]
        while 2 << (len(self.levels) - 1) <= np.bincount(term).max(initial=0):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(self.levels[-1][:-half], self.levels[-1][half:]))
        self.flat = np.concatenate(self.levels)
        sizes = np.array([level.size for level in self.levels])
        self.offset = np.cumsum(sizes) - sizes

    def place(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first posting of the term at or behind the document; 0 for no term."""
        return np.where(term < 0, 0, np.searchsorted(self.key, term * (self.n + 1) + doc))

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Packed maximum of postings [a, b) of one list; 0 if there are none."""
        size = np.maximum(b - a, 1)
        level = np.frexp(size.astype(float))[1] - 1  # of the largest power of two within
        at = self.offset[level]
        last = self.flat.size - 1
        both = np.maximum(self.flat[np.minimum(at + a, last)], self.flat[np.minimum(np.maximum(at + b - (1 << level), 0), last)]) if last >= 0 else np.zeros_like(a)
        return np.where(b > a, both, 0)


def search_block(block: Block, terms: np.ndarray, times: np.ndarray, k: int, floor: tuple[np.ndarray, np.ndarray] | None,
                 waves: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place of a document, score) of each query's k best documents of a block, or of those that the first
    `waves` rounds find.

    `floor` is a (score, id) per query that k documents are known to reach; nothing below it is looked for.
    """
    n = len(terms)
    none = np.zeros(0, np.int64)
    if not n or not terms.shape[1] or not block.key.size:
        return none, none, none
    # order of documents: score, then place. A document's place in the floor is where its id would stand.
    need = np.zeros(n, np.int64)
    need_place = np.full(n, -1, np.int64)
    if floor is not None:
        need = floor[0].copy()
        need_place = np.searchsorted(block.ids[~block.nulls], floor[1], side="right") - 1

    def opened(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        top = block.most(a, b)
        impact = (top >> DOC_BITS) * times[q]
        bound = impact.sum(axis=1)
        best = impact.argmax(axis=1)
        split = (1 << DOC_BITS) - 1 - (top[np.arange(q.size), best] & ((1 << DOC_BITS) - 1))
        live = (bound > 0) & ((bound > need[q]) | (bound == need[q]) & (lo <= need_place[q]))
        return [v[live] for v in (q, lo, hi, a, b, bound, split)]

    every = np.arange(n)
    lo, hi = np.zeros(n, np.int64), np.full(n, block.n, np.int64)
    heap = opened(every, lo, hi, block.place(terms, lo[:, None]), block.place(terms, hi[:, None]))
    found = [none, none, none]
    while heap[0].size and waves != 0:
        q, lo, hi, a, b, bound, split = heap
        order = np.lexsort((lo, -bound, q))
        rank = np.arange(q.size) - np.searchsorted(q[order], q[order], side="left")
        now, later = order[rank < WAVE], order[rank >= WAVE]
        rest = [v[later] for v in heap]
        q, lo, hi, a, b, _, split = (v[now] for v in heap)
        # the document that splits the interval is scored
        cut = block.place(terms[q], split[:, None])
        has = (terms[q] >= 0) & (cut < b)
        has &= block.key[np.minimum(cut, block.key.size - 1)] == terms[q] * (block.n + 1) + split[:, None]
        score = (np.where(has, block.impact[np.minimum(cut, block.key.size - 1)], 0) * times[q]).sum(axis=1)
        found = [np.concatenate([x, y]) for x, y in zip(found, (q, split, score), strict=True)]
        order = np.lexsort((found[1], -found[2], found[0]))
        rank = np.arange(order.size) - np.searchsorted(found[0][order], found[0][order], side="left")
        found = [v[order[rank < k]] for v in found]
        full = order[rank == k - 1]
        kth = np.flatnonzero(np.bincount(found[0], minlength=n) >= k)
        if full.size:
            ends = np.searchsorted(found[0], kth, side="right") - 1
            better = (found[2][ends] > need[kth]) | (found[2][ends] == need[kth]) & (found[1][ends] < need_place[kth])
            need[kth[better]], need_place[kth[better]] = found[2][ends][better], found[1][ends][better]
        left = opened(q, lo, split, a, cut)
        right = opened(q, split + 1, hi, cut + has, b)
        live = (rest[5] > need[rest[0]]) | (rest[5] == need[rest[0]]) & (rest[1] <= need_place[rest[0]])
        heap = [np.concatenate([v[live], x, y]) for v, x, y in zip(rest, left, right, strict=True)]
        if waves is not None:
            waves -= 1
    return found[0], found[1], found[2]


def item_groups(items: DataFrame, item_col: str, item_text_col: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items in groups of about `most` characters of text, one at a time; rows of one id stay together."""
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).orderBy("item_id", "text")
    group, size = [], 0
    for r in rows.toLocalIterator():
        if group and size + len(r["text"] or "") > most and r["item_id"] != group[-1][0]:
            yield group
            group, size = [], 0
        group.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") + 8
    if group:
        yield group


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_docs: int = 16_384, block_postings: int = 600_000, group_chars: int = 400_000, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): each item's `k` best documents with a score above 0, equal
    scores by ascending doc_id.

    Weights come from all documents. A null or empty text has no terms and is found by nothing; an item without known
    terms finds nothing. Rows of one id are documents of their own; rows without an id count and are found like others,
    last among equal scores. Items without an id are left out; rows of one item id are one item with the terms of all.
    Items are searched in groups of `group_chars` characters, as their terms go to every task; an index
    is written for each group. Other columns are not read. A text of any length is indexed whole, in one task. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    out = None
    for group in item_groups(items, item_col, item_text_col, group_chars):
        queries = Queries(group)
        table = written(index(docs, queries.vocabulary, block_docs, block_postings, id_col, text_col), "index", "zstd")
        part = search(table, queries, k)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def search(table: DataFrame, queries: Queries, k: int) -> DataFrame:
    """The k best documents of each query in an index."""
    n_docs, n_terms = table.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    size = len(queries.vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.column("term").to_pylist():
                total += np.bincount(np.frombuffer(row, np.int32), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["term", "df"])

    weight = np.zeros(size, np.int64)
    for r in table.select("term").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row per asked term
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))

    def found(floor, waves):
        shared = shared_object(table.sparkSession, (queries, weight, floor))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, weights, least = shared()
            for batch in batches:
                for lo, hi in blocks(np.array([len(t) for t in batch.column("term").to_pylist()]), 1):
                    for row in batch.slice(lo, hi - lo).to_pylist():
                        block = Block(row, n_docs, n_terms, weights)
                        for at in asked.parts():
                            own = None if least is None else (least[0][at], least[1][at])
                            q, place, score = search_block(block, asked.terms[at], asked.times[at], k, own, waves)
                            ids = pa.array(block.ids[place], pa.int64(), mask=block.nulls[place])
                            yield pa.RecordBatch.from_arrays([pa.array(at[q]), ids, pa.array(score)], names=["query", "doc_id", "score"])

        rows = table.mapInArrow(run, "query long, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # the k-th best document that the first rounds find in any block is a floor for all
    score, ident = np.zeros(len(queries.items), np.int64), np.full(len(queries.items), -1, np.int64)
    for r in found(None, 2).where((F.col("rank") == k) & F.col("doc_id").isNotNull()).collect():  # one row per item
        score[r["query"]], ident[r["query"]] = r["score"], r["doc_id"]
    best = found((score, ident), None)
    of = table.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(queries.items)], "query long, item_id long")
    best = best.join(F.broadcast(of), "query")  # one row per item of the group
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


TWIN = """
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
               FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM words WHERE len(t) > 0),
sized AS (SELECT doc_id, t, 100 - 25 + ((25 * len(t) * n_docs) // n_terms) AS m FROM words, totals WHERE len(t) > 0),
counts AS (SELECT doc_id, m, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, m, unnest(t) AS term FROM sized) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM asked JOIN counts USING (term) JOIN weights USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
