"""Ranked search against scoring every document, in blocks of every size, with ties, odd rows and range maxima."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k):
    """Every document scored for every item; None is larger than any id."""
    held = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = [term for i, t in items if i == item for term in terms(t)]
        scores = []
        for d, t in held:
            m = 75 + 25 * len(t) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[a] + 1))) * (10**9 * t.count(a) // (1000 * t.count(a) + 12 * m)) for a in asked if a in df)
            if score > 0:
                scores.append((-score, d is None, d, score))
        out += [(item, r + 1, s[2], s[3]) for r, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return out


def search(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rank", "'x' AS score", "2 AS query")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS rank", "4 AS doc_id")
    return sorted(tuple(r) for r in ranked.ranked(d, i, **options).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("block_docs,group_chars", [(1, 400_000), (7, 30), (16_384, 400_000)])
def test_equals_scoring_everything(spark, block_docs, group_chars):
    rng = random.Random(block_docs)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20 + ["Äh", "B2"]
    docs = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 60])))) for i in range(150)]
    docs += [(1000 + i, "the W1, the w2!") for i in range(40)] + [(5, None), (7, ""), (9, "...")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(12)] + [(50, "w1 the w2"), (51, None), (52, "unseen"), (53, "the the the")]
    for k in (1, 20):
        assert search(spark, docs, items, k=k, block_docs=block_docs, group_chars=group_chars) == plain(docs, items, k)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "alpha beta") for i in random.Random(1).sample(range(1000), 300)] + [(2000, "gamma")]
    items = [(1, "alpha"), (2, "gamma alpha")]
    got = search(spark, docs, items, block_docs=16)
    assert got == plain(docs, items, 20)
    assert [r[2] for r in got if r[0] == 1] == sorted(d for d, _ in docs)[:20]


def test_odd_rows(spark, odd, nothing):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert search(spark, docs, items) == sorted(plain(docs, items, 20), key=lambda r: (r[0], r[1]))
    bench = odd.selectExpr("doc_id AS item_id", "text")
    assert ranked.ranked(nothing, bench).collect() == [] and ranked.ranked(odd, bench.limit(0)).collect() == []
    assert ranked.ranked(odd, bench).columns == ["item_id", "rank", "doc_id", "score"]


def test_range_maxima():
    rng = np.random.default_rng(2)
    term, doc = np.divmod(np.flatnonzero(rng.random(5 * 300) < 0.4), 300)
    tf = rng.integers(1, 5, term.size)
    sizes = rng.integers(5, 50, 300)
    row = {"ids": np.arange(300).tobytes(), "nulls": np.zeros(300, bool).tobytes(), "sizes": sizes.tobytes(), "term": term.astype(np.int32).tobytes(),
           "doc": doc.astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes()}
    block = ranked.Block(row, 300, int(sizes.sum()), np.array([9, 800, 30, 70, 5]))
    for _ in range(300):
        t = rng.integers(0, 5)
        lo, hi = sorted(rng.integers(0, 301, 2))
        a, b = (block.place(np.array([t]), np.array([x]))[0] for x in (lo, hi))
        inside = np.flatnonzero((term == t) & (doc >= lo) & (doc < hi))
        assert b - a == inside.size
        got = int(block.most(np.array([a]), np.array([b]))[0])
        if inside.size:
            best = max(zip(block.impact[inside].tolist(), (-doc[inside]).tolist(), strict=True))
            assert (got >> ranked.DOC_BITS, (1 << ranked.DOC_BITS) - 1 - got % (1 << ranked.DOC_BITS)) == (best[0], -best[1])
        else:
            assert got == 0


def test_intervals_that_cannot_win_stay_closed(monkeypatch):
    """Of many documents, few are scored once some score high."""
    n, scored = 4096, []
    rng = np.random.default_rng(0)
    tf = np.where(rng.random(n) < 0.01, 9, 1).astype(np.int32)
    row = {"ids": np.arange(n).tobytes(), "nulls": np.zeros(n, bool).tobytes(), "sizes": np.full(n, 20).tobytes(), "term": np.zeros(n, np.int32).tobytes(),
           "doc": np.arange(n, dtype=np.int32).tobytes(), "tf": tf.tobytes()}
    block = ranked.Block(row, n, 20 * n, np.array([50]))
    place = block.place
    monkeypatch.setattr(block, "place", lambda t, d: (scored.append(d.size), place(t, d))[1])
    q, doc, score = ranked.search_block(block, np.array([[0]]), np.array([[1]]), 20, None, None)
    assert doc.tolist() == np.flatnonzero(tf == 9)[:20].tolist() and (q == 0).all()
    assert sum(scored) < 200


def test_twin(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.TWINS["op11_interval_ranking"])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES["op11_interval_ranking"](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall()) and got
