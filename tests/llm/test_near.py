"""Near copies against all pairs of sets."""

import random

import numpy as np
import pytest

from tidemark.llm import near


def sets_of(texts, width):
    out = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        out[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def brute(texts, width, percent):
    sets = sets_of(texts, width)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.fixture(scope="module")
def families():
    """Families of edited copies around the limit, exact copies, and short texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts, d = {}, 0
    for size in (12, 30, 90, 300):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                    copy[rng.randrange(size)] = rng.choice(words)
                texts[d] = " ".join(copy)
                d += 1
    for t in ("", "one", "one two", "ONE  two", "one two three"):
        texts[d] = t
        texts[d + 1] = t
        d += 2
    return texts


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_families(spark, families, width, percent):
    docs = spark.createDataFrame(list(families.items()), "doc_id long, text string").repartition(5)
    assert found(near.near_copies(docs, width, percent)) == brute(families, width, percent)


def test_large_unresolved_buckets_are_compared_in_blocks(spark, families, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 100)
    docs = spark.createDataFrame(list(families.items()), "doc_id long, text string")
    assert found(near.near_copies(docs, 3, 85)) == brute(families, 3, 85)


def test_documents(documents, texts):
    assert found(near.near_copies(documents, 3, 85)) == brute(texts, 3, 85)


def test_odd_rows(odd, nothing):
    rows = near.near_copies(odd).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[5]["component_id"] == 1 and not by_id[5]["kept"]
    assert by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == by_id[4]["n_shingles"] == 0
    assert all(by_id[d]["kept"] for d in (1, 2, 3, 4, 6, 7, 8, 9, 10))
    lost = [r for r in rows if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in lost] == [(None, True)]
    assert near.near_copies(nothing).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["rep"]: r["root"] for r in near.components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 95: 90, 100: 90}


def test_registers_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    for n in (20, 400, 20_000):
        shared = rng.integers(0, 2**52, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([shared, rng.integers(0, 2**52, n // 10).astype(np.uint64)])) for _ in range(2)]
        doc = np.repeat([0, 1], [s.size for s in sets])
        rows = near.register_rows(doc, np.concatenate(sets), 2, 4000)
        both = np.intersect1d(*sets).size
        true = both / (sets[0].size + sets[1].size - both)
        est = near.estimate(np.array([(rows[0] == rows[1]).sum()]), np.array([sets[0].size]), np.array([sets[1].size]), 4000)[0]
        assert abs(est - true) < 0.05


def test_unrelated_registers_agree_by_chance_as_the_table_says():
    rng = np.random.default_rng(1)
    sizes = (3000, 3000)
    doc = np.repeat([0, 1], sizes)
    agree = [(lambda r: (r[0] == r[1]).mean())(near.register_rows(doc, np.concatenate([np.unique(rng.integers(0, 2**52, s).astype(np.uint64)) for s in sizes]), 2, 500)) for _ in range(200)]
    want = near.chance_table()[5, 5]
    assert abs(np.mean(agree) - want) < 5e-4


def test_blocks_are_bounded_by_sets_too(spark, families, monkeypatch):
    classes = spark.range(1, 6001).selectExpr("id AS rep", "2L AS n_shingles")  # short sets, all in one bucket
    members = classes.selectExpr("7L AS key", "rep")
    labels = spark.createDataFrame([(r, 1) for r in range(2, 2501)], "rep long, root long")
    sizes = near.block_members(members, classes, labels).groupBy("g").count().collect()
    assert max(r["count"] for r in sizes) < 2.5 * near.SETS
    monkeypatch.setattr(near, "SETS", 3)
    docs = spark.createDataFrame(list(families.items()), "doc_id long, text string")
    assert found(near.near_copies(docs, 3, 85)) == brute(families, 3, 85)


def test_links_of_a_block_of_many_slices():
    n = 3 * near.SLICE + 7
    rep = np.arange(n)
    sets = [np.array([10 * (i // 2), 10 * (i // 2) + 1 + (i % 2 and i % 3 == 0)], np.uint64) for i in range(n)]
    links = near.block_links(rep, rep, sets, 80)
    assert links == [(i, i + 1) for i in range(0, n - 1, 2) if np.array_equal(sets[i], sets[i + 1])]
