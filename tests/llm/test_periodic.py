"""Periodic runs against all lags tried word by word, hard words, odd rows, long texts."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic, queries


def plain_runs(x, least):
    """Every lag, every stretch; of one stretch the smallest period."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(texts, least=12):
    rows = periodic.find_runs([np.array(t, np.int32) for t in texts], least).tolist()
    return [[tuple(r[1:]) for r in rows if r[0] == i] for i in range(len(texts))]


def hard_words(n):
    fibonacci, next_one = [0], [1]
    while len(next_one) < n:
        fibonacci, next_one = next_one, next_one + fibonacci
    thue_morse = [0]
    while len(thue_morse) < n:
        thue_morse += [1 - v for v in thue_morse]
    m = n // 6
    return {"fibonacci": next_one[:n], "thue-morse": thue_morse[:n], "turned": ([0, 1] * m + [1, 0] * m + [0]) * 2, "one word": [7] * n,
            "nested": ([0] * 40 + [1]) * 5 + ([0] * 40 + [2]) * 5, "copies": list(range(n)) * 3, "empty": []}


@pytest.mark.parametrize("kind", sorted(hard_words(12)))
def test_hard_words(kind):
    for n in (12, 100, 300):
        word = hard_words(n)[kind]
        assert runs_of([word]) == [plain_runs(word, 12)]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 7)), max_size=5), min_size=1, max_size=4))
def test_random_repeats(parts):
    texts = [[w for word, times in text for w in word * times] for text in parts]
    assert runs_of(texts) == [plain_runs(t, 12) for t in texts]


def test_long_random_texts():
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        unit = [rng.randrange(200) for _ in range(rng.randint(30, 260))]
        texts.append([rng.randrange(200) for _ in range(rng.randint(0, 300))] + unit * 2 + unit[: rng.randint(0, 30)] + [rng.randrange(200) for _ in range(200)])
    assert runs_of(texts) == [plain_runs(t, 12) for t in texts]


def test_a_million_words_take_seconds():
    began = time.time()
    assert runs_of([[5] * 1_000_000]) == [[(0, 1_000_000, 1)]]
    block = list(range(30_000))
    assert runs_of([block * 30 + [-7]]) == [[(0, 900_000, 30_000)]]
    assert time.time() - began < 60


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 10)
    codes = periodic.defaultdict()
    codes.default_factory = codes.__len__
    data = b" one two\tthree four\x0bfive onetwothreefourfive one\n"
    got = [list(codes)[c] for c in periodic.word_codes(data, codes)]
    assert got == data.split()


def test_query_equals_brute_force(spark, sf, texts):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op13_minimizer_runs"](spark, sf).collect()}
    assert set(rows) == set(texts)
    checked = 0
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = len(words)
        if n > 2500:
            continue
        draw = zlib.crc32(str(doc_id).encode())
        if draw % 10 == 0 and n:
            g = draw // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = [(s, e - s, q) for s, e, q in plain_runs(words, 12)]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = rows[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        checked += bool(runs)
    assert checked > 20


def test_odd_rows(odd, nothing):
    rows = periodic.periodic_runs(odd.withColumn("runs", odd["lang"])).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and [(r["start"], r["length"], r["period"]) for r in by_id[6]["runs"]] == [(0, 60_000, 1)] and by_id[6]["collapsed"] == "word"
    assert all((by_id[d]["n_words"], by_id[d]["runs"], by_id[d]["collapsed"]) == (0, [], "") for d in (2, 3, 4))
    assert by_id[None]["collapsed"] == "a text without any id at all" and sum(r["doc_id"] == 7 for r in rows) == 2
    assert periodic.periodic_runs(nothing).collect() == []
    digest = {r["doc_id"]: r for r in periodic.digests(periodic.periodic_runs(odd)).collect()}
    assert digest[2]["runs_sha256"] == digest[2]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()


def test_equal_lengths_go_by_start_then_period(spark):
    text = " ".join(["a b"] * 6 + ["x y z"] * 4)
    row = periodic.digests(periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (2, 0, 12, 2, 6000)
