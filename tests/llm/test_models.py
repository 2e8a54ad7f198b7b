"""Quality network, vector search and the hidden Markov model."""

import inspect
import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import hidden_markov, neighbours, quality
from tidemark.llm.shared import Words, crc_mod


def test_words_and_hashes():
    texts = ["A b\x0bC", "", "  ", "b c", "ä Ä x"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    got = [[w.data[a:b].tobytes() for a, b, d in zip(w.start, w.end, w.doc, strict=True) if d == i] for i in range(len(texts))]
    assert got == [t.lower().split() for t in raw]
    hashes = w.hash_of(w.start, w.end)
    assert hashes[1] == hashes[3] and hashes[2] == hashes[4] and len(set(hashes.tolist())) == 5


def test_quality_on_held_out_labels(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, labels, crc_mod("doc_id", 4) == 2).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9


def test_neighbour_sums_against_loops():
    text = b"a b c a d"
    w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    hashes = w.hash_of(w.start, w.end)
    place, sign = quality.index_entries(hashes, 16)
    want = np.zeros((64, 16))
    for i, j in itertools.product(range(5), range(5)):
        if 0 < abs(i - j) <= quality.REACH:
            for s in range(quality.NONZERO):
                want[int(hashes[i] % np.uint64(64)), place[s][j]] += sign[s][j]
    assert np.allclose(quality.neighbour_sums(w, 64, 16).reshape(64, 16), want)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 6))
    y = (x[:, 0] + rng.normal(size=800) > 0).astype(float)
    net = quality.Network(x[:300], y[:300], 32, 60)

    def loss():
        p = np.clip(net.probability(x[300:]), 1e-12, 1 - 1e-12)
        return -(y[300:] * np.log(p) + (1 - y[300:]) * np.log(1 - p)).mean()

    before = loss()
    net.calibrate(x[300:], y[300:])
    assert loss() <= before and net.temperature > 1


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = odd.selectExpr("doc_id", "CASE WHEN doc_id < 7 THEN 1 WHEN doc_id < 9 THEN 0 END AS quality", "'x' AS text")
    rows = quality.score_quality(odd, labels, F.lit(False)).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.score_quality(odd, labels.limit(0), F.lit(False)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(nothing, labels, F.lit(False)).collect() == []


def brute_nearest(vectors, every, k):
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            score = {o: float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))) for o, w in vectors.items() if o != q}
            out[q] = sorted(score.items(), key=lambda e: (-round(e[1], 12), e[0]))[:k]
    return out


def test_recall_and_exact_scores(spark, sf):
    table = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    want = brute_nearest(vectors, 50, 5)
    got = {}
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    found = 0
    for q, rows in got.items():
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        scores = [s for _, _, s in rows]
        assert scores == sorted(scores, reverse=True)
        for _, other, score in rows:
            a, b = vectors[q], vectors[other]
            assert abs(score - np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
        found += len({o for _, o, _ in rows} & {o for o, _ in want[q]})
    assert found >= 0.9 * 5 * len(want)


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(20)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (250, [float("nan")] * 4), (300, [float("inf"), 0.0, 0.0, 0.0]), (350, [1.0, 2.0]), (None, [1.0] * 4)]
    rows += [rows[3]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS q", "'x' AS rep", "2 AS t", "3 AS v", "4 AS score")
    got = neighbours.nearest(table, every=50).orderBy("query_id", "rank").collect()
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and i < 150}
    want = brute_nearest(vectors, 50, 5)
    assert {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in want} == {q: [o for o, _ in w] for q, w in want.items()}
    assert {r["query_id"] for r in got} == {0, 100}
    few = neighbours.nearest(table.where("vec_id IN (0, 1, 100, 101)"), every=50).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(q, n) for q in (0, 100) for n in (1, 2, 3)]
    assert neighbours.nearest(table.limit(0)).collect() == []


def plain_likelihood(model, seq):
    total = 0.0
    for path in itertools.product(range(model.start.size), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, c in zip(path, path[1:], seq[1:], strict=False):
            p *= model.move[a, b] * model.emit[c, b]
        total += p
    return math.log10(total)


def small_model():
    rng = np.random.default_rng(3)
    start, move, emit = rng.random(3), rng.random((3, 3)), rng.random((5, 3))
    return hidden_markov.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_equal_cosines_at_the_border_of_a_block(spark):
    """Multiples of one direction by powers of two: all cosines are equal, the smallest ids win."""
    rng = np.random.default_rng(3)
    one = rng.normal(size=8)
    ids = [50, *range(976, 1000)]
    rows = [(i, (one * 2.0 ** (j % 11)).tolist()) for j, i in enumerate(ids)] + [(2000 + i, rng.normal(size=8).tolist()) for i in range(1, 31)]
    rows = [(i, v) for i, v in rows if i == 50 or i % 50]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [976, 977, 978, 979, 980]


def test_forward_recursion_sums_over_all_paths():
    model, seqs = small_model(), [[0], [1, 4, 2], [3, 3, 0, 1, 2, 4], [2, 2]]
    length = np.array([len(s) for s in seqs])
    got = model.log10_likelihood(np.concatenate(seqs), np.cumsum(length) - length, length)
    assert np.allclose(got, [plain_likelihood(model, s) for s in seqs])


def test_expected_counts_sum_over_all_paths():
    model, seqs = small_model(), [[1, 4, 2], [3, 0], [2]]
    length = np.array([len(s) for s in seqs])
    got = model.expected_counts(np.concatenate(seqs), np.cumsum(length) - length, length)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for seq in seqs:
        total = 10 ** plain_likelihood(model, seq)
        for path in itertools.product(range(3), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, c in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[c, b]
            start[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                move[a, b] += p / total
            for c, k in zip(seq, path, strict=True):
                emit[c, k] += p / total
    assert np.allclose(got, np.concatenate([start, move.ravel(), emit.ravel()]))


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(4)
    seq = np.concatenate([rng.integers(0, 10, 500), rng.integers(10, 20, 500)])
    first, length = np.arange(0, 1000, 50), np.full(20, 50)
    model, last = hidden_markov.Model.first(np.bincount(seq, minlength=20).astype(float), 3), -np.inf
    for _ in range(5):
        now = model.log10_likelihood(seq, first, length).sum()
        assert now > last - 1e-6
        last, model = now, hidden_markov.Model.of_counts(model.expected_counts(seq, first, length), 3, 20)


def test_scores_against_counts(spark, documents, texts):
    rows = hidden_markov.score_texts(documents, crc_mod("doc_id", 7) == 2, classes=513, chunk=20_000).collect()
    tokens = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    held = {r["doc_id"]: r["held_out"] for r in rows}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert set(held) == set(texts)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_of_odd_rows(odd, nothing):
    rows = hidden_markov.score_texts(odd, F.col("doc_id") == 9, classes=65).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by_id[d]["n_tokens"] == 1 for d in (2, 3, 4)) and by_id[6]["n_tokens"] == 60_001
    assert all(np.isfinite(r["score"]) for r in rows)
    unknown = hidden_markov.score_texts(odd, F.lit(True), classes=65).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isclose(r["base_score"], 0, abs_tol=1e-9) for r in unknown)
    assert hidden_markov.score_texts(nothing, F.lit(False), classes=65).collect() == []


def test_word_vectors_have_64_places():
    assert inspect.signature(quality.score_quality).parameters["dims"].default == 64
