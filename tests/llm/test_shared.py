"""Helpers: sums over many tasks, membership on both paths, blocks of rows."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.shared import among, blocks, mix, text_blocks, tree_sum, written


def test_tree_sum(spark):
    rows = [(task, piece, np.full(3, task + 10 * piece, float).tobytes()) for task in range(23) for piece in range(2)]
    df = spark.createDataFrame(rows, "task int, piece int, counts binary")
    for fan_in in (2, 5, 64):
        got = {r["piece"]: np.frombuffer(r["counts"], float).tolist() for r in tree_sum(df, "piece", "counts", "<f8", fan_in).collect()}
        assert got == {0: [253.0] * 3, 1: [483.0] * 3}
    assert tree_sum(df.limit(0), "piece", "counts", "<f8").collect() == []


@pytest.mark.parametrize("most", [0, 100])
def test_among(spark, most):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id long, v string")
    ids = written(spark.createDataFrame([(2,), (9,)], "id long"), "test-ids")
    assert sorted(r["v"] for r in among(df, ids, "id", most=most).collect()) == ["b", "c"]
    assert sorted(r["v"] for r in among(df, ids, "id", inside=False, most=most).collect()) == ["a", "d"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=20), st.integers(1, 40))
def test_blocks_cover_all_rows(sizes, most):
    spans = list(blocks(np.array(sizes, int), most))
    assert [i for lo, hi in spans for i in range(lo, hi)] == list(range(len(sizes)))
    assert all(sum(sizes[lo:hi]) <= most or hi - lo == 1 or sum(sizes[lo:hi]) - sizes[hi - 1] <= most for lo, hi in spans)


def test_text_blocks_of_a_sliced_batch():
    batch = pa.record_batch({"t": pa.array(["ab", None, "", "cdé", "f"])}).slice(1, 4)
    got = [(lo, hi, data.tobytes(), offsets.tolist()) for lo, hi, data, offsets in text_blocks(batch, "t", 3)]
    assert b"".join(g[2] for g in got) == "cdéf".encode() and got[0][0] == 0 and got[-1][1] == 4


def test_mix_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert np.unique(mix(x, 3)).size == x.size and (mix(x, 3) != mix(x, 4)).any()
