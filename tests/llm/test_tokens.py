"""Token files and packing: exact against the library, round trips, and the bounds of packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bitplanes, packing
from tidemark.llm.tokens import Encoder
from tidemark.session import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH, most=50)


def ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9,.'s\n\t\x00\x0b  éß中\U0001f600"), max_size=40))
def test_encoder_equals_the_library(library, encoder, text):
    assert encoder.encode(text) == ids(library, text).tobytes()


def test_encoder_keeps_special_strings(library, encoder):
    text = "before <|endoftext|> after"
    assert encoder.encode(text) == ids(library, text).tobytes()
    assert 50256 in ids(library, text)


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("values", [[], [0], [5, 70_000, 2**32 - 1], list(range(1000))])
def test_planes_round_trip(kind, values):
    values = np.array(values, "<u4")
    planes, sizes, payload = bitplanes.pack_planes(values, 64, kind)
    assert (bitplanes.unpack_planes(payload, sizes, values.size, planes, 64, kind) == values).all()


def test_files_give_the_ids_back(spark, documents, texts, library):
    folder = scratch(spark, "test-tokens")
    bitplanes.write_tokens(documents, folder, block=512, chunk_ids=3000)
    start = 0
    rows = bitplanes.read_tokens(spark, folder).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        want = np.append(ids(library, texts[r["doc_id"]]), np.uint32(0)).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, want.size, zlib.crc32(want.tobytes()), want.tobytes())
        start += want.size
    index = spark.read.parquet(f"{folder}/index").orderBy("start").collect()
    assert sum(r["n_ids"] for r in index) == start
    assert all(a["start"] + a["n_ids"] == b["start"] for a, b in zip(index, index[1:], strict=False))


def test_files_of_odd_rows(spark, odd, nothing):
    for docs, n in ((odd, 12), (nothing, 0)):
        folder = scratch(spark, "test-odd")
        bitplanes.write_tokens(docs, folder)
        rows = bitplanes.read_tokens(spark, folder).orderBy("start").collect()
        assert len(rows) == n
        assert all(r["n_tokens"] >= 1 for r in rows)
    assert not rows


def checked(rows, window):
    """Pieces tile their documents, sequences have no gap; the padding."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (_, n), parts in docs.items():
        copies = len([p for p in parts if p[0] == 0])
        assert sum(length for _, length in parts) == n * copies
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(window - sum(x for _, x in p) for p in sequences.values())


def test_packing(spark, documents, texts, library):
    rows = packing.pack(documents, window=256, with_ids=True).collect()
    padding = checked(rows, 256)
    assert padding <= 256 + 0.01 * sum(r["length"] for r in rows)
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        want = np.append(ids(library, texts[r["doc_id"]]), np.uint32(1)).astype("<u4")[r["start"] : r["start"] + r["length"]].tobytes()
        assert (bytes(r["ids"]), r["ids_crc32"]) == (want, zlib.crc32(want))


def test_packing_of_odd_rows(odd, nothing):
    checked(packing.pack(odd).collect(), 2048)
    assert packing.pack(nothing).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=6), st.integers(0, 40))
def test_best_fill_is_optimal(counts, room):
    used = packing.best_fill(counts, room)
    assert all(0 < n <= counts[length] for length, n in used.items())
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * i for s in sums for i in range(n + 1) if s + length * i <= room}
    assert sum(length * n for length, n in used.items()) == max(sums)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plan_uses_every_piece_once(histogram):
    used = dict.fromkeys(histogram, 0)
    for times, pattern in packing.plan_windows(histogram, 64):
        assert sum(length * n for length, n in pattern.items()) <= 64
        for length, n in pattern.items():
            used[length] += n * times
    assert used == histogram
