"""Cross-parsing against a plain parser, held-out accuracy, odd rows."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import language
from tidemark.llm.shared import crc_mod


def plain_phrases(sample, text):
    """Longest matches from left to right; a character the sample lacks is a phrase of its own."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


@settings(max_examples=80, deadline=None)
@given(st.text("abc ", min_size=1, max_size=40), st.lists(st.text("abcd ", min_size=1, max_size=60), min_size=1, max_size=4))
def test_phrases_equal_a_plain_parse(sample, texts):
    model = language.Model({"x": [sample], "y": ["dddd"]}, 10_000)
    table = language.code_table(model.letters)
    codes = [language.encode(t, table) for t in texts]
    inside = np.concatenate([[1], language.encode(sample, table), [1]])
    word = bytes(c for c in inside.tolist() if c)
    for lane in (1000, 7, 2, 1):
        got = model.phrases(codes, lane=lane)[:, 0].tolist()
        assert got == [plain_phrases(word, bytes(c.tolist())) for c in codes]


def test_lanes_do_not_change_the_count():
    model = language.Model({"x": ["banana bandana cabana " * 5], "y": ["a banana in a cabana"]}, 10_000)
    table = language.code_table(model.letters)
    codes = [language.encode("a banana in a cabana with a bandana " * 20, table), language.encode("na" * 400, table)]
    want = model.phrases(codes, lane=100_000)
    for lane in (1, 3, 50, 512):
        assert (model.phrases(codes, lane=lane) == want).all()


def test_every_letter_counts():
    """Two scripts of a thousand letters each, told apart by their rarest."""
    first, second = "".join(map(chr, range(0x4E00, 0x4E00 + 1000))), "".join(map(chr, range(0xAC00, 0xAC00 + 1000)))
    model = language.Model({"x": [first], "y": [second]}, 10_000)
    table = language.code_table(model.letters)
    counts = model.phrases([language.encode(first[900:950], table), language.encode(second[950:], table)])
    assert counts.tolist() == [[1, 50], [50, 1]]
    assert model.target.size < 40 * 1000  # not states times letters


def test_every_text_has_an_equal_share():
    assert [len(t) for t in language.equal_shares(["a" * 1000, "b" * 10, "c" * 500], 110)] == [50, 10, 50]
    assert language.equal_shares(["ab", "c"], 100) == ["ab", "c"] and language.equal_shares([], 9) == []


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = language.identify(docs, crc_mod("doc_id", 5) == 0).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if r["held_out"]}
    assert len(got) == docs.count()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(odd, nothing):
    got = language.identify(odd, F.lit(False), keep_columns=True)
    assert set(got.columns) == {*odd.columns, "lang_pred", "score", "held_out"}
    rows = got.collect()
    assert len(rows) == 12
    pred = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert all(pred[d] == "und" for d in (2, 3, 4, 7)) and pred[1] == "en" and pred[8] == "de" and pred[10] == "fr"
    assert pred[None] == "en"
    assert language.identify(nothing, F.lit(False)).collect() == []
    alone = language.identify(odd.where("doc_id = 1").withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert [(r["lang_pred"], r["score"]) for r in alone] == [("und", 0.0)]
