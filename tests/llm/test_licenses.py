"""The generalised suffix automaton against all substrings, phrases against a plain scan, planted licences, odd rows."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licenses, queries

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14)


@settings(max_examples=80, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=5))
def test_automaton_holds_every_place_of_every_substring(sequences):
    automaton = licenses.Automaton(sequences)
    places = {}
    for nth, s in enumerate(sequences):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                places.setdefault(tuple(s[i:j]), []).append((nth, j))
    for run, ends in places.items():
        state = automaton.locus(run)
        assert sorted(automaton.ends_of(state)) == ends
        assert automaton.size[automaton.link[state]] < len(run) <= automaton.size[state]


@settings(max_examples=80, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=60), st.sampled_from([7, 4_000_000]))
def test_matching_statistics(sequences, text, piece):
    scanner = licenses.Scanner([(str(i), b" ".join(s).decode()) for i, s in enumerate(sequences)], [("ab", "a b"), ("a", "a")], least=2)
    was, licenses.PIECE = licenses.PIECE, piece
    n, places, matches = scanner.stream(b" ".join(text))
    licenses.PIECE = was
    held = {tuple(s[i:j]) for s in [*sequences, [b"a", b"b"]] for i in range(len(s)) for j in range(i + 1, len(s) + 1)} | {(b"a",)}
    longest = [0]
    for i in range(1, len(text) + 1):
        longest.append(next(k for k in range(i, -1, -1) if k == 0 or tuple(text[i - k : i]) in held))
    assert n == len(text)
    assert sorted(places) == sorted([(i, 0) for i in range(n - 1) if text[i : i + 2] == [b"a", b"b"]] + [(i, 1) for i in range(n) if text[i] == b"a"])
    assert [(end, length) for end, length, _ in matches] == [(i, longest[i]) for i in range(1, n + 1) if longest[i] >= 2 and (i == n or longest[i + 1] <= longest[i])]


def spans_of(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in licenses.scan_licenses(docs, **options).collect()}


def test_every_template_is_found_whole_and_with_changes(spark):
    texts = [f"some words before {text} and behind" for _, text in licenses.TEMPLATES]
    changed = []
    for _, text in licenses.TEMPLATES:
        words = text.split()
        if len(words) >= 30:  # another word in the middle, and one more
            words[len(words) // 2] = "changed"
            words.insert(len(words) // 4, "added")
        changed.append(" ".join(words))
    got = spans_of(spark, texts + changed)
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        n = len(licenses.words_of(text.encode()))
        assert (label, 3, 3 + n, n, n) in got[i], text
        assert any(s[0] == label and s[3] >= 0.75 * n for s in got[i + len(licenses.TEMPLATES)]), text


def test_repeats_partial_texts_and_other_prose(spark):
    mit = licenses.TEMPLATES[2][1]
    n = len(licenses.words_of(mit.encode()))
    half = " ".join(mit.split()[: n // 2])
    got = spans_of(spark, [f"{mit} {mit} {mit}", half, "the software is free of charge and the license is not", " ".join(reversed(mit.split()))])
    assert got[0] == [("mit", k * n, (k + 1) * n, n, n) for k in range(3)]
    assert got[1] == got[2] == got[3] == []


def test_query_equals_a_plain_scan(spark, sf, texts):
    rows = queries.QUERIES["op12_license_automaton"](spark, sf.replace("0.001", "0.01")).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()}
    assert len(rows) == len(docs) and sum(r["n_base"] > 0 for r in rows) > 5
    for r in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), docs[r["doc_id"]])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        found = sorted((i, label) for label, phrase in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert (r["n_words"], r["n_base"]) == (len(words), len(found))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        labels = {label for _, label in found}
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
        if "licensed under cc by nc 4 0" in " ".join(words):
            assert "cc-by-nc" in r["labels"]


def test_odd_rows(odd, nothing, spark):
    got = licenses.scan_licenses(odd.withColumn("spans", odd["lang"])).collect()
    assert len(got) == 12 and all(r["mentions"] == [] and r["spans"] == [] for r in got)
    assert {r["doc_id"]: r["n_words"] for r in got}[6] == 60_000
    assert licenses.scan_licenses(nothing).collect() == []
    plain = licenses.report(licenses.scan_licenses(odd)).where("doc_id = 2").first()
    assert tuple(plain)[:8] == (2, 0, 0, None, None, "", "", 0.0)
    ties = licenses.report(licenses.scan_licenses(spark.createDataFrame([(1, "MIT License, mit-license; Apache License")], "doc_id long, text string"))).first()
    assert (ties["n_base"], ties["first_word"], ties["last_word"], ties["base_labels"]) == (3, 0, 4, "apache,mit")


def test_long_texts_take_seconds():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    began = time.time()
    mit = licenses.TEMPLATES[2][1]
    for text in ("the software " * 100_000, "x" * 2_000_000, f"{mit} " * 2_000, "permission is hereby granted free " * 40_000):
        n, _, matches = scanner.stream(text.encode())
        spans = scanner.chains(matches)
        assert n == len(licenses.words_of(text.encode()))
        assert len(spans) == (2_000 if text.startswith(mit) else 0)
    assert time.time() - began < 60


@pytest.mark.parametrize("text", ["", "\x00\x7f{}[]", "ÀÉ über 7"])
def test_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    assert [w.decode() for w in licenses.words_of(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
