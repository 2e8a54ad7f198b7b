"""Certain spans against the plain patterns, what the trees add, odd rows."""

import hashlib
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii


def plain(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return spans + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a1.@-+ ()é%_9025\n"), max_size=60))
def test_certain_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_documents(spark, documents, texts):
    rows = pii.find_personal_data(documents, with_text=True).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        spans = plain(text)
        written = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        every = [s for s in r["spans"].split(",") if s]
        assert every[: len(written)] == written and len(every) == len(written) + r["n_added"]
        assert not plain(r["redacted"]) or len(plain(r["redacted"])) < len(spans)


def test_secrets_and_odd_numbers():
    rng = np.random.default_rng(2)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(80)]
    phones = [f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}" for _ in range(80)]
    plain_numbers = [f"see page {rng.integers(1, 400)} of version {rng.integers(1, 9)}.{rng.integers(0, 9)}" for _ in range(160)]
    texts = [f'a token = "{h}" here' for h in hexes] + [f"call {p} now" for p in phones] + plain_numbers
    x, y = [], []
    for t in texts:
        certain = pii.Cover([(a, b) for _, a, b in pii.base_spans(t)])
        for c in pii.candidates(t):
            label = pii.weak_label(t, *c, certain)
            if label >= 0:
                x.append(pii.features(t, *c))
                y.append(label)
    model = pii.Model(np.array(x, float), np.array(y, float), 0.95)
    _, added = pii.find_spans(f'the token = "{hexes[0][::-1]}" here', model)
    assert added == [("secret", 13, 53)]
    assert pii.find_spans("see page 12 of version 3.1", model) == ([], [])
    certain, _ = pii.find_spans("call +1 (212) 555-1234 now", model)
    assert certain == [("phone", 5, 22)]


def test_odd_rows(odd, nothing):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == 12 and all(r["n_email"] == r["n_card"] == 0 for r in rows)
    assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_personal_data(nothing).collect() == []
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


def values(text):
    return {text[a:b] for kind, a, b in pii.candidates(text) if kind == "secret"}


def test_values_without_digits_are_proposed():
    assert "correcthorse" in values("my password=correcthorse, ok")
    assert "abcdefghijkl" in values('the secret: "abcdefghijkl" here')
    assert "abcdefghijkl" in values("api_key =  abcdefghijkl")
    assert values("a word : another and see http://example.org/page") == set()
    for text, want in (("my password=correcthorse, ok", "correcthorse"), ('the secret: "abcdefghijkl" here', "abcdefghijkl")):
        a = text.index(want)
        assert pii.weak_label(text, "secret", a, a + len(want), pii.Cover([])) == 1


def test_every_value_of_a_token_is_proposed():
    text = "see http://example.org/x?id=12&token=9f86d0818&user=somebody now"
    assert {"9f86d0818", "somebody"} <= values(text)
    a = text.index("9f86d0818")
    assert pii.weak_label(text, "secret", a, a + 9, pii.Cover([])) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=8), st.integers(0, 35), st.integers(1, 9))
def test_cover(spans, start, n):
    spans, end = [(a, a + m) for a, m in spans], start + n
    cover = pii.Cover(spans)
    assert cover.meets(start, end) == any(a < end and start < b for a, b in spans)
    assert cover.mostly(start, end) == any(min(b, end) - max(a, start) >= 0.8 * n for a, b in spans)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab=:;,.&?)'\" /<>7"), max_size=40))
def test_values_equal_a_plain_walk(text):
    want = set()
    for m in pii.ASSIGN.finditer(text):
        start = m.end()
        if text.startswith("//", start) or m.group(1) and not pii.NAMED.search(text[max(0, start - 24) : start]):
            continue
        end = next((i for i in range(start, len(text)) if text[i].isspace() or text[i] in "\"'<>"), len(text))
        for stop in {next((i for i in range(start, end) if text[i] in "&;,"), end), end}:
            stop = start + len(text[start:stop].rstrip(".,;:!?)"))
            if stop - start >= 2 and any(c.isalpha() for c in text[start:stop]):
                want.add((start, stop))
    assert set(pii.assigned(text)) == want


def test_a_megabyte_without_white_space_takes_seconds():
    x = np.random.default_rng(0).normal(size=(400, pii.N_FEATURES))
    model = pii.Model(x, (x[:, 1] > 0).astype(float), 0.9)
    for unit in ("7", "1.2.3.", "a@b.cc,", ":;.", "+1(2)", "x"):
        text = unit * (1_000_000 // len(unit))
        began = time.time()
        pii.base_spans(text)
        assert len(pii.candidates(text)) <= len(text)
        assert time.time() - began < 20, unit
    for unit in ("a=b", "k=1.2.3.4&", "token:ab12;"):
        text = unit * (100_000 // len(unit))
        began = time.time()
        pii.find_spans(text, model)
        assert time.time() - began < 20, unit


KINDS = {"secret": "token = {}", "handle": "write to {} soon", "number": "account {} at the bank", "none": "see page {} of it"}


def planted(rng, n):
    """Texts with one private value each, or a number that is none, and where it is."""
    out = []
    for i in range(n):
        kind = list(KINDS)[i % 4]
        digits = "".join(rng.choice(list("0123456789"), 16))
        value = {"secret": "".join(rng.choice(list("0123456789abcdef"), 40)), "handle": "".join(rng.choice(list("abcdefgh"), 7)) + "@localhost",
                 "number": "-".join(digits[j : j + 4] for j in range(0, 16, 4)), "none": digits[:2]}[kind]
        text = "some words before " + KINDS[kind].format(value) + " and behind"
        out.append((kind, text, text.index(value), text.index(value) + len(value)))
    return out


def test_planted_secrets_are_added_and_page_numbers_are_not(spark):
    rng = np.random.default_rng(5)
    train, held = planted(rng, 1200), planted(rng, 400)
    docs = spark.createDataFrame([(i, t) for i, (_, t, _, _) in enumerate(train)], "doc_id long, text string")
    model = pii.Model(*pii.training_rows(docs, 10_000, 100_000, "doc_id", "text"), 0.95)
    hits = {kind: [0, 0] for kind in KINDS}
    for kind, text, a, b in held:
        certain, added = pii.find_spans(text, model)
        hits[kind][0] += any(x < b and a < y for _, x, y in certain + added)
        hits[kind][1] += 1
    assert hits["secret"][0] >= 0.95 * hits["secret"][1] and hits["none"][0] <= 0.02 * hits["none"][1]


def test_of_many_proposals_a_sample_is_fitted(spark):
    docs = spark.createDataFrame([(i, "a token = abc123abc123 " * 40 + f"page {i}") for i in range(50)], "doc_id long, text string")
    x, y = pii.training_rows(docs, 10_000, 500, "doc_id", "text")
    assert 250 < len(x) == len(y) < 800
