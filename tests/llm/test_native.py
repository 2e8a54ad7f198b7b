"""Line templates and spaced seeds: twins over the tables, planted cases, odd rows, and no Python on the way."""

import random

import duckdb
import pytest

from tidemark.llm import decontaminate, lines, queries

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.mark.parametrize("name", ["op1_template_tree", "op8_spaced_seeds"])
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.TWINS[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert got == want and got
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def cut(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_repeated_lines(docs, **options).collect()}


def test_a_form_that_three_documents_fill_in(spark):
    got = cut(spark, [
        (1, "own line one\nuser alice logged in at 10:22 from host web"),
        (2, "user alice logged in at 11:59 from host web\nown line two"),
        (3, "user alice logged in at 10:22 from host db now\nuser alice logged in at 12:01 from host web"),
        (4, "page 3 of 10\nwords that nobody else has"),
        (5, "page 17 of 22"),
    ])
    assert got[1] == ("own line one\nuser alice logged in at 10:22 from host web", 2, 0)
    assert got[2] == ("own line two", 2, 1)
    assert got[3] == ("user alice logged in at 10:22 from host db now", 2, 1)
    assert got[4][2] == got[5][2] == 0  # two documents only


@pytest.mark.parametrize("most_sent", [0, 4_000_000])
def test_unique_text_stays(spark, most_sent):
    texts = {
        1: "1.5 2.5 3.5\n2024\nthe case was won by the plaintiff here\nrevenue 10 20 30",
        2: "9.1 8.2 7.3\n17\nthe case was lost by the plaintiff there",
        3: "1.5 2.5 3.5\nthe case was won by the defendant now\nrevenue 11 21 31",
        4: "in 1990 there were 12 of them there then\nrevenue 12 22 32",
        5: "in 1991 there were 15 of them there then\nthe case was won by the plaintiff here",
    }
    got = cut(spark, list(texts.items()), most_sent=most_sent)
    assert {d: got[d][0] for d in range(1, 5)} == {d: texts[d] for d in range(1, 5)}
    assert got[5] == ("in 1991 there were 15 of them there then", 2, 1)


def test_a_changed_word_behind_the_leading_tokens(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank".split()
    one, two, field = list(base), list(base), list(base)
    one[6] = "that"
    two[6:8] = "that", "idle"
    got = cut(spark, [(1, " ".join(base)), (2, " ".join(one) + "\nkept"), (3, " ".join(["a", *base[1:]])), (4, " ".join(two))])
    assert [got[d][2] for d in (1, 2, 3, 4)] == [0, 1, 0, 0]
    assert got[2][0] == "kept"
    field[6] = "room12"
    got = cut(spark, [(1, " ".join(field)), (2, " ".join(field).replace("12", "13")), (3, " ".join(field).replace("lazy", "idle"))])
    assert [got[d][2] for d in (1, 2, 3)] == [0, 0, 1]  # of two documents' forms none goes, but a near copy with equal fields does


@pytest.mark.parametrize("most_sent", [0, 4_000_000])
def test_repeats_within_a_document_stay(spark, most_sent):
    got = cut(spark, [(1, "same here\nsame here"), (2, "\nsame here\n\nsame here\nnew"), (3, "same here")], most_sent=most_sent)
    assert got == {1: ("same here\nsame here", 2, 0), 2: ("\n\nnew", 5, 2), 3: ("", 1, 1)}


def test_lines_of_odd_rows(odd, nothing):
    got = lines.drop_repeated_lines(odd)
    assert got.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 12
    assert (rows[5]["text"], rows[5]["n_dropped"], rows[1]["n_dropped"]) == ("", 1, 0)
    assert (rows[2]["text"], rows[2]["n_lines"]) == (None, 0)
    assert rows[3]["text"] == "" and rows[4]["text"] == " \t\n " and rows[7]["text"] == "1234 5678 !!"
    assert rows[None]["n_dropped"] == 0 and rows[1]["score"] == "x"
    assert lines.drop_repeated_lines(nothing).collect() == []


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def leaks(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["shift"], r["matched"], r["score"]) for r in decontaminate.contaminated(docs, bench, **options).collect()}


@pytest.mark.parametrize("most_seeds", [0, 2_000_000])
def test_substitutions_are_tolerated(spark, most_seeds):
    words = ITEM.split()
    changed = [*words[:4], "OTHER", *words[5:]]
    texts = ["x y " + ITEM.upper().replace(" ", ", "), " ".join(changed), " ".join(words[:6]), " ".join(reversed(words)), None, ""]
    got = leaks(spark, texts, [ITEM, "too short to matter", None, ""], most_seeds=most_seeds)
    assert got == {(0, 0): (2, 16, 16), (1, 0): (0, 15, 14)}


def test_part_of_an_item_and_ties(spark):
    words = ITEM.split()
    half = " ".join(words[2:15])  # 13 of 16 tokens
    got = leaks(spark, [f"{half} q {half}", " ".join(words[5:])], [ITEM, ITEM])
    assert got == {(0, 0): (-2, 13, 13), (0, 1): (-2, 13, 13)}


@pytest.mark.parametrize("most_seeds", [0, 2_000_000])
def test_short_items_are_found_whole(spark, most_seeds):
    five, four = "one two three four five", "six seven eight nine"
    texts = [f"x {five} y {five}", "one two three four six", f"{four} {four}", "One, two; THREE four five!", " ".join(ITEM.split()[:9])]
    got = leaks(spark, texts, [five, four, " ".join(ITEM.split()[:9]), ITEM, five], most_seeds=most_seeds)
    assert got == {(0, 0): (1, 5, 5), (3, 0): (0, 5, 5), (4, 2): (0, 9, 9), (0, 4): (1, 5, 5), (3, 4): (0, 5, 5)}
    bench = spark.createDataFrame([(1, five), (2, four), (3, None), (None, "a")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.skipped_items(bench).collect())) == [(2, 4), (3, 0)]


def plain_overlaps(text, item, masks, least):
    """Every shift at which a mask's tokens agree, every run, without the reductions of the operator."""
    best = None
    for shift in range(-len(item), len(text)):
        side = [(text[i + shift], item[i]) for i in range(len(item)) if 0 <= i + shift < len(text)]
        if not any(all(side[p + j][0] == side[p + j][1] for j, bit in enumerate(m) if bit == "1") for m in masks for p in range(len(side) - len(m) + 1)):
            continue
        run = top = 0
        for x, y in side:
            run = max(run + (1 if x == y else -1), 0)
            top = max(top, run)
        if top >= min(least, len(item)) and (best is None or top > best[2]):
            best = (shift, sum(x == y for x, y in side), top)
    return best


def test_repetitive_texts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(w for _ in range(rng.randint(1, 6)) for w in rng.choices("abc", k=rng.randint(1, 7)) * rng.randint(1, 4)) for _ in range(40)]
    items = [" ".join(w for _ in range(rng.randint(1, 3)) for w in rng.choices("abc", k=rng.randint(1, 6)) * rng.randint(1, 4)) for _ in range(12)]
    items = [i for i in items if len(i.split()) >= 11]
    want = {(d, i): plain_overlaps(t.split(), s.split(), decontaminate.MASKS, 12) for d, t in enumerate(texts) for i, s in enumerate(items)}
    assert leaks(spark, texts, items) == {k: v for k, v in want.items() if v} and any(want.values())


def test_benchmark_of_odd_rows(spark, odd, nothing):
    bench = odd.selectExpr("doc_id AS item_id", "text", "'c' AS seed", "1 AS shift", "2 AS pos", "3 AS item")
    got = decontaminate.contaminated(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(6, 6), (1, 1), (1, 5), (5, 1), (5, 5), (8, 8)}  # short items whole
    assert decontaminate.contaminated(nothing, bench).collect() == []
    assert decontaminate.contaminated(odd, bench.limit(0)).collect() == []
