"""Every stage of the pipeline against a brute-force version on its own input."""

import os
import re
import sys

import duckdb
import pyarrow as pa

import corpus_pipeline
from tidemark.llm.lines import TWIN

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_near import brute  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test-stage")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language ID":
            assert set(kept[name]) == {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "line dedup":
            con = duckdb.connect()
            con.register("documents", pa.table({"doc_id": list(before), "text": list(before.values())}))
            want = {d: text for d, text, _, dropped in con.execute(f"SELECT doc_id, text, n_lines, n_dropped FROM ({TWIN})").fetchall() if not dropped or text.strip()}
            assert kept[name] == want
        elif name == "near dedup":
            assert set(kept[name]) == {d for d, (_, _, keep) in brute(before, 5, 80).items() if keep}
        elif name == "decontamination":
            def norm(t):
                return " ".join(re.findall(r"[^\W_]+", t.lower()))
            leaks = {d for d, t in before.items() if any(f" {norm(b)} " in f" {norm(t)} " for b in bench)}
            gone = set(before) - set(kept[name])
            assert leaks <= gone and len(gone - leaks) <= 0.02 * len(before)
    assert {r["doc_id"] for r in docs.collect()} == set(kept["decontamination"])


def test_stages_on_odd_tables(spark, sf, nothing, odd):
    docs = odd.selectExpr("doc_id", "text", "lang", "cast(null AS string) AS source", "cast(1 AS bigint) AS n_chars")
    for start in (nothing, docs):
        left = start
        for _, stage in corpus_pipeline.STAGES:
            left = corpus_pipeline.written(stage(spark, left, sf), "test-odd")
        ids = [r["doc_id"] for r in left.collect() if r["start"] == 0]
        # what has no letters goes, and so do copies; what has no id stays
        assert sorted(ids, key=str) == ([] if start is nothing else [1, 10, 6, 8, 9, None])


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
