"""No task reads a whole folder or blocks of wide books."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import grid, quality
from tidemark.sources import files


def test_book_grid_is_filled_without_the_books(spark, sf, monkeypatch):
    widths, fill_grid = [], grid.fill_grid

    def told(rows, *args, **kwargs):
        widths.append(len(rows.columns))
        assert not any(t.startswith("struct") for _, t in rows.dtypes)
        return fill_grid(rows, *args, **kwargs)

    monkeypatch.setattr(grid, "fill_grid", told)
    entry.queries()["i04_book_snapshots_filled"](spark, sf)
    assert widths == [2]


def test_append_does_not_shuffle_rows_by_folder(spark, tmp_path, monkeypatch):
    plans, first_per_key = [], files.first_per_key

    def told(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return first_per_key(df, *args)

    monkeypatch.setattr(files, "first_per_key", told)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select(F.col("id").cast("string").alias("key"), "id", (F.col("id") % 3).alias("part"))
        for _ in range(2):
            files.append_dedup(spark, str(tmp_path / "table"), rows, "key", ["id"], "part")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]
    assert files.read_table(spark, str(tmp_path / "table")).count() == 100


def test_key_overlaps_are_exact_beyond_the_sketch(spark):
    keys = {"l": (spark.range(0, 200_000), "id"), "r": (spark.range(100_000, 300_000), "id"), "n": (spark.range(0), "id")}
    got = {(r["left_key"], r["right_key"]): tuple(r)[2:] for r in quality.key_overlaps(keys, 12).collect()}
    assert len(got) == 6 and got["l", "r"] == (200_000, 200_000, 100_000, 0.5)
    assert got["l", "n"] == (200_000, 0, 0, 0.0) and got["n", "l"] == (0, 200_000, 0, None)
