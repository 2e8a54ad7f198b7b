"""Sources, sinks, and streams restarted, repeated and late."""

import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.operators import options as opt
from tidemark.session import checkpoint_dir
from tidemark.sources import calendar, files
from tidemark.streaming import capture


def test_csv_gz_with_bad_values(spark, tmp_path):
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("exchange,symbol,timestamp,local_timestamp,id,side,price,amount\nx,BTC,1,2,a,buy,10.5,1\nx,BTC,oops,2,b,sell,11,\n")
    rows = files.read_csv(spark, str(tmp_path), files.TRADE_CSV).orderBy("id").collect()
    assert [(r["timestamp"], r["price"], r["amount"]) for r in rows] == [(1, 10.5, 1.0), (None, 11.0, None)]


def test_messages_with_every_defect(spark, tmp_path):
    good = '{"type":"quote","exchange":"x","symbol":"BTC-5FEB24-50000-C","timestamp":"2024-01-01T00:00:00.250Z","bids":[{"price":1.0,"amount":2.0}],"asks":[{"price":1.5,"amount":1.0}]}'
    bad = [good.replace('"price":1.0', '"price":-1.0'), good.replace('"price":1.0', '"price":9.0'), good.replace("BTC-5FEB24-50000-C", "BTC-PERP"),
           good.replace("2024-01-01T00:00:00.250Z", "never"), good.replace('[{"price":1.0,"amount":2.0}]', "[]").replace('[{"price":1.5,"amount":1.0}]', "[]"), good.replace('"quote"', '"trade"')]
    one_sided = good.replace('[{"price":1.5,"amount":1.0}]', "[]")
    (tmp_path / "m.json").write_text("\n".join([good, one_sided, *bad]))
    out = opt.clean_messages(files.read_messages(spark, str(tmp_path))).collect()
    assert sorted((r["bid_price"], r["ask_price"] or 0) for r in out) == [(1.0, 0), (1.0, 1.5)]
    assert {r["ts_us"] for r in out} == {1704067200250000} and {r["strike_price"] for r in out} == {50000.0}


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    part = lambda a, b, tag: spark.range(a, b).select(F.col("id").alias("tx"), F.lit(tag).alias("src"), (F.col("id") % 3).alias("cat"))
    for _ in range(2):
        files.append_dedup(spark, path, part(0, 50, "a"), "tx", ["src"], "cat")
        files.append_dedup(spark, path, part(40, 80, "b"), "tx", ["src"], "cat")
    out = files.read_table(spark, path)
    assert out.count() == 80 and out.where("src = 'a'").count() == 50


def test_heal_union_casts_null_columns(spark):
    left = spark.createDataFrame([(1, "2.5")], "id int, v string").withColumn("w", F.lit(None))
    right = spark.createDataFrame([(2, 3.5, "x")], "id long, v double, extra string")
    out = files.heal_union(left, right, {"id": "long", "v": "double", "w": "double"})
    assert sorted(map(tuple, out.collect())) == [(1, 2.5, None), (2, 3.5, None)]


def test_schedule(spark):
    rows = calendar.schedule(spark, 1704067200, 1704067200 + 3600, 900).collect()
    assert [r["contract_id"] for r in rows] == ["20240101_0000", "20240101_0015", "20240101_0030", "20240101_0045"]
    slug = spark.range(1).select(calendar.local_slug(F.lit(1718085600))).first()[0]
    assert slug == "bitcoin-up-or-down-june-11-2am-et"


def drop(spark, path, rows):
    df = spark.createDataFrame(rows, "key string, s long, v double, hash string").withColumn("event_time", F.timestamp_seconds("s"))
    df.select("key", "event_time", "v", "hash").coalesce(1).write.mode("append").json(path)


SCHEMA = "key string, event_time timestamp, v double, hash string"


def test_restart_neither_loses_nor_repeats(spark, tmp_path):
    path, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for start in (0, 10, 20):
        drop(spark, path, [("a", s, 1.0, str(s)) for s in range(start, start + 10)])
        capture.append_table(capture.message_stream(spark, path, SCHEMA), table, mark)
        capture.append_table(capture.message_stream(spark, path, SCHEMA), table, mark)
    assert spark.read.parquet(table).count() == 30


def test_repeats_and_late_rows(spark, tmp_path):
    path, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        s = capture.deduplicated(capture.message_stream(spark, path, SCHEMA), "hash", "100 seconds")
        capture.append_table(s.select("key", "hash"), table, mark)

    drop(spark, path, [("a", 1000, 1.0, "x"), ("a", 1001, 1.0, "x"), ("a", 1002, 1.0, "y")])
    run()
    drop(spark, path, [("a", 1010, 1.0, "y"), ("a", 1005, 1.0, "z")])  # a repeat, and an event out of order
    run()
    drop(spark, path, [("a", 5000, 1.0, "w")])
    run()
    drop(spark, path, [("a", 1003, 1.0, "late")])  # beyond the watermark
    run()
    assert sorted(r["hash"] for r in spark.read.parquet(table).collect()) == ["w", "x", "y", "z"]


def test_sampler_state_survives_restart(spark, tmp_path):
    path, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        s = capture.message_stream(spark, path, SCHEMA).withColumn("ms", F.unix_millis("event_time"))
        capture.append_table(capture.sampled(s, "key", ["ms", "hash"], "ms", "v", "v", interval_ms=10_000, move=0.1), table, mark)

    drop(spark, path, [("a", 0, 100.0, "1"), ("a", 3, 105.0, "2"), ("a", 4, 120.0, "3")])  # first, small move, large move
    run()
    drop(spark, path, [("a", 9, 121.0, "4"), ("a", 14, 121.0, "5"), ("b", 1, 5.0, "6")])  # too early, due, another key
    run()
    assert sorted(r["hash"] for r in spark.read.parquet(table).collect()) == ["1", "3", "5", "6"]


def test_books_skip_replayed_changes(spark, tmp_path):
    path, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "asset string, seq long, is_snapshot boolean, side string, price double, size double"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)
        capture.append_table(capture.maintained_books(capture.message_stream(spark, path, schema)), table, mark)

    run([("a", 2, False, "SELL", 11.0, 1.0), ("a", 1, True, "BUY", 10.0, 5.0)])
    run([("a", 2, False, "SELL", 11.0, 9.0), ("a", 3, False, "BUY", 10.0, 0.0), ("a", 4, True, "SELL", 12.0, 2.0)])
    out = {r["seq"]: (r["best_bid"], r["best_ask"], r["ask_volume"]) for r in spark.read.parquet(table).collect()}
    assert out == {1: (10.0, None, 0.0), 2: (10.0, 11.0, 1.0), 3: (None, 11.0, 1.0), 4: (None, 12.0, 2.0)}


def test_checkpoint_folder_is_kept(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_reports_of_one_file_are_small(spark, tmp_path):
    files.write_csv_report(spark.range(5), str(tmp_path / "a"), most=5)
    assert spark.read.option("header", "true").csv(str(tmp_path / "a")).count() == 5
    with pytest.raises(ValueError):
        files.write_json_summary(spark.range(6), str(tmp_path / "b"), most=5)


def test_latest_file(spark, tmp_path):
    for n in (3, 5, 4):
        spark.range(n).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert files.latest_file(spark, str(tmp_path / "t")).count() == 4
