"""Live capture as Structured Streaming over landed event files.

Sources are folders that a collector drops JSON files into; every sink has a checkpoint in the shared folder, so a
restart continues where the last batch ended.  Nothing here opens a connection.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.operators.book import top_levels
from tidemark.session import configure, scratch
from tidemark.sources.files import with_hour_parts

_LEVELS = "array<struct<price:double,size:double>>"
EVENT_SCHEMA = (
    "event_type string, asset_id string, market string, hash string, event_time timestamp, received_time timestamp, "
    f"seq long, bids {_LEVELS}, asks {_LEVELS}, "
    "price_changes array<struct<side:string,price:double,size:double>>, side string, price double, size double"
)
STATE = "best_bid double, best_ask double, bid_levels long, ask_levels long, bid_volume double, ask_volume double"
LATENESS = "60 seconds"
MIN_INTERVAL_MS = 1_000
MIN_MOVE = 0.005  # share of the best price


def message_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """Stream of JSON messages dropped into a folder."""
    reader = configure(spark).readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


# -- sinks -------------------------------------------------------------------------------------------


def drain(writer, checkpoint: str, timeout: int = 300):
    """Run everything that has landed, then stop; fails with the query's own error."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"stream did not finish in {timeout} s")
    finally:
        query.stop()
    return query


def append_table(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), timeout: int = 300):
    """Append to a (partitioned) Parquet table, exactly once."""
    return drain(stream.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by).option("path", path),
                 checkpoint, timeout)


def watermark_ms(query) -> int:
    """Event time up to which a drained stream has closed its windows, epoch milliseconds."""
    mark = query.lastProgress["eventTime"]["watermark"]
    return round(datetime.fromisoformat(mark.replace("Z", "+00:00")).timestamp() * 1000)


def by_hour(stream: DataFrame, ts: Column) -> DataFrame:
    """Columns for the ``market / date / hour`` folders."""
    return with_hour_parts(stream, ts)


def route(stream: DataFrame, routes: Mapping[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str, timeout: int = 300):
    """One stream, one table per event type.

    Each batch is written under its own id with overwrite, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, select in routes.items():
                select(kept).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            kept.unpersist()

    return drain(stream.writeStream.foreachBatch(write), checkpoint, timeout)


def event_routes() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """book, price_change (one row per change), trade and tick-size tables."""
    common = ["event_type", "asset_id", "market", "hash", "event_time", "received_time", "seq"]

    def of(kind):
        return lambda df: df.where(F.col("event_type") == kind)

    return {
        "book": lambda df: flatten_book(of("book")(df)),
        "price_change": lambda df: of("price_change")(df).select(*common, F.inline("price_changes")),
        "trade": lambda df: of("last_trade_price")(df).select(*common, "side", "price", "size"),
        "tick_size": lambda df: of("tick_size_change")(df).select(*common),
    }


# -- stateless transforms ----------------------------------------------------------------------------


def flatten_book(df: DataFrame) -> DataFrame:
    """Top of book by price (highest bid, lowest ask) and the number of levels per side."""
    bid = F.get(F.sort_array("bids", asc=False), F.lit(0))
    ask = F.get(F.sort_array("asks"), F.lit(0))
    return df.select(
        "asset_id", "market", "hash", "event_time", "seq", bid["price"].alias("best_bid"), bid["size"].alias("best_bid_size"),
        ask["price"].alias("best_ask"), ask["size"].alias("best_ask_size"), F.size("bids").alias("bid_depth"), F.size("asks").alias("ask_depth"),
    )


def top_of_book(df: DataFrame, levels: int = 3) -> DataFrame:
    """Best levels per side, spread and mid."""
    return df.where(F.col("event_type") == "book").select("asset_id", "seq", "event_time", *[c.alias(n) for n, c in top_levels("bids", "asks", levels).items()])


def with_schedule(stream: DataFrame, schedule: DataFrame, length: int) -> DataFrame:
    """Attach the market period to each event: equality on the period number, then the static schedule."""
    slot = F.floor(F.unix_seconds("event_time") / length) * length
    return stream.withColumn("open_time", slot).join(schedule, "open_time", "left")


# -- event-time aggregates ---------------------------------------------------------------------------


def tumbling(stream: DataFrame, length: str, keys: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    """Events, price and spread statistics per market period."""
    return _windowed(stream, F.window("event_time", length), keys, lateness)


def sliding(stream: DataFrame, length: str, step: str, keys: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    return _windowed(stream, F.window("event_time", length, step), keys, lateness)


def sessions(stream: DataFrame, gap: str, keys: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    """Continuous capture segments: a pause longer than the gap ends one."""
    return _windowed(stream, F.session_window("event_time", gap), keys, lateness)


def _windowed(stream: DataFrame, window: Column, keys: Sequence[str], lateness: str) -> DataFrame:
    best_bid, best_ask = F.array_max(F.transform("bids", lambda x: x["price"])), F.array_min(F.transform("asks", lambda x: x["price"]))
    out = stream.withWatermark("event_time", lateness).withColumn("spread", best_ask - best_bid).groupBy(*keys, window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.avg("spread").alias("mean_spread"), F.max("spread").alias("max_spread"), F.min("spread").alias("min_spread"),
    )
    stats = ("n", "mean_price", "high", "low", "mean_spread", "max_spread", "min_spread")
    return out.select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), *stats)


def deduplicated(stream: DataFrame, key: str = "hash", lateness: str = LATENESS) -> DataFrame:
    """One event per hash among those that arrive within the lateness of each other."""
    return stream.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([key])


def latency(stream: DataFrame, length: str, lateness: str = LATENESS) -> DataFrame:
    """Mean, exact 95th percentile and worst delay between event and arrival per window, in milliseconds.

    The state of a window is the count of every distinct delay.
    """
    delay = F.unix_millis("received_time") - F.unix_millis("event_time")
    out = stream.withWatermark("event_time", lateness).withColumn("_ms", delay).groupBy(F.window("event_time", length).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_ms").alias("mean_ms"), F.percentile("_ms", 0.95).alias("p95_ms"),
        F.max("_ms").alias("max_ms"), F.count_if(F.col("_ms") < 0).alias("errors"),
    )
    return out.select(F.unix_micros("w.start").alias("start_us"), "n", "mean_ms", "p95_ms", "max_ms", "errors")


# -- stateful operators ------------------------------------------------------------------------------


class Sampler:
    """Keeps an event when enough time has passed since the last kept one or a best price has moved."""

    def __init__(self, last: float | None, bid: float | None, ask: float | None, interval: float, move: float):
        self.last, self.bid, self.ask, self.interval, self.move = last, bid, ask, interval, move

    def _moved(self, old, new) -> bool:
        return old is not None and old > 0 and new is not None and abs(new - old) / old > self.move

    def keep(self, at: float, bid: float | None, ask: float | None) -> bool:
        due = self.last is None or at - self.last >= self.interval
        known = self.bid is None or self.ask is None or (bid is not None and ask is not None and (self._moved(self.bid, bid) or self._moved(self.ask, ask)))
        if not (due or known):
            return False
        self.last = at
        self.bid = bid if bid is not None else self.bid
        self.ask = ask if ask is not None else self.ask
        return True


def sampled(stream: DataFrame, key: str, order: Sequence[str], at_ms: str, bid: str, ask: str,
            interval_ms: float = MIN_INTERVAL_MS, move: float = MIN_MOVE) -> DataFrame:
    """Adaptive sampler with its state in the checkpoint.

    Files must land in time order; inside a micro-batch the events of a key are sorted.  ``maxFilesPerTrigger`` bounds
    what a key can bring per batch.
    """
    kinds = dict(stream.dtypes)
    columns = [key, *dict.fromkeys([*order, at_ms, bid, ask])]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sampler = Sampler(*(state.get if state.exists else (None, None, None)), interval_ms, move)
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        values = zip(rows[at_ms], *[[None if pd.isna(v) else v for v in rows[c]] for c in (bid, ask)])
        kept = [sampler.keep(t, b, a) for t, b, a in values]
        state.update((float(sampler.last), sampler.bid, sampler.ask))
        yield rows[kept][columns]

    return stream.select(*columns).groupBy(key).applyInPandasWithState(
        step, ", ".join(f"{c} {kinds[c]}" for c in columns), "last double, bid double, ask double", "append", GroupStateTimeout.NoTimeout
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State in maps and lists needs a store that reads and writes single entries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class BookKeeper(StatefulProcessor):
    """Book of one asset: a map of the live sizes by side and price, and one value with epoch, best prices and totals.

    Of the map only the levels that a batch touches are read and written; all of it is listed only where the best price
    of a side goes, to find the next one.
    """

    SIDES = ("BUY", "SELL")

    def init(self, handle) -> None:
        self.sizes = handle.getMapState("sizes", "side string, price double", "size double")
        self.totals = handle.getValueState("totals", "applied long, bid double, ask double, bids long, asks long, bid_volume double, ask_volume double")

    def close(self) -> None:
        pass

    def _size(self, side: str, price: float) -> float:
        key = (side, price)
        if key not in self.touched:
            known = None if self.cleared else self.sizes.getValue(key) if self.sizes.containsKey(key) else None
            self.touched[key] = float(known[0]) if known else 0.0
        return self.touched[key]

    def _next_best(self, side: str) -> float | None:
        live = {k for k, size in self.touched.items() if size > 0 and k[0] == side}
        if not self.cleared:
            live |= {tuple(k) for k in self.sizes.keys() if k[0] == side and tuple(k) not in self.touched}
        prices = [price for _, price in live]
        return (max(prices) if side == "BUY" else min(prices)) if prices else None

    def _apply(self, reset: bool, side: str, price: float, size: float) -> None:
        if reset:
            self.touched, self.cleared = {}, True
            self.best, self.levels, self.volume = {s: None for s in self.SIDES}, dict.fromkeys(self.SIDES, 0), dict.fromkeys(self.SIDES, 0.0)
        before, size = self._size(side, price), max(size, 0.0)
        self.touched[side, price] = size
        self.levels[side] += (size > 0) - (before > 0)
        self.volume[side] = self.volume[side] + size - before if self.levels[side] else 0.0
        best = self.best[side]
        if size > 0 and (best is None or (price > best if side == "BUY" else price < best)):
            self.best[side] = price
        elif size == 0 and best == price:
            self.best[side] = self._next_best(side)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.touched, self.cleared, applied = {}, False, -1
        self.best, self.levels, self.volume = {s: None for s in self.SIDES}, dict.fromkeys(self.SIDES, 0), dict.fromkeys(self.SIDES, 0.0)
        if self.totals.exists():
            applied, self.best["BUY"], self.best["SELL"], self.levels["BUY"], self.levels["SELL"], self.volume["BUY"], self.volume["SELL"] = self.totals.get()
        waiting: list[tuple] = []  # rows that came before their predecessor

        def out(ready: list[tuple]) -> pd.DataFrame:
            nonlocal applied
            states = []
            for seq, reset, side, price, size in ready:
                if seq <= applied:  # a replay
                    continue
                self._apply(reset, side, price, size)
                applied = seq
                states.append((key[0], seq, self.best["BUY"], self.best["SELL"], self.levels["BUY"], self.levels["SELL"], self.volume["BUY"], self.volume["SELL"]))
            return pd.DataFrame(states, columns=["asset", "seq", *[f.split()[0] for f in STATE.split(", ")]]).astype({"best_bid": "float64", "best_ask": "float64"})

        for part in rows:
            for row in zip(part["seq"].tolist(), part["is_snapshot"].tolist(), part["side"].tolist(), part["price"].tolist(), part["size"].tolist()):
                heapq.heappush(waiting, row)
            ready, last = [], applied
            while waiting and waiting[0][0] <= last + 1:
                ready.append(heapq.heappop(waiting))
                last = max(last, ready[-1][0])
            yield out(ready)
        yield out([heapq.heappop(waiting) for _ in range(len(waiting))])
        if self.cleared:
            self.sizes.clear()
        for (side, price), size in self.touched.items():
            if size > 0:
                self.sizes.updateValue((side, price), (size,))
            elif not self.cleared and self.sizes.containsKey((side, price)):
                self.sizes.removeKey((side, price))
        self.totals.update((applied, self.best["BUY"], self.best["SELL"], self.levels["BUY"], self.levels["SELL"], self.volume["BUY"], self.volume["SELL"]))


def maintained_books(changes: DataFrame) -> DataFrame:
    """Book after every change, with the live levels as checkpointed keyed state.

    ``changes`` has asset, seq, is_snapshot, side, price, size. A batch's rows are applied in the order of their sequence
    numbers: as they come where they follow each other, and at the batch's end where numbers are missing. A number at or
    below the last applied one is a replay and is skipped.
    """
    keyed_state(changes.sparkSession)
    kinds = dict(changes.dtypes)
    rows = changes.select("asset", "seq", "is_snapshot", "side", "price", "size")
    return rows.groupBy("asset").transformWithStateInPandas(
        statefulProcessor=BookKeeper(), outputStructType=f"asset {kinds['asset']}, seq {kinds['seq']}, {STATE}", outputMode="Append", timeMode="None")


class RecentDelays(StatefulProcessor):
    """Delays of the last messages of a market, as a list in the state; every message reports their 95th percentile."""

    CHUNK = 5_000  # windows sorted at once

    def __init__(self, last: int, share: float):
        self.last, self.share = last, share

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "ms double")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = np.array([r[0] for r in self.ring.get()], dtype="float64")
        # three numbers per message of the batch as arrays, not as objects; results leave some thousand at a time
        parts = [[part[c].to_numpy() for c in ("us", "seq", "ms")] for part in rows]
        us, seq, delays = (np.concatenate([part[i] for part in parts] or [np.empty(0, "int64")]) for i in range(3))
        order = np.lexsort((seq, us))
        del parts, us
        for start in range(0, len(order), self.CHUNK):
            taken = order[start : start + self.CHUNK]
            ms = delays[taken].astype("float64")
            known = np.concatenate([ring, ms])
            # a window that has fewer messages is filled up at its low end, and counted without the filling
            filled = np.concatenate([np.full(self.last - 1, -np.inf), known])
            windows = sliding_window_view(filled, self.last)[len(ring) :]
            n = np.minimum(np.arange(len(ring) + 1, len(known) + 1), self.last)
            at = (n - 1) * self.share
            low = at.astype("int64")
            ordered, each, first = np.sort(windows, axis=1), np.arange(len(n)), self.last - n
            below, above = ordered[each, first + low], ordered[each, first + np.minimum(low + 1, n - 1)]
            yield pd.DataFrame({
                "market": key[0], "seq": seq[taken], "ms": ms, "mean_ms": np.where(np.isinf(windows), 0.0, windows).sum(axis=1) / n,
                "p95_ms": below + (above - below) * (at - low), "n": n,
            })
            ring = known[-self.last :]
        self.ring.put([(float(ms),) for ms in ring])


def recent_latency(stream: DataFrame, last: int = 100, share: float = 0.95) -> DataFrame:
    """Mean and 95th percentile of the delay between event and arrival over the last messages of a market, for every one."""
    keyed_state(stream.sparkSession)
    delay = F.unix_millis("received_time") - F.unix_millis("event_time")
    rows = stream.select("market", F.unix_micros("event_time").alias("us"), "seq", delay.alias("ms"))
    return rows.groupBy("market").transformWithStateInPandas(
        statefulProcessor=RecentDelays(last, share), outputStructType="market string, seq long, ms double, mean_ms double, p95_ms double, n long", outputMode="Append", timeMode="None")


def late_rows(stream: DataFrame, watermark: int, length: str) -> DataFrame:
    """Side output: events whose window had been closed by a watermark (epoch milliseconds) before they came."""
    end = F.unix_millis(F.window("event_time", length).end)
    return stream.where(end <= watermark)


def progress_table(spark: SparkSession, query) -> DataFrame:
    """What a drained stream tells of its batches: rows read, its watermark, and rows dropped for being late."""
    rows = [(p["batchId"], p["numInputRows"], (p.get("eventTime") or {}).get("watermark"), sum(s.get("numRowsDroppedByWatermark", 0) for s in p["stateOperators"])) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, rows long, watermark string, dropped long")


# -- batch checks on captured files ------------------------------------------------------------------


def capture_health(spark: SparkSession, path: str, expected_per_day: int, tolerance: float, min_bytes: int) -> DataFrame:
    """Files per date folder against the expected number, and files below the minimum size."""
    files = configure(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    sized = files.select("path", "length", F.regexp_extract("path", r"date=([0-9-]+)", 1).alias("date"))
    low, high = expected_per_day * (1 - tolerance), expected_per_day * (1 + tolerance)
    n = F.count(F.lit(1))
    return sized.groupBy("date").agg(
        n.alias("files"), F.count_if(F.col("length") < min_bytes).alias("too_small"), F.min("length").alias("smallest"),
        n.between(low, high).alias("as_expected"),
    )


def fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new table folder and checkpoint folder."""
    base = scratch(spark, name)
    return f"{base}/table", f"{base}/checkpoint"
