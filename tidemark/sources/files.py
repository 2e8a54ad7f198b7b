"""Readers and writers: Parquet, CSV, NDJSON, landed pages, partitioned and compacted tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.aggregates import first_per_key
from tidemark.session import configure, cut_lineage

# -- file schemas, fixed by the feeds ---------------------------------------------------------------

OPTION_QUOTE_CSV = (
    "exchange string, symbol string, timestamp long, local_timestamp long, type string, strike_price double, "
    "underlying string, expiry_str string, bid_price double, bid_amount double, ask_price double, ask_amount double"
)
TRADE_CSV = (
    "exchange string, symbol string, timestamp long, local_timestamp long, id string, side string, price double, "
    "amount double"
)
_LEVELS = "array<struct<price:double,amount:double>>"
MESSAGE_JSON = (
    "type string, exchange string, symbol string, timestamp string, localTimestamp string, "
    f"bids {_LEVELS}, asks {_LEVELS}"
)


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, predicate: Column | str | None = None
) -> DataFrame:
    """Parquet with column and row selection; both reach the scan."""
    df = configure(spark).read.parquet(path)
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*columns) if columns else df


def read_tree(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """All matching Parquet files below a folder."""
    reader = configure(spark).read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.parquet(root)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV or CSV.gz with a header and a given schema; unreadable values become null."""
    return configure(spark).read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path)


def read_messages(spark: SparkSession, path: str, schema: str | T.StructType = MESSAGE_JSON) -> DataFrame:
    """Newline-delimited JSON messages."""
    return configure(spark).read.schema(schema).json(path)


def landed_pages(pages: DataFrame, key: str, order: Sequence[str], casts: dict[str, str]) -> DataFrame:
    """Overlapping pages of an API dump as one table: cast leniently, keep one row per key."""
    typed = pages.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})
    return first_per_key(typed, [key], order)


def heal_union(left: DataFrame, right: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Union of tables with missing or all-null columns, cast to one schema."""

    def healed(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(
            *[(F.col(c) if c in have else F.lit(None)).try_cast(t).alias(c) for c, t in schema.items()]
        )

    return healed(left).unionByName(healed(right))


def latest_snapshot(df: DataFrame, snapshot: str) -> DataFrame:
    """Rows of the newest snapshot."""
    return df.where(F.col(snapshot) == df.agg(F.max(snapshot)).scalar())


def latest_file(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the most recently written file below a folder; only the listing is searched, not the rows."""
    listing = configure(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    newest = listing.load(root).select("modificationTime", "path").agg(F.max(F.struct("modificationTime", "path")).alias("f")).first()["f"]
    if newest is None:
        raise FileNotFoundError(f"no Parquet file below {root}")
    return configure(spark).read.parquet(newest["path"])


def spread(df: DataFrame) -> DataFrame:
    """A table of few files dealt to all cores, for work that costs far more per row than moving the row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# -- sinks ------------------------------------------------------------------------------------------


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                  compression: str = "zstd") -> None:
    """Parquet sink.  With partition columns the rows are rebalanced on them: adaptive execution merges small
    partitions and splits large ones, so there are few files and no folder has to fit one task."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).option("compression", compression).partitionBy(*partition_by).parquet(path)


def with_hour_parts(df: DataFrame, ts: Column) -> DataFrame:
    """Columns for ``date=/hour=`` folders."""
    return df.withColumns({"date": F.date_format(ts, "yyyy-MM-dd"), "hour": F.date_format(ts, "HH")})


def with_calendar_parts(df: DataFrame, ts: Column) -> DataFrame:
    """Columns for ``year/month/day`` folders."""
    return df.withColumns({p: F.date_format(ts, f) for p, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))})


SMALL_REPORT = 100_000  # rows that go into a report of one file


def _one_file(df: DataFrame, most: int) -> DataFrame:
    """The table in one partition; refused if it has more than ``most`` rows, which nobody reads in one file."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a report of one file is limited to {most} rows; write a table instead")
    return df.coalesce(1)


def write_csv_report(df: DataFrame, path: str, most: int = SMALL_REPORT) -> None:
    """A small ranked report as a single CSV file."""
    _one_file(df, most).write.mode("overwrite").option("header", "true").csv(path)


def write_json_summary(df: DataFrame, path: str, most: int = SMALL_REPORT) -> None:
    """A small summary as JSON lines."""
    _one_file(df.select(F.to_json(F.struct(*df.columns)).alias("value")), most).write.mode("overwrite").text(path)


def compact(df: DataFrame, order: Sequence[str], path: str, rows_per_file: int = 20_000_000) -> None:
    """Many files to one table sorted by ``order`` across and inside files."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option(
        "maxRecordsPerFile", rows_per_file
    ).parquet(path)


def append_dedup(
    spark: SparkSession, path: str, new: DataFrame, key: str, order: Sequence[str], partition: str
) -> None:
    """Merge new rows into a partitioned table: one row per key, rewriting only the touched partitions."""
    touched = new.select(partition).distinct()
    try:
        old = read_table(spark, path)
    except AnalysisException as error:  # first load: there is no table yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = new
    else:
        # one row per touched folder; a shuffle on it would put a whole folder into one task
        merged = old.join(F.broadcast(touched), partition, "left_semi").unionByName(new)
    # The result replaces files it was read from, so it is made durable first.
    kept = cut_lineage(first_per_key(merged, [key], order))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def manifest(spark: SparkSession, path: str, ts: str) -> DataFrame:
    """Rows, first and last time and bytes of every file of a written table."""
    df = read_tree(spark, path)
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.max("_metadata.file_size").alias("bytes"),
    )


def local_label_to_utc(label: Column, pattern: str, zone: str) -> Column:
    """Local-time folder label to UTC."""
    return F.to_utc_timestamp(F.try_to_timestamp(label, F.lit(pattern)), zone)
