"""Generated calendars: contract schedules, local-time slugs, day spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import configure

QUARTER_HOUR, HOUR = 900, 3600


def contracts_between(span: DataFrame, lo: str, hi: str, length: int) -> DataFrame:
    """Contracts of fixed length covering [lo, hi] of a one-row table."""
    start = F.floor(F.col(lo) / length) * length
    return schedule_columns(span.select(F.explode(F.sequence(start, F.col(hi), F.lit(length))).alias("open_time")), length)


def schedule(spark: SparkSession, start: int, end: int, length: int) -> DataFrame:
    """Contracts of fixed length from start (included) to end (excluded), epoch seconds."""
    return schedule_columns(configure(spark).range(start, end, length).toDF("open_time"), length)


def schedule_columns(df: DataFrame, length: int) -> DataFrame:
    """Identifier, close time and calendar columns of contracts given their open time."""
    ts = F.timestamp_seconds("open_time")
    return df.select(
        F.date_format(ts, "yyyyMMdd_HHmm").alias("contract_id"),
        "open_time",
        (F.col("open_time") + length).alias("close_time"),
        F.to_date(ts).alias("date"),
        F.hour(ts).alias("hour_of_day"),
        F.minute(ts).alias("minute_of_hour"),
        F.weekday(ts).alias("day_of_week"),
    )


def local_slug(open_time: Column, prefix: str = "bitcoin-up-or-down", zone: str = "America/New_York") -> Column:
    """Slug such as ``bitcoin-up-or-down-june-11-2am-et`` in the market's local time."""
    local = F.from_utc_timestamp(F.timestamp_seconds(open_time), zone)
    return F.lower(F.concat(F.lit(prefix + "-"), F.date_format(local, "MMMM-d-ha"), F.lit("-et")))


def day_spine(df: DataFrame, day: str) -> DataFrame:
    """Every calendar day between the first and last day of a table."""
    span = df.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    return span.select(F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(day))
