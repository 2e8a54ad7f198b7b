"""Repeatable samples and orders by hash; no driver-side choice, so re-run tasks pick the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.aggregates import top_per_group
from tidemark.operators.series import Running, Series

_DRAWS = float(1 << 32)


def digest(keys: Sequence[str], seed: int) -> Column:
    """md5 of the key's text and the seed: the same in every engine, so samples can be repeated elsewhere."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def key_hash(keys: Sequence[str], seed: int) -> Column:
    """The first 60 bits of the digest as a number."""
    return F.conv(F.substring(digest(keys, seed), 1, 15), 16, 10).cast("long")


def uniform(keys: Sequence[str], seed: int) -> Column:
    """One of 2 ** 32 values in [0, 1) fixed by the key and the seed."""
    return first_bits(keys, seed) / _DRAWS


def repeated_uniform(first: Column, nth: Column) -> Column:
    """One of 2 ** 32 values in [0, 1) for the nth draw of a row whose first 32 digest bits are given: integer mixing, so
    that many draws cost one digest."""
    word = F.lit((1 << 32) - 1)
    x = first.bitwiseXOR((nth * F.lit(2654435761)).bitwiseAND(word))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * 73244475).bitwiseAND(word)
    return x.bitwiseXOR(F.shiftright(x, 16)) / _DRAWS


def first_bits(keys: Sequence[str], seed: int) -> Column:
    """The first 32 bits of the digest as a number."""
    return F.conv(F.substring(digest(keys, seed), 1, 8), 16, 10).cast("long")


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int) -> DataFrame:
    return df.where(uniform(keys, seed) < fraction)


def hash_order(df: DataFrame, keys: Sequence[str], seed: int, position: str = "position") -> DataFrame:
    """Rows numbered from 1 in an order that looks random but is fixed by key and seed."""
    return Series(df.withColumn("_digest", digest(keys, seed)), [], ["_digest", *keys]).running(**{position: Running("count")}).drop("_digest")


def stratified(df: DataFrame, strata: Sequence[str], keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows per stratum, those with the smallest hash."""
    return top_per_group(df, strata, [digest(keys, seed), *[F.col(k) for k in keys]], n, "_rank").drop("_rank")


def every_nth(df: DataFrame, order: Sequence[str], n: int, name: str = "row_index") -> DataFrame:
    """Rows 0, n, 2n, ... of the table in the given order."""
    return Series(df, [], order).numbered(name).df.where(F.col(name) % n == 0)
