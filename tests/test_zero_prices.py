"""Prices of zero: quotients and logarithms that need them are null, everything else stands."""

import math

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def zero_sf(tmp_path_factory, sf):
    """The events, of which one in 400 has a price of zero."""
    folder = tmp_path_factory.mktemp("zero")
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 400 = 7 THEN 0.0 ELSE value END AS value) FROM '{sf}/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


def test_feature_table_with_prices_of_zero(spark, zero_sf):
    """A step that opens at zero has no basis, one that closes at zero no relative spread; the hour keeps the others."""
    rows = entry.queries()["i41_feature_table"](spark, zero_sf).collect()
    partly = [r for r in rows if r.spread_bps_known < r.seconds]
    assert partly and any(r.basis_bps_known < r.seconds for r in rows)
    assert all(r.close_known == r.seconds for r in rows)
    assert not any(isinstance(v, float) and not math.isfinite(v) for r in rows for v in r)
