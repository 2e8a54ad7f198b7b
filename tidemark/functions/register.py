"""SQL-callable functions: native SQL expressions where they suffice, one batch function for the solver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from tidemark.functions import pricing
from tidemark.functions.pricing import norm_cdf_array


@F.pandas_udf(T.DoubleType())
def normal_cdf_batch(x: pd.Series) -> pd.Series:
    """Normal distribution function over Arrow batches; the Column form is the one to use."""
    return pd.Series(norm_cdf_array(x.to_numpy(np.float64)))


def _polynomial(coefficients, x: str) -> str:
    text = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}D)"
    return text


def register_functions(spark: SparkSession) -> None:
    """norm_cdf, norm_pdf, binary_price and calendar as SQL functions, implied_vol as a batch function."""
    z, density = "abs(x)", "exp(-x * x / 2D)"
    fraction = f"({z} + 1D / ({z} + 2D / ({z} + 3D / ({z} + 4D / ({z} + 0.65D)))))"
    tail = (
        f"CASE WHEN {z} > {pricing.TAIL_END}D THEN 0D WHEN {z} < {pricing.TAIL_SPLIT}D "
        f"THEN {density} * {_polynomial(pricing.TAIL_NUM, z)} / {_polynomial(pricing.TAIL_DEN, z)} "
        f"ELSE {density} / {fraction} / {pricing.TAIL_SCALE}D END"
    )
    statements = [
        f"norm_cdf(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x > 0 THEN 1D - ({tail}) ELSE {tail} END",
        "norm_pdf(x DOUBLE) RETURNS DOUBLE RETURN exp(-x * x / 2D) / sqrt(2D * pi())",
        f"""binary_price(spot DOUBLE, strike DOUBLE, rate DOUBLE, sigma DOUBLE, seconds DOUBLE) RETURNS DOUBLE
        RETURN exp(-rate * seconds / {pricing.SECONDS_PER_YEAR}D) * norm_cdf(CASE
          WHEN sigma * sqrt(seconds / {pricing.SECONDS_PER_YEAR}D) > 1e-10D
          THEN try_divide(ln(spot / strike) + (rate - 0.5D * sigma * sigma) * seconds / {pricing.SECONDS_PER_YEAR}D,
                          sigma * sqrt(seconds / {pricing.SECONDS_PER_YEAR}D))
          WHEN spot > strike THEN 1e10D ELSE -1e10D END)""",
        "calendar(start BIGINT, stop BIGINT, step BIGINT) RETURNS TABLE (open_time BIGINT) "
        "RETURN SELECT explode(sequence(start, stop - step, step))",
    ]
    for statement in statements:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {statement}")
    spark.udf.register("implied_vol", pricing.implied_vol)
