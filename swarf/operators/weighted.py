"""Weighted percentiles by a step distribution, and the robust diameters built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_percentile(rows: DataFrame, by: Sequence[str], value: str, weight: str, p: float, name: str) -> DataFrame:
    """by, name: the least value whose running weight reaches p of the whole; weights not over 0 are dropped, p is clamped.

    A group without weight is absent. One shuffle, on `by`.
    """
    p = min(1.0, max(0.0, p))
    up = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.where(F.col(weight) > 0).select(*by, value, F.sum(weight).over(up).alias("_run"), F.sum(weight).over(Window.partitionBy(*by)).alias("_all"))
    return rows.where(F.col("_run") >= p * F.col("_all")).groupBy(*by).agg(F.min(value).alias(name))
