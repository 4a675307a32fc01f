"""Aggregation by calendar period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, period_key, period_label


def auto_period(df: DataFrame, column: str) -> str:
    """Year over more than six years, quarter over more than two and a half, else month."""
    lo, hi = df.agg(F.min(F.col(column).cast("date")), F.max(F.col(column).cast("date"))).first()
    if lo is None:
        return "month"
    years = (hi - lo).days / 365.25
    return "year" if years > 6 else "quarter" if years > 2.5 else "month"


def time_aggregate(df: DataFrame, column: str, grain: str, series: list[str] = ()) -> DataFrame:
    """Rows and means per period; missing values are left out of a mean."""
    key = period_key(F.col(column), grain)
    out = df.where(F.col(column).isNotNull()).groupBy(key.alias("period")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(finite(F.col(c))).alias(f"mean_{c}") for c in series))
    return out.withColumn("label", period_label(F.col("period"), grain))


def composition(df: DataFrame, column: str, grain: str, label: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(period_key(F.col(column), grain).alias("period"), F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def trajectory(df: DataFrame, column: str, grain: str, x: str, y: str, least: int = 5) -> DataFrame:
    """Mean coordinates per period of at least ``least`` rows."""
    return df.where(F.col(column).isNotNull()).groupBy(period_key(F.col(column), grain).alias("period")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
