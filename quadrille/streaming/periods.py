"""Period aggregation of a stream: the batch operator's keys over event time, with late rows left out by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, period_key

#: Longest periods in days.
DAYS = {"month": 31, "quarter": 92, "year": 366}


def stream_periods(stream: DataFrame, column: str, grain: str, series: list[str] = (), late: str | None = None) -> DataFrame:
    """Rows and means per month, quarter or year. Calendar periods have no fixed length, so a period's first instant is the
    key, and it carries the watermark: in update and append mode a period that began earlier than ``late`` and a period's
    length behind the newest one is closed; rows that come for it are dropped, and its state goes. A row that is not more
    than ``late`` behind the newest is always counted. Complete mode keeps all."""
    start = F.date_trunc(grain, F.col(column).cast("timestamp"))
    rows = stream.where(F.col(column).isNotNull()).select(start.alias("start"), *(finite(F.col(c)).alias(f"v{i}") for i, c in enumerate(series)))
    if late is not None:
        rows = rows.withWatermark("start", f"{late} {DAYS[grain]} days")
    counted = rows.groupBy("start").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"v{i}").alias(f"mean_{c}") for i, c in enumerate(series)))
    return counted.select(period_key(F.col("start"), grain).alias("period"), "n", *(f"mean_{c}" for c in series))
