"""Rows joined to the ranges of days that hold them, by an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_ranges(rows: DataFrame, ranges: DataFrame, day: Column, start: str, end: str, width: int = 32) -> DataFrame:
    """``rows`` once for each of ``ranges`` with ``start <= day < end``, with the ranges' columns.

    Ranges are repeated for each bucket of ``width`` days that they touch and joined by bucket, so there is no join without an equality; Spark broadcasts
    the ranges if they turn out small, and splits a hot bucket if not. Null days and empty ranges join nothing."""
    bucket = lambda d: F.floor(F.unix_date(d) / width)
    r = ranges.where(F.col(start) < F.col(end))
    r = r.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.date_sub(F.col(end), 1)))))
    x = rows.withColumn("__day", day.cast("date")).withColumn("__bucket", bucket(F.col("__day")))
    return x.join(r, "__bucket").where((F.col("__day") >= F.col(start)) & (F.col("__day") < F.col(end))).drop("__day", "__bucket")
