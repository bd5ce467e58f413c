"""Bars: aggregation, cleaning, gaps, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import in_blocks, ordered, trailing


def ohlcv() -> list[Column]:
    """A bar's aggregates over ticks, in batches and streams."""
    order = F.struct("ts", "tick_id")
    return [F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume")]


def ticks_to_bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """OHLCV by symbol and time unit. Partial aggregates only: no sort, and no symbol in one task."""
    b = ticks.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("at")).agg(*ohlcv())
    return b.withColumnRenamed("at", "ts")


def first_of_duplicates(bars: DataFrame, order: str = "ingest_id") -> DataFrame:
    """The first row by ``order`` of each symbol and time."""
    return bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(order))).where("__n = 1").drop("__n")


def valid_ohlc():
    return (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))


def ohlc_violations(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count_if(~valid_ohlc()).alias("violations"), F.count("*").alias("bars"))


def missing_bars(bars: DataFrame, step: str = "1 hour", weekdays: bool = False) -> DataFrame:
    """Times between a symbol's first and last bar that have none."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    all_ = span.select("symbol", F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias("ts"))
    if weekdays:
        all_ = all_.where(F.weekday("ts") < 5)
    return all_.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def gap_report(bars: DataFrame, step_seconds: int = 3600, warn: int = 3) -> DataFrame:
    """Missing bars by symbol: how many, the first, the last and the longest run."""
    gap = in_blocks(bars.select("symbol", "ts"), lambda x: x.withColumn("before", F.lag("ts").over(ordered())), 1).withColumn("n", (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("before").cast("timestamp"))) / step_seconds - 1)
    out = gap.groupBy("symbol").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("missing"), F.min(F.when(F.col("n") > 0, F.col("before"))).alias("first_gap_after"), F.max(F.when(F.col("n") > 0, F.col("before"))).alias("last_gap_after"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("longest"))
    return out.withColumn("warn", F.col("longest") > warn)


def clip_zscore(bars: DataFrame, column: str = "close", window: int = 60, threshold: float = 3.0, min_rows: int = 1) -> DataFrame:
    """``column`` held within ``threshold`` deviations of its rolling mean; symbols of fewer than ``min_rows`` bars pass as they are."""
    enough = bars.groupBy(F.col("symbol").alias("__s")).agg((F.count("*") >= min_rows).alias("__enough"))

    def clip(x: DataFrame) -> DataFrame:
        w = trailing(window)
        mean, n = F.avg(column).over(w), F.count(column).over(w)
        sd = F.coalesce(F.stddev_samp(column).over(w), F.lit(1e-9))
        held = F.greatest(F.least(F.col(column), mean + threshold * sd), mean - threshold * sd)
        return x.withColumn(column, F.when((n >= max(1, window // 2)) & F.col("__enough"), held).otherwise(F.col(column)))

    return in_blocks(bars.join(enough, F.col("symbol").eqNullSafe(F.col("__s"))).drop("__s"), clip, window - 1).drop("__enough")


def clean(bars: DataFrame, min_rows: int = 60, window: int = 60, threshold: float = 3.0) -> DataFrame:
    """Duplicates out (first kept), broken bars out, outliers clipped where a symbol is long enough."""
    return clip_zscore(first_of_duplicates(bars).where(valid_ohlc()), "close", window, threshold, min_rows)


def latest(bars: DataFrame, n: int = 100) -> DataFrame:
    return bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("__n") <= n).drop("__n")


def first_source(sources: list[DataFrame]) -> DataFrame:
    """All rows of the first source that has the symbol."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(i))
        every = s if every is None else every.unionByName(s)
    best = every.groupBy("symbol").agg(F.min("priority").alias("priority"))
    return every.join(best, ["symbol", "priority"])


def stale_symbols(bars: DataFrame, as_of, days: int = 1) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("ts").alias("last_ts")).withColumn("fresh", F.col("last_ts") >= as_of - F.expr(f"interval {days} day"))
