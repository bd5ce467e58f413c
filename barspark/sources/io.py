"""Bar caches, vendor payloads, dates and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch  # noqa: F401

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def write_bars(bars: DataFrame, path: str, buckets: int = 16) -> None:
    """Parquet by a bucket of the symbol: readers of one symbol prune the others, and many symbols make few folders."""
    bars.withColumn("symbol_bucket", F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("symbol_bucket").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BARS + ", symbol_bucket int").parquet(path).drop("symbol_bucket")


def read_bar_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and a fixed schema: no pass over the data to infer one."""
    return spark.read.schema(BARS).option("header", True).option("enforceSchema", False).csv(path)


RESULT = "array<struct<t: long, o: double, h: double, l: double, c: double, v: double>>"


def to_aggregates(bars: DataFrame) -> DataFrame:
    """One payload per symbol and day, as a vendor's aggregates."""
    r = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").cast("double").alias("v"))
    return bars.groupBy("symbol", F.col("ts").cast("date").alias("day")).agg(F.to_json(F.struct(F.collect_list(r).alias("results"))).alias("payload")).drop("day")


def parse_aggregates(payloads: DataFrame) -> DataFrame:
    x = payloads.select("symbol", F.explode(F.from_json("payload", f"results {RESULT}")["results"]).alias("r"))
    return x.select("symbol", F.timestamp_millis("r.t").cast("timestamp_ntz").alias("ts"), *[F.col(f"r.{n[0]}").alias(n) for n in ("open", "high", "low", "close", "volume")])


def to_records(bars: DataFrame) -> DataFrame:
    return bars.select(F.to_json(F.struct("symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_event"), "open", "high", "low", "close", "volume")).alias("record"))


def parse_records(lines: DataFrame) -> DataFrame:
    r = F.from_json("record", "symbol string, ts_event string, open double, high double, low double, close double, volume double")
    return lines.select(r.alias("r")).select("r.symbol", F.to_timestamp_ntz("r.ts_event").alias("ts"), "r.open", "r.high", "r.low", "r.close", "r.volume")


def normalize_symbol(s: Column) -> Column:
    u = F.upper(F.replace(s, F.lit("/"), F.lit("-")))
    return F.when(F.contains(u, F.lit("-")), u).otherwise(F.concat(u, F.lit("-USD")))


def resolve_date(text: Column, as_of: Column) -> Column:
    """``-30D`` is 30 days before ``as_of``; anything else is read as a date."""
    n = F.regexp_extract(text, r"^-(\d+)D$", 1)
    return F.when(n != "", F.date_sub(as_of, F.when(n != "", n).cast("int"))).otherwise(F.try_to_date(text))


def append_curves(curves: DataFrame, path: str) -> None:
    """Adds rows (``strategy, ts, equity``) to the CSV files at ``path``: each call writes files of its own, so a repeated task leaves no part of a row."""
    curves.select("ts", "equity", "strategy").write.mode("append").option("header", True).csv(path)


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """Equity files by strategy; rows whose number can't be read are skipped."""
    x = spark.read.schema("ts string, equity string, strategy string").option("header", True).csv(path)
    return x.select("strategy", F.to_timestamp_ntz("ts").alias("ts"), F.expr("try_cast(equity AS double)").alias("equity")).where("equity is not null")


def curves_to_json(curves: DataFrame) -> DataFrame:
    """``{strategy: [{ts, equity}]}``, one row per strategy."""
    g = curves.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("ts", "equity"))).alias("c"))
    return g.select(F.to_json(F.map_from_arrays(F.array("strategy"), F.array("c"))).alias("payload"))


def curves_from_json(payloads: DataFrame) -> DataFrame:
    m = F.from_json("payload", "map<string, array<struct<ts: string, equity: double>>>")
    return payloads.select(F.explode(m).alias("strategy", "c")).select("strategy", F.inline("c"))


def export_signals(signals: DataFrame, path: str, symbol: str | None = None, since=None, most: int | None = None) -> None:
    """CSV with a header of the signals that aren't 0, newest first, of one symbol, from a time on, and at most so many if asked for."""
    x = signals.where("signal <> 0").where(F.lit(True) if symbol is None else F.col("symbol") == symbol).where(F.lit(True) if since is None else F.col("ts") >= since)
    x = x.orderBy(F.desc("ts"), "symbol")
    (x if most is None else x.limit(most)).write.option("header", True).csv(path)


def report_json(metrics: DataFrame, *keys: str) -> DataFrame:
    """One JSON document a row of ``metrics``, beside its keys."""
    return metrics.select(*keys, F.to_json(F.struct(*[c for c in metrics.columns if c not in keys]), {"ignoreNullFields": "false"}).alias("report"))
