"""The library's inputs as views of the star tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.running import running, total
from ..functions.scratch import settled
from ..operators.bars import ticks_to_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"))


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("tick_id"), F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("qty"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by event type."""
    return ticks_to_bars(ticks(spark, sf_dir), "hour")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by brand: a long history for 25 symbols."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    t = li.join(part, li.l_partkey == part.p_partkey).select(F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("tick_id"))
    return ticks_to_bars(t, "day")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with their symbol, reason and strategy. Orders meet customers before lines meet orders, so that lines are shuffled once less."""
    li, o, p, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "customer"))
    x = li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return x.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("ts"), F.col("p_brand").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("o_orderpriority").alias("reason"), F.col("c_mktsegment").alias("strategy"),
    )


def cash_flow() -> Column:
    """The signed cash flow of trades, in whole cents."""
    return F.sum(F.round(F.when(F.col("side") == "BUY", -1).otherwise(1) * F.col("qty") * F.col("price") * 100).cast("long")).alias("flow")


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily equity per strategy: a million plus the running signed cash flow, in whole cents."""
    # Written before its rows are numbered, which reads them twice: the joins are made once.
    return curve(settled(trades(spark, sf_dir).groupBy("strategy", F.col("ts").cast("date").alias("day")).agg(cash_flow()), "flows"))


def curve(flows: DataFrame) -> DataFrame:
    """Equity by strategy and day from daily flows in cents."""
    x = running(flows, {"total": total(F.col("flow"))}, "strategy", order="day")
    return x.select("strategy", "day", (1_000_000.0 + F.col("total") / 100).alias("equity"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_posts(table(spark, sf_dir, "documents"))


def as_posts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("post_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("ts"), F.col("lang").alias("symbol"), "source", "text")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a stand-in score that has ties."""
    d, y = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select("doc_id", F.col("quality").alias("y"), (F.pmod(F.col("n_chars"), F.lit(101)) / 100.0).alias("p"))


TICKS = "ticks AS (SELECT event_id AS tick_id, event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty FROM events)"
BARS = f"{TICKS}, bars AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, sum(qty)::BIGINT AS volume FROM ticks GROUP BY 1, 2)"
DAILY = """daily AS (SELECT p_brand AS symbol, l_shipdate::TIMESTAMP AS ts, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS close,
  sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
TRADES = """trades AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_shipdate AS ts, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS qty,
  l_extendedprice / l_quantity AS price, o_orderpriority AS reason, c_mktsegment AS strategy FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""
EQUITY = f"""{TRADES}, flows AS (SELECT strategy, ts::DATE AS day, sum(round(CASE WHEN side = 'BUY' THEN -1 ELSE 1 END * qty * price * 100)::BIGINT) AS flow FROM trades GROUP BY 1, 2),
equity AS (SELECT strategy, day, 1000000.0::DOUBLE + (sum(flow) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING))::DOUBLE / 100 AS equity FROM flows)"""
POSTS = "posts AS (SELECT doc_id AS post_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts, lang AS symbol, source, text FROM documents)"
SCORED = "scored AS (SELECT doc_id, quality AS y, (n_chars % 101) / 100.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"
