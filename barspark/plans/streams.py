"""Streaming jobs over the star tables, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journal as J
from ..operators import metrics as M
from ..sources.io import scratch
from ..streaming import jobs
from .decisions import ENTRIES, LEXICON, PATHS, TOKENS
from .inputs import BARS, POSTS, TICKS, as_posts, as_ticks, bars
from .market import ewm_sql, simple_signals, up
from .registry import query

#: When windows that end at {0} are out: the watermark is the last time in whole milliseconds, less 10 minutes.
CLOSED = "{0} <= (SELECT date_trunc('milliseconds', max(ts)) FROM {1}) - INTERVAL 10 MINUTE"


def _ticks(spark, d):
    return as_ticks(jobs.read(spark, f"{d}/events.parquet"))


def _bars(spark, d):
    path = scratch(spark, "stream-bars")
    bars(spark, d).write.parquet(path)
    return jobs.read(spark, path)


@query("stream_bars", f"WITH {BARS} SELECT * FROM bars WHERE {CLOSED.format('ts + INTERVAL 1 HOUR', 'ticks')}")
def stream_bars(spark, d):
    return jobs.run(jobs.bars(_ticks(spark, d)), scratch(spark, "stream-out"))


@query("stream_sentiment", f"""WITH {POSTS}, {TOKENS}, w AS (SELECT symbol, score, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS until FROM pol)
SELECT symbol, until::TIMESTAMP AS until, count(*) AS mentions, count(*) FILTER (score > 0.25) AS bullish, count(*) FILTER (score < -0.25) AS bearish, round(avg(score), 4) AS mean FROM w WHERE {CLOSED.format('until', 'posts')} GROUP BY 1, 2""")
def stream_sentiment(spark, d):
    x = J.with_polarity(as_posts(jobs.read(spark, f"{d}/documents.parquet")), dict(LEXICON))
    return jobs.run(jobs.rolling_sentiment(x).withColumn("mean", F.round("mean", 4)), scratch(spark, "stream-out"))


@query("stream_distinct_posts", f"WITH {POSTS} SELECT DISTINCT substr(sha256(coalesce(text, '') || coalesce(source, '')), 1, 12) AS hash FROM posts")
def stream_distinct_posts(spark, d):
    x = as_posts(jobs.read(spark, f"{d}/documents.parquet")).select("ts", J.post_id(F.col("text"), F.col("source")).alias("hash"))
    return jobs.run(jobs.distinct(x, "hash").select("hash"), scratch(spark, "stream-out"))


@query("stream_sessions", f"""WITH {TICKS}, g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, tick_id) > INTERVAL 30 MINUTE)::INTEGER AS new FROM ticks),
s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY symbol ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING) AS s FROM g),
o AS (SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS ticks, sum(qty)::BIGINT AS qty FROM s GROUP BY symbol, s) SELECT * FROM o WHERE {CLOSED.format('until', 'ticks')}""")
def stream_sessions(spark, d):
    return jobs.run(jobs.sessions(_ticks(spark, d)), scratch(spark, "stream-out"))


@query("stream_journal", f"WITH {TICKS} SELECT * FROM ticks")
def stream_journal(spark, d):
    path = scratch(spark, "stream-journal")
    x = _ticks(spark, d)
    jobs.append_once(x, path)
    return spark.read.schema(x.schema).parquet(path).select(*x.columns)


@query("stream_signals", f"WITH RECURSIVE {BARS}, {ewm_sql('bars', {'fast': ('close', 2 / 10), 'slow': ('close', 2 / 22)})} SELECT symbol, ts, round(fast, 6) AS fast, round(slow, 6) AS slow, (CASE WHEN {up('fast', 'slow')} THEN 1 WHEN {up('slow', 'fast')} THEN -1 ELSE 0 END)::INTEGER AS signal FROM e")
def stream_signals(spark, d):
    return jobs.run(jobs.running_cross(_bars(spark, d)), scratch(spark, "stream-out")).select("symbol", "ts", F.round("fast", 6).alias("fast"), F.round("slow", 6).alias("slow"), "signal")


@query("stream_exits", f"""WITH {ENTRIES}, {PATHS}, y AS (SELECT *, CASE WHEN close <= entry_price * 0.9 THEN 'stop' WHEN close <= peak * 0.85 THEN 'trail' WHEN days >= 30 THEN 'time' WHEN close / entry_price - 1 >= 0.20 OR (close / entry_price - 1 >= 0.10 AND days >= 10) THEN 'roi' END AS why FROM pth)
SELECT symbol, trade_id, arg_min(ts, ts) AS exit_ts, round(arg_min(close, ts), 6) AS exit_price, arg_min(why, ts) AS why FROM y WHERE why IS NOT NULL GROUP BY 1, 2""")
def stream_exits(spark, d):
    x = jobs.exits(_bars(spark, d), M.trades(M.with_position(simple_signals(spark, d))))
    return jobs.run(x, scratch(spark, "stream-out")).withColumn("exit_price", F.round("exit_price", 6))


@query("stream_daily_limits", f"""WITH {BARS}, x AS (SELECT symbol AS strategy, ts, ts::DATE AS day, 1 - close / first_value(close) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS loss, round(1 - close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 9) AS dd FROM bars)
SELECT strategy, ts, round(loss, 6) AS loss, bool_or(round(loss, 9) >= 0.03) OVER (PARTITION BY strategy, day ORDER BY ts ROWS UNBOUNDED PRECEDING) AS tripped,
  dd >= 0.02 AND dd > coalesce(max(dd) FILTER (dd >= 0.02) OVER (PARTITION BY strategy, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS alert FROM x""")
def stream_daily_limits(spark, d):
    x = jobs.daily_limits(_bars(spark, d).select(F.col("symbol").alias("strategy"), "ts", F.col("close").alias("equity")))
    return jobs.run(x, scratch(spark, "stream-out")).withColumn("loss", F.round("loss", 6))
