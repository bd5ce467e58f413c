"""The library's operators on streams: watermarked windows, and state by key where an operator is recursive.

Late rows are dropped once the watermark has passed them. Windows and sessions come out when the watermark passes their end, so what is still
open at the end of the input stays in the state. State by key takes rows in time order from one micro-batch to the next, and is forgotten when a key falls idle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import ohlcv


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files. A stream of a single file needs a pattern: this one fits nothing but the path."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, path: str) -> DataFrame:
    """Runs what is there to its end, into Parquet below ``path`` with a file log (a repeated batch is written once), and reads that."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def timed(rows: DataFrame, late: str) -> DataFrame:
    """Rows with a watermark; naive times are taken in the session's time zone, since a watermark needs instants."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _naive(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def bars(ticks: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Closed bars of ticks, with the batch job's aggregates."""
    b = timed(ticks, late).groupBy("symbol", F.window("ts", length).alias("w")).agg(*ohlcv())
    return b.select("symbol", _naive("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def rolling_sentiment(scored: DataFrame, length: str = "24 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mentions, bullish and bearish posts and the mean score by symbol in sliding windows."""
    s = F.col("score")
    g = timed(scored, late).groupBy("symbol", F.window("ts", length, step).alias("w"))
    g = g.agg(F.count("*").alias("mentions"), F.count_if(s > 0.25).alias("bullish"), F.count_if(s < -0.25).alias("bearish"), F.avg(s).alias("mean"))
    return g.select("symbol", _naive("w.end").alias("until"), "mentions", "bullish", "bearish", "mean")


def distinct(rows: DataFrame, *keys: str, within: str = "30 days") -> DataFrame:
    """The first row of each key that arrives; a key is forgotten when the watermark is ``within`` past it."""
    return timed(rows, within).dropDuplicatesWithinWatermark(list(keys))


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of ticks of a symbol with less than ``gap`` between neighbours."""
    s = timed(ticks, late).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count("*").alias("ticks"), F.sum("qty").alias("qty"))
    return s.select("symbol", _naive("w.start").alias("start"), _naive("w.end").alias("until"), "ticks", "qty")


def append_once(stream: DataFrame, path: str) -> None:
    """A journal whose folders carry the batch's number: a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()


Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]
#: Days without a row after which a key is forgotten.
IDLE_DAYS = 30
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Carried(StatefulProcessor):
    """A key's typed state, the time of its last row and a timer in event time that clears both."""

    def __init__(self, state: str, step: Step, idle_ms: int):
        self.schema, self.step, self.idle = f"{state}, last long", step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("carried", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        old = tuple(self.state.get()) if self.state.exists() else None
        last = old[-1] if old else None
        # rows that aren't after the last one handled are late or repeated
        new = [f if last is None else f[f["event_ms"] > last] for f in rows if len(f)]
        if not new:
            return
        f = pd.concat(new).sort_values("event_ms", kind="stable").drop_duplicates("event_ms").reset_index(drop=True)
        if f.empty:
            return
        made, carried = self.step(f, old[:-1] if old else None)
        now = int(f["event_ms"].iloc[-1])
        self.state.update((*carried, now))
        if last is not None:
            self.handle.deleteTimer(last + self.idle)
        self.handle.registerTimer(now + self.idle)
        yield made

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def by_key(rows: DataFrame, keys: list[str], state: str, out: str, step: Step, late: str = "10 minutes", idle_days: int = IDLE_DAYS) -> DataFrame:
    """``step(rows in time order, state or None) -> (rows out, state)`` per key and micro-batch; the trigger's file limit bounds a batch's rows.

    A key's rows count once each time and in order: one that isn't after the last row handled is late or a repeat, and is dropped. A key without rows for
    ``idle_days`` of event time is forgotten: a timer clears its state once the watermark, ``late`` behind the latest row, has passed."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    x = timed(rows, late)
    x = x.withColumn("event_ms", F.unix_millis("ts"))
    done = x.groupBy(*keys).transformWithStateInPandas(_Carried(state, step, idle_days * 86_400_000), out.replace("timestamp_ntz", "timestamp"), "append", "EventTime")
    naive = [c.split()[0] for c in out.split(", ") if c.endswith("timestamp_ntz")]
    return done.withColumns({c: _naive(c) for c in naive}) if naive else done


def running_cross(bars: DataFrame, fast: int = 9, slow: int = 21) -> DataFrame:
    """Both exponential means of each bar and the signal of their crossing (1 up, -1 down, else 0), carried by symbol."""

    def step(f: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        close, seed = f.close.to_numpy(float), state or (float(f.close.iloc[0]),) * 2
        for name, n, e in (("fast", fast, seed[0]), ("slow", slow, seed[1])):
            f[name] = pd.Series(np.concatenate([[e], close])).ewm(alpha=2 / (n + 1), adjust=False).mean().to_numpy()[1:]
        gap = np.sign(np.round(f.fast, 9) - np.round(f.slow, 9)).to_numpy()
        before = np.concatenate([[np.sign(round(seed[0], 9) - round(seed[1], 9)) if state else np.nan], gap[:-1]])
        f["signal"] = np.where((gap > 0) & (before <= 0), 1, np.where((gap < 0) & (before >= 0), -1, 0)).astype("int32")
        return f[["symbol", "ts", "fast", "slow", "signal"]], (float(f.fast.iloc[-1]), float(f.slow.iloc[-1]))

    ts = dict(bars.dtypes)["ts"]
    return by_key(bars, ["symbol"], "fast double, slow double", f"symbol string, ts {ts}, fast double, slow double, signal int", step)


def exits(prices: DataFrame, trades: DataFrame, max_days: int = 30, stop: float = 0.10, trail: float = 0.15, roi: tuple[tuple[float, int], ...] = ((0.20, 0), (0.10, 10))) -> DataFrame:
    """The first exit of each trade as prices come in: stop, trailing stop, time or return, as ``risk.exit_paths`` finds it. Trades meet prices by symbol and a bucket of days."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / max_days)
    t = trades.select("symbol", "trade_id", "entry_ts", "entry_price", F.explode(F.array(bucket("entry_ts"), bucket("entry_ts") + 1)).alias("bucket"))
    x = prices.select("symbol", "ts", "close", bucket("ts").alias("bucket")).join(t, ["symbol", "bucket"])
    x = x.where((F.col("ts") > F.col("entry_ts")) & (F.datediff("ts", "entry_ts") <= max_days)).withColumn("days", F.datediff("ts", "entry_ts"))

    def step(f: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        entry, c = f.entry_price.to_numpy(float), f.close.to_numpy(float)
        peak, done = state or (float(entry[0]), False)
        high = np.maximum(np.maximum.accumulate(c), peak)
        gained = np.logical_or.reduce([(c / entry - 1 >= r) & (f.days.to_numpy() >= d) for r, d in roi])
        f["why"] = np.select([c <= entry * (1 - stop), c <= high * (1 - trail), f.days >= max_days, gained], ["stop", "trail", "time", "roi"], "")
        first = f[f.why != ""].head(0 if done else 1).rename(columns={"ts": "exit_ts", "close": "exit_price"})
        return first[["symbol", "trade_id", "exit_ts", "exit_price", "why"]], (float(high[-1]), bool(done or len(first)))

    ts = dict(prices.dtypes)["ts"]
    return by_key(x, ["symbol", "trade_id"], "peak double, done boolean", f"symbol string, trade_id long, exit_ts {ts}, exit_price double, why string", step, idle_days=max_days + 1)


def daily_limits(equity: DataFrame, limit: float = 0.03, least: float = 0.02) -> DataFrame:
    """By strategy and row: the loss since the day's first value, whether it has tripped the day's switch, and whether the drawdown is a new alert of the day."""

    def step(f: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        day, e = pd.to_datetime(f.ts).dt.strftime("%Y-%m-%d").to_numpy(), f.equity.to_numpy(float)
        last, start, tripped, peak, deepest = state or ("", 0.0, False, float(e[0]), 0.0)
        out = []
        for d, v in zip(day, e, strict=True):
            if d != last:
                last, start, tripped, deepest = d, v, False, 0.0
            peak = max(peak, v)
            loss, dd = 1 - v / start, round(1 - v / peak, 9)
            tripped = tripped or round(loss, 9) >= limit
            alert = dd >= least and dd > deepest
            deepest = max(deepest, dd) if alert else deepest
            out.append((loss, tripped, alert))
        f[["loss", "tripped", "alert"]] = pd.DataFrame(out, index=f.index)
        return f[["strategy", "ts", "loss", "tripped", "alert"]], (last, float(start), bool(tripped), float(peak), float(deepest))

    ts = dict(equity.dtypes)["ts"]
    return by_key(equity, ["strategy"], "day string, start double, tripped boolean, peak double, deepest double", f"strategy string, ts {ts}, loss double, tripped boolean, alert boolean", step)
