"""Stops, exits and daily limits as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import peak, running
from ..functions.windows import upto

#: Profit from which a tier holds, and its trailing distance.
TIERS = ((0.20, 0.03), (0.10, 0.05), (0.05, 0.08), (0.02, 0.10))
DAY = 86_400


def exit_paths(trades: DataFrame, bars: DataFrame, max_days: int = 30, stop: float = 0.10, trail: float = 0.15, roi: tuple[tuple[float, int], ...] = ((0.20, 0), (0.10, 10))) -> DataFrame:
    """Each trade's first exit: fixed stop, trailing stop, return reached after so many days, or time.

    Trades are told by symbol and ``trade_id``. Trades and bars meet by symbol and 30-day bucket, with a bound on the days held, so a trade sees only its own bars."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / max_days)
    t = trades.withColumn("__b", F.explode(F.array(bucket("entry_ts"), bucket("entry_ts") + 1)))
    b = bars.select(F.col("symbol").alias("__s"), F.col("ts").alias("ts"), "close", bucket("ts").alias("__bb"))
    x = t.join(b, (F.col("symbol") == F.col("__s")) & (F.col("__b") == F.col("__bb")) & (F.col("ts") > F.col("entry_ts")) & (F.datediff("ts", "entry_ts") <= max_days))
    w = Window.partitionBy("symbol", "trade_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"peak": F.greatest("entry_price", F.max("close").over(w)), "days": F.datediff("ts", "entry_ts")})
    c, e = F.col("close"), F.col("entry_price")
    reached = F.exists(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(d).alias("d")) for r, d in roi]), lambda z: (c / e - 1 >= z["r"]) & (F.col("days") >= z["d"]))
    why = F.when(c <= e * (1 - stop), "stop").when(c <= F.col("peak") * (1 - trail), "trail").when(F.col("days") >= max_days, "time").when(reached, "roi")
    first = x.withColumn("why", why).where("why is not null").groupBy("symbol", "trade_id").agg(F.min_by(F.struct("ts", "close", "why"), "ts").alias("x"))
    return trades.select("trade_id", "symbol", "entry_ts", "entry_price").join(first, ["symbol", "trade_id"], "left").select("trade_id", "symbol", "entry_ts", "entry_price", F.col("x.ts").alias("exit_ts"), F.col("x.close").alias("exit_price"), F.coalesce("x.why", F.lit("open")).alias("why"))


def ratcheted_stop(path: DataFrame, tiers=TIERS) -> DataFrame:
    """A trailing stop whose distance narrows by the best profit so far and which never falls. Needs ``symbol, trade_id, ts, close, entry_price``."""
    w = upto("symbol", "trade_id")
    x = path.withColumn("peak", F.greatest("entry_price", F.max("close").over(w)))
    gain = F.round(F.col("peak") / F.col("entry_price") - 1, 9)
    level = None
    for g, d in tiers:
        level = (level if level is not None else F).when(gain >= g, F.col("peak") * (1 - d))
    return x.withColumn("__l", level).withColumn("stop", F.max("__l").over(w)).drop("__l").withColumn("hit", F.coalesce(F.col("close") <= F.col("stop"), F.lit(False)))


def kill_switch(equity: DataFrame, limit: float = 0.03, keys: tuple[str, ...] = ("strategy",), order: str = "ts", day: str = "day") -> DataFrame:
    """Tripped once equity falls ``limit`` below the day's first value, and for the rest of the day."""
    w = upto(*keys, day, order=order)
    x = equity.withColumn("start", F.first("equity").over(w)).withColumn("loss", 1 - F.col("equity") / F.col("start"))
    return x.withColumn("tripped", F.max(F.round("loss", 9) >= limit).over(w))


def drawdown_alerts(equity: DataFrame, least: float = 0.02, keys: tuple[str, ...] = ("strategy",), order: str = "ts", day: str = "day") -> DataFrame:
    """Rows that draw down by ``least`` or more, and deeper than any alert before them that day."""
    x = running(equity, {"__top": peak(F.col("equity"))}, *keys, order=order)
    x = x.withColumn("dd", F.round(1 - F.col("equity") / F.col("__top"), 9)).drop("__top")
    before = upto(*keys, day, order=order).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("last", F.max(F.when(F.col("dd") >= least, F.col("dd"))).over(before)).where((F.col("dd") >= least) & (F.col("last").isNull() | (F.col("dd") > F.col("last")))).drop("last")


def activated_stop(path: DataFrame, tiers: tuple[tuple[float, float], ...] = TIERS, trail: float = 0.05, activate: float = 0.02) -> DataFrame:
    """A trailing stop that holds only while the close is ``activate`` or more in profit: below that it goes back to the entry price, and
    from the next active row on it never falls. The distance is that of the tier of the current profit. Needs ``symbol, trade_id, ts, close, entry_price``."""
    w, e = upto("symbol", "trade_id"), F.col("entry_price")
    gain = F.round(F.col("close") / e - 1, 9)
    distance = None
    for g, d in tiers:
        distance = (distance if distance is not None else F).when(gain >= g, d)
    x = path.withColumns({"peak": F.greatest(e, F.max("close").over(w)), "__on": gain >= activate})
    x = x.withColumn("__part", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(w))
    x = x.withColumn("__level", F.when(F.col("__on"), F.greatest(e, F.col("peak") * (1 - distance.otherwise(trail)))).otherwise(e))
    return x.withColumn("stop", F.max("__level").over(upto("symbol", "trade_id", "__part"))).drop("__on", "__part", "__level")
