"""Signals over timeframes, as-of joins, sectors and macro regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import latest, running
from ..functions.windows import ROW, numbered, ordered

#: Fixed values.
TIMEFRAME_WEIGHTS = {"1m": 0.5, "5m": 0.6, "15m": 0.7, "30m": 0.8, "1h": 0.9, "1d": 1.0}


#: Timeframes by their priority.
TIMEFRAME_PRIORITY = ("1m", "5m", "15m", "30m", "1h", "240min", "4h", "1d", "1w", "1M")


def daily_last(signals: DataFrame) -> DataFrame:
    """Each day's last signal from a symbol's first day to its last; days without one are 0."""
    d = signals.groupBy("symbol", F.col("ts").cast("date").alias("day")).agg(F.max_by("signal", "ts").alias("signal"))
    days = signals.groupBy("symbol").agg(F.explode(F.sequence(F.min(F.col("ts").cast("date")), F.max(F.col("ts").cast("date")))).alias("day"))
    return days.join(d, ["symbol", "day"], "left").select("symbol", "day", F.coalesce("signal", F.lit(0)).alias("signal"))


def aligned(frames: dict[str, DataFrame], at: str = "day") -> DataFrame:
    """One column per timeframe on the union of their times, 0 where a timeframe has none: one shuffle for all."""
    every = None
    for tf, f in frames.items():
        f = f.select("symbol", at, F.lit(tf).alias("tf"), "signal")
        every = f if every is None else every.unionByName(f)
    return every.groupBy("symbol", at).pivot("tf", list(frames)).agg(F.first("signal")).fillna(0, list(frames))


def votes(x: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Majority, weighted, unanimous and any-long consensus of ``aligned`` signals."""
    cols = [F.col(f"`{tf}`") for tf in weights]
    total = sum((c * w for c, w in zip(cols, weights.values(), strict=True)), F.lit(0.0))
    every = sum(weights.values())
    longs, exits = sum(((c > 0).cast("int") for c in cols), F.lit(0)), sum(((c < 0).cast("int") for c in cols), F.lit(0))
    return x.withColumns({
        "majority": F.signum(F.round(total, 9)).cast("int"),
        "weighted": F.when(F.round(total, 9) > 0.5 * every, 1).when(F.round(total, 9) < -0.5 * every, -1).otherwise(0),
        "unanimous": F.when(longs == len(cols), 1).when(exits == len(cols), -1).otherwise(0),
        "any_long": F.when(exits > 0, -1).when(longs > 0, 1).otherwise(0),
    })


def fused(frames: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """``votes`` on the union of the frames' exact times, with weights that sum to 1: by priority unless given, equal if they don't add up to more than 0."""
    rank = {tf: i for i, tf in enumerate(TIMEFRAME_PRIORITY)}
    w = weights or {tf: 0.3 + 0.07 * rank.get(tf, 5) for tf in frames}
    total = sum(w.values())
    return votes(aligned(frames, "ts"), {tf: w.get(tf, 0.0) / total if total > 0 else 1 / len(w) for tf in frames})


def asof(left: DataFrame, right: DataFrame, value: str, by: str = "symbol", on: str = "ts") -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before each row: one union, numbered, and a value that runs by blocks; no inequality join, and no series in one task."""
    l = left.drop(ROW).select("*", F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    r = right.select(by, on, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    both = numbered(l.unionByName(r, allowMissingColumns=True), by, order=(on, "__side"))
    return running(both, {value: latest(F.col("__v"))}, by).where("__side = 1").drop("__v", "__side", ROW)


def inverse_volatility_weights(returns: DataFrame, lookback: int = 20) -> DataFrame:
    """By symbol and timeframe, one over the deviation of the last ``lookback`` returns (1e-6 at least), summing to 1 per symbol."""
    n = F.row_number().over(Window.partitionBy("symbol", "tf").orderBy(F.desc("ts")))
    v = returns.withColumn("__n", n).where(F.col("__n") <= lookback).groupBy("symbol", "tf").agg(F.greatest(F.coalesce(F.stddev_samp("ret"), F.lit(0.0)), F.lit(1e-6)).alias("vol"))
    return v.withColumn("weight", (1 / F.col("vol")) / F.sum(1 / F.col("vol")).over(Window.partitionBy("symbol")))


def sector_momentum(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Last close against the one ``lookback - 1`` bars before; 0 for short series; with its rank."""
    k = max(lookback, 5)
    x = bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("__n") <= k)
    m = x.groupBy("symbol").agg(F.max(F.when(F.col("__n") == 1, F.col("close"))).alias("now"), F.max(F.when(F.col("__n") == k, F.col("close"))).alias("past"))
    m = m.select("symbol", F.round(F.coalesce(F.when(F.col("past") > 0, F.col("now") / F.col("past") - 1), F.lit(0.0)), 6).alias("momentum"))
    return m.withColumn("rank", F.rank().over(Window.orderBy(F.desc("momentum"))))


def sector_bias(momentum: DataFrame, threshold: float = 0.02, scale: float = 0.05) -> DataFrame:
    m = F.col("momentum")
    return momentum.withColumn("bias", F.when(F.abs(m) >= threshold, F.greatest(F.least(m / scale, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0))


def market_breadth(momentum: DataFrame, scale: float = 0.05) -> DataFrame:
    return momentum.agg(F.greatest(F.least(F.avg("momentum") / scale, F.lit(1.0)), F.lit(-1.0)).alias("breadth"))


def regimes(bars: DataFrame, short: int = 20, mid: int = 60, long: int = 126, calm: float = 0.20, stormy: float = 0.35) -> DataFrame:
    """Each symbol's regime at its last bar from three votes: momentum, annualised volatility, and the growth proxy."""
    w = ordered()
    back = lambda k: F.try_divide("close", F.lag("close", k).over(w)) - 1
    x = numbered(bars)
    n = x.groupBy(F.struct("symbol").alias("__s")).agg((F.max(ROW) + 1).alias("__n"))
    x = x.withColumn("__s", F.struct("symbol")).join(n, "__s").where(F.col(ROW) >= F.col("__n") - long - 1)  # a symbol's last bars are all that its windows need
    x = x.withColumns({"m20": back(short), "m60": back(mid), "m126": back(long), "ret": back(1), "n": (F.col(ROW) + 1).cast("int")})
    vol = F.when(F.count("ret").over(w.rowsBetween(-short + 1, 0)) >= 10, F.stddev_samp("ret").over(w.rowsBetween(-short + 1, 0)) * 252**0.5)
    x = x.withColumn("vol", vol).groupBy("symbol").agg(*[F.max_by(c, "ts").alias(c) for c in ("m20", "m60", "m126", "vol", "n")])
    x = x.withColumns({"slope": F.col("m20") / F.greatest(F.abs(F.coalesce("m126", F.lit(0.0))), F.lit(1e-6)), "growth": F.coalesce(F.col("m60") - F.col("m126"), F.lit(0.0))})
    vote = F.signum(F.coalesce("m60", F.lit(0.0))) + F.when(F.col("vol") < calm, 1).when(F.col("vol") > stormy, -1).otherwise(0) + F.signum("growth")
    return x.withColumn("votes", vote.cast("int")).withColumn("regime", F.when(F.col("n") < 63, "neutral").when(F.col("votes") >= 2, "risk_on").when(F.col("votes") <= -2, "risk_off").otherwise("neutral"))


def assign_sectors(symbols: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The sector of the first prefix (by ``map_order``) that a symbol starts with; else ``other``. Each distinct symbol is looked up by all its beginnings."""
    d = symbols.select("symbol").distinct()
    begins = F.transform(F.sequence(F.lit(0), F.char_length("symbol")), lambda i: F.substring("symbol", F.lit(1), i))
    hit = d.withColumn("prefix", F.explode(begins)).join(prefixes, "prefix").groupBy("symbol").agg(F.min_by("sector", "map_order").alias("sector"))
    return d.join(hit, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("other")))


def target_weights(members: DataFrame, equity: float, tilts: DataFrame) -> DataFrame:
    """``equity`` dealt to sectors by tilt times the root of their members, and equally within a sector."""
    s = members.groupBy("sector").agg(F.count("*").alias("n")).join(tilts.select("sector", "tilt"), "sector", "left")
    s = s.withColumn("score", F.coalesce("tilt", F.lit(1.0)) * F.sqrt("n"))
    s = s.withColumn("weight", F.round(F.lit(equity) * F.col("score") / F.col("n") / F.sum("score").over(Window.partitionBy()), 8))  # one row a sector
    return members.select("symbol", "sector").join(s.select("sector", "weight"), "sector").select("symbol", "sector", "weight")


def rebalance(current: DataFrame, target: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """1, -1 or 0 by how far the target lies from the current weight; a symbol missing on a side has weight 0 there."""
    x = current.select("symbol", F.col("weight").alias("now")).join(target.select("symbol", F.col("weight").alias("goal")), "symbol", "full_outer").fillna(0.0, ["now", "goal"])
    d = F.round(F.col("goal") - F.col("now"), 9)
    return x.withColumn("drift", d).withColumn("signal", F.when(d > tolerance, 1).when(d < -tolerance, -1).otherwise(0))


def sector_lookup(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """``symbols`` with the ``sector`` of the small table ``members`` (upper-case ``symbol``, one row each); null if there is none."""
    m = members.select(F.col("symbol").alias("__member"), "sector")
    return symbols.join(m, F.upper("symbol") == F.col("__member"), "left").drop("__member")


def full_rebalance(bars: DataFrame, lead: str, members: DataFrame, tilts: DataFrame, equity: dict[str, float], current: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The regime of symbol ``lead`` sets the share of equity (and picks rows of ``tilts`` by ``regime``); targets by sector, then drift signals, in one job."""
    r = regimes(bars.where(F.col("symbol") == lead)).select("regime")  # one row
    share = F.element_at(F.create_map(*[F.lit(v) for kv in equity.items() for v in kv]), F.col("regime"))
    goal = target_weights(members, 1.0, tilts.join(F.broadcast(r), "regime", "left_semi").select("sector", "tilt"))
    goal = goal.crossJoin(F.broadcast(r)).withColumn("weight", F.col("weight") * share)
    return rebalance(current, goal, tolerance).crossJoin(F.broadcast(r))
