"""Signals: 1 long, -1 exit, 0 nothing; a later rule overrides an earlier one."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import latest, running
from ..functions.windows import ROW, crosses_up, in_blocks, mean, numbered, ordered
from . import indicators as ind

STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(name: str):
    """Registers a function of numbered bars: they are numbered once, and every window of the strategy runs over blocks of them, with the look-back that it declares."""

    def add(f):
        @functools.wraps(f)
        def run(bars: DataFrame, *args, **kw) -> DataFrame:
            out = f(numbered(bars), *args, **kw)
            return out if ROW in bars.columns else out.drop(ROW)

        STRATEGIES[name] = run
        return run

    return add


def register(name: str, function: Callable[[pd.DataFrame], pd.Series], look_back: int, look_ahead: int = 0) -> None:
    """A user's strategy in pandas: bars of one symbol in order of time to their signals.

    The function gets a block of bars with the ``look_back`` bars before it (fewer at the series' begin) and the ``look_ahead`` bars after it; what it says of those
    is dropped. A signal must not depend on more than that, so that it is the same for any size of blocks."""

    @strategy(name)
    def run(bars: DataFrame) -> DataFrame:
        def work(b: DataFrame) -> DataFrame:
            flat = b.select(F.col("symbol.name").alias("symbol"), F.col("symbol.block").alias("__block"), *[c for c in b.columns if c != "symbol"])
            one = lambda f: (f := f.sort_values(ROW).reset_index(drop=True)).assign(signal=function(f).astype("int32").to_numpy())
            kinds = ", ".join(f"`{c}` {t}" for c, t in flat.dtypes)
            out = flat.groupBy("symbol", "__block").applyInPandas(one, f"{kinds}, signal int")
            return out.withColumn("symbol", F.struct(F.col("symbol").alias("name"), F.col("__block").alias("block"))).drop("__block")

        return in_blocks(bars, work, look_back, look_ahead)


def register_columns(name: str, function: Callable[[DataFrame], Column], look_back: int, look_ahead: int = 0) -> None:
    """A user's strategy as a column of signals over windows by symbol and time that reach no further than declared: it stays in the JVM."""

    @strategy(name)
    def run(bars: DataFrame) -> DataFrame:
        return in_blocks(bars, lambda b: b.withColumn("signal", function(b).cast("int")), look_back, look_ahead)


def _signal(entry: Column, leave: Column) -> Column:
    return F.when(F.coalesce(leave, F.lit(False)), -1).when(F.coalesce(entry, F.lit(False)), 1).otherwise(0).cast("int")


@strategy("ema_cross_rsi")
def ema_cross_rsi(bars: DataFrame, fast: int = 9, slow: int = 21, rsi_period: int = 14, entry_max: float = 70, leave_at: float = 75) -> DataFrame:
    a, b, w = F.col(f"ema{fast}"), F.col(f"ema{slow}"), ordered()

    def windows(x: DataFrame) -> DataFrame:
        x = ind.with_rsi(x, rsi_period)
        return x.withColumn("signal", _signal(crosses_up(a, b, w) & (F.col("rsi") < entry_max), crosses_up(b, a, w) | (F.round("rsi", 9) > leave_at)))

    return in_blocks(ind.with_ema(bars, fast, slow), windows, rsi_period + 1)


@strategy("mean_reversion_rsi")
def mean_reversion_rsi(bars: DataFrame, period: int = 14, smooth: int = 3, low: float = 30, high: float = 70, volume_n: int = 20) -> DataFrame:
    x = ind.ewm(in_blocks(bars, lambda x: ind.with_rsi(x, period), period + 1), [("rsi_s", "rsi", ind.span(smooth))])
    w, r, busy = ordered(), F.col("rsi_s"), F.col("volume") > F.col("vol_ma")

    def windows(x: DataFrame) -> DataFrame:
        x = x.withColumn("vol_ma", mean(F.col("volume"), volume_n))
        return x.withColumn("signal", _signal(crosses_up(r, F.lit(low), w) & busy, crosses_up(F.lit(high), r, w) & busy))

    return in_blocks(x, windows, max(volume_n, 2))


@strategy("rsi2")
def rsi2(bars: DataFrame, low: float = 10, leave: float = 50, n: int = 20) -> DataFrame:
    def windows(x: DataFrame) -> DataFrame:
        x = ind.with_rsi(x, 2).withColumns(ind.bollinger(n))
        return x.withColumn("signal", _signal((F.round("rsi", 9) < low) & (F.round(F.col("close") - F.col("bb_lower") * 1.01, 9) <= 0), F.round("rsi", 9) > leave))

    return in_blocks(bars, windows, max(n, 3))


@strategy("bollinger_reversion")
def bollinger_reversion(bars: DataFrame, low: float = 20, high: float = 80, n: int = 20, rsi_period: int = 14) -> DataFrame:
    r = F.round("rsi", 9)

    def windows(x: DataFrame) -> DataFrame:
        x = ind.with_rsi(x, rsi_period).withColumns(ind.bollinger(n))
        return x.withColumn("signal", _signal((F.round(F.col("close") - F.col("bb_mid"), 9) <= 0) & (r < low), (r > high) | (F.round(F.col("close") - F.col("bb_mid") * 0.99, 9) >= 0)))

    return in_blocks(bars, windows, max(n, rsi_period + 1))


@strategy("vwap_breakout")
def vwap_breakout(bars: DataFrame, n: int = 20, surge: float = 1.5, min_ratio: float = 0.8) -> DataFrame:
    def windows(x: DataFrame) -> DataFrame:
        x = x.withColumn("vol_ma", mean(F.col("volume"), n))
        above, below = crosses_up(F.col("close"), F.col("vwap"), ordered()), F.round(F.col("close") - F.col("vwap"), 9) < 0
        return x.withColumn("signal", _signal(above & (F.col("volume") > F.col("vol_ma") * surge), below & (F.col("volume") < F.col("vol_ma") * min_ratio)))

    return in_blocks(ind.with_vwap(bars), windows, max(n, 2))


@strategy("momentum_scanner")
def momentum_scanner(bars: DataFrame, trend: int = 50, n: int = 20, surge: float = 1.2) -> DataFrame:
    x = ind.with_macd(bars, 12, 26, 9, trend).drop("ema12", "ema26")
    a, b, w = F.col("macd"), F.col("macd_signal"), ordered()

    def windows(x: DataFrame) -> DataFrame:
        x = x.withColumn("vol_ma", mean(F.col("volume"), n))
        return x.withColumn("signal", _signal(crosses_up(a, b, w) & (F.col("volume") > F.col("vol_ma") * surge) & (F.round(F.col("close") - F.col(f"ema{trend}"), 9) > 0), crosses_up(b, a, w)))

    return in_blocks(x, windows, max(n, 2))


@strategy("turtle_breakout")
def turtle_breakout(bars: DataFrame, enter: int = 20, leave: int = 10, atr_n: int = 20, most: float = 0.10, exit_shift: int = 0) -> DataFrame:
    x = ind.with_wilder(in_blocks(bars, ind.with_true_range, 1), "tr", atr_n, "atr")
    # a zero range carries the last one forward
    x = running(x, {"__atr": latest(F.when(F.col("atr") != 0, F.col("atr")))})
    x = x.withColumn("atr", F.coalesce("__atr", "atr")).drop("__atr")
    w = ordered()

    def windows(x: DataFrame) -> DataFrame:
        x = x.withColumns({"hi": ind.donchian(enter)["dc_high"], "lo": ind.donchian(leave)["dc_low"]})
        low = F.lag("lo", exit_shift).over(w) if exit_shift else F.col("lo")
        return x.withColumn("signal", _signal((F.col("close") > F.lag("hi").over(w)) & (F.round(F.try_divide("atr", "close"), 9) < most), F.col("close") < low))

    return in_blocks(x, windows, max(enter + 1, leave + exit_shift))


def sentiment_filter(signals: DataFrame, scores: DataFrame, least: float = -0.15) -> DataFrame:
    """Longs go where the symbol's net score is below ``least``; exits stay."""
    x = signals.join(scores.select("symbol", "net"), "symbol", "left")
    return x.withColumn("signal", F.when((F.col("signal") == 1) & (F.coalesce("net", F.lit(0.0)) < least), 0).otherwise(F.col("signal")))


def bias_filter(signals: DataFrame, bias: DataFrame, block: float = -0.3) -> DataFrame:
    x = signals.join(bias.select("symbol", "bias"), "symbol", "left")
    return x.withColumn("signal", F.when((F.col("signal") == 1) & (F.coalesce("bias", F.lit(0.0)) <= block), 0).otherwise(F.col("signal")))


def probability_signal(scored: DataFrame, enter: float = 0.55, leave: float = 0.45) -> DataFrame:
    return scored.withColumn("signal", F.when(F.col("p") >= enter, 1).when(F.col("p") <= leave, -1).otherwise(0).cast("int"))


def probability_veto(signals: DataFrame, enter: float = 0.55) -> DataFrame:
    """A long with a probability below ``enter`` goes; one without a probability stays."""
    return signals.withColumn("signal", F.when((F.col("signal") == 1) & (F.col("p") < enter), 0).otherwise(F.col("signal")))


def audit(signals: DataFrame, *keys: str) -> DataFrame:
    s = F.col("signal")
    return signals.groupBy(*keys).agg(F.count_if(s == 1).alias("longs"), F.count_if(s == -1).alias("exits"), F.count_if(s == 0).alias("flat"), F.coalesce(F.bool_and(s.isin(1, 0, -1)), F.lit(True)).alias("valid")).withColumn("has_entries", F.col("longs") > 0)


def latest_signal(signals: DataFrame) -> DataFrame:
    return signals.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("signal", "ts").alias("signal"))


def allowed(df: DataFrame, white: DataFrame, black: DataFrame) -> DataFrame:
    """Symbols not on the black list and, if the white list has any, on it."""
    norm = lambda d: d.select(F.upper(F.trim("symbol")).alias("__s")).distinct()
    s = F.upper(F.trim(df["symbol"]))
    out = df.withColumn("__k", s).join(norm(black), F.col("__k") == F.col("__s"), "left_anti")
    return (out if white.isEmpty() else out.join(norm(white), F.col("__k") == F.col("__s"), "left_semi")).drop("__k")
