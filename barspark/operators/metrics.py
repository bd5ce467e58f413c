"""Positions, trades, equity and their figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import join_ranges
from ..functions.running import lag, latest, lead, peak, peak_of_total, running, total
from ..functions.scratch import settled
from ..functions.windows import ROW, numbered


def _entered(signal: Column) -> Column:
    return F.when(signal != 0, signal)


def with_position(signals: DataFrame, *keys: str) -> DataFrame:
    """1 from an entry to the exit after it: the last signal that isn't 0 decides."""
    x = running(signals, {"__last": latest(_entered(F.col("signal")))}, *keys)
    return x.withColumn("position", F.when(F.col("__last") == 1, 1).otherwise(0).cast("int")).drop("__last")


def trades(positions: DataFrame, *keys: str) -> DataFrame:
    """Runs of position 1 as trades, entered and left at the next bar's open; one still open has no exit.

    A trade's rows are those from its first bar to the next trade's: the first of them is filled on entry, the first without the position on exit."""
    keys = keys or ("symbol",)
    held = F.col("position") == 1
    x = running(numbered(positions, *keys), {"__before": lag(F.col("position")), "__fill": lead(F.col("open")), "__fill_ts": lead(F.col("ts"))}, *keys)
    start = held & (F.coalesce("__before", F.lit(0)) == 0)
    x = settled(x.select(*keys, ROW, "position", "__fill", "__fill_ts", start.cast("int").alias("__start")), "fills")
    x = running(x, {"trade_id": total(F.col("__start"))}, *keys).where("trade_id > 0")
    on, off = F.when(held, F.col(ROW)), F.when(F.col("position") != 1, F.col(ROW))
    t = x.groupBy(*keys, "trade_id").agg(
        F.min_by("__fill_ts", on).alias("entry_ts"), F.min_by("__fill", on).alias("entry_price"), F.min_by("__fill_ts", off).alias("exit_ts"), F.min_by("__fill", off).alias("exit_price"), F.count_if(held).alias("bars"),
    )
    return t.where("entry_price is not null")


def trade_stats(t: DataFrame, *keys: str) -> DataFrame:
    r = F.col("exit_price") / F.col("entry_price") - 1
    x = t.where("exit_price is not null").withColumn("r", r)
    won, lost = F.sum(F.when(F.col("r") > 0, F.col("r"))), F.sum(F.when(F.col("r") < 0, -F.col("r")))
    return x.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.when(lost > 0, F.coalesce(won, F.lit(0.0)) / lost).alias("profit_factor"),
        F.max("r").alias("best"), F.min("r").alias("worst"), F.avg("bars").alias("avg_bars"),
    )


def _returns(held: Column, before: Column, last_close: Column, commission: float) -> dict[str, Column]:
    """``held, bar_return, ret`` of a bar: what the bar before signalled, times the bar's return, less commission where that is new."""
    held, before = F.coalesce(held, F.lit(0)), F.coalesce(before, F.lit(0))
    gain = F.coalesce(F.try_divide(F.col("close"), last_close) - 1, F.lit(0.0))
    cost = F.when((held != 0) & (held != before), commission).otherwise(0.0)
    return {"held": held, "bar_return": gain, "ret": held * gain - cost}


def _growth() -> Column:
    return F.log1p(F.greatest("ret", F.lit(-0.999999)))


def signal_returns(signals: DataFrame, commission: float = 0.0005) -> DataFrame:
    """The signal of the bar before times the bar's return, less commission where a signal starts, and the equity that grows from 1."""
    s = F.col("signal")
    x = running(numbered(signals), {"__1": lag(s), "__2": lag(s, 2), "__c": lag(F.col("close"))})
    x = running(x.withColumns(_returns(F.col("__1"), F.col("__2"), F.col("__c"), commission)).drop("__1", "__2", "__c"), {"__t": total(_growth())})
    x = x.withColumn("equity", F.exp("__t")).drop("__t")
    return x if ROW in signals.columns else x.drop(ROW)


def sharpe(r: Column, periods: int = 252, rf: float = 0.0) -> Column:
    sd = F.stddev_samp(r)
    return F.coalesce(F.when(F.max(r) > F.min(r), (F.avg(r) - rf / periods) / sd * periods**0.5), F.lit(0.0))


def sortino(r: Column, periods: int = 252) -> Column:
    sd = F.stddev_samp(F.when(r < 0, r))
    return F.coalesce(F.when(sd > 0, F.avg(r) / sd * periods**0.5), F.lit(0.0))


def with_drawdown(curve: DataFrame, *keys: str, order: str = "ts") -> DataFrame:
    return running(curve, {"__top": peak(F.col("equity"))}, *keys, order=order).withColumn("drawdown", F.col("equity") / F.col("__top") - 1).drop("__top")


def cagr(periods: int = 252, order: str = "ts") -> Column:
    return F.pow(F.max_by("equity", order) / F.min_by("equity", order), periods / F.count("*")) - 1


def calmar(growth: Column, drawdown: Column) -> Column:
    return F.when(F.abs(drawdown) < 0.01, 0.0).otherwise(growth / F.abs(drawdown))


def backtest(signals: DataFrame, commission: float = 0.0005, *also: str) -> DataFrame:
    """One row per symbol (and per value of the columns ``also``, which tell series apart): returns, risk figures and trades of its signals.

    Two passes over the numbered bars: one finds the position now and at the two bars before, one the growth and its peak."""
    keys = ("symbol", *also)
    on = _entered(F.col("signal"))
    x = running(numbered(signals, *keys), {"__0": latest(on), "__1": latest(on, 1), "__2": latest(on, 2), "__c": lag(F.col("close"))}, *keys)
    now, held, before = (F.when(F.col(c) == 1, 1).otherwise(0) for c in ("__0", "__1", "__2"))
    x = x.withColumns({"position": now} | _returns(held, before, F.col("__c"), commission)).select(*keys, ROW, "close", "position", "held", "ret")
    x = running(x, {"__t": total(_growth()), "__top": peak_of_total(_growth())}, *keys)
    x = x.withColumns({"equity": F.exp("__t"), "drawdown": F.exp(F.col("__t") - F.col("__top")) - 1})
    r = F.col("ret")
    return x.groupBy(*keys).agg(
        F.count("*").alias("bars"), (F.max_by("equity", ROW) - 1).alias("total_return"), (F.max_by("close", ROW) / F.min_by("close", ROW) - 1).alias("buy_hold"),
        sharpe(r).alias("sharpe"), sortino(r).alias("sortino"), F.min("drawdown").alias("max_drawdown"), F.sum(((F.col("position") == 1) & (F.col("held") == 0)).cast("int")).alias("entries"), F.avg(F.col("held").cast("double")).alias("exposure"),
    )


def comparison(bars: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]], commission: float = 0.0005) -> DataFrame:
    """``backtest`` of several strategies, one row per ``symbol`` and ``strategy``: bars are numbered once, and all signals are tested together."""
    x, every = numbered(bars), None
    for name, f in strategies.items():
        s = f(x).select("symbol", ROW, "ts", "close", "signal", F.lit(name).alias("strategy"))
        every = s if every is None else every.unionByName(s)
    return backtest(settled(every, "signals"), commission, "strategy")


def head_to_head(a: DataFrame, b: DataFrame, key: str = "symbol") -> DataFrame:
    """Both sides' figures and their differences for every key of either side."""
    figures = [c for c, t in a.dtypes if c != key and c in b.columns and t in ("double", "bigint", "int")]
    x = a.select(key, *[F.col(c).alias(f"{c}_a") for c in figures]).join(b.select(key, *[F.col(c).alias(f"{c}_b") for c in figures]), key, "full_outer")
    return x.withColumns({f"{c}_diff": F.col(f"{c}_a") - F.col(f"{c}_b") for c in figures})


#: What a trial must reach out of sample.
CRITERIA = {"min_sharpe": 0.5, "min_return": 0.0, "max_drawdown": -25.0, "min_retention": 0.5, "max_spread": 100.0, "min_win_rate": 35.0}


def oos_backtest(bars: DataFrame, trials: DataFrame, strategy, commission: float = 0.0005) -> DataFrame:
    """``backtest`` of each symbol in each trial's two ranges of days, where indicators start anew. ``trials`` (``trial, train_start, cutoff, test_end``) is
    a table of ranges ``[train_start, cutoff)`` and ``[cutoff, test_end)``; bars near them are copied once a trial, and all trials run in one job."""
    day = F.col("ts").cast("date")
    x = join_ranges(bars, trials, day, "train_start", "test_end")
    x = x.withColumn("symbol", F.to_json(F.struct(F.col("symbol").alias("s"), F.col("trial").alias("t"), F.when(day < F.col("cutoff"), "train").otherwise("test").alias("r")))).select(*bars.columns)
    signals = with_position(numbered(strategy(x)))
    t = trades(signals).where("exit_price is not null").groupBy("symbol").agg(F.count("*").alias("trades"), (100 * F.avg((F.col("exit_price") > F.col("entry_price")).cast("double"))).alias("win_rate"))
    m = backtest(signals.drop("position"), commission).join(t, "symbol", "left").fillna(0, ["trades", "win_rate"])
    k = F.from_json("symbol", "s string, t int, r string")
    return m.select(k["s"].alias("symbol"), k["t"].alias("trial"), k["r"].alias("role"), "bars", (100 * F.col("total_return")).alias("total_return"), "sharpe", "sortino", (100 * F.col("max_drawdown")).alias("max_drawdown"), "trades", "win_rate")


def oos_trials(results: DataFrame, criteria: dict[str, float] = CRITERIA) -> DataFrame:
    """Per symbol and trial that has both ranges: the failed criteria, and whether there are none."""
    figures = [c for c in results.columns if c not in ("symbol", "trial", "role")]
    g = results.groupBy("symbol", "trial").agg(*[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("train", "test") for c in figures]).where("train_bars is not null and test_bars is not null")
    t = lambda c: F.col(f"test_{c}")
    failed = {
        "sharpe": t("sharpe") < criteria["min_sharpe"], "return": t("total_return") < criteria["min_return"], "drawdown": t("max_drawdown") < criteria["max_drawdown"],
        "win_rate": t("win_rate") < criteria["min_win_rate"], "retention": (F.col("train_sharpe") > 0) & (F.try_divide(t("sharpe"), F.col("train_sharpe")) < criteria["min_retention"]),
        "spread": F.abs(F.col("train_total_return") - t("total_return")) > criteria["max_spread"],
    }
    x = g.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in failed.items()])))
    return x.withColumn("passed", F.size("reasons") == 0)


def oos_report(trials: DataFrame) -> DataFrame:
    """Per symbol: means and population deviations over its trials, kept Sharpe ratio, passes, failures and the distinct reasons in order."""
    figures = ("sharpe", "sortino", "max_drawdown", "win_rate", "total_return", "trades")
    x = trials.groupBy("symbol").agg(
        *[f(F.col(f"{r}_{c}")).alias(f"{r}_{c}_{n}") for r in ("train", "test") for c in figures for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))],
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
    )
    return x.withColumn("retention", F.when(F.col("train_sharpe_mean") > 0, F.col("test_sharpe_mean") / F.col("train_sharpe_mean")).otherwise(0.0))
