"""Parameter grids, date windows and walk-forward search in one job."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.intervals import join_ranges
from ..functions.scratch import settled
from . import indicators as ind


def grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """Every combination, numbered in the order of the lists."""
    one = spark.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    for k in values:
        one = one.select(*[c for c in one.columns if c != k and not c.startswith("__i")], *[c for c in one.columns if c.startswith("__i")], F.posexplode(k).alias(f"__i_{k}", k))
    index = reduce(lambda a, k: a * len(values[k]) + F.col(f"__i_{k}"), values, F.lit(0))
    return one.select(index.cast("int").alias("params_id"), *values)


def stepped(low: float, high: float, steps: int) -> list[float]:
    return [round(low + (high - low) * i / max(steps - 1, 1), 4) for i in range(steps)]


def windows(spark: SparkSession, start: str, end: str, train: int, test: int, step: int | None = None) -> DataFrame:
    """``fold`` and its train and test ranges of days ``[start, end)``; ``step`` is the test length unless given."""
    s = step or test
    d = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.make_dt_interval(F.lit(s)))).alias("train_start"))
    d = d.withColumns({"train_end": F.date_add("train_start", train), "test_end": F.date_add("train_start", train + test)}).where(F.col("test_end") <= F.to_date(F.lit(end)))
    return d.select((F.row_number().over(Window.orderBy("train_start")) - 1).alias("fold"), "train_start", "train_end", "test_end")


def score(sharpe_: Column, total: Column, drawdown: Column) -> Column:
    """Ten Sharpe ratios, half the return in percent, less a penalty for the drawdown of up to a half."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.round(10 * z(sharpe_) + 0.5 * z(total) * 100 - 20 * F.least(F.abs(z(drawdown)), F.lit(0.5)), 4)


def enhanced_score(sharpe_: Column, sortino_: Column, drawdown_pct: Column, weights: tuple[float, float, float] = (10, 5, 20)) -> Column:
    """Weighted Sharpe and Sortino ratios less the drawdown, 0 at least; missing figures count 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.round(F.greatest(weights[0] * z(sharpe_) + weights[1] * z(sortino_) - weights[2] * F.abs(z(drawdown_pct)), F.lit(0.0)), 4)


def in_folds(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """Bars once for each fold whose ranges hold their day, as ``fold, role``."""
    day = F.col("ts").cast("date")
    x = join_ranges(bars, folds.select(F.col("fold").cast("int").alias("fold"), "train_start", "train_end", "test_end"), day, "train_start", "test_end")
    return x.withColumn("role", F.when(day < F.col("train_end"), "train").otherwise("test")).drop("train_start", "train_end", "test_end")


#: Combinations that are evaluated together, on every bar at once.
TOGETHER = 256
_RANGE = ["chunk", "symbol", "fold", "role"]


class _Range:
    """One range of one symbol under many combinations: what is known after the bars so far, and the figures that they have made."""

    def __init__(self, params: list, rsi_period: int, leave_at: float, commission: float):
        self.ids = np.array([p[0] for p in params])
        self.spans = sorted({n for p in params for n in p[1:3]})
        at = {n: i for i, n in enumerate(self.spans)}
        self.fast, self.slow = (np.array([at[p[k]] for p in params]) for k in (1, 2))
        self.entry_max = np.array([p[3] for p in params], float)
        self.period, self.leave_at, self.commission = rsi_period, leave_at, commission
        self.means, self.close, self.rows = None, np.empty(0), 0
        n = len(params)
        self.last, self.held, self.before = (np.zeros(n, np.int8) for _ in range(3))
        self.mean, self.m2, self.low, self.high = np.zeros(n), np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)
        self.total, self.peak, self.drawdown = np.zeros(n), np.full(n, -np.inf), np.zeros(n)

    def add(self, close: np.ndarray) -> None:
        """The next bars in order."""
        n, tail = len(close), self.close
        seeds = self.means[-1] if self.means is not None else np.full(len(self.spans), close[0])
        ema = np.column_stack([ind.smooth(close, ind.span(s), e) for s, e in zip(self.spans, seeds, strict=True)])
        past = np.vstack([self.means[-1:] if self.means is not None else np.full((1, len(self.spans)), np.nan), ema[:-1]])
        now, past = np.round(ema, 9), np.round(past, 9)
        self.means = ema[-1:]
        # the last ``period`` changes; a range's first bar has none
        known = np.concatenate([tail, close])
        change = np.diff(known, prepend=known[0])
        seen = np.concatenate([np.full(self.period - 1, np.nan), change])
        up, down = (np.lib.stride_tricks.sliding_window_view(np.maximum(d, 0), self.period).sum(axis=1)[len(tail) :] for d in (seen, -seen))
        with np.errstate(invalid="ignore", divide="ignore"):
            rsi = np.where(up + down > 0, 100 * up / (up + down), np.nan)
            gain = np.nan_to_num(close / np.concatenate([tail[-1:] if len(tail) else [np.nan], close[:-1]]) - 1, nan=0.0, posinf=0.0, neginf=0.0)
            a, b, a0, b0 = now[:, self.fast], now[:, self.slow], past[:, self.fast], past[:, self.slow]
            leave = ((b > a) & (b0 <= a0)) | (np.round(rsi, 9) > self.leave_at)[:, None]
            enter = (a > b) & (a0 <= b0) & (rsi[:, None] < self.entry_max)
        signal = np.where(leave, np.int8(-1), enter.astype(np.int8))
        at = np.where(signal != 0, np.arange(n)[:, None], -1)
        at = np.maximum.accumulate(at, axis=0)
        on = np.where(at >= 0, np.take_along_axis(signal, np.maximum(at, 0), axis=0), self.last)
        position = (on == 1).astype(np.int8)
        held = np.vstack([self.held[None], position[:-1]])
        before = np.vstack([self.before[None], held[:-1]])
        ret = held * gain[:, None] - np.where((held != 0) & (held != before), self.commission, 0.0)
        self.last, self.held, self.before = on[-1], position[-1], held[-1]
        # mean and squared deviations of two parts together
        mean, m2 = ret.mean(axis=0), ((ret - ret.mean(axis=0)) ** 2).sum(axis=0)
        d, rows = mean - self.mean, self.rows + n
        self.m2 += m2 + d * d * self.rows * n / rows
        self.mean += d * n / rows
        self.low, self.high, self.rows = np.minimum(self.low, ret.min(axis=0)), np.maximum(self.high, ret.max(axis=0)), rows
        grown = self.total + np.cumsum(np.log1p(np.maximum(ret, -0.999999)), axis=0)
        top = np.maximum(np.maximum.accumulate(grown, axis=0), self.peak)
        self.drawdown = np.minimum(self.drawdown, (np.exp(grown - top) - 1).min(axis=0))
        self.total, self.peak = grown[-1], top[-1]
        self.close = known[-self.period - 1 :] if self.rows > self.period else known

    def figures(self, key: dict) -> pd.DataFrame:
        with np.errstate(invalid="ignore", divide="ignore"):
            sharpe = np.where(self.high > self.low, self.mean / np.sqrt(self.m2 / (self.rows - 1)) * 252**0.5, 0.0)
        return pd.DataFrame({"params_id": self.ids, "symbol": key["symbol"], "fold": key["fold"], "role": key["role"], "bars": self.rows, "sharpe": sharpe, "total_return": np.expm1(self.total), "max_drawdown": self.drawdown})


def evaluated(bars: DataFrame, folds: DataFrame, params: DataFrame, rsi_period: int = 14, leave_at: float = 75, commission: float = 0.0005) -> DataFrame:
    """Back-test figures of the strategy of crossing exponential means and RSI: one row per ``params_id, symbol, fold, role``, for every combination (``params_id, fast,
    slow, entry_max``) on every fold's two ranges, where means and RSI start anew.

    Combinations are a table, dealt to chunks of ``TOGETHER``; a range's bars go to each chunk, and its first row brings the chunk's combinations. Spark sorts
    each range, a task reads it batch by batch and keeps what a range needs to go on, so neither a range nor the combinations are held whole. A chunk's
    combinations share each bar's means and are evaluated as columns."""
    chunks = params.select("params_id", "fast", "slow", "entry_max").withColumn("chunk", F.floor(F.col("params_id") / TOGETHER))
    chunks = settled(chunks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("params_id", "fast", "slow", F.col("entry_max").cast("double").alias("entry_max")))).alias("params")), "chunks")
    x = in_folds(bars.select("symbol", "ts", "close"), folds)
    ranges = x.select("symbol", "fold", "role").distinct()
    every = F.explode(F.sequence(F.lit(0), F.lit((chunks.agg(F.max("chunk")).first()[0] or 0)))).alias("chunk")
    head = ranges.select("*", every).join(chunks, "chunk").select(*_RANGE, F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("close"), "params")
    rows = x.select("*", every).select(*_RANGE, F.col("ts").cast("timestamp_ntz").alias("ts"), "close", F.lit(None).cast(chunks.schema["params"].dataType).alias("params"))
    order = [F.col(c) for c in _RANGE] + [F.col("params").isNull(), F.col("ts")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in batches:
            if f.empty:
                continue
            key = list(zip(*(f[c].tolist() for c in _RANGE), strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if key[i] != now:
                    if state is not None and state.rows:
                        yield state.figures(dict(zip(_RANGE, now, strict=True)))
                    now, state = key[i], None
                if f.params.iloc[i] is not None:
                    state = _Range([tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in f.params.iloc[i]], rsi_period, leave_at, commission)
                    i += 1
                if state is not None and i < j:  # a chunk without combinations has no head
                    state.add(f.close.to_numpy(float)[i:j])
        if state is not None and state.rows:
            yield state.figures(dict(zip(_RANGE, now, strict=True)))

    out = "params_id int, symbol string, fold int, role string, bars long, sharpe double, total_return double, max_drawdown double"
    return rows.unionByName(head).repartition(*_RANGE).sortWithinPartitions(*order).mapInPandas(run, out)


def walk_forward_search(bars: DataFrame, folds: DataFrame, params: DataFrame, rsi_period: int = 14, leave_at: float = 75, commission: float = 0.0005) -> DataFrame:
    """One row per ``params_id, fold, role``: the mean of the symbols' ``score``, and their number. Written once, for all reports that read it."""
    m = evaluated(bars, folds, params, rsi_period, leave_at, commission)
    per = m.withColumn("score", score(F.col("sharpe"), F.col("total_return"), F.col("max_drawdown")))
    return settled(per.groupBy("params_id", "fold", "role").agg(F.round(F.avg("score"), 3).alias("score"), F.count("*").alias("symbols")), "search")


def best_per_fold(results: DataFrame) -> DataFrame:
    """The combination with the best training score of each fold (ties: the first), with its test score."""
    w = Window.partitionBy("fold").orderBy(F.desc("score"), "params_id")
    best = results.where("role = 'train'").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("fold", "params_id", F.col("score").alias("train_score"))
    return best.join(results.where("role = 'test'").select("fold", "params_id", F.col("score").alias("test_score")), ["fold", "params_id"], "left")


def top(results: DataFrame, n: int = 10) -> DataFrame:
    return results.where("role = 'test'").groupBy("params_id").agg(F.round(F.avg("score") + 1e-9, 2).alias("score")).orderBy(F.desc("score"), "params_id").limit(n)


