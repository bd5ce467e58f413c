"""Indicators. Recursions run block by block in time, so that a long series is not one task."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows
from ..functions.running import first, lag, running, total
from ..functions.windows import ROW, full, mean, numbered, ordered, trailing


def with_rsi(df: DataFrame, n: int = 14, name: str = "rsi") -> DataFrame:
    """``100 g / (g + l)`` of the gains and losses of n changes, the first change being 0; null if nothing moves."""
    w = trailing(n)
    x = df.withColumn("__d", F.coalesce(F.col("close") - F.lag(F.col("close")).over(ordered()), F.lit(0.0)))
    g, l = F.sum(F.greatest("__d", F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("__d"), F.lit(0.0))).over(w)
    x = x.withColumns({"__g": g, "__l": l, "__n": F.count("*").over(w)})
    return x.withColumn(name, F.when((F.col("__n") == n) & (F.col("__g") + F.col("__l") > 0), 100 * F.col("__g") / (F.col("__g") + F.col("__l")))).drop("__d", "__g", "__l", "__n")


def with_true_range(df: DataFrame) -> DataFrame:
    p = F.lag(F.col("close")).over(ordered())
    return df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p)))


def with_atr(df: DataFrame, n: int = 14) -> DataFrame:
    return with_true_range(df).withColumn("atr", mean(F.col("tr"), n))


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    m, s = mean(F.col("close"), n), full(F.stddev_samp(F.col("close")), F.col("close"), n, trailing(n))
    return {"bb_mid": m, "bb_upper": m + k * s, "bb_lower": m - k * s}


def percent_b(lower: Column, upper: Column) -> Column:
    return F.try_divide(F.col("close") - lower, upper - lower)


def donchian(n: int = 20) -> dict[str, Column]:
    w = trailing(n)
    return {"dc_high": full(F.max(F.col("high")), F.col("high"), n, w), "dc_low": full(F.min(F.col("low")), F.col("low"), n, w)}


def with_vwap(df: DataFrame) -> DataFrame:
    """The mean of the typical price so far, weighted by volume."""
    v = F.col("volume")
    x = running(df, {"__p": total((F.col("high") + F.col("low") + F.col("close")) / 3 * v), "__v": total(v)})
    return x.withColumn("vwap", F.col("__p") / F.when(F.col("__v") == 0, 1).otherwise(F.col("__v"))).drop("__p", "__v")


def roc(k: int = 10) -> Column:
    return F.try_divide(F.col("close"), F.lag(F.col("close"), k).over(ordered())) - 1


def with_returns(df: DataFrame) -> DataFrame:
    return df.withColumn("ret", F.try_divide(F.col("close"), F.lag(F.col("close")).over(ordered())) - 1)


def volatility(n: int = 20) -> Column:
    r = F.col("ret")
    return full(F.stddev_samp(r), r, n, trailing(n))


def volume_zscore(n: int = 20) -> Column:
    return F.try_divide(F.col("volume") - mean(F.col("volume"), n), full(F.stddev_samp(F.col("volume")), F.col("volume"), n, trailing(n)))


def smooth(x: np.ndarray, alpha: float, seed: float) -> np.ndarray:
    """``e = alpha x + (1 - alpha) e'`` from ``seed``; missing values carry the state."""
    return pd.Series(np.concatenate([[seed], x])).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]


def ewm(df: DataFrame, specs: Iterable[tuple[str, str, float]], block: str = "month", keys: tuple[str, ...] = ("symbol",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds recursive means ``(output, input column, alpha)``, seeded by the first value; ``n`` counts a series' rows from 1.

    A block of time maps the state before it to the one after it, ``e -> a e + b``. One pass finds each block's a and b, the few
    blocks of a series are then composed in order, and a second pass fills in the rows: no series is a single group.
    Blocks are those of a numbered table, else of time, where rows of equal times go by the input's values."""
    specs = list(specs)
    known = ROW in df.columns
    at = F.floor(F.col(ROW) / windows.BLOCK_ROWS) if known else F.date_trunc(block, F.col("ts"))
    rows = df.select("*", at.alias("__block"))
    key = [*keys, "__block"]
    order = [ROW] if known else ["ts", *dict.fromkeys(c for _, c, _ in specs)]
    names, made = list(df.columns), [o for o, _, _ in specs]

    def shape(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        out = {k: [f[k].iloc[0]] for k in key} | {"rows": [len(f)]}
        for i, (_, c, alpha) in enumerate(specs):
            x = f[c].to_numpy(float)
            good = x[~np.isnan(x)]
            out[f"first{i}"] = [good[0] if len(good) else None]
            out[f"a{i}"] = [(1 - alpha) ** len(good)]
            out[f"b{i}"] = [smooth(good, alpha, 0.0)[-1] if len(good) else 0.0]
        return pd.DataFrame(out)

    def seeds(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__block").reset_index(drop=True)
        out = f[key].copy()
        out["before"] = f.rows.cumsum() - f.rows
        for i in range(len(specs)):
            e, col = np.nan, []
            for first, a, b in zip(f[f"first{i}"], f[f"a{i}"], f[f"b{i}"], strict=True):
                if np.isnan(e) and first is not None and not np.isnan(first):
                    e = first
                col.append(e)
                e = a * e + b if not np.isnan(e) else e
            out[f"seed{i}"] = col
        return out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ks = ", ".join(f"{k} {kinds[k]}" for k in key)
    one = ", ".join(f"first{i} double, a{i} double, b{i} double" for i in range(len(specs)))
    seeded = rows.groupBy(*key).applyInPandas(shape, f"{ks}, rows long, {one}").groupBy(*keys).applyInPandas(seeds, f"{ks}, before long, " + ", ".join(f"seed{i} double" for i in range(len(specs))))

    def fill(f: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order).reset_index(drop=True)
        if f.empty:
            return pd.DataFrame({c: [] for c in [*names, *made, "n"]})
        for i, (o, c, alpha) in enumerate(specs):
            f[o] = smooth(f[c].to_numpy(float), alpha, s[f"seed{i}"].iloc[0])
        f["n"] = s.before.iloc[0] + np.arange(1, len(f) + 1)
        return f[[*names, *made, "n"]]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in df.columns) + "".join(f", {o} double" for o, _, _ in specs) + ", n long"
    return rows.groupBy(*key).cogroup(seeded.groupBy(*key)).applyInPandas(fill, schema)


def span(n: int) -> float:
    return 2 / (n + 1)


def with_ema(df: DataFrame, *periods: int) -> DataFrame:
    return ewm(df, [(f"ema{p}", "close", span(p)) for p in periods])


def with_ema_adjusted(df: DataFrame, n: int) -> DataFrame:
    """Weighted mean with weights ``(1 - alpha) ** age``: the ratio of two recursions."""
    a = span(n)
    x = ewm(running(numbered(df), {"__first": first(F.col("close"))}), [("__e", "close", a)])
    # The seeded recursion is the weighted sum with the first value's weight too large by (1 - alpha) ** (n - 1) - that of the adjusted one.
    decay = F.pow(F.lit(1 - a), F.col("n"))
    x = x.withColumn("ema_adjusted", (F.col("__e") - decay * F.col("__first")) / (1 - decay)).drop("__e", "__first")
    return x if ROW in df.columns else x.drop(ROW)


def with_wilder(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """Smoothing by 1/n, null until n rows."""
    x = ewm(df, [(name, column, 1 / n)])
    return x.withColumn(name, F.when(F.col("n") >= n, F.col(name)))


def with_rsi_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    x = running(numbered(df), {"__c": lag(F.col("close"))})
    x = x.withColumn("__d", F.coalesce(F.col("close") - F.col("__c"), F.lit(0.0))).drop("__c").withColumns({"__up": F.greatest("__d", F.lit(0.0)), "__down": F.greatest(-F.col("__d"), F.lit(0.0))})
    x = ewm(x, [("__g", "__up", 1 / n), ("__l", "__down", 1 / n)])
    moved = F.col("__g") + F.col("__l")
    return x.withColumn("rsi_wilder", F.when((F.col("n") >= n) & (moved > 0), 100 * F.col("__g") / moved)).drop("__d", "__up", "__down", "__g", "__l", *([] if ROW in df.columns else [ROW]))


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *also: int) -> DataFrame:
    """The difference of two exponential means, its own mean and the rest; ``also``: further means of the close, found in the first pass."""
    x = with_ema(df, fast, slow, *also).drop("n").withColumn("macd", F.col(f"ema{fast}") - F.col(f"ema{slow}"))
    x = ewm(x, [("macd_signal", "macd", span(signal))])
    return x.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
