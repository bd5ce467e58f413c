"""Kelly fractions, weights, sizes and plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_returns(df: DataFrame, column: str = "ret") -> DataFrame:
    c = F.col(column)
    return df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def kelly_from_returns(df: DataFrame, *keys: str, fraction: float = 0.5, cap: float = 0.25, least: int = 10) -> DataFrame:
    """A fraction of mean over variance, within 0 and the cap; 0 for few or constant returns."""
    f = F.when((F.count("ret") >= least) & (F.var_samp("ret") > 0), F.greatest(F.lit(0.0), F.least(F.lit(cap), fraction * F.avg("ret") / F.var_samp("ret")))).otherwise(0.0)
    return clean_returns(df).groupBy(*keys).agg(F.count("ret").alias("n"), f.alias("kelly"))


def kelly_from_odds(win_rate: Column, win: Column, loss: Column, fraction: float = 0.5, cap: float = 0.25) -> Column:
    b = F.try_divide(win, loss)
    raw = win_rate - F.try_divide(1 - win_rate, b)
    return F.when((loss > 0) & (win > 0), F.greatest(F.lit(0.0), F.least(F.lit(cap), fraction * raw))).otherwise(0.0)


def outcomes(trades: DataFrame) -> DataFrame:
    """Each sale's profit against its symbol's mean price."""
    mean = trades.groupBy("symbol").agg(F.avg("price").alias("mean_price"))
    return trades.where("side = 'SELL'").join(mean, "symbol").withColumn("pnl", F.round(F.col("qty") * (F.col("price") - F.col("mean_price")), 4))


def outcome_stats(o: DataFrame) -> DataFrame:
    """Wins, losses and the payoff per strategy and symbol; profits of 0 don't count."""
    p = F.col("pnl")
    x = o.where(p != 0).groupBy("strategy", "symbol").agg(F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(p < 0, -p)), F.lit(0.0)).alias("avg_loss"))
    x = x.withColumns({"win_rate": F.col("wins") / (F.col("wins") + F.col("losses")), "payoff": F.try_divide("avg_win", "avg_loss")})
    return x.withColumn("kelly", F.when(F.col("wins") + F.col("losses") >= 10, kelly_from_odds(F.col("win_rate"), F.col("avg_win"), F.col("avg_loss"))).otherwise(0.0))


def scaled_risk(base: Column, kelly: Column, least: float = 0.0) -> Column:
    return F.greatest(base * (1 + F.greatest(kelly, F.lit(0.0))), F.lit(least))


def normalised(value: Column, others: Column | None = None) -> Column:
    """``value`` over the sum of all, where values that aren't positive count 0; equal shares if none is positive."""
    v = F.when(value > 0, value).otherwise(0.0)
    total = F.sum(v).over(Window.partitionBy())
    return F.when(total > 0, v / total).otherwise(1 / F.count("*").over(Window.partitionBy()))


def inverse_volatility(vol: Column) -> Column:
    return normalised(F.when(vol > 0, 1 / vol))


def position_size(equity: Column, price: Column, stop: Column, risk: float = 0.01, most: float = 0.25) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(F.try_divide(equity * risk, stop)), F.floor(F.try_divide(equity * most, price)))).cast("long")


def stops(entry: Column, atr: Column, down: float = 2.0, up: float = 3.0) -> dict[str, Column]:
    return {"stop": entry - down * atr, "target": entry + up * atr}


#: Symbols of one block of a Gram matrix.
BLOCK_SYMBOLS = 64


def gram(returns: DataFrame, *keys: str, block: int = BLOCK_SYMBOLS, piece: str = "year") -> DataFrame:
    """For each pair ``a < b`` (and each of ``keys``): ``n``, the times at which both stand, ``m``, those at which both have a return, and over these the sums
    ``sa, sb, saa, sbb, sab``.

    Symbols are dealt to blocks; a task multiplies the matrices of two blocks over a piece of time, so rows are copied once for each block and never joined by
    time. Returns are taken less their symbol's mean, which leaves correlations as they are and sums small. A null return or NaN is none; null symbols are left out; of rows that repeat a symbol and time one counts."""
    x = returns.where("symbol is not null").select(*keys, "symbol", "ts", F.nullif(F.col("ret").cast("double"), F.lit(float("nan"))).alias("ret"))
    mean = x.groupBy(*keys, "symbol").agg(F.avg("ret").alias("__mean"))
    blocks = max(1, -(-x.select("symbol").distinct().count() // block))
    x = x.join(mean, [*keys, "symbol"]).withColumn("ret", F.col("ret") - F.col("__mean")).drop("__mean")
    x = x.withColumns({"__own": F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"), "__piece": F.date_trunc(piece, F.col("ts"))})
    x = x.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = x.withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")})
    group = [*keys, "__i", "__j", "__piece"]

    def products(f: pd.DataFrame) -> pd.DataFrame:
        first, second = f[f["__own"] == f["__i"].iloc[0]], f[f["__own"] == f["__j"].iloc[0]]
        times, names = np.unique(f.ts.to_numpy(), return_inverse=True), [np.unique(s.symbol.to_numpy()) for s in (first, second)]
        m, stands = [], []
        for s, n in zip((first, second), names, strict=True):
            v, there = np.full((len(times[0]), len(n)), np.nan), np.zeros((len(times[0]), len(n)))
            at = np.searchsorted(times[0], s.ts.to_numpy()), np.searchsorted(n, s.symbol.to_numpy())
            v[at], there[at] = s.ret.to_numpy(float), 1.0
            m.append(v)
            stands.append(there)
        known = [~np.isnan(v) for v in m]
        a, b = (np.where(k, v, 0.0) for k, v in zip(known, m, strict=True))
        ka, kb = (k.astype(float) for k in known)
        sums = {"n": stands[0].T @ stands[1], "m": ka.T @ kb, "sa": a.T @ kb, "sb": ka.T @ b, "saa": (a * a).T @ kb, "sbb": ka.T @ (b * b), "sab": a.T @ b}
        i, j = (v.ravel() for v in np.meshgrid(np.arange(len(names[0])), np.arange(len(names[1])), indexing="ij"))
        out = pd.DataFrame({"a": names[0][i], "b": names[1][j]} | {k: v[i, j] for k, v in sums.items()})
        swap = (out.a > out.b).to_numpy()
        same = f["__i"].iloc[0] == f["__j"].iloc[0]
        for p, q in (("a", "b"), ("sa", "sb"), ("saa", "sbb")):
            x, y = out[p].to_numpy(), out[q].to_numpy()
            out[p], out[q] = np.where(swap, y, x), np.where(swap, x, y)
        out = out[(out.n > 0) & (out.a != out.b) & ~(swap & same)]
        return out.assign(**{k: f[k].iloc[0] for k in keys})

    kinds = dict(x.dtypes)
    schema = "a string, b string, n double, m double, sa double, sb double, saa double, sbb double, sab double" + "".join(f", {k} {kinds[k]}" for k in keys)
    parts = x.groupBy(*group).applyInPandas(products, schema)
    sums = [F.sum(c).alias(c) for c in ("sa", "sb", "saa", "sbb", "sab")]
    return parts.groupBy(*keys, "a", "b").agg(F.sum("n").cast("long").alias("n"), F.sum("m").cast("long").alias("m"), *sums)


def correlation_distance(returns: DataFrame, *keys: str) -> DataFrame:
    """Pairwise correlation of symbols' returns over common times, and the distance ``sqrt((1 - r) / 2)``, of all rows or for each of ``keys``. Null where a side doesn't vary."""
    g, n = gram(returns, *keys), F.col("m")
    spread = lambda c: F.col(f"{c}{c[1:]}") - F.col(c) * F.col(c) / n
    va, vb = spread("sa"), spread("sb")
    flat = (va <= 1e-14 * F.col("saa")) | (vb <= 1e-14 * F.col("sbb"))
    corr = F.when((n > 1) & ~flat, F.greatest(F.least((F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb), F.lit(1.0)), F.lit(-1.0)))
    c = g.select(*keys, "a", "b", "n", corr.alias("corr"))
    return c.withColumn("distance", F.sqrt(F.greatest((1 - F.col("corr")) / 2, F.lit(0.0))))


def ward_tree(distance: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """The merges of Ward's clustering, each as the members of its two sides: the closest pair of clusters first, of equally close ones that which stands first."""
    n = len(distance)
    d = distance.astype(float) ** 2
    np.fill_diagonal(d, np.inf)
    members, merges = [[i] for i in range(n)], []
    live = np.ones(n, bool)
    for _ in range(n - 1):
        rows = np.flatnonzero(live)
        sub = np.round(d[np.ix_(rows, rows)], 12)
        i, j = (int(rows[k]) for k in np.unravel_index(np.argmin(sub), sub.shape))
        i, j = min(i, j), max(i, j)
        merges.append((sorted(members[i]), sorted(members[j])))
        ni, nj = len(members[i]), len(members[j])
        rest = rows[(rows != i) & (rows != j)]
        nk = np.array([len(members[k]) for k in rest])
        new = ((ni + nk) * d[i, rest] + (nj + nk) * d[j, rest] - nk * d[i, j]) / (ni + nj + nk) if len(rest) else np.empty(0)
        d[i, rest] = d[rest, i] = new
        members[i] += members[j]
        live[j] = False
    return merges


def bisected(corr: np.ndarray, merges: list[tuple[list[int], list[int]]]) -> np.ndarray:
    """Weights by the tree from its root down: each merge deals its weight to its sides by the variance of the other, each side weighted equally."""
    w = np.ones(len(corr))
    var = lambda m: max(float(corr[np.ix_(m, m)].sum()) / len(m) ** 2, 1e-12)
    for left, right in reversed(merges):
        a, b = var(left), var(right)
        w[left] *= b / (a + b)
        w[right] *= a / (a + b)
    return w / w.sum()


def hierarchical_risk_parity(returns: DataFrame, date: str) -> DataFrame:
    """``date, symbol, weight``: weights by hierarchical risk parity of the returns (``symbol, ts, ret``) that belong to each rebalance date; they sum to 1.

    Correlations of all dates come from one job of block products; then each date's matrix is a group of its own, so dates are many tasks. A pair without common times or
    spread counts as uncorrelated. Symbols stand in the order of their names, which decides ties; a single symbol weighs 1; symbols without a return have no weight."""
    pairs = correlation_distance(returns, date).select(date, "a", "b", F.coalesce("corr", F.lit(0.0)).alias("corr"))
    names = returns.where("ret is not null and not isnan(ret) and symbol is not null").select(date, F.col("symbol").alias("a"), F.col("symbol").alias("b")).distinct()
    both = pairs.unionByName(names.withColumn("corr", F.lit(1.0)))

    def weights(f: pd.DataFrame) -> pd.DataFrame:
        s = np.unique(f.a[f.a == f.b].to_numpy())
        c = np.eye(len(s))
        i, j = np.searchsorted(s, f.a.to_numpy()), np.searchsorted(s, f.b.to_numpy())
        c[i, j] = c[j, i] = f["corr"].to_numpy()
        w = bisected(c, ward_tree(np.sqrt(np.clip((1 - c) / 2, 0, None))))
        return pd.DataFrame({date: f[date].iloc[0], "symbol": s, "weight": w})

    return both.groupBy(date).applyInPandas(weights, f"{date} {dict(returns.dtypes)[date]}, symbol string, weight double")


def rebalance_plan(positions: DataFrame, prices: DataFrame, targets: DataFrame, band: float = 0.15) -> DataFrame:
    """Shares to buy or sell where a position lies outside the band around its target value."""
    x = targets.select("symbol", F.col("value").alias("goal")).join(positions.select("symbol", "qty"), "symbol", "full_outer").join(prices.select("symbol", "price"), "symbol").fillna(0.0, ["goal", "qty"])
    diff = F.col("goal") - F.col("qty") * F.col("price")
    act = F.abs(diff) > band * F.col("goal")
    return x.withColumns({"shares": F.when(act, F.floor(F.abs(diff) / F.col("price"))).otherwise(0).cast("long"), "action": F.when(act & (diff > 0), "BUY").when(act & (diff < 0), "SELL").otherwise("HOLD")})


def reconcile(own: DataFrame, broker: DataFrame) -> DataFrame:
    """The broker's positions win: unknown ones are adopted, vanished ones dropped, the others kept."""
    held = broker.where("qty > 0")
    return held.join(own.select("symbol"), "symbol", "left_anti").withColumn("how", F.lit("adopted")).unionByName(own.join(held.select("symbol"), "symbol", "left_semi").withColumn("how", F.lit("kept"))).unionByName(own.join(held.select("symbol"), "symbol", "left_anti").withColumn("how", F.lit("dropped")))


def confident_size(win_rate: Column, win: Column, loss: Column, confidence: Column, fraction: float = 0.5, cap: float = 0.25) -> Column:
    """A fraction of Kelly times the confidence, within 0 and the cap; without losses Kelly is the win rate. Rates and confidences are held to 0 and 1."""
    p, c = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in (win_rate, confidence))
    kelly = F.when(loss <= 0, p).otherwise(p - F.coalesce(F.try_divide(1 - p, win / loss), F.lit(float("inf"))))
    return F.greatest(F.lit(0.0), F.least(F.lit(cap), kelly * fraction * c))


def listed_weights(symbols: DataFrame, weights: DataFrame) -> DataFrame:
    """Symbols with their listed weight (1 if not listed, 0 if below 0) over the sum of all; equal shares if that is 0."""
    x = symbols.join(weights, "symbol", "left").withColumn("raw", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0))).drop("weight")
    total = x.agg(F.sum("raw").alias("__total"), F.count("*").alias("__n"))  # one row
    return x.crossJoin(F.broadcast(total)).withColumn("weight", F.when(F.col("__total") > 0, F.col("raw") / F.col("__total")).otherwise(1 / F.col("__n"))).drop("__total", "__n", "raw")


def stop_size(equity: Column, price: Column, stop: Column, risk: float = 0.01, most: float = 0.10, least: float = 1.0) -> Column:
    """Shares, value and money at risk so that the way to the stop costs ``risk`` of the equity, held to ``most`` of it; nothing below ``least``, for bad prices, or a stop at the price."""
    gap = F.abs(price - stop)
    n = F.greatest(F.least(F.floor(F.try_divide(equity * risk, gap)), F.floor(F.try_divide(equity * most, price))), F.lit(0))
    n = F.when((price > 0) & (stop > 0) & (gap >= 1e-6) & (n * price >= least), n).otherwise(0).cast("long")
    return F.struct(n.alias("shares"), F.round(n * price, 2).alias("value"), F.round(n * F.coalesce(gap, F.lit(0.0)), 2).alias("risk"))


def entry_plan(latest: DataFrame, held: DataFrame, equity: float, least: float = 0.0, most: float | None = None) -> DataFrame:
    """Buys for symbols whose latest signal is 1 and which aren't held, from ``symbol, signal, close, atr``: sized by twice the range
    (2 % of the price if it is missing or not positive), with stop and target, and a value within the bounds."""
    x = latest.where("signal = 1").join(held.select("symbol"), "symbol", "left_anti")
    x = x.withColumn("atr", F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.col("close") * 0.02))
    x = x.withColumn("shares", position_size(F.lit(equity), F.col("close"), 2 * F.col("atr"))).withColumns(stops(F.col("close"), F.col("atr")))
    value = F.col("shares") * F.col("close")
    return x.where((F.col("shares") > 0) & (value >= least) & (F.lit(most is None) | (value <= F.lit(most)))).withColumn("value", value)


def capital_split(allocations: DataFrame, known: list[str], capital: float) -> DataFrame:
    """Capital by strategy from JSON ``{name: {"weight": w, "symbols": [..]}}`` in ``plan``: weights over the sum of all; then unknown
    strategies and those without symbols fall out. No rows if the weights don't add up to more than 0."""
    x = allocations.select(F.explode(F.from_json("plan", "map<string, struct<weight: double, symbols: array<string>>>")).alias("strategy", "s"))
    x = x.select("strategy", F.coalesce("s.weight", F.lit(0.0)).alias("weight"), "s.symbols")
    total = x.agg(F.sum("weight").alias("__total"))  # one row
    x = x.crossJoin(F.broadcast(total)).where("__total > 0").withColumn("weight", F.col("weight") / F.col("__total"))
    return x.where(F.col("strategy").isin(known) & (F.size("symbols") > 0)).select("strategy", "symbols", "weight", (F.col("weight") * capital).alias("capital"))
