"""What trades cost: commission, slippage and spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Commission as a share of the value traded (0.5 %) and its least amount, slippage at no volume and by volume ratio, and a day's range as a share of the price.
COMMISSION, LEAST, SLIPPAGE, BY_VOLUME, RANGE = 0.005, 1.0, 0.001, 0.0005, 0.002


def commission(qty: Column, price: Column) -> Column:
    return F.greatest(COMMISSION * qty * price, F.lit(LEAST))


def slippage(volume: Column, mean_volume: Column) -> Column:
    """The expected share of the price; a mean volume that isn't positive counts as a ratio of 1."""
    return SLIPPAGE + BY_VOLUME * F.when(mean_volume > 0, volume / mean_volume).otherwise(1.0)


def spread(price: Column) -> Column:
    return price * RANGE * 0.5


def trade_costs(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Closed trades with each cost, from ``qty, volume, entry_price, exit_price``; null volumes count 0. Only one row a symbol of ``bars`` is joined."""
    mean = bars.groupBy("symbol").agg(F.avg("volume").alias("mean_volume"))
    q, a, b = (F.col(c) for c in ("qty", "entry_price", "exit_price"))
    x = trades.where("exit_price is not null").join(mean, "symbol")
    x = x.withColumns({
        "gross": (b - a) * q, "commission": commission(q, a) + commission(q, b),
        "slippage": slippage(F.coalesce("volume", F.lit(0)), F.col("mean_volume")) * q * (a + b) / 2, "spread": (spread(a) + spread(b)) * q,
    })
    return x.withColumn("net", F.col("gross") - F.col("commission") - F.col("slippage") - F.col("spread")).drop("mean_volume")


def cost_report(costs: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """By symbol: sums, returns on ``cash`` before and after costs, and commission over gross profit (0 if that is 0)."""
    x = costs.groupBy("symbol").agg(F.count("*").alias("trades"), *[F.sum(c).alias(c) for c in ("gross", "net", "commission", "slippage")])
    return x.withColumns({"gross_return": F.col("gross") / cash, "net_return": F.col("net") / cash, "cost_ratio": F.coalesce(F.try_divide("commission", "gross"), F.lit(0.0))})


def range_costs(trades: DataFrame, bars: DataFrame, rate: float = 0.001, slip: float = 0.25, half: float = 0.5) -> DataFrame:
    """Costs by the ranges of the entry's and exit's bars: prices move against the trade by ``slip + half`` of the range. ``side`` is long or short."""
    bar = lambda p: bars.select("symbol", F.col("ts").alias(f"{p}_ts"), *[F.col(c).alias(f"{p}_{c}") for c in ("high", "low", "close")])
    x = trades.join(bar("entry"), ["symbol", "entry_ts"]).join(bar("exit"), ["symbol", "exit_ts"])
    away = lambda p: F.greatest(F.col(f"{p}_high") - F.col(f"{p}_low"), F.lit(0.0)) * (slip + half)
    x = x.withColumns({"entry_effective": F.col("entry_close") + away("entry"), "exit_effective": F.col("exit_close") - away("exit")})
    a, b, q = F.col("entry_effective"), F.col("exit_effective"), F.col("qty")
    ranges = F.col("entry_high") - F.col("entry_low") + F.col("exit_high") - F.col("exit_low")
    x = x.withColumns({
        "gross": q * F.when(F.col("side") == "long", b - a).otherwise(a - b), "commission": rate * (a + b) * q,
        "slippage": F.abs(F.col("entry_high") - a + b - F.col("exit_low")) * q, "spread": ranges * half * q,
    })
    return x.withColumn("total", F.col("commission") + F.col("slippage") + F.col("spread")).withColumn("net", F.col("gross") - F.col("total"))
