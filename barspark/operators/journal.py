"""Trade journal, equity reports and sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ordered, upto


def query_trades(trades: DataFrame, symbol: str | None = None, side: str | None = None, reason: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    x = trades
    if symbol:
        x = x.where(F.upper("symbol") == symbol.upper())
    if side:
        x = x.where(F.upper("side") == side.upper())
    if reason:
        x = x.where(F.contains(F.lower("reason"), F.lit(reason.lower())))
    if start:
        x = x.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return x.where(F.col("ts") < F.lit(end).cast("timestamp_ntz")) if end else x


def top_reasons(trades: DataFrame, n: int = 5) -> DataFrame:
    return trades.groupBy("reason").count().orderBy(F.desc("count"), "reason").limit(n)


def cash_flow(trades: DataFrame, *keys: str) -> DataFrame:
    amount = F.round(F.col("qty") * F.col("price") * 100).cast("long")
    x = trades.withColumn("cents", F.when(F.col("side") == "BUY", -amount).otherwise(amount))
    c = F.col("cents")
    return x.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"), (F.sum(c) / 100).alias("net"),
        (F.sum(F.when(c < 0, -c).otherwise(0)) / 100).alias("spent"), (F.sum(F.when(c > 0, c).otherwise(0)) / 100).alias("received"), F.round(F.avg(F.abs(c)) / 100, 4).alias("avg_abs"), (F.max(c) / 100).alias("most"), (F.min(c) / 100).alias("least"),
    )


def daily_pnl(trades: DataFrame, days: int = 14) -> DataFrame:
    """Cash flow of the last ``days`` days that have trades, with the best and the worst marked."""
    d = cash_flow(trades.withColumn("day", F.col("ts").cast("date")), "day").orderBy(F.desc("day")).limit(days)
    w = Window.partitionBy()
    return d.select("day", "trades", "buys", "sells", "net", (F.col("net") == F.max("net").over(w)).alias("best"), (F.col("net") == F.min("net").over(w)).alias("worst"))


def curve_stats(equity: DataFrame, order: str = "day") -> DataFrame:
    """Per strategy, the Sharpe ratio of differences in money, the drawdown, and the longest run of losing steps."""
    w = ordered("strategy", order=order)
    x = equity.withColumn("d", F.col("equity") - F.lag("equity").over(w)).withColumn("dd", F.col("equity") / F.max("equity").over(upto("strategy", order=order)) - 1)
    x = x.withColumn("island", F.sum(F.when(F.coalesce(F.col("d"), F.lit(0.0)) < 0, 0).otherwise(1)).over(upto("strategy", order=order)))
    x = x.withColumn("run", F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).over(Window.partitionBy("strategy", "island")))
    return x.groupBy("strategy").agg(F.count("*").alias("points"), F.min_by("equity", order).alias("first"), F.max_by("equity", order).alias("last"), F.coalesce(F.try_divide(F.avg("d"), F.stddev_samp("d")) * 252**0.5, F.lit(0.0)).alias("sharpe"), F.min("dd").alias("max_drawdown"), F.max("run").alias("losing_run"), F.var_samp("d").alias("variance"))


def latest_positions(changes: DataFrame) -> DataFrame:
    """The last row of each strategy and symbol, if its quantity isn't 0: one partial aggregate."""
    return changes.groupBy("strategy", "symbol").agg(F.max_by(F.struct("ts", "qty", "price"), F.struct("ts", "order_id", "line", "qty", "price")).alias("x")).select("strategy", "symbol", "x.*").where("qty <> 0")


def post_id(text: Column, source: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.coalesce(text, F.lit("")), F.coalesce(source, F.lit(""))), 256), 1, 12)


def distinct_posts(posts: DataFrame) -> DataFrame:
    """The first post (by time, then id) of each text and source."""
    x = posts.withColumn("hash", post_id(F.col("text"), F.col("source")))
    first = x.groupBy("hash").agg(F.min(F.struct("ts", "post_id")).alias("f"))
    return x.join(first, "hash").where((F.col("ts") == F.col("f.ts")) & (F.col("post_id") == F.col("f.post_id"))).drop("f")


def polarity(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sum of the lexicon's values over a post's tokens, squashed by ``s / sqrt(s * s + 15)``. Only tokens of the lexicon are joined."""
    tokens = posts.select("post_id", F.explode(F.split(F.lower("text"), r"[ \n]+")).alias("token"))
    s = tokens.join(lexicon, "token").groupBy("post_id").agg(F.sum("value").alias("s"))
    return posts.join(s, "post_id", "left").withColumn("score", F.coalesce(F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15), 6), F.lit(0.0))).drop("s")


def with_polarity(posts: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``polarity`` by a small lexicon given as literals, row by row: for streams, which can't join their own aggregates."""
    value = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    s = F.aggregate(F.split(F.lower("text"), r"[ \n]+"), F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(value, t), F.lit(0.0)))
    return posts.withColumn("__s", s).withColumn("score", F.coalesce(F.round(F.col("__s") / F.sqrt(F.col("__s") * F.col("__s") + 15), 6), F.lit(0.0))).drop("__s")


def sentiment(scored: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Per symbol within the hours before ``as_of``: mentions, shares and the five strongest posts."""
    x = scored.where((F.col("ts") >= as_of - F.expr(f"interval {hours} hours")) & (F.col("ts") <= as_of))
    s = F.col("score")
    g = x.groupBy("symbol").agg(F.count("*").alias("mentions"), F.count_if(s > 0.25).alias("bullish"), F.count_if(s < -0.25).alias("bearish"), F.round(F.avg(s), 4).alias("mean"))
    g = g.withColumns({"neutral": F.col("mentions") - F.col("bullish") - F.col("bearish"), "net": F.round((F.col("bullish") - F.col("bearish")) / F.greatest("mentions", F.lit(1)), 4)})
    # the five of each of many parts of a symbol's posts, then the five of those
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("score")), "post_id"))
    few = x.select("symbol", "post_id", "score", F.pmod(F.xxhash64("post_id"), F.lit(256)).alias("__part")).withColumn("__n", rank("symbol", "__part")).where("__n <= 5")
    top = few.withColumn("__n", rank("symbol")).where("__n <= 5").groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "post_id"))), lambda z: z["post_id"]).alias("top"))
    return g.join(top, "symbol")


def mentions(posts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Posts by symbol that they name, as ``$SYM`` or a word: tokens are filtered to the symbols before anything is shuffled."""
    t = posts.select("post_id", F.explode(F.array_distinct(F.split(F.upper("text"), r"[^A-Z0-9]+"))).alias("token"))
    return t.join(symbols.select(F.upper("symbol").alias("token"), "symbol"), "token").select("post_id", "symbol")


def dashboard(equity: DataFrame, trades: DataFrame, order: str = "day") -> DataFrame:
    """Per strategy: first and last equity, gain, best and worst return in percent, points, trades by side and distinct symbols."""
    e = equity.withColumn("ret", F.try_divide("equity", F.lag("equity").over(Window.partitionBy("strategy").orderBy(order))) - 1)
    e = e.groupBy("strategy").agg(F.min_by("equity", order).alias("first"), F.max_by("equity", order).alias("last"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.count("*").alias("points"))
    e = e.withColumns({"gain": F.round(F.col("last") - F.col("first"), 2), "gain_pct": F.round(100 * (F.col("last") / F.col("first") - 1), 2), "best": F.round(100 * F.col("best"), 4), "worst": F.round(100 * F.col("worst"), 4)})
    side = F.upper("side")
    t = trades.groupBy("strategy").agg(F.count("*").alias("trades"), F.count_if(side == "BUY").alias("buys"), F.count_if(side == "SELL").alias("sells"), F.count_distinct("symbol").alias("symbols"))
    return e.join(t, "strategy", "full_outer")


def recent(rows: DataFrame, n: int = 50, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last ``n`` rows, oldest first."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def day_moves(trades: DataFrame, *more: Column) -> DataFrame:
    """Per strategy, symbol and day: the trades' number ``n``, the change of the position ``q``, and further aggregates."""
    q = F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")))
    return trades.groupBy("strategy", "symbol", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), q.alias("q"), *more)


def day_summary(equity: DataFrame, moves: DataFrame) -> DataFrame:
    """Per strategy and day: equity, change since the day before in money and percent (null on the first), trades, and symbols with an open position at its end,
    from the ``day_moves`` of the trades."""
    w = Window.partitionBy("strategy").orderBy("day")
    before = F.lag("equity").over(w)
    e = equity.withColumns({"pnl": F.round(F.col("equity") - before, 2) + F.lit(0.0), "pnl_pct": F.round(100 * F.try_divide(F.col("equity") - before, before), 2) + F.lit(0.0)})
    upto = Window.partitionBy("strategy", "symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    open_ = (F.sum("q").over(upto) != 0).cast("int")
    move = moves.withColumn("open", open_)
    move = move.withColumn("opened", F.col("open") - F.coalesce(F.lag("open").over(Window.partitionBy("strategy", "symbol").orderBy("day")), F.lit(0)))
    day = move.groupBy("strategy", "day").agg(F.sum("n").alias("trades"), F.sum("opened").alias("opened"))
    x = e.join(day, ["strategy", "day"], "left").fillna(0, ["trades", "opened"])
    return x.withColumn("open_positions", F.sum("opened").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opened")


def exposure(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Per strategy: open positions and their long, short and net values at the given prices; unpriced ones count at their own price."""
    x = positions.join(prices.select("symbol", F.col("price").alias("now")), "symbol", "left").withColumn("value", F.col("qty") * F.coalesce("now", "price"))
    v = F.col("value")
    return x.groupBy("strategy").agg(F.count("*").alias("positions"), F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("long"), F.coalesce(F.sum(F.when(v < 0, -v)), F.lit(0.0)).alias("short"), F.sum(v).alias("net"))


def as_posts(raw: DataFrame, most: int = 500) -> DataFrame:
    """Vendor rows as posts: texts held to ``most`` characters, ISO times with ``Z`` or an offset as instants, null if they can't be read."""
    return raw.withColumns({"text": F.left("text", F.lit(most)), "ts": F.try_to_timestamp("created_at")})
