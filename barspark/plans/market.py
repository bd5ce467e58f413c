"""Bars, indicators, strategies and back-tests over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import in_blocks, numbered
from ..operators import bars as B
from ..operators import indicators as I
from ..operators import metrics as M
from ..operators import strategies as S
from ..sources import io
from .inputs import BARS, DAILY, TICKS, bars, daily, ticks
from .registry import query

KEY = ("symbol", "ts")


def out(df, *cols, digits=6):
    """Key and columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*KEY, *[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in cols])


OHLCV = ("open", "high", "low", "close", "volume")


@query("bars_1h", f"WITH {BARS} SELECT * FROM bars")
def bars_1h(spark, d):
    return bars(spark, d)


@query("bars_daily_brand", f"WITH {DAILY} SELECT * FROM daily")
def bars_daily(spark, d):
    return daily(spark, d)


@query("bars_15m", BARS_15 := f"WITH {TICKS} SELECT symbol, time_bucket(INTERVAL '15 minutes', ts)::TIMESTAMP AS ts, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, sum(qty)::BIGINT AS volume FROM ticks GROUP BY 1, 2")
def bars_15m(spark, d):
    t = ticks(spark, d)
    o = F.struct("ts", "tick_id")
    b = t.groupBy("symbol", F.window("ts", "15 minutes").alias("w")).agg(F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("qty").alias("volume"))
    return b.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), *OHLCV)


@query("bar_cache_round_trip", f"WITH {BARS} SELECT * FROM bars")
def bar_cache(spark, d):
    path = io.scratch(spark, "bars")
    io.write_bars(bars(spark, d), path)
    return io.read_bars(spark, path).select(*KEY, *OHLCV)


@query("bar_csv_round_trip", f"WITH {BARS} SELECT * FROM bars")
def bar_csv(spark, d):
    path = io.scratch(spark, "csv")
    bars(spark, d).write.option("header", True).csv(path)
    return io.read_bar_csv(spark, path)


@query("vendor_aggregates_json", f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume::DOUBLE AS volume FROM bars")
def vendor_json(spark, d):
    return io.parse_aggregates(io.to_aggregates(bars(spark, d)))


@query("vendor_records_json", f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume::DOUBLE AS volume FROM bars")
def vendor_records(spark, d):
    return io.parse_records(io.to_records(bars(spark, d)))


@query("source_fallback", f"WITH {BARS}, a AS (SELECT *, 0 AS priority FROM bars WHERE symbol <> 'click'), b AS (SELECT *, 1 AS priority FROM bars), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT * FROM u QUALIFY priority = min(priority) OVER (PARTITION BY symbol)")
def source_fallback(spark, d):
    b = bars(spark, d)
    return B.first_source([b.where("symbol <> 'click'"), b])


@query("latest_bars", f"WITH {BARS} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100")
def latest_bars(spark, d):
    return B.latest(bars(spark, d))


@query("fresh_symbols", f"WITH {DAILY} SELECT symbol, max(ts) AS last_ts, max(ts) >= TIMESTAMP '2001-12-01' - INTERVAL 7 DAY AS fresh FROM daily GROUP BY symbol")
def fresh_symbols(spark, d):
    return B.stale_symbols(daily(spark, d), F.lit("2001-12-01").cast("timestamp_ntz"), 7)


@query("normalized_symbols", "SELECT DISTINCT c_mktsegment AS raw, CASE WHEN contains(s, '-') THEN s ELSE s || '-USD' END AS symbol FROM (SELECT c_mktsegment, upper(replace(c_mktsegment, '/', '-')) AS s FROM customer)")
def normalized_symbols(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("raw")).distinct()
    return c.select("raw", io.normalize_symbol(F.col("raw")).alias("symbol"))


@query("relative_dates", "SELECT o_orderkey, DATE '2001-06-30' - CAST(o_orderkey % 90 AS INTEGER) AS start FROM orders")
def relative_dates(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", io.resolve_date(F.concat(F.lit("-"), F.col("o_orderkey") % 90, F.lit("D")), F.lit("2001-06-30").cast("date")).alias("start"))


@query("first_of_duplicate_ticks", f"WITH {TICKS}, x AS (SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS ts, tick_id, price FROM ticks) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY tick_id) = 1")
def first_of_duplicates(spark, d):
    t = ticks(spark, d).select("symbol", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "tick_id", "price")
    return B.first_of_duplicates(t, "tick_id")


BROKEN = "broken AS (SELECT symbol, ts, open, CASE WHEN volume % 7 = 0 THEN low - 1 ELSE high END AS high, low, close, volume FROM bars)"


def broken(spark, d):
    """Bars of which some have a high below the low."""
    return bars(spark, d).withColumn("high", F.when(F.col("volume") % 7 == 0, F.col("low") - 1).otherwise(F.col("high")))


@query("valid_bars", f"WITH {BARS}, {BROKEN} SELECT * FROM broken WHERE high >= greatest(open, close, low) AND low <= least(open, close)")
def valid_bars(spark, d):
    return broken(spark, d).where(B.valid_ohlc())


@query("ohlc_violations", f"WITH {BARS}, {BROKEN} SELECT symbol, count(*) FILTER (NOT (high >= greatest(open, close, low) AND low <= least(open, close))) AS violations, count(*) AS bars FROM broken GROUP BY symbol")
def ohlc_violations(spark, d):
    return B.ohlc_violations(broken(spark, d))


@query("missing_bars", f"WITH {BARS}, s AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY symbol) SELECT s.symbol, s.ts FROM s ANTI JOIN bars b ON s.symbol = b.symbol AND s.ts = b.ts")
def missing_bars(spark, d):
    return B.missing_bars(bars(spark, d))


@query("missing_business_days", f"WITH {DAILY}, s AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM daily GROUP BY symbol) SELECT s.symbol, s.ts FROM s ANTI JOIN daily b ON s.symbol = b.symbol AND s.ts = b.ts WHERE isodow(s.ts) < 6")
def missing_days(spark, d):
    return B.missing_bars(daily(spark, d), "1 day", True)


@query("gap_report", f"""WITH {BARS}, g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM bars), n AS (SELECT *, (epoch(ts) - epoch(b)) / 3600 - 1 AS n FROM g)
SELECT symbol, coalesce(sum(n), 0)::BIGINT AS missing, min(b) FILTER (n > 0) AS first_gap_after, max(b) FILTER (n > 0) AS last_gap_after, coalesce(max(n), 0)::BIGINT AS longest, coalesce(max(n), 0)::BIGINT > 3 AS warn FROM n GROUP BY symbol""")
def gap_report(spark, d):
    return B.gap_report(bars(spark, d))


CLIP = """SELECT symbol, ts, round(CASE WHEN n >= 30 AND c >= 60 THEN greatest(least(close, m + 3 * s), m - 3 * s) ELSE close END, 6) AS close FROM
(SELECT *, avg(close) OVER w AS m, coalesce(stddev_samp(close) OVER w, 1e-9) AS s, count(close) OVER w AS n, count(*) OVER (PARTITION BY symbol) AS c FROM {0} WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING))"""


@query("clipped_closes", f"WITH {BARS} " + CLIP.format("bars"))
def clipped(spark, d):
    return out(B.clip_zscore(bars(spark, d), min_rows=60), "close")


@query("cleaned_bars", f"WITH {BARS}, {BROKEN}, ok AS (SELECT * FROM broken WHERE high >= greatest(open, close, low) AND low <= least(open, close)) " + CLIP.format("ok"))
def cleaned(spark, d):
    return out(B.clean(broken(spark, d).withColumn("ingest_id", F.lit(0))), "close")


# --- indicators

W = "OVER (PARTITION BY symbol ORDER BY ts ROWS {0} PRECEDING)"


def full(expr: str, col: str, n: int) -> str:
    w = W.format(n - 1)
    return f"CASE WHEN count({col}) {w} = {n} THEN {expr} {w} END"


def rsi_sql(src: str, n: int = 14, name: str = "rsi") -> str:
    """Tables ``{name}_d`` and ``{name}_t`` over ``src``: all its columns and the RSI."""
    w = W.format(n - 1)
    return f"""{name}_d AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) AS d_ FROM {src}),
{name}_s AS (SELECT *, sum(greatest(d_, 0)) {w} AS g_, sum(greatest(-d_, 0)) {w} AS l_, count(*) {w} AS n_ FROM {name}_d),
{name}_t AS (SELECT * EXCLUDE (d_, g_, l_, n_), CASE WHEN n_ = {n} AND g_ + l_ > 0 THEN 100 * g_ / (g_ + l_) END AS {name} FROM {name}_s)"""


TR = "tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER v), abs(low - lag(close) OVER v)) AS tr FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY ts))"
ATR = f"{TR}, atr AS (SELECT *, {full('avg(tr)', 'tr', 14)} AS atr FROM tr)"
BB = f"bb AS (SELECT *, {full('avg(close)', 'close', 20)} AS bb_mid, {full('stddev_samp(close)', 'close', 20)} AS sd FROM {{0}})"


@query("rsi_sma", f"WITH {BARS}, {rsi_sql('bars')} SELECT symbol, ts, round(rsi, 6) AS rsi FROM rsi_t")
def rsi(spark, d):
    return out(in_blocks(bars(spark, d), I.with_rsi, 15), "rsi")


@query("atr", f"WITH {BARS}, {ATR} SELECT symbol, ts, round(tr, 6) AS tr, round(atr, 6) AS atr, round(atr / nullif(close, 0), 6) AS atr_pct FROM atr")
def atr(spark, d):
    return out(in_blocks(bars(spark, d), I.with_atr, 15).withColumn("atr_pct", F.try_divide("atr", "close")), "tr", "atr", "atr_pct")


@query("bollinger", f"WITH {BARS}, {BB.format('bars')} SELECT symbol, ts, round(bb_mid, 6) AS bb_mid, round(bb_mid + 2 * sd, 6) AS bb_upper, round(bb_mid - 2 * sd, 6) AS bb_lower, round((close - (bb_mid - 2 * sd)) / nullif((bb_mid + 2 * sd) - (bb_mid - 2 * sd), 0), 6) AS bb_pct FROM bb")
def bollinger(spark, d):
    x = in_blocks(bars(spark, d), lambda b: b.withColumns(I.bollinger()), 19)
    return out(x.withColumn("bb_pct", I.percent_b(F.col("bb_lower"), F.col("bb_upper"))), "bb_mid", "bb_upper", "bb_lower", "bb_pct")


@query("donchian", f"WITH {BARS} SELECT symbol, ts, {full('max(high)', 'high', 20)} AS dc_high, {full('min(low)', 'low', 20)} AS dc_low FROM bars")
def donchian(spark, d):
    return out(in_blocks(bars(spark, d), lambda b: b.withColumns(I.donchian()), 19), "dc_high", "dc_low")


VWAP = "vw AS (SELECT *, sum((high + low + close) / 3 * volume) OVER u / CASE WHEN sum(volume) OVER u = 0 THEN 1 ELSE sum(volume) OVER u END AS vwap, " + full("avg(volume)", "volume", 20) + " AS vol_ma FROM {0} WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))"


@query("vwap_and_volume", f"WITH {BARS}, {VWAP.format('bars')} SELECT symbol, ts, round(vwap, 6) AS vwap, round(vol_ma, 6) AS vol_ma, coalesce(volume > 1.5 * vol_ma, false) AS surge FROM vw")
def vwap(spark, d):
    x = in_blocks(I.with_vwap(numbered(bars(spark, d))), lambda b: b.withColumn("vol_ma", I.mean(F.col("volume"), 20)), 19)
    return out(x.withColumn("surge", F.coalesce(F.col("volume") > 1.5 * F.col("vol_ma"), F.lit(False))), "vwap", "vol_ma", "surge")


RET = "ret AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM {0})"


@query("returns_and_volatility", f"WITH {DAILY}, {RET.format('daily')} SELECT symbol, ts, round(close / nullif(lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 6) AS roc, round({full('stddev_samp(ret)', 'ret', 20)}, 6) AS vol, round({full('stddev_samp(ret)', 'ret', 20)} * sqrt(252), 6) AS vol_year FROM ret")
def returns(spark, d):
    x = in_blocks(daily(spark, d), lambda b: I.with_returns(b).withColumns({"roc": I.roc(10), "vol": I.volatility(20)}), 20)
    return out(x.withColumn("vol_year", F.col("vol") * F.sqrt(F.lit(252.0))), "roc", "vol", "vol_year")


@query("volume_and_calendar", f"WITH {BARS} SELECT symbol, ts, round((volume - {full('avg(volume)', 'volume', 20)}) / nullif({full('stddev_samp(volume)', 'volume', 20)}, 0), 6) AS vol_z, (isodow(ts) - 1)::INTEGER AS weekday, extract(day FROM ts)::INTEGER AS month_day, month(ts)::INTEGER AS month FROM bars")
def volume_calendar(spark, d):
    return out(in_blocks(bars(spark, d), lambda b: b.withColumn("vol_z", I.volume_zscore()), 19).withColumns({"weekday": F.weekday("ts"), "month_day": F.day("ts"), "month": F.month("ts")}), "vol_z", "weekday", "month_day", "month")


def ewm_sql(src: str, specs: dict[str, tuple[str, float]], name: str = "e") -> str:
    """Table ``name``: ``src`` numbered by symbol, with each recursive mean ``output: (column, alpha)``. Needs WITH RECURSIVE."""
    first = ", ".join(f"{c}::DOUBLE AS {o}" for o, (c, _) in specs.items())
    step = ", ".join(f"CASE WHEN b.{c} IS NULL THEN p.{o} WHEN p.{o} IS NULL THEN b.{c} ELSE {a!r}::DOUBLE * b.{c} + (1 - {a!r}::DOUBLE) * p.{o} END" for o, (c, a) in specs.items())
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM {src}),
{name}_r AS (SELECT symbol AS s_, n AS n_, {first} FROM {name}_n WHERE n = 1 UNION ALL SELECT p.s_, b.n, {step} FROM {name}_r p JOIN {name}_n b ON b.symbol = p.s_ AND b.n = p.n_ + 1),
{name} AS (SELECT {name}_n.*, {', '.join(f'{name}_r.{o}' for o in specs)} FROM {name}_n JOIN {name}_r ON symbol = s_ AND n = n_)"""


@query("ema", f"WITH RECURSIVE {BARS}, {ewm_sql('bars', {'ema9': ('close', 2 / 10), 'ema21': ('close', 2 / 22)})} SELECT symbol, ts, round(ema9, 6) AS ema9, round(ema21, 6) AS ema21, round((ema9 - lag(ema9) OVER (PARTITION BY symbol ORDER BY ts)) / nullif(ema9, 0), 6) AS slope FROM e")
def ema(spark, d):
    x = in_blocks(I.with_ema(numbered(bars(spark, d)), 9, 21), lambda b: b.withColumn("slope", F.try_divide(F.col("ema9") - F.lag("ema9").over(I.ordered()), F.col("ema9"))), 1)
    return out(x, "ema9", "ema21", "slope")


@query("ema_adjusted", f"WITH RECURSIVE {BARS}, one AS (SELECT *, close AS w1, 1.0::DOUBLE AS w0 FROM bars), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM one), r AS (SELECT symbol AS s_, n AS n_, close AS a, 1.0::DOUBLE AS b FROM n WHERE n = 1 UNION ALL SELECT s_, n.n, n.close + {1 - 2 / 13!r}::DOUBLE * a, 1 + {1 - 2 / 13!r}::DOUBLE * b FROM r JOIN n ON n.symbol = s_ AND n.n = n_ + 1) SELECT symbol, ts, round(a / b, 6) AS ema_adjusted FROM n JOIN r ON symbol = s_ AND n = n_")
def ema_adjusted(spark, d):
    return out(I.with_ema_adjusted(bars(spark, d), 12), "ema_adjusted")


@query("wilder_atr", f"WITH RECURSIVE {BARS}, {TR}, {ewm_sql('tr', {'atr': ('tr', 1 / 20)})} SELECT symbol, ts, CASE WHEN n >= 20 THEN round(atr, 6) END AS atr FROM e")
def wilder_atr(spark, d):
    return out(I.with_wilder(in_blocks(numbered(bars(spark, d)), I.with_true_range, 1), "tr", 20, "atr"), "atr")


@query("rsi_wilder", f"WITH RECURSIVE {BARS}, d AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) AS d FROM bars), ud AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM d), {ewm_sql('ud', {'g': ('up', 1 / 14), 'l': ('down', 1 / 14)})} SELECT symbol, ts, CASE WHEN n >= 14 AND g + l > 0 THEN round(100 * g / (g + l), 6) END AS rsi_wilder FROM e")
def rsi_wilder(spark, d):
    return out(I.with_rsi_wilder(bars(spark, d)), "rsi_wilder")


MACD = f"{ewm_sql('{0}', {'ema12': ('close', 2 / 13), 'ema26': ('close', 2 / 27)}, 'm1')}, m2 AS (SELECT * EXCLUDE (n), ema12 - ema26 AS macd FROM m1), {ewm_sql('m2', {'macd_signal': ('macd', 2 / 10)}, 'm3')}"


@query("macd", f"WITH RECURSIVE {BARS}, {MACD.replace('{0}', 'bars')} SELECT symbol, ts, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd - macd_signal, 6) AS macd_hist FROM m3")
def macd(spark, d):
    return out(I.with_macd(bars(spark, d)), "macd", "macd_signal", "macd_hist")


# --- strategies


def up(a: str, b: str) -> str:
    v = "OVER (PARTITION BY symbol ORDER BY ts)"
    return f"coalesce(round({a}, 9) > round({b}, 9) AND lag(round({a}, 9)) {v} <= lag(round({b}, 9)) {v}, false)"


def signal_sql(entry: str, leave: str, src: str) -> str:
    return f"SELECT symbol, ts, (CASE WHEN coalesce({leave}, false) THEN -1 WHEN coalesce({entry}, false) THEN 1 ELSE 0 END)::INTEGER AS signal FROM {src}"


EMA_X = f"{ewm_sql('bars', {'ema9': ('close', 2 / 10), 'ema21': ('close', 2 / 22)})}, {rsi_sql('e')}"
EMA_SIGNAL = signal_sql(f"{up('ema9', 'ema21')} AND rsi < 70", f"{up('ema21', 'ema9')} OR round(rsi, 9) > 75", "rsi_t")
STRATEGY_SQL = {
    "ema_cross_rsi": f"WITH RECURSIVE {BARS}, {EMA_X} {EMA_SIGNAL}",
    "mean_reversion_rsi": f"WITH RECURSIVE {BARS}, {rsi_sql('bars')}, {ewm_sql('rsi_t', {'rsi_s': ('rsi', 2 / 4)})}, f AS (SELECT *, volume > {full('avg(volume)', 'volume', 20)} AS busy FROM e) " + signal_sql(f"{up('rsi_s', '30')} AND busy", f"{up('70', 'rsi_s')} AND busy", "f"),
    "rsi2": f"WITH {BARS}, {rsi_sql('bars', 2)}, {BB.format('rsi_t')} " + signal_sql("round(rsi, 9) < 10 AND round(close - (bb_mid - 2 * sd) * 1.01, 9) <= 0", "round(rsi, 9) > 50", "bb"),
    "bollinger_reversion": f"WITH {BARS}, {rsi_sql('bars')}, {BB.format('rsi_t')} " + signal_sql("round(close - bb_mid, 9) <= 0 AND round(rsi, 9) < 20", "round(rsi, 9) > 80 OR round(close - bb_mid * 0.99, 9) >= 0", "bb"),
    "vwap_breakout": f"WITH {BARS}, {VWAP.format('bars')} " + signal_sql(f"{up('close', 'vwap')} AND volume > vol_ma * 1.5", "round(close - vwap, 9) < 0 AND volume < vol_ma * 0.8", "vw"),
    "momentum_scanner": f"WITH RECURSIVE {BARS}, {MACD.replace('{0}', 'bars')}, m4 AS (SELECT * EXCLUDE (n) FROM m3), {ewm_sql('m4', {'ema50': ('close', 2 / 51)})}, f AS (SELECT *, {full('avg(volume)', 'volume', 20)} AS vol_ma FROM e) " + signal_sql(f"{up('macd', 'macd_signal')} AND volume > vol_ma * 1.2 AND round(close - ema50, 9) > 0", up("macd_signal", "macd"), "f"),
    "turtle_breakout": f"WITH RECURSIVE {BARS}, {TR}, {ewm_sql('tr', {'w': ('tr', 1 / 20)})}, f AS (SELECT *, CASE WHEN n >= 20 THEN w END AS a, {full('max(high)', 'high', 20)} AS hi, {full('min(low)', 'low', 10)} AS lo FROM e), g AS (SELECT *, coalesce(last_value(nullif(a, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), a) AS atr FROM f) " + signal_sql("close > lag(hi) OVER (PARTITION BY symbol ORDER BY ts) AND round(atr / nullif(close, 0), 9) < 0.10", "close < lo", "g"),
}
for _name, _sql in STRATEGY_SQL.items():
    query(f"strategy_{_name}", _sql)(lambda spark, d, n=_name: S.STRATEGIES[n](bars(spark, d)).select("symbol", "ts", "signal"))

SIG = f"sig AS (SELECT symbol, ts, open, close, (CASE WHEN volume % 5 = 0 THEN 1 WHEN volume % 7 = 0 THEN -1 ELSE 0 END)::INTEGER AS signal FROM bars)"


def simple_signals(spark, d):
    v = F.col("volume")
    return bars(spark, d).withColumn("signal", F.when(v % 5 == 0, 1).when(v % 7 == 0, -1).otherwise(0).cast("int")).select("symbol", "ts", "open", "close", "signal")


@query("user_strategy", f"WITH {BARS} SELECT symbol, ts, (CASE WHEN close > open THEN 1 ELSE -1 END)::INTEGER AS signal FROM bars")
def user_strategy(spark, d):
    import numpy as np
    import pandas as pd

    S.register("up_bar", lambda f: pd.Series(np.where(f.close > f.open, 1, -1)), look_back=0)
    return S.STRATEGIES["up_bar"](bars(spark, d)).select("symbol", "ts", "signal")


@query("sentiment_filtered_signals", f"WITH {BARS}, {SIG} SELECT symbol, ts, (CASE WHEN signal = 1 AND symbol IN ('click', 'error') THEN 0 ELSE signal END)::INTEGER AS signal FROM sig")
def sentiment_filtered(spark, d):
    scores = spark.createDataFrame([("click", -0.5), ("error", -0.2), ("view", 0.3)], "symbol string, net double")
    return S.sentiment_filter(simple_signals(spark, d), scores).select("symbol", "ts", "signal")


@query("sector_biased_signals", f"WITH {BARS}, {SIG} SELECT symbol, ts, (CASE WHEN signal = 1 AND symbol = 'click' THEN 0 ELSE signal END)::INTEGER AS signal FROM sig")
def sector_biased(spark, d):
    return S.bias_filter(simple_signals(spark, d), spark.createDataFrame([("click", -0.3), ("view", 0.5)], "symbol string, bias double")).select("symbol", "ts", "signal")


P = "p AS (SELECT *, CASE WHEN volume % 11 = 0 THEN NULL ELSE (volume % 10) / 10.0::DOUBLE END AS p FROM bars)"


def with_probability(spark, d):
    return bars(spark, d).withColumn("p", F.when(F.col("volume") % 11 != 0, (F.col("volume") % 10) / 10.0))


@query("probability_signals", f"WITH {BARS}, {P} SELECT symbol, ts, (CASE WHEN p >= 0.55 THEN 1 WHEN p <= 0.45 THEN -1 ELSE 0 END)::INTEGER AS signal FROM p")
def probability_signals(spark, d):
    return S.probability_signal(with_probability(spark, d)).select("symbol", "ts", "signal")


@query("probability_veto", f"WITH {BARS}, {P} SELECT symbol, ts, (CASE WHEN volume % 5 = 0 AND NOT coalesce(p < 0.55, false) THEN 1 ELSE 0 END)::INTEGER AS signal FROM p")
def probability_veto(spark, d):
    x = with_probability(spark, d).withColumn("signal", (F.col("volume") % 5 == 0).cast("int"))
    return S.probability_veto(x).select("symbol", "ts", "signal")


@query("signal_audit", f"WITH {BARS}, {SIG} SELECT symbol, count(*) FILTER (signal = 1) AS longs, count(*) FILTER (signal = -1) AS exits, count(*) FILTER (signal = 0) AS flat, true AS valid, count(*) FILTER (signal = 1) > 0 AS has_entries FROM sig GROUP BY symbol")
def signal_audit(spark, d):
    return S.audit(simple_signals(spark, d), "symbol")


@query("latest_signals", f"WITH {BARS}, {SIG} SELECT symbol, max(ts) AS ts, arg_max(signal, ts) AS signal FROM sig GROUP BY symbol")
def latest_signals(spark, d):
    return S.latest_signal(simple_signals(spark, d))


@query("allowed_symbols", f"WITH {BARS} SELECT symbol, count(*) AS n FROM bars WHERE symbol IN ('click', 'view') GROUP BY symbol")
def allowed_symbols(spark, d):
    one = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    return S.allowed(bars(spark, d), one(" Click", "VIEW", "error"), one("error ")).groupBy("symbol").agg(F.count("*").alias("n"))


# --- back-tests

POS = "pos AS (SELECT *, (CASE WHEN last_value(nullif(signal, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 THEN 1 ELSE 0 END)::INTEGER AS position FROM {0})"


@query("positions", f"WITH {BARS}, {SIG}, {POS.format('sig')} SELECT symbol, ts, position FROM pos")
def positions(spark, d):
    return M.with_position(simple_signals(spark, d)).select("symbol", "ts", "position")


TRD = """tr0 AS (SELECT *, position = 1 AND coalesce(lag(position) OVER v, 0) = 0 AS st, lead(open) OVER v AS f, lead(ts) OVER v AS fts, lead(open, 1) OVER v AS xo FROM pos WINDOW v AS (PARTITION BY symbol ORDER BY ts)),
tr1 AS (SELECT *, sum(st::INTEGER) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS trade_id, lead(f) OVER (PARTITION BY symbol ORDER BY ts) AS nf, lead(fts) OVER (PARTITION BY symbol ORDER BY ts) AS nts FROM tr0),
tr2 AS (SELECT symbol, trade_id, arg_min(fts, ts) AS entry_ts, first(f ORDER BY ts) AS entry_price, last(nts ORDER BY ts) AS exit_ts, last(nf ORDER BY ts) AS exit_price, count(*) AS bars FROM tr1 WHERE position = 1 GROUP BY symbol, trade_id),
trd AS (SELECT * FROM tr2 WHERE entry_price IS NOT NULL)"""


@query("trades_next_open", f"WITH {BARS}, {SIG}, {POS.format('sig')}, {TRD} SELECT * FROM trd")
def trades_next_open(spark, d):
    return M.trades(M.with_position(simple_signals(spark, d)))


@query("trade_stats", f"""WITH {BARS}, {SIG}, {POS.format('sig')}, {TRD}, r AS (SELECT *, exit_price / entry_price - 1 AS r FROM trd WHERE exit_price IS NOT NULL)
SELECT symbol, count(*) AS trades, round(avg((r > 0)::INTEGER), 6) AS win_rate, round(CASE WHEN sum(-r) FILTER (r < 0) > 0 THEN coalesce(sum(r) FILTER (r > 0), 0) / sum(-r) FILTER (r < 0) END, 6) AS profit_factor, round(max(r), 6) AS best, round(min(r), 6) AS worst, round(avg(bars), 6) AS avg_bars FROM r GROUP BY symbol""")
def trade_stats(spark, d):
    s = M.trade_stats(M.trades(M.with_position(simple_signals(spark, d))), "symbol")
    return s.select("symbol", "trades", *[F.round(c, 6).alias(c) for c in ("win_rate", "profit_factor", "best", "worst", "avg_bars")])


SRET = """sr0 AS (SELECT *, coalesce(lag({1}) OVER v, 0) AS held, coalesce(close / nullif(lag(close) OVER v, 0) - 1, 0) AS br FROM {0} WINDOW v AS (PARTITION BY symbol ORDER BY ts)),
sr1 AS (SELECT *, held * br - CASE WHEN held <> 0 AND held <> coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), 0) THEN 0.0005 ELSE 0 END AS ret FROM sr0),
sr2 AS (SELECT *, exp(sum(ln(1 + greatest(ret, -0.999999::DOUBLE))) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM sr1),
sr3 AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM sr2)"""


@query("signal_returns", f"WITH {DAILY}, sig AS (SELECT symbol, ts, close, (CASE WHEN volume::BIGINT % 5 = 0 THEN 1 WHEN volume::BIGINT % 7 = 0 THEN -1 ELSE 0 END)::INTEGER AS signal FROM daily), {SRET.format('sig', 'signal')} SELECT symbol, ts, round(ret, 6) + 0.0::DOUBLE AS ret FROM sr1")
def signal_returns(spark, d):
    v = F.col("volume").cast("long")
    x = daily(spark, d).withColumn("signal", F.when(v % 5 == 0, 1).when(v % 7 == 0, -1).otherwise(0).cast("int"))
    return M.signal_returns(x).select("symbol", "ts", (F.round("ret", 6) + F.lit(0.0)).alias("ret"))


BT = """SELECT symbol, count(*) AS bars, round(arg_max(equity, ts) - 1, 6) AS total_return, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS buy_hold,
round(coalesce(CASE WHEN max(ret) > min(ret) THEN avg(ret) / stddev_samp(ret) * sqrt(252) END, 0), 6) AS sharpe, round(coalesce(CASE WHEN stddev_samp(ret) FILTER (ret < 0) > 0 THEN avg(ret) / (stddev_samp(ret) FILTER (ret < 0)) * sqrt(252) END, 0), 6) AS sortino,
round(min(dd), 6) AS max_drawdown, (count(*) FILTER (position = 1 AND held = 0))::BIGINT AS entries, round(avg(held), 6) AS exposure FROM sr3 GROUP BY symbol"""


def rounded(df, keys=("symbol",), digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


@query("ema_cross_backtest", f"WITH RECURSIVE {BARS}, {EMA_X}, es AS ({EMA_SIGNAL.replace('symbol, ts, (', 'symbol, ts, close, (')}), {POS.format('es')}, {SRET.format('pos', 'position')} {BT}")
def ema_cross_backtest(spark, d):
    return rounded(M.comparison(bars(spark, d), {"ema_cross_rsi": S.STRATEGIES["ema_cross_rsi"]}).drop("strategy"))


COMPARED = ("rsi2", "bollinger_reversion", "vwap_breakout")


@query("strategy_comparison", "WITH " + ", ".join([BARS] + [f"s_{n} AS ({STRATEGY_SQL[n].replace('SELECT symbol, ts, (', 'SELECT symbol, ts, close, (')}), b_{n} AS (WITH {POS.format(f's_{n}')}, {SRET.format('pos', 'position')} {BT})" for n in COMPARED]) + " " + " UNION ALL ".join(f"SELECT '{n}' || '::' || symbol AS key, * EXCLUDE (symbol) FROM b_{n}" for n in COMPARED))
def strategy_comparison(spark, d):
    x = M.comparison(bars(spark, d), {n: S.STRATEGIES[n] for n in COMPARED})
    return rounded(x.withColumn("key", F.concat_ws("::", "strategy", "symbol")).drop("symbol", "strategy"), ("key",))


@query("drawdown_and_growth", f"WITH {DAILY}, e AS (SELECT symbol, ts, close AS equity, close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM daily), g AS (SELECT symbol, min(dd) AS max_drawdown, pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0::DOUBLE / count(*)) - 1 AS cagr FROM e GROUP BY symbol) SELECT symbol, round(max_drawdown, 6) AS max_drawdown, round(cagr, 6) AS cagr, round(CASE WHEN abs(max_drawdown) < 0.01 THEN 0 ELSE cagr / abs(max_drawdown) END, 6) AS calmar FROM g")
def drawdown_growth(spark, d):
    x = M.with_drawdown(daily(spark, d).select("symbol", "ts", F.col("close").alias("equity")), "symbol")
    g = x.groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"), M.cagr(order="ts").alias("cagr"))
    return rounded(g.withColumn("calmar", M.calmar(F.col("cagr"), F.col("max_drawdown"))))
