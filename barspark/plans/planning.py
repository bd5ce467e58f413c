"""Costs, trials, features, sizes, stops and reports over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import settled
from ..functions.windows import in_blocks
from ..operators import allocate as A
from ..operators import combine as C
from ..operators import costs as K
from ..operators import indicators as I
from ..operators import journal as J
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import risk as R
from ..operators import search as S
from ..operators import strategies as T
from ..sources import io
from .decisions import ENTRIES, UPS, _sectors
from .inputs import BARS, DAILY, EQUITY, POSTS, TRADES, bars, cash_flow, curve, daily, equity, posts, trades
from .market import ATR, BB, BT, MACD, POS, RET, SIG, SRET, STRATEGY_SQL, TRD, ewm_sql, full, out, rounded, rsi_sql, simple_signals, up
from .registry import ORACLES, query

_TABLES, _LAST = ORACLES["regimes"].removeprefix("WITH ").rsplit("\nSELECT symbol, round(m60", 1)
REGIMES_SQL = f"{_TABLES}, regs AS (SELECT symbol, round(m60{_LAST})"

# --- costs

COSTED = f"{ENTRIES}, tq AS (SELECT t.*, 100 + 10 * t.trade_id % 7 AS qty, b.volume FROM trd t LEFT JOIN bars b ON t.symbol = b.symbol AND t.entry_ts = b.ts WHERE exit_price IS NOT NULL)"


def _costed(spark, d):
    b = bars(spark, d)
    t = M.trades(M.with_position(simple_signals(spark, d))).where("exit_price is not null").withColumn("qty", 100 + 10 * F.col("trade_id") % 7)
    return t.join(b.select("symbol", F.col("ts").alias("entry_ts"), "volume"), ["symbol", "entry_ts"], "left"), b


@query("trade_costs", f"""WITH {COSTED}, m AS (SELECT symbol, avg(volume) AS mv FROM bars GROUP BY symbol), k AS (SELECT *, (exit_price - entry_price) * qty AS gross, greatest(0.005 * qty * entry_price, 1) + greatest(0.005 * qty * exit_price, 1) AS commission,
  (0.001 + 0.0005 * CASE WHEN mv > 0 THEN coalesce(volume, 0) / mv ELSE 1 END) * qty * (entry_price + exit_price) / 2 AS slippage, (entry_price + exit_price) * 0.001 * qty AS spread FROM tq JOIN m USING (symbol))
SELECT symbol, trade_id, round(gross, 8) AS gross, round(commission, 8) AS commission, round(slippage, 8) AS slippage, round(spread, 8) AS spread, round(gross - commission - slippage - spread, 8) AS net FROM k""")
def trade_costs(spark, d):
    x = K.trade_costs(*_costed(spark, d)).select("symbol", "trade_id", "gross", "commission", "slippage", "spread", "net")
    return rounded(x, ("symbol", "trade_id"), 8)


@query("cost_report", f"""WITH {COSTED}, m AS (SELECT symbol, avg(volume) AS mv FROM bars GROUP BY symbol), k AS (SELECT symbol, (exit_price - entry_price) * qty AS gross, greatest(0.005 * qty * entry_price, 1) + greatest(0.005 * qty * exit_price, 1) AS commission,
  (0.001 + 0.0005 * CASE WHEN mv > 0 THEN coalesce(volume, 0) / mv ELSE 1 END) * qty * (entry_price + exit_price) / 2 AS slippage, (entry_price + exit_price) * 0.001 * qty AS spread FROM tq JOIN m USING (symbol)),
g AS (SELECT symbol, count(*) AS trades, sum(gross) AS gross, sum(gross - commission - slippage - spread) AS net, sum(commission) AS commission, sum(slippage) AS slippage FROM k GROUP BY symbol)
SELECT symbol, trades, round(gross, 7) AS gross, round(net, 7) AS net, round(commission, 7) AS commission, round(slippage, 7) AS slippage, round(gross / 100000, 7) AS gross_return, round(net / 100000, 7) AS net_return, round(coalesce(commission / nullif(gross, 0), 0), 7) AS cost_ratio FROM g""")
def cost_report(spark, d):
    return rounded(K.cost_report(K.trade_costs(*_costed(spark, d))), digits=7)


@query("range_costs", f"""WITH {COSTED}, j AS (SELECT t.symbol, t.trade_id, t.qty, CASE WHEN t.trade_id % 3 = 0 THEN 'short' ELSE 'long' END AS side, e.high AS eh, e.low AS el, e.close + greatest(e.high - e.low, 0) * 0.75::DOUBLE AS a, x.high AS xh, x.low AS xl, x.close - greatest(x.high - x.low, 0) * 0.75::DOUBLE AS b
  FROM tq t JOIN bars e ON t.symbol = e.symbol AND t.entry_ts = e.ts JOIN bars x ON t.symbol = x.symbol AND t.exit_ts = x.ts),
k AS (SELECT *, qty * CASE WHEN side = 'long' THEN b - a ELSE a - b END AS gross, 0.001::DOUBLE * (a + b) * qty AS commission, abs(eh - a + b - xl) * qty AS slippage, (eh - el + xh - xl) * 0.5::DOUBLE * qty AS spread FROM j)
SELECT symbol, trade_id, round(a, 8) AS entry_effective, round(b, 8) AS exit_effective, round(gross, 8) AS gross, round(commission, 8) AS commission, round(slippage, 8) AS slippage, round(spread, 8) AS spread, round(commission + slippage + spread, 8) AS total, round(gross - (commission + slippage + spread), 8) AS net FROM k""")
def range_costs(spark, d):
    t, b = _costed(spark, d)
    x = K.range_costs(t.withColumn("side", F.when(F.col("trade_id") % 3 == 0, "short").otherwise("long")), b)
    return rounded(x.select("symbol", "trade_id", "entry_effective", "exit_effective", "gross", "commission", "slippage", "spread", "total", "net"), ("symbol", "trade_id"), 8)


# --- comparison and trials


FIGURES = ("bars", "total_return", "buy_hold", "sharpe", "sortino", "max_drawdown", "entries", "exposure")


@query("head_to_head", f"WITH {BARS}, a0 AS ({STRATEGY_SQL['rsi2'].replace('SELECT symbol, ts, (', 'SELECT symbol, ts, close, (').replace(f'WITH {BARS},', 'WITH')}), b0 AS ({STRATEGY_SQL['vwap_breakout'].replace('SELECT symbol, ts, (', 'SELECT symbol, ts, close, (').replace(f'WITH {BARS},', 'WITH')}), "
       + ", ".join(f"{x} AS (WITH {POS.format(x + '0')}, {SRET.format('pos', 'position')} {BT})" for x in "ab")
       + " SELECT symbol, " + ", ".join(f"a.{c} AS {c}_a, b.{c} AS {c}_b, round(a.{c} - b.{c}, 6) AS {c}_diff" for c in FIGURES) + " FROM a FULL JOIN b USING (symbol)")
def head_to_head(spark, d):
    b = bars(spark, d)
    a, b = (rounded(M.backtest(T.STRATEGIES[s](b))) for s in ("rsi2", "vwap_breakout"))
    return rounded(M.head_to_head(a, b))


TRIALS = ((0, "1992-01-01", "1995-01-01", "1996-01-01"), (1, "1992-01-01", "1996-01-01", "1997-01-01"), (2, "1992-01-01", "1997-01-01", "1998-01-01"))
SERIES = f"""{DAILY.replace('daily AS', 'daily0 AS')}, tri(trial, s, c, e) AS (VALUES {', '.join(f"({i}, DATE '{s}', DATE '{c}', DATE '{e}')" for i, s, c, e in TRIALS)}),
bars AS (SELECT symbol || '|' || trial || '|' || CASE WHEN ts::DATE < c THEN 'train' ELSE 'test' END AS symbol, ts, open, high, low, close, volume FROM daily0, tri WHERE ts::DATE >= s AND ts::DATE < e),
sg AS (WITH {rsi_sql('bars', 2)}, {BB.format('rsi_t')} SELECT symbol, ts, open, close, (CASE WHEN coalesce(round(rsi, 9) > 50, false) THEN -1 WHEN coalesce(round(rsi, 9) < 10 AND round(close - (bb_mid - 2 * sd) * 1.01, 9) <= 0, false) THEN 1 ELSE 0 END)::INTEGER AS signal FROM bb),
{POS.format('sg')}, {TRD}, w AS (SELECT symbol, count(*) AS trades, 100 * avg((exit_price > entry_price)::INTEGER) AS win_rate FROM trd WHERE exit_price IS NOT NULL GROUP BY symbol), {SRET.format('pos', 'position')},
bt AS ({BT.replace(', 6)', ', 15)')}), oos AS (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2)::INTEGER AS trial, split_part(symbol, '|', 3) AS role, bars, 100 * total_return AS total_return, sharpe, sortino, 100 * max_drawdown AS max_drawdown, coalesce(trades, 0) AS trades, coalesce(win_rate, 0) AS win_rate FROM bt LEFT JOIN w USING (symbol))"""
REASONS = {"sharpe": "b.sharpe < 0.5", "return": "b.total_return < 0", "drawdown": "b.max_drawdown < -25", "win_rate": "b.win_rate < 35", "retention": "a.sharpe > 0 AND b.sharpe / a.sharpe < 0.5", "spread": "abs(a.total_return - b.total_return) > 100"}
JUDGED = f"jd AS (SELECT a.symbol, a.trial, list_filter([{', '.join(f'CASE WHEN {c} THEN {n!r} END' for n, c in REASONS.items())}], lambda x: x IS NOT NULL) AS reasons, " + ", ".join(f"{t}.{c} AS {r}_{c}" for t, r in (("a", "train"), ("b", "test")) for c in ("sharpe", "sortino", "max_drawdown", "win_rate", "total_return", "trades")) + " FROM oos a JOIN oos b ON a.symbol = b.symbol AND a.trial = b.trial AND a.role = 'train' AND b.role = 'test')"


def _oos(spark, d):
    t = spark.createDataFrame(TRIALS, "trial int, train_start string, cutoff string, test_end string").select("trial", *[F.col(c).cast("date").alias(c) for c in ("train_start", "cutoff", "test_end")])
    return M.oos_backtest(daily(spark, d), t, T.STRATEGIES["rsi2"])


@query("oos_backtest", f"WITH {SERIES} SELECT symbol, trial, role, bars, round(total_return, 4) AS total_return, round(sharpe, 4) AS sharpe, round(sortino, 4) AS sortino, round(max_drawdown, 4) AS max_drawdown, trades, round(win_rate, 4) AS win_rate FROM oos")
def oos_backtest(spark, d):
    return rounded(_oos(spark, d), ("symbol", "trial", "role"), 4)


@query("oos_trials", f"WITH {SERIES}, {JUDGED} SELECT symbol, trial, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM jd")
def oos_trials(spark, d):
    return M.oos_trials(_oos(spark, d)).select("symbol", "trial", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("oos_report", f"""WITH {SERIES}, {JUDGED}, u AS (SELECT symbol, string_agg(DISTINCT r, ',' ORDER BY r) AS reasons FROM (SELECT symbol, unnest(reasons) AS r FROM jd) GROUP BY symbol),
g AS (SELECT symbol, avg(train_sharpe) AS a, avg(test_sharpe) AS b, stddev_pop(test_sharpe) AS sd, avg(test_trades) AS t, count(*) FILTER (len(reasons) = 0) AS passed, count(*) FILTER (len(reasons) > 0) AS failed FROM jd GROUP BY symbol)
SELECT symbol, round(a, 4) AS train_sharpe_mean, round(b, 4) AS test_sharpe_mean, round(sd, 4) AS test_sharpe_std, round(t, 4) AS test_trades_mean, passed, failed, coalesce(reasons, '') AS reasons, round(CASE WHEN a > 0 THEN b / a ELSE 0 END, 4) AS retention FROM g LEFT JOIN u USING (symbol)""")
def oos_report(spark, d):
    x = M.oos_report(M.oos_trials(_oos(spark, d)))
    return rounded(x.select("symbol", "train_sharpe_mean", "test_sharpe_mean", "test_sharpe_std", "test_trades_mean", "passed", "failed", F.array_join("reasons", ",").alias("reasons"), "retention"), digits=4)


@query("enhanced_scores", f"WITH {DAILY}, {RET.format('daily')}, g AS (SELECT symbol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sh, avg(ret) / (stddev_samp(ret) FILTER (ret < 0)) * sqrt(252) AS so, min(ret) AS dd FROM ret GROUP BY symbol) SELECT symbol, round(greatest(10 * coalesce(sh, 0) + 5 * coalesce(so, 0) - 20 * abs(coalesce(dd, 0)), 0), 4) AS score FROM g")
def enhanced_scores(spark, d):
    r = F.col("ret")
    x = in_blocks(daily(spark, d), I.with_returns, 1).groupBy("symbol").agg(M.sharpe(r).alias("sh"), M.sortino(r).alias("so"), F.min(r).alias("dd"))
    return x.select("symbol", S.enhanced_score(F.col("sh"), F.col("so"), F.col("dd")).alias("score"))


PARAMS = {"fast": [5, 9], "slow": [21, 30], "entry_max": [60.0, 70.0]}
SEARCH = f"""{DAILY.replace('daily AS', 'daily0 AS')}, fo AS (SELECT row_number() OVER (ORDER BY s) - 1 AS fold, s::DATE AS a, (s + INTERVAL 360 DAY)::DATE AS c, (s + INTERVAL 480 DAY)::DATE AS e FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01', INTERVAL 120 DAY) g(s) WHERE s + INTERVAL 480 DAY <= TIMESTAMP '1998-01-01'),
bars AS (SELECT symbol || '|' || fold || '|' || CASE WHEN ts::DATE < c THEN 'train' ELSE 'test' END AS symbol, ts, open, high, low, close, volume FROM daily0, fo WHERE ts::DATE >= a AND ts::DATE < e),
{ewm_sql('bars', {f'e{n}': ('close', 2 / (n + 1)) for n in (5, 9, 21, 30)})}, {rsi_sql('e')},
pr(params_id, fast, slow, cap) AS (VALUES {', '.join(f"({4 * i + 2 * j + k}, {f}, {w}, {c}::DOUBLE)" for i, f in enumerate((5, 9)) for j, w in enumerate((21, 30)) for k, c in enumerate((60, 70)))}),
px AS (SELECT symbol || '|' || params_id AS symbol, ts, open, close, rsi, cap, CASE fast WHEN 5 THEN e5 ELSE e9 END AS f, CASE slow WHEN 21 THEN e21 ELSE e30 END AS s FROM rsi_t, pr),
sg AS (SELECT symbol, ts, open, close, (CASE WHEN {up('s', 'f')} OR coalesce(round(rsi, 9) > 75, false) THEN -1 WHEN {up('f', 's')} AND coalesce(rsi < cap, false) THEN 1 ELSE 0 END)::INTEGER AS signal FROM px),
{POS.format('sg')}, {SRET.format('pos', 'position')}, bt AS ({BT.replace(', 6)', ', 15)')}),
sco AS (SELECT split_part(symbol, '|', 2)::INTEGER AS fold, split_part(symbol, '|', 3) AS role, split_part(symbol, '|', 4)::INTEGER AS params_id, round(10 * sharpe + 50 * total_return - 20 * least(abs(max_drawdown), 0.5), 4) AS score FROM bt),
res AS (SELECT params_id, fold, role, round(avg(score), 3) AS score, count(*) AS symbols FROM sco GROUP BY 1, 2, 3)"""
BEST = "bst AS (SELECT fold, params_id, score AS train_score FROM res WHERE role = 'train' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC, params_id) = 1)"


_RESULTS: dict = {}


def _search(spark, d):
    """The search's written result, one for the three reports of a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RESULTS:
        _RESULTS.clear()
        _RESULTS[key] = _searched(spark, d)
    return _RESULTS[key]


def _searched(spark, d):
    return S.walk_forward_search(daily(spark, d), S.windows(spark, "1996-01-01", "1998-01-01", 360, 120), S.grid(spark, PARAMS))


@query("walk_forward_search", f"WITH RECURSIVE {SEARCH} SELECT * FROM res")
def walk_forward_search(spark, d):
    return _search(spark, d)


@query("best_parameters", f"WITH RECURSIVE {SEARCH}, {BEST} SELECT fold, params_id, train_score, t.score AS test_score FROM bst LEFT JOIN (SELECT * FROM res WHERE role = 'test') t USING (fold, params_id)")
def best_parameters(spark, d):
    return S.best_per_fold(_search(spark, d))


@query("top_parameters", f"WITH RECURSIVE {SEARCH} SELECT params_id, round(avg(score) + 1e-9, 2) AS score FROM res WHERE role = 'test' GROUP BY params_id ORDER BY score DESC, params_id LIMIT 10")
def top_parameters(spark, d):
    return S.top(_search(spark, d))


@query("parameter_grid", "WITH g AS (SELECT c_custkey, (c_custkey % 5) / 4.0::DOUBLE AS hi FROM customer), f(i, fast) AS (VALUES (0, 5), (1, 9)), s(j, step) AS (VALUES (0, 0.1), (1, 0.3), (2, 0.5)) SELECT (3 * i + j)::INTEGER AS params_id, fast, step::DOUBLE AS step, c_custkey FROM f, s, g WHERE hi >= step")
def parameter_grid(spark, d):
    g = S.grid(spark, {"fast": [5, 9], "step": S.stepped(0.1, 0.5, 3)})
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 5 / 4).alias("hi"))
    return c.join(F.broadcast(g), F.col("hi") >= F.col("step")).select("params_id", "fast", "step", "c_custkey")


# --- timeframes, sectors, regimes

SIGN = "(CASE WHEN volume % 5 = 0 THEN 1 WHEN volume % 7 = 0 THEN -1 ELSE 0 END)::INTEGER AS signal"


@query("fused_signals", f"""WITH {BARS}, {SIG}, d15 AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', ts)::TIMESTAMP AS ts, sum(qty)::BIGINT AS volume FROM ticks GROUP BY 1, 2), s15 AS (SELECT symbol, ts, {SIGN} FROM d15),
x AS (SELECT symbol, ts, coalesce(s15.signal, 0) AS "15m", coalesce(sig.signal, 0) AS "1h" FROM s15 FULL JOIN sig USING (symbol, ts)), t AS (SELECT *, round((0.44 * "15m" + 0.58 * "1h") / 1.02, 9) AS t FROM x)
SELECT symbol, ts, "15m", "1h", sign(t)::INTEGER AS majority, (CASE WHEN t > 0.5 THEN 1 WHEN t < -0.5 THEN -1 ELSE 0 END)::INTEGER AS weighted,
  (CASE WHEN "1h" = 1 AND "15m" = 1 THEN 1 WHEN "1h" = -1 AND "15m" = -1 THEN -1 ELSE 0 END)::INTEGER AS unanimous, (CASE WHEN "1h" = -1 OR "15m" = -1 THEN -1 WHEN "1h" = 1 OR "15m" = 1 THEN 1 ELSE 0 END)::INTEGER AS any_long FROM t""")
def fused_signals(spark, d):
    from .market import bars_15m

    v = F.col("volume")
    short = bars_15m(spark, d).withColumn("signal", F.when(v % 5 == 0, 1).when(v % 7 == 0, -1).otherwise(0).cast("int"))
    return C.fused({"15m": short, "1h": simple_signals(spark, d)})


ETFS = (("BUILDING", "XLRE"), ("AUTOMOBILE", "XLY"), ("MACHINERY", "XLI"), ("HOUSEHOLD", "XLP"))


@query("sector_lookup", f"WITH m(s, sector) AS (VALUES {', '.join(map(str, ETFS))}) SELECT c_custkey, lower(c_mktsegment) AS symbol, sector FROM customer LEFT JOIN m ON upper(c_mktsegment) = s")
def sector_lookup(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.lower("c_mktsegment").alias("symbol"))
    return C.sector_lookup(c, spark.createDataFrame(ETFS, "symbol string, sector string"))


SHARES = {"risk_on": 0.9, "neutral": 0.6, "risk_off": 0.3}
BY_REGIME = tuple((r, *t) for r, f in (("risk_on", 1.5), ("neutral", 1.25), ("risk_off", 0.75)) for t in (("first", f), ("second", 0.5)))


@query("full_rebalance", f"""WITH {REGIMES_SQL}, rg AS (SELECT regime, CASE regime WHEN 'risk_on' THEN 0.9 WHEN 'neutral' THEN 0.6 ELSE 0.3 END::DOUBLE AS share, CASE regime WHEN 'risk_on' THEN 1.5 WHEN 'neutral' THEN 1.25 ELSE 0.75 END::DOUBLE AS t1 FROM regs WHERE symbol = 'Brand#11'),
sc AS (SELECT DISTINCT p_brand AS symbol, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'first' WHEN p_brand LIKE 'Brand#2%' THEN 'second' WHEN p_brand LIKE 'Brand#3%' THEN 'third' ELSE 'other' END AS sector FROM lineitem JOIN part ON l_partkey = p_partkey),
tl AS (SELECT symbol, share, regime, CASE sector WHEN 'first' THEN t1 WHEN 'second' THEN 0.5 ELSE 1.0 END::DOUBLE / sqrt(count(*) OVER (PARTITION BY sector)) AS s FROM sc, rg), gl AS (SELECT symbol, regime, share * round(s / sum(s) OVER (), 8) AS w FROM tl),
dr AS (SELECT symbol, regime, round(w - CASE WHEN symbol IN ('Brand#11', 'Brand#45') THEN 0.1 ELSE 0.0 END::DOUBLE, 9) AS drift FROM gl)
SELECT symbol, regime, round(drift, 6) AS drift, (CASE WHEN drift > 0.02 THEN 1 WHEN drift < -0.02 THEN -1 ELSE 0 END)::INTEGER AS signal FROM dr""")
def full_rebalance(spark, d):
    b = daily(spark, d)
    held = b.where("symbol in ('Brand#11', 'Brand#45')").select("symbol").distinct().withColumn("weight", F.lit(0.1))
    tilts = spark.createDataFrame(BY_REGIME, "regime string, sector string, tilt double")
    return rounded(C.full_rebalance(b, "Brand#11", _sectors(spark, d), tilts, SHARES, held, 0.02).select("symbol", "regime", "drift", "signal"), ("symbol", "regime"))


# --- features and labels

FEATS = f"""{MACD.replace('{0}', 'bars')}, m4 AS (SELECT * EXCLUDE (n), macd - macd_signal AS macd_hist FROM m3), {ewm_sql('m4', {'ema50': ('close', 2 / 51)}, 'm5')}, {rsi_sql('m5', 14, 'rsi_14')},
f1 AS (SELECT *, close / nullif(lag(close) OVER v, 0) - 1 AS ret, greatest(high - low, abs(high - lag(close) OVER v), abs(low - lag(close) OVER v)) AS tr, {full('avg(close)', 'close', 20)} AS mid, {full('stddev_samp(close)', 'close', 20)} AS sd,
  (ema50 - lag(ema50) OVER v) / nullif(ema50, 0) AS ema_slope, {', '.join(f'close / nullif(lag(close, {k}) OVER v, 0) - 1 AS ret_{k}' for k in (1, 3, 5, 10))} FROM rsi_14_t WINDOW v AS (PARTITION BY symbol ORDER BY ts)),
f2 AS (SELECT *, (close - (mid - 2 * sd)) / nullif(4 * sd, 0) AS bb_pct, {full('avg(tr)', 'tr', 14)} / nullif(close, 0) AS atr_pct, {full('stddev_samp(ret)', 'ret', 10)} AS vol_10, {full('stddev_samp(ret)', 'ret', 20)} AS vol_20 FROM f1)"""


@query("feature_frame", f"WITH RECURSIVE {BARS}, {FEATS} SELECT symbol, ts, " + ", ".join(f"round({f}, 5) AS {f}" for f in L.FEATURES) + " FROM f2")
def feature_frame(spark, d):
    return out(L.feature_frame(bars(spark, d)), *L.FEATURES, digits=5)


@query("label_shift", f"WITH {BARS}, {UPS}, s AS (SELECT round(coalesce(avg((label = 1)::INTEGER) FILTER (ts < TIMESTAMP '2024-01-20'), 0), 4) AS a, round(coalesce(avg((label = 1)::INTEGER) FILTER (ts >= TIMESTAMP '2024-01-20'), 0), 4) AS b FROM up WHERE label IS NOT NULL) SELECT a AS train_share, b AS test_share, round(1 - abs(a - b), 4) AS stability, round(1 - abs(a - b), 4) < 0.7 AS shifted FROM s")
def label_shift(spark, d):
    x = in_blocks(bars(spark, d), lambda b: L.next_direction(b), 0, 1)
    return L.label_shift(x.withColumn("role", F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), "train").otherwise("test")))


COLS = ("open", "high", "low", "volume")
RANKED = "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in COLS) + " FROM bars), sp AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM rk" for i, a in enumerate(COLS) for b in COLS[i + 1 :]) + ")"


@query("rank_correlations", f"WITH {BARS}, {RANKED} SELECT * FROM sp")
def rank_correlations(spark, d):
    return L.spearman(bars(spark, d), list(COLS))


@query("collinear_groups", f"""WITH RECURSIVE {BARS}, {RANKED}, both_ AS (SELECT a, b, abs(corr) AS c FROM sp UNION ALL SELECT b, a, abs(corr) FROM sp), pl(f, p) AS (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(COLS))}),
re AS (SELECT f AS a, f AS b FROM pl UNION SELECT re.a, both_.b FROM re JOIN both_ ON re.b = both_.a WHERE c > 0.3), gr AS (SELECT re.a AS f, min(p)::INTEGER AS g FROM re JOIN pl ON re.b = pl.f GROUP BY re.a),
m AS (SELECT x.a AS feature, g1.g AS "group", p, avg(c) AS mean FROM both_ x JOIN gr g1 ON x.a = g1.f JOIN gr g2 ON x.b = g2.f JOIN pl ON pl.f = x.a WHERE g1.g = g2.g GROUP BY 1, 2, 3)
SELECT feature, "group", round(mean, 4) AS mean, row_number() OVER (PARTITION BY "group" ORDER BY round(mean, 9), p) = 1 AS kept FROM m""")
def collinear_groups(spark, d):
    return L.collinear_groups(L.spearman(bars(spark, d), list(COLS)), list(COLS), 0.3).withColumn("mean", F.round("mean", 4))


# --- sizes, plans, stops

ODDS = "od AS (SELECT o_orderkey, (o_orderkey % 11) / 10.0::DOUBLE AS p, (o_orderkey % 7)::DOUBLE AS win, (o_orderkey % 5)::DOUBLE AS loss, (o_orderkey % 13) / 10.0::DOUBLE AS conf FROM orders), ok AS (SELECT *, CASE WHEN loss <= 0 THEN least(p, 1) WHEN win = 0 AND p < 1 THEN -1e9 ELSE least(p, 1) - coalesce((1 - least(p, 1)) / nullif(win / loss, 0), 0) END AS kelly FROM od)"


@query("confident_sizes", f"WITH {ODDS} SELECT o_orderkey, round(greatest(0, least(0.25, kelly * 0.5 * least(conf, 1))), 9) + 0.0 AS size FROM ok WHERE win > 0 OR loss <= 0")
def confident_sizes(spark, d):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (k % 11 / 10).alias("p"), (k % 7).cast("double").alias("win"), (k % 5).cast("double").alias("loss"), (k % 13 / 10).alias("conf")).where("win > 0 or loss <= 0")
    return o.select("o_orderkey", (F.round(A.confident_size(F.col("p"), F.col("win"), F.col("loss"), F.col("conf")), 9) + F.lit(0.0)).alias("size"))


LISTED = (("Brand#11", 3.0), ("Brand#12", -1.0), ("Brand#13", 0.5))


@query("listed_weights", f"WITH l(symbol, w) AS (VALUES {', '.join(map(str, LISTED))}), x AS (SELECT symbol, greatest(coalesce(w, 1), 0)::DOUBLE AS w FROM (SELECT DISTINCT p_brand AS symbol FROM part) LEFT JOIN l USING (symbol)) SELECT symbol, round(w / sum(w) OVER (), 9) AS weight FROM x")
def listed_weights(spark, d):
    s = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("symbol")).distinct()
    return A.listed_weights(s, spark.createDataFrame(LISTED, "symbol string, weight double")).withColumn("weight", F.round("weight", 9))


@query("stop_sizes", f"WITH {BARS}, z AS (SELECT symbol, ts, close, abs(close - low) AS gap, CASE WHEN close > 0 AND low > 0 AND abs(close - low) >= 1e-6 THEN greatest(least(floor(100000 * 0.01 / nullif(abs(close - low), 0)), floor(100000 * 0.10 / nullif(close, 0))), 0) ELSE 0 END AS n0 FROM bars), y AS (SELECT *, CASE WHEN n0 * close >= 1 THEN n0 ELSE 0 END AS n FROM z) SELECT symbol, ts, n::BIGINT AS shares, round(n * close, 2) AS value, round(n * gap, 2) AS risk FROM y")
def stop_sizes(spark, d):
    return bars(spark, d).select("symbol", "ts", A.stop_size(F.lit(100_000.0), F.col("close"), F.col("low")).alias("s")).select("symbol", "ts", "s.*")


@query("entry_plan", f"""WITH {BARS}, {ATR}, l AS (SELECT symbol, arg_max(CASE WHEN volume % 5 < 3 THEN 1 ELSE -1 END, ts) AS signal, arg_max(close, ts) AS close, last(atr ORDER BY ts) AS atr0 FROM atr GROUP BY symbol), z AS (SELECT *, CASE WHEN atr0 > 0 THEN atr0 ELSE close * 0.02 END AS a FROM l WHERE signal = 1 AND symbol <> 'click'),
p AS (SELECT *, greatest(0, least(floor(100000 * 0.01 / nullif(2 * a, 0)), floor(100000 * 0.25 / nullif(close, 0))))::BIGINT AS shares FROM z) SELECT symbol, shares, round(close - 2 * a, 6) AS stop, round(close + 3 * a, 6) AS target, round(shares * close, 6) AS value FROM p WHERE shares > 0 AND shares * close >= 100""")
def entry_plan(spark, d):
    x = in_blocks(bars(spark, d), I.with_atr, 15).groupBy("symbol").agg(F.max_by(F.when(F.col("volume") % 5 < 3, 1).otherwise(-1), "ts").alias("signal"), F.max_by("close", "ts").alias("close"), F.max_by("atr", "ts").alias("atr"))
    held = bars(spark, d).where("symbol = 'click'").select("symbol").distinct()
    return rounded(A.entry_plan(x, held, 100_000.0, 100.0).select("symbol", "shares", "stop", "target", "value"))


@query("capital_split", "WITH p AS (SELECT c_mktsegment AS strategy, count(*)::DOUBLE AS w, list(DISTINCT c_nationkey::VARCHAR) FILTER (c_mktsegment <> 'MACHINERY') AS s FROM customer GROUP BY 1) SELECT strategy, len(s)::INTEGER AS symbols, round(w / (SELECT sum(w) FROM p), 9) AS weight, round(w / (SELECT sum(w) FROM p) * 1000000, 4) AS capital FROM p WHERE strategy IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND len(s) > 0")
def capital_split(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").groupBy("c_mktsegment").agg(F.count("*").alias("weight"), F.collect_set(F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey").cast("string"))).alias("symbols"))
    plan = c.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", F.struct("weight", "symbols"))))).alias("plan"))
    x = A.capital_split(plan, ["BUILDING", "MACHINERY", "FURNITURE"], 1_000_000.0)
    return x.select("strategy", F.size("symbols").alias("symbols"), F.round("weight", 9).alias("weight"), F.round("capital", 4).alias("capital"))


@query("activated_stops", f"""WITH {ENTRIES}, b AS (SELECT t.symbol, t.trade_id, b.ts, b.close, t.entry_price, greatest(entry_price, max(b.close) OVER (PARTITION BY t.symbol, t.trade_id ORDER BY b.ts ROWS UNBOUNDED PRECEDING)) AS peak, round(b.close / entry_price - 1, 9) AS gain FROM trd t JOIN bars b ON t.symbol = b.symbol AND b.ts > entry_ts AND b.ts <= exit_ts),
l AS (SELECT *, CASE WHEN gain < 0.02 THEN entry_price ELSE greatest(entry_price, peak * (1 - CASE WHEN gain >= 0.20 THEN 0.03 WHEN gain >= 0.10 THEN 0.05 WHEN gain >= 0.05 THEN 0.08 WHEN gain >= 0.02 THEN 0.10 ELSE 0.05 END::DOUBLE)) END AS level, count(*) FILTER (gain < 0.02) OVER (PARTITION BY symbol, trade_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM b)
SELECT symbol, trade_id, ts, round(max(level) OVER (PARTITION BY symbol, trade_id, part ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS stop FROM l""")
def activated_stops(spark, d):
    t = M.trades(M.with_position(simple_signals(spark, d))).where("exit_ts is not null")
    path = t.select("symbol", "trade_id", "entry_ts", "exit_ts", "entry_price").join(bars(spark, d).select("symbol", "ts", "close"), "symbol").where("ts > entry_ts and ts <= exit_ts")
    return R.activated_stop(path).select("symbol", "trade_id", "ts", F.round("stop", 6).alias("stop"))


# --- reports and files


@query("dashboard", f"""WITH {EQUITY}, r AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY strategy ORDER BY day), 0) - 1 AS ret FROM equity), e AS (SELECT strategy, arg_min(equity, day) AS first, arg_max(equity, day) AS last, max(ret) AS best, min(ret) AS worst, count(*) AS points FROM r GROUP BY strategy),
t AS (SELECT strategy, count(*) AS trades, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, count(DISTINCT symbol) AS symbols FROM trades GROUP BY strategy)
SELECT strategy, first, last, round(100 * best, 4) AS best, round(100 * worst, 4) AS worst, points, round(last - first, 2) AS gain, round(100 * (last / first - 1), 2) AS gain_pct, trades, buys, sells, symbols FROM e FULL JOIN t USING (strategy)""")
def dashboard(spark, d):
    return J.dashboard(equity(spark, d), trades(spark, d))


@query("recent_trades", f"WITH {TRADES} SELECT order_id, line, ts, symbol, side FROM trades WHERE side = 'SELL' ORDER BY ts DESC, order_id DESC, line DESC LIMIT 50")
def recent_trades(spark, d):
    return J.recent(J.query_trades(trades(spark, d), side="sell"), 50, ("ts", "order_id", "line")).select("order_id", "line", "ts", "symbol", "side")


@query("day_summary", f"""WITH {EQUITY}, e AS (SELECT *, lag(equity) OVER (PARTITION BY strategy ORDER BY day) AS b FROM equity), mv AS (SELECT strategy, symbol, ts::DATE AS day, count(*) AS n, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS q FROM trades GROUP BY 1, 2, 3),
o AS (SELECT *, (sum(q) OVER (PARTITION BY strategy, symbol ORDER BY day ROWS UNBOUNDED PRECEDING) <> 0)::INTEGER AS o FROM mv), c AS (SELECT *, o - coalesce(lag(o) OVER (PARTITION BY strategy, symbol ORDER BY day), 0) AS d FROM o), g AS (SELECT strategy, day, sum(n)::BIGINT AS trades, sum(d)::BIGINT AS d FROM c GROUP BY 1, 2)
SELECT strategy, day, equity, round(equity - b, 2) + 0.0::DOUBLE AS pnl, round(100 * (equity - b) / nullif(b, 0), 2) + 0.0::DOUBLE AS pnl_pct, coalesce(trades, 0) AS trades, (sum(coalesce(d, 0)) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS open_positions FROM e LEFT JOIN g USING (strategy, day)""")
def day_summary(spark, d):
    # A row a strategy, symbol and day, from which both the curve and the positions follow: trades are joined once.
    moves = settled(J.day_moves(trades(spark, d), cash_flow()), "moves")
    flows = moves.groupBy("strategy", "day").agg(F.sum("flow").alias("flow"))
    return J.day_summary(curve(flows), moves)


@query("exposure", f"WITH {TRADES}, p AS (SELECT strategy, symbol, arg_max(qty * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END, (ts, order_id, line)) AS qty FROM trades GROUP BY 1, 2), n AS (SELECT symbol, max(price) AS price FROM trades GROUP BY symbol), v AS (SELECT strategy, qty * price AS v FROM p JOIN n USING (symbol)) SELECT strategy, count(*) AS positions, round(coalesce(sum(v) FILTER (v > 0), 0), 2) AS long, round(coalesce(-sum(v) FILTER (v < 0), 0), 2) AS short, round(sum(v), 2) AS net FROM v GROUP BY strategy")
def exposure(spark, d):
    t = trades(spark, d)
    p = J.latest_positions(t.withColumn("qty", F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))))
    return rounded(J.exposure(p, t.groupBy("symbol").agg(F.max("price").alias("price"))), ("strategy",), 2)


@query("vendor_posts", f"WITH {POSTS} SELECT post_id, left(text, 500) AS text, CASE WHEN post_id % 9 <> 0 THEN ts END AS ts FROM posts")
def vendor_posts(spark, d):
    p = posts(spark, d)
    raw = p.withColumn("created_at", F.when(p.post_id % 9 == 0, "soon").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))))
    return J.as_posts(raw.drop("ts")).select("post_id", "text", F.to_utc_timestamp("ts", F.current_timezone()).cast("timestamp_ntz").alias("ts"))


@query("signal_export", f"WITH {BARS}, {SIG} SELECT symbol, ts, signal FROM sig WHERE signal <> 0 AND symbol = 'view' AND ts >= TIMESTAMP '2024-01-05'")
def signal_export(spark, d):
    path = io.scratch(spark, "signals")
    io.export_signals(simple_signals(spark, d).select("symbol", "ts", "signal"), path, "view", F.lit("2024-01-05").cast("timestamp_ntz"))
    return spark.read.schema("symbol string, ts timestamp_ntz, signal int").option("header", True).csv(path)


@query("report_documents", f"WITH {BARS} SELECT symbol, '{{\"bars\":' || count(*) || ',\"volume\":' || sum(volume)::BIGINT || '}}' AS report FROM bars GROUP BY symbol")
def report_documents(spark, d):
    return io.report_json(bars(spark, d).groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume")), "symbol")
