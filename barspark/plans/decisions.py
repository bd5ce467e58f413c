"""Timeframes, sectors, labels, splits, sizes, exits, reports and sentiment over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import join_ranges
from ..functions.scratch import settled
from ..functions.windows import in_blocks
from ..operators import allocate as A
from ..operators import combine as C
from ..operators import indicators as I
from ..operators import journal as J
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import risk as R
from ..operators import search as S
from .analysis import DLAST
from .inputs import BARS, DAILY, EQUITY, POSTS, SCORED, TRADES, bars, daily, equity, posts, scored, trades
from .market import ATR, POS, RET, SIG, TRD, out, rounded, simple_signals
from .registry import query

# --- timeframes, sectors, regimes

DAY_SIGN = "ds AS (SELECT symbol, ts::DATE AS day, CASE WHEN arg_max(close, ts) > arg_min(open, ts) THEN 1 ELSE -1 END AS signal FROM bars GROUP BY 1, 2)"


@query("timeframe_votes", f"""WITH {BARS}, {SIG}, {DLAST}, h AS (SELECT dd.symbol, dd.day, coalesce(dl.signal, 0) AS a FROM dd LEFT JOIN dl USING (symbol, day)), {DAY_SIGN},
x AS (SELECT symbol, day, coalesce(a, 0)::INTEGER AS "1h", coalesce(signal, 0)::INTEGER AS "1d" FROM h FULL JOIN ds USING (symbol, day)), t AS (SELECT *, round(0.9 * "1h" + 1.0 * "1d", 9) AS t FROM x)
SELECT symbol, day, "1h", "1d", sign(t)::INTEGER AS majority, (CASE WHEN t > 0.95 THEN 1 WHEN t < -0.95 THEN -1 ELSE 0 END)::INTEGER AS weighted,
  (CASE WHEN "1h" = 1 AND "1d" = 1 THEN 1 WHEN "1h" = -1 AND "1d" = -1 THEN -1 ELSE 0 END)::INTEGER AS unanimous, (CASE WHEN "1h" = -1 OR "1d" = -1 THEN -1 WHEN "1h" = 1 OR "1d" = 1 THEN 1 ELSE 0 END)::INTEGER AS any_long FROM t""")
def timeframe_votes(spark, d):
    b = bars(spark, d)
    day = b.groupBy("symbol", F.col("ts").cast("date").alias("day")).agg(F.when(F.max_by("close", "ts") > F.min_by("open", "ts"), 1).otherwise(-1).alias("signal"))
    return C.votes(C.aligned({"1h": C.daily_last(simple_signals(spark, d)), "1d": day}), {k: C.TIMEFRAME_WEIGHTS[k] for k in ("1h", "1d")})


@query("inverse_volatility_weights", f"""WITH {DAILY}, {RET.format('daily')}, t AS (SELECT *, CASE WHEN day(ts) % 2 = 0 THEN 'even' ELSE 'odd' END AS tf FROM ret),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY ts DESC) AS n FROM t), v AS (SELECT symbol, tf, greatest(coalesce(stddev_samp(ret), 0), 1e-6) AS vol FROM n WHERE n <= 20 GROUP BY ALL)
SELECT symbol, tf, round(vol, 6) AS vol, round((1 / vol) / sum(1 / vol) OVER (PARTITION BY symbol), 6) AS weight FROM v""")
def inverse_volatility_weights(spark, d):
    x = in_blocks(daily(spark, d), I.with_returns, 1).withColumn("tf", F.when(F.day("ts") % 2 == 0, "even").otherwise("odd"))
    return rounded(C.inverse_volatility_weights(x).select("symbol", "tf", "vol", "weight"), ("symbol", "tf"))


MOMENTUM = f"{DAILY}, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM daily), m AS (SELECT symbol, round(coalesce(max(close) FILTER (n = 1) / max(close) FILTER (n = 20) - 1, 0), 6) AS momentum FROM n GROUP BY symbol)"


@query("sector_bias", f"WITH {MOMENTUM} SELECT symbol, momentum, round(CASE WHEN abs(momentum) >= 0.02 THEN greatest(least(momentum / 0.05, 1), -1) ELSE 0 END, 6) AS bias FROM m")
def sector_bias(spark, d):
    return rounded(C.sector_bias(C.sector_momentum(daily(spark, d))).select("symbol", "momentum", "bias"))


@query("market_breadth", f"WITH {MOMENTUM} SELECT round(greatest(least(avg(momentum) / 0.05, 1), -1), 6) AS breadth FROM m")
def market_breadth(spark, d):
    return rounded(C.market_breadth(C.sector_momentum(daily(spark, d))), ())


@query("regimes", f"""WITH {DAILY}, b AS (SELECT *, close / nullif(lag(close, 20) OVER w, 0) - 1 AS m20, close / nullif(lag(close, 60) OVER w, 0) - 1 AS m60, close / nullif(lag(close, 126) OVER w, 0) - 1 AS m126, close / nullif(lag(close) OVER w, 0) - 1 AS ret, row_number() OVER w AS n FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
v AS (SELECT *, CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w * sqrt(252) END AS vol FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
t AS (SELECT *, (sign(coalesce(m60, 0)) + CASE WHEN vol < 0.2 THEN 1 WHEN vol > 0.35 THEN -1 ELSE 0 END + sign(coalesce(m60 - m126, 0)))::INTEGER AS votes FROM l)
SELECT symbol, round(m60, 6) AS m60, round(vol, 6) AS vol, round(m20 / greatest(abs(coalesce(m126, 0)), 1e-6), 6) AS slope, round(coalesce(m60 - m126, 0), 6) AS growth, votes,
  CASE WHEN n < 63 THEN 'neutral' WHEN votes >= 2 THEN 'risk_on' WHEN votes <= -2 THEN 'risk_off' ELSE 'neutral' END AS regime FROM t""")
def regimes(spark, d):
    return rounded(C.regimes(daily(spark, d)).select("symbol", "m60", "vol", "slope", "growth", "votes", "regime"))


PREFIXES = (("Brand#1", "first", 0), ("Brand#12", "never", 1), ("Brand#2", "second", 2), ("Brand#3", "third", 3))
TILTS = (("first", 1.5), ("second", 0.5))


def _sectors(spark, d):
    return C.assign_sectors(daily(spark, d), spark.createDataFrame(PREFIXES, "prefix string, sector string, map_order int"))


SECTORS = """sec AS (SELECT DISTINCT p_brand AS symbol, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'first' WHEN p_brand LIKE 'Brand#2%' THEN 'second' WHEN p_brand LIKE 'Brand#3%' THEN 'third' ELSE 'other' END AS sector FROM part JOIN lineitem ON p_partkey = l_partkey),
tw0 AS (SELECT symbol, sector, CASE sector WHEN 'first' THEN 1.5 WHEN 'second' THEN 0.5 ELSE 1.0 END::DOUBLE * sqrt(count(*) OVER (PARTITION BY sector)) / count(*) OVER (PARTITION BY sector) AS s FROM sec), tw AS (SELECT symbol, sector, round(0.9 * s / sum(s) OVER (), 8) AS weight FROM tw0)"""


@query("target_weights", f"WITH {SECTORS} SELECT symbol, sector, round(weight, 6) AS weight FROM tw")
def target_weights(spark, d):
    return rounded(C.target_weights(_sectors(spark, d), 0.9, spark.createDataFrame(TILTS, "sector string, tilt double")), ("symbol", "sector"))


@query("drift_signals", f"WITH {SECTORS}, {DAILY}, v AS (SELECT symbol, sum(volume) AS v FROM daily GROUP BY symbol), cur AS (SELECT symbol, v / (SELECT sum(v) FROM v) AS weight FROM v WHERE symbol <> 'Brand#11'), x AS (SELECT symbol, round(coalesce(tw.weight, 0) - coalesce(cur.weight, 0), 9) AS drift FROM cur FULL JOIN tw USING (symbol)) SELECT symbol, round(drift, 6) AS drift, (CASE WHEN drift > 0.005 THEN 1 WHEN drift < -0.005 THEN -1 ELSE 0 END)::INTEGER AS signal FROM x")
def drift_signals(spark, d):
    v = daily(spark, d).groupBy("symbol").agg(F.sum("volume").alias("v"))
    total = v.agg(F.sum("v").alias("t"))
    goal = C.target_weights(_sectors(spark, d), 0.9, spark.createDataFrame(TILTS, "sector string, tilt double"))
    now = v.crossJoin(F.broadcast(total)).where("symbol <> 'Brand#11'").select("symbol", (F.col("v") / F.col("t")).alias("weight"))
    return rounded(C.rebalance(now, goal, 0.005).select("symbol", "drift", "signal"))


# --- labels and splits

BARRIER = """nx AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM atr),
hit AS (SELECT a.symbol, a.ts, arg_min(CASE WHEN b.close <= a.close - {1} * a.atr THEN -1.0 ELSE 1.0 END::DOUBLE, b.rn) AS label FROM nx a JOIN nx b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 20 AND (b.close >= a.close + {0} * a.atr OR b.close <= a.close - {1} * a.atr) GROUP BY 1, 2)"""
LABELLED = "lab AS (SELECT nx.symbol, nx.ts, CASE WHEN close <= 0 THEN 0.0 ELSE hit.label END AS label FROM nx LEFT JOIN hit USING (symbol, ts) WHERE nts IS NOT NULL)"


@query("triple_barrier", f"WITH {BARS}, {ATR}, {BARRIER.format(1.0, 1.0)}, {LABELLED} SELECT * FROM lab")
def triple_barrier(spark, d):
    return in_blocks(bars(spark, d), lambda b: L.triple_barrier(I.with_atr(b)), 15, 20).select("symbol", "ts", "label")


@query("asymmetric_barrier", f"WITH {BARS}, {ATR}, {BARRIER.format(2.0, 0.5)}, {LABELLED} SELECT * FROM lab")
def asymmetric_barrier(spark, d):
    return in_blocks(bars(spark, d), lambda b: L.triple_barrier(I.with_atr(b), 2.0, 0.5), 15, 20).select("symbol", "ts", "label")


DISTRIBUTION = "SELECT symbol, count(*) AS rows, count(*) FILTER (label = 1) AS ups, count(*) FILTER (label = -1) AS downs, count(*) FILTER (label IS NULL) AS open, round(count(*) FILTER (label = 1) / count(*), 4) AS up_share, round((count(*) FILTER (label = 1) - count(*) FILTER (label = -1)) / nullif(count(*) FILTER (abs(label) = 1), 0), 4) AS asymmetry FROM {} GROUP BY symbol"


@query("label_distribution", f"WITH {BARS}, {ATR}, {BARRIER.format(1.0, 1.0)}, {LABELLED} {DISTRIBUTION.format('lab')}")
def label_distribution(spark, d):
    return L.label_distribution(in_blocks(bars(spark, d), lambda b: L.triple_barrier(I.with_atr(b)), 15, 20), "symbol")


PAIRS = (("open", "high"), ("open", "low"), ("open", "volume"), ("high", "low"), ("high", "volume"), ("low", "volume"))


@query("feature_correlations", f"WITH {BARS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr, coalesce(abs(round(corr({a}, {b}), 4)) > 0.5, false) AS collinear FROM bars" for a, b in PAIRS))
def feature_correlations(spark, d):
    return L.correlations(bars(spark, d), ["open", "high", "low", "volume"], 0.5)


@query("lookahead_scan", f"WITH {BARS}, y AS (SELECT *, " + ", ".join(f"lead(close, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS y{k}" for k in (1, 2, 3)) + " FROM bars) " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {k} AS k, round(corr({f}, y{k}), 4) AS corr, coalesce(abs(round(corr({f}, y{k}), 4)) > 0.1, false) AS flagged FROM y" for f in ("open", "volume") for k in (1, 2, 3)))
def lookahead_scan(spark, d):
    return L.lookahead(bars(spark, d), ["open", "volume"], "close", 3)


ROWS = "rw AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row, count(*) OVER (PARTITION BY symbol) AS n FROM {})"


@query("purged_folds", f"WITH {BARS}, {ROWS.format('bars')}, f AS (SELECT *, unnest(range(5)) AS fold FROM rw), b AS (SELECT *, fold * (n // 5) AS lo, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END AS hi FROM f) SELECT symbol, row, fold::INTEGER AS fold, CASE WHEN row >= lo AND row < hi THEN 'test' WHEN row >= lo - 5 AND row < hi + 5 THEN 'embargo' ELSE 'train' END AS role FROM b")
def purged_folds(spark, d):
    return L.purged_folds(bars(spark, d)).select("symbol", "row", "fold", "role")


_SPLITS = f"""WITH {BARS}, {ROWS.format('bars')}, f AS (SELECT *, unnest(range(4)) AS fold, 30 AS size FROM rw), b AS (SELECT *, fold * (n // 4) AS lo, least(fold * (n // 4) + size, n) AS hi FROM f)
SELECT symbol, row, fold::INTEGER AS fold, CASE WHEN row >= lo AND row < hi THEN 'test' WHEN (CASE WHEN row < lo THEN row ELSE row - (hi - lo) END) >= 200 THEN 'unused'
  WHEN row >= hi AND row < hi + 3 + 2 THEN 'embargo' ELSE 'train' END AS role FROM b"""


@query("purged_splits", _SPLITS)
def purged_splits(spark, d):
    return L.purged_splits(bars(spark, d), 4, test_size=30, train_size=200, embargo_share=0.1, gap=2).select("symbol", "row", "fold", "role")


@query("split_by_date", f"WITH {DAILY}, {ROWS.format('daily')}, c AS (SELECT *, row + 1 - coalesce(min(CASE WHEN ts >= TIMESTAMP '1998-01-01' THEN row + 1 END) OVER (PARTITION BY symbol), 1099511627776) AS d FROM rw) SELECT symbol, ts, CASE WHEN d < -5 THEN 'train' WHEN d >= 5 THEN 'test' ELSE 'embargo' END AS role FROM c")
def split_by_date(spark, d):
    return L.split_by_date(daily(spark, d), F.lit("1998-01-01").cast("timestamp_ntz")).select("symbol", "ts", "role")


@query("model_scores", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (y = 1 AND p >= .5) AS tp, count(*) FILTER (y <> 1 AND p >= .5) AS fp, count(*) FILTER (y = 1 AND p < .5) AS fn, avg(p) AS mean_p, avg((y = 1)::INTEGER) AS positive_rate FROM scored)
SELECT round(mean_p, 6) AS mean_p, round(positive_rate, 6) AS positive_rate, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def model_scores(spark, d):
    return rounded(L.classification(scored(spark, d)).select("mean_p", "positive_rate", "f1"), ())


@query("average_precision", f"WITH {SCORED}, s AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM scored GROUP BY p), w AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS alln FROM s) SELECT round(sum(pos * tp / alln) / sum(pos), 6)::DOUBLE AS average_precision FROM w")
def average_precision(spark, d):
    return rounded(L.roc_auc(scored(spark, d)).select("average_precision"), ())


UPS = "up AS (SELECT *, CASE WHEN lead(close) OVER (PARTITION BY symbol ORDER BY ts) > close THEN 1 WHEN lead(close) OVER (PARTITION BY symbol ORDER BY ts) <= close THEN 0 END AS label FROM bars)"


@query("feature_importance", f"WITH {BARS}, {UPS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(abs(avg({f}) FILTER (label = 1) - avg({f}) FILTER (label = 0)), 6) AS gap FROM up" for f in ("open", "high", "volume")))
def feature_importance(spark, d):
    return rounded(L.importance(in_blocks(bars(spark, d), L.next_direction, 0, 1), ["open", "high", "volume"]), ("feature",))


@query("regression_scores", f"""WITH {BARS}, x AS (SELECT symbol, close AS a, open AS b, close - lag(close) OVER w AS da, open - lag(open) OVER w AS db FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, round(avg((a - b) ** 2), 6) AS mse, round(avg(abs(a - b)), 6) AS mae, round(avg((sign(da) = sign(db))::INTEGER) FILTER (da <> 0), 6) AS direction, round(1 - sum((a - b) ** 2) / (var_pop(a) * count(a)), 6) AS r2 FROM x GROUP BY symbol""")
def regression_scores(spark, d):
    return rounded(L.regression_scores(bars(spark, d), "close", "open"))


FOLDS = "fo AS (SELECT row_number() OVER (ORDER BY s) - 1 AS fold, s::DATE AS train_start, (s + INTERVAL 180 DAY)::DATE AS train_end, (s + INTERVAL 240 DAY)::DATE AS test_end FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01', INTERVAL {} DAY) g(s) WHERE s + INTERVAL 240 DAY <= TIMESTAMP '1998-01-01')"


@query("walk_forward_windows", f"WITH {DAILY}, {FOLDS.format(60)} SELECT symbol, fold, train_start, test_end, count(*) FILTER (ts::DATE < train_end) AS train_bars, count(*) FILTER (ts::DATE >= train_end) AS test_bars FROM daily JOIN fo ON ts::DATE >= train_start AND ts::DATE < test_end GROUP BY ALL")
def walk_forward_windows(spark, d):
    return _window_bars(spark, d, None)


@query("overlapping_windows", f"WITH {DAILY}, {FOLDS.format(30)} SELECT symbol, fold, train_start, test_end, count(*) FILTER (ts::DATE < train_end) AS train_bars, count(*) FILTER (ts::DATE >= train_end) AS test_bars FROM daily JOIN fo ON ts::DATE >= train_start AND ts::DATE < test_end GROUP BY ALL")
def overlapping_windows(spark, d):
    return _window_bars(spark, d, 30)


def _window_bars(spark, d, step):
    w, day = S.windows(spark, "1996-01-01", "1998-01-01", 180, 60, step), F.col("ts").cast("date")
    x = join_ranges(daily(spark, d), w, day, "train_start", "test_end")
    return x.groupBy("symbol", "fold", "train_start", "test_end").agg(F.count_if(day < F.col("train_end")).alias("train_bars"), F.count_if(day >= F.col("train_end")).alias("test_bars"))


# --- sizes and weights

OUTCOMES = f"""{TRADES}, m AS (SELECT symbol, avg(price) AS mp FROM trades GROUP BY symbol), o AS (SELECT strategy, symbol, round(qty * (price - mp), 4) AS pnl FROM trades JOIN m USING (symbol) WHERE side = 'SELL'),
g AS (SELECT strategy, symbol, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(-pnl) FILTER (pnl < 0), 0) AS avg_loss FROM o WHERE pnl <> 0 GROUP BY ALL), k AS (SELECT *, wins / (wins + losses) AS win_rate, avg_win / nullif(avg_loss, 0) AS payoff FROM g),
kk AS (SELECT *, CASE WHEN wins + losses >= 10 AND avg_loss > 0 AND avg_win > 0 THEN greatest(0, least(0.25, 0.5 * (win_rate - (1 - win_rate) / payoff))) ELSE 0 END AS kelly FROM k)"""


@query("kelly_by_group", f"WITH {OUTCOMES} SELECT strategy, symbol, wins, losses, round(avg_win + 1e-9, 4) AS avg_win, round(avg_loss + 1e-9, 4) AS avg_loss, round(win_rate + 1e-9, 4) AS win_rate, round(payoff + 1e-9, 4) AS payoff, round(kelly + 1e-9, 4) AS kelly, round(0.01 * (1 + greatest(kelly, 0)), 6) AS risk FROM kk")
def kelly_by_group(spark, d):
    x = A.outcome_stats(A.outcomes(trades(spark, d))).withColumn("risk", F.round(A.scaled_risk(F.lit(0.01), F.col("kelly")), 6))
    return x.select("strategy", "symbol", "wins", "losses", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("avg_win", "avg_loss", "win_rate", "payoff", "kelly")], "risk")


VOLS = f"{DAILY}, {RET.format('daily')}, vol AS (SELECT symbol, stddev_samp(ret) AS vol, var_samp(ret) AS var, greatest(avg(ret), 0) AS edge FROM ret GROUP BY symbol)"


@query("allocations", f"WITH {VOLS} SELECT symbol, round((1 / vol) / sum(1 / vol) OVER (), 6) AS risk_parity, round((1 / var) / sum(1 / var) OVER (), 6) AS inverse_variance, round(1 / count(*) OVER (), 6) AS equal_weight, round(CASE WHEN sum(edge) OVER () > 0 THEN edge / sum(edge) OVER () ELSE 1 / count(*) OVER () END, 6) AS by_edge FROM vol")
def allocations(spark, d):
    v = in_blocks(daily(spark, d), I.with_returns, 1).groupBy("symbol").agg(F.stddev_samp("ret").alias("vol"), F.var_samp("ret").alias("var"), F.greatest(F.avg("ret"), F.lit(0.0)).alias("edge"))
    return rounded(v.select("symbol", A.inverse_volatility(F.col("vol")).alias("risk_parity"), A.inverse_volatility(F.col("var")).alias("inverse_variance"), A.normalised(F.lit(0)).alias("equal_weight"), A.normalised(F.col("edge")).alias("by_edge")))


@query("asset_correlations", f"WITH {DAILY}, {RET.format('daily')} SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.ret, b.ret), 4) AS corr, round(sqrt(greatest((1 - corr(a.ret, b.ret)) / 2, 0)), 4) AS distance FROM ret a JOIN ret b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY ALL")
def asset_correlations(spark, d):
    x = A.correlation_distance(in_blocks(daily(spark, d), I.with_returns, 1))
    return x.select("a", "b", "n", F.round("corr", 4).alias("corr"), F.round("distance", 4).alias("distance"))


@query("sizes_and_stops", f"WITH {BARS}, {ATR} SELECT symbol, ts, greatest(0, least(floor(100000 * 0.01 / nullif(2 * atr, 0)), floor(100000 * 0.25 / nullif(close, 0))))::BIGINT AS shares, round(close - 2 * atr, 6) AS stop, round(close + 3 * atr, 6) AS target FROM atr WHERE atr > 0 AND close > 0")
def sizes_and_stops(spark, d):
    x = in_blocks(bars(spark, d), I.with_atr, 15).where("atr > 0 and close > 0")
    return out(x.withColumns({"shares": A.position_size(F.lit(100000.0), F.col("close"), 2 * F.col("atr"))} | A.stops(F.col("close"), F.col("atr"))), "shares", "stop", "target")


TARGETS = "pos AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS qty, avg(price) AS price FROM trades GROUP BY symbol), tot AS (SELECT sum(qty * price) / count(*) AS goal FROM pos)"


@query("rebalance_plan", f"WITH {TRADES}, {TARGETS}, x AS (SELECT symbol, qty, price, round(goal, 2) AS goal, round(goal, 2) - qty * price AS diff FROM pos, tot WHERE symbol <> 'Brand#21' UNION ALL SELECT symbol, qty, price, 0, -qty * price FROM pos WHERE symbol = 'Brand#21') SELECT symbol, (CASE WHEN abs(diff) > 0.15 * goal THEN floor(abs(diff) / price) ELSE 0 END)::BIGINT AS shares, CASE WHEN abs(diff) <= 0.15 * goal THEN 'HOLD' WHEN diff > 0 THEN 'BUY' WHEN diff < 0 THEN 'SELL' ELSE 'HOLD' END AS action FROM x")
def rebalance_plan(spark, d):
    p = settled(_positions(spark, d), "positions")  # a row a symbol, read for the goal, the targets, the positions and the prices
    goal = p.agg(F.round(F.sum(F.col("qty") * F.col("price")) / F.count("*"), 2).alias("value"))
    targets = p.where("symbol <> 'Brand#21'").select("symbol").crossJoin(F.broadcast(goal))
    return A.rebalance_plan(p, p, targets).select("symbol", "shares", "action")


def _positions(spark, d):
    return trades(spark, d).groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).alias("qty"), F.avg("price").alias("price"))


@query("reconciled_positions", f"WITH {TRADES}, own AS (SELECT DISTINCT symbol FROM trades WHERE symbol < 'Brand#40'), held AS (SELECT DISTINCT symbol FROM trades WHERE symbol > 'Brand#20') SELECT symbol, CASE WHEN o.symbol IS NULL THEN 'adopted' WHEN h.symbol IS NULL THEN 'dropped' ELSE 'kept' END AS how FROM (SELECT symbol AS symbol FROM own UNION SELECT symbol FROM held) LEFT JOIN own o USING (symbol) LEFT JOIN held h USING (symbol)")
def reconciled_positions(spark, d):
    t = trades(spark, d)
    mine = t.where("symbol < 'Brand#40'").select("symbol").distinct().withColumn("qty", F.lit(1.0))
    held = t.where("symbol > 'Brand#20'").select("symbol").distinct().withColumn("qty", F.lit(2.0))
    return A.reconcile(mine, held).select("symbol", "how")


# --- exits and limits

ENTRIES = f"{BARS}, {SIG}, {POS.format('sig')}, {TRD}"
PATHS = "pth AS (SELECT t.symbol, t.trade_id, t.entry_ts, t.entry_price, b.ts, b.close, date_diff('day', entry_ts::DATE, b.ts::DATE) AS days, greatest(entry_price, max(b.close) OVER (PARTITION BY t.symbol, t.trade_id ORDER BY b.ts ROWS UNBOUNDED PRECEDING)) AS peak FROM trd t JOIN bars b ON t.symbol = b.symbol AND b.ts > entry_ts AND date_diff('day', entry_ts::DATE, b.ts::DATE) <= 30)"


@query("exit_paths", f"""WITH {ENTRIES}, {PATHS}, y AS (SELECT *, CASE WHEN close <= entry_price * 0.9 THEN 'stop' WHEN close <= peak * 0.85 THEN 'trail' WHEN days >= 30 THEN 'time' WHEN close / entry_price - 1 >= 0.2 OR close / entry_price - 1 >= 0.1 AND days >= 10 THEN 'roi' END AS why FROM pth),
f AS (SELECT symbol, trade_id, arg_min(ts, ts) AS exit_ts, arg_min(close, ts) AS exit_price, arg_min(why, ts) AS why FROM y WHERE why IS NOT NULL GROUP BY 1, 2)
SELECT t.symbol, t.trade_id, t.entry_ts, round(t.entry_price, 6) AS entry_price, f.exit_ts, round(f.exit_price, 6) AS exit_price, coalesce(f.why, 'open') AS why FROM trd t LEFT JOIN f USING (symbol, trade_id)""")
def exit_paths(spark, d):
    t = M.trades(M.with_position(simple_signals(spark, d)))
    x = R.exit_paths(t, bars(spark, d))
    return x.select("symbol", "trade_id", "entry_ts", F.round("entry_price", 6).alias("entry_price"), "exit_ts", F.round("exit_price", 6).alias("exit_price"), "why")


@query("ratcheted_stops", f"""WITH {ENTRIES}, b AS (SELECT t.symbol, t.trade_id, b.ts, b.close, t.entry_price, greatest(entry_price, max(b.close) OVER (PARTITION BY t.symbol, t.trade_id ORDER BY b.ts ROWS UNBOUNDED PRECEDING)) AS peak FROM trd t JOIN bars b ON t.symbol = b.symbol AND b.ts > entry_ts AND b.ts <= exit_ts),
g AS (SELECT *, round(peak / entry_price - 1, 9) AS gain FROM b), l AS (SELECT *, CASE WHEN gain >= 0.20 THEN peak * 0.97 WHEN gain >= 0.10 THEN peak * 0.95 WHEN gain >= 0.05 THEN peak * 0.92 WHEN gain >= 0.02 THEN peak * 0.9 END AS lv FROM g), s AS (SELECT *, max(lv) OVER (PARTITION BY symbol, trade_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stop FROM l)
SELECT symbol, trade_id, ts, round(stop, 6) AS stop, coalesce(close <= stop, false) AS hit FROM s""")
def ratcheted_stops(spark, d):
    t = M.trades(M.with_position(simple_signals(spark, d))).where("exit_ts is not null")
    b = bars(spark, d).select("symbol", "ts", "close")
    path = t.select("symbol", "trade_id", "entry_ts", "exit_ts", "entry_price").join(b, "symbol").where("ts > entry_ts and ts <= exit_ts")
    return R.ratcheted_stop(path).select("symbol", "trade_id", "ts", F.round("stop", 6).alias("stop"), "hit")


@query("kill_switch", f"WITH {BARS}, x AS (SELECT symbol AS strategy, ts, ts::DATE AS day, close, first(close) OVER w AS start, 1 - close / first(close) OVER w AS loss FROM bars WINDOW w AS (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING)) SELECT strategy, ts, round(loss, 6) AS loss, max(round(loss, 9) >= 0.03) OVER (PARTITION BY strategy, day ORDER BY ts ROWS UNBOUNDED PRECEDING) AS tripped FROM x")
def kill_switch(spark, d):
    e = bars(spark, d).select(F.col("symbol").alias("strategy"), "ts", F.col("ts").cast("date").alias("day"), F.col("close").alias("equity"))
    return R.kill_switch(e).select("strategy", "ts", F.round("loss", 6).alias("loss"), "tripped")


@query("intraday_drawdown_alerts", f"WITH {BARS}, x AS (SELECT symbol AS strategy, ts, ts::DATE AS day, round(1 - close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 9) AS dd FROM bars), l AS (SELECT *, max(CASE WHEN dd >= 0.02 THEN dd END) OVER (PARTITION BY strategy, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM x) SELECT strategy, ts, round(dd, 6) AS dd FROM l WHERE dd >= 0.02 AND (last IS NULL OR dd > last)")
def intraday_drawdown_alerts(spark, d):
    e = bars(spark, d).select(F.col("symbol").alias("strategy"), "ts", F.col("ts").cast("date").alias("day"), F.col("close").alias("equity"))
    return R.drawdown_alerts(e).select("strategy", "ts", F.round("dd", 6).alias("dd"))


# --- reports and sentiment

CENTS = f"{TRADES}, c AS (SELECT *, ts::DATE AS day, (CASE WHEN side = 'BUY' THEN -1 ELSE 1 END) * round(qty * price * 100)::BIGINT AS c FROM trades)"


@query("cash_flow_full", f"WITH {CENTS} SELECT strategy, symbol, count(*) AS trades, sum(c)::DOUBLE / 100 AS net, -coalesce(sum(c) FILTER (c < 0), 0)::DOUBLE / 100 AS spent, coalesce(sum(c) FILTER (c > 0), 0)::DOUBLE / 100 AS received, round(avg(abs(c)) / 100, 1) AS avg_abs, max(c)::DOUBLE / 100 AS most, min(c)::DOUBLE / 100 AS least FROM c GROUP BY ALL")
def cash_flow_full(spark, d):
    return J.cash_flow(trades(spark, d), "strategy", "symbol").select("strategy", "symbol", "trades", "net", "spent", "received", F.round("avg_abs", 1).alias("avg_abs"), "most", "least")


@query("daily_pnl", f"WITH {CENTS}, g AS (SELECT day, count(*) AS trades, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, sum(c)::DOUBLE / 100 AS net FROM c GROUP BY day ORDER BY day DESC LIMIT 14) SELECT *, net = max(net) OVER () AS best, net = min(net) OVER () AS worst FROM g")
def daily_pnl(spark, d):
    return J.daily_pnl(trades(spark, d))


@query("curve_stats", f"""WITH {EQUITY}, x AS (SELECT *, equity - lag(equity) OVER w AS d, equity / max(equity) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM equity WINDOW w AS (PARTITION BY strategy ORDER BY day)),
i AS (SELECT *, sum(CASE WHEN coalesce(d, 0) < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM x), r AS (SELECT *, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, island) AS run FROM i)
SELECT strategy, count(*) AS points, arg_min(equity, day) AS first, arg_max(equity, day) AS last, round(coalesce(avg(d) / stddev_samp(d) * sqrt(252), 0), 6) AS sharpe, round(min(dd), 6) AS max_drawdown, max(run)::BIGINT AS losing_run FROM r GROUP BY strategy""")
def curve_stats(spark, d):
    x = J.curve_stats(equity(spark, d))
    return x.select("strategy", "points", "first", "last", F.round("sharpe", 6).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"), "losing_run")


@query("latest_positions", f"WITH {TRADES} SELECT strategy, symbol, ts, qty, round(price + 1e-9, 6) AS price FROM trades WHERE order_id % 5 <> 0 AND qty <> 0 QUALIFY row_number() OVER (PARTITION BY strategy, symbol ORDER BY ts DESC, order_id DESC, line DESC, qty DESC, price DESC) = 1")
def latest_positions(spark, d):
    return J.latest_positions(trades(spark, d).where("order_id % 5 <> 0")).select("strategy", "symbol", "ts", "qty", F.round(F.col("price") + 1e-9, 6).alias("price"))


LEXICON = (("the", 0.5), ("data", 1.0), ("free", -1.5), ("of", -0.25), ("de", 0.75), ("und", -0.5))
TOKENS = "tok AS (SELECT post_id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS token FROM posts), lx(token, value) AS (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in LEXICON) + "), sc AS (SELECT post_id, sum(value) AS s FROM tok JOIN lx USING (token) GROUP BY post_id), pol AS (SELECT posts.*, coalesce(round(s / sqrt(s * s + 15), 6), 0) AS score FROM posts LEFT JOIN sc USING (post_id))"


def _polar(spark, d):
    return J.polarity(posts(spark, d), spark.createDataFrame(LEXICON, "token string, value double"))


@query("post_polarity", f"WITH {POSTS}, {TOKENS} SELECT post_id, score FROM pol")
def post_polarity(spark, d):
    return _polar(spark, d).select("post_id", "score")


@query("sentiment_by_symbol", f"""WITH {POSTS}, {TOKENS}, x AS (SELECT * FROM pol WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-02'), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(score) DESC, post_id) AS n FROM x)
SELECT symbol, count(*) AS mentions, count(*) FILTER (score > 0.25) AS bullish, count(*) FILTER (score < -0.25) AS bearish, round(avg(score), 4) AS mean, count(*) FILTER (abs(score) <= 0.25) AS neutral, round((count(*) FILTER (score > 0.25) - count(*) FILTER (score < -0.25)) / count(*), 4) AS net,
  array_to_string(list(post_id ORDER BY n) FILTER (n <= 5), ',') AS top FROM n GROUP BY symbol""")
def sentiment_by_symbol(spark, d):
    x = J.sentiment(_polar(spark, d), F.lit("2024-01-02").cast("timestamp_ntz"))
    return x.withColumn("top", F.array_join(F.col("top").cast("array<string>"), ","))


@query("symbol_mentions", f"WITH {POSTS}, t AS (SELECT DISTINCT post_id, unnest(string_split_regex(upper(text), '[^A-Z0-9]+')) AS symbol FROM posts) SELECT post_id, symbol FROM t WHERE symbol IN ('DATA', 'TIME', 'STONE')")
def symbol_mentions(spark, d):
    return J.mentions(posts(spark, d), spark.createDataFrame([("DATA",), ("TIME",), ("STONE",)], "symbol string"))
