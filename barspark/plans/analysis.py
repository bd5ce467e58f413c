"""Timeframes, labels, splits and allocation over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import in_blocks
from ..operators import allocate as A
from ..operators import combine as C
from ..operators import labels as L
from .inputs import BARS, DAILY, SCORED, TRADES, bars, daily, scored, trades
from .market import RET, SIG, rounded, simple_signals
from .registry import query

DLAST = f"""dl AS (SELECT symbol, ts::DATE AS day, arg_max(signal, ts) AS signal FROM sig GROUP BY 1, 2), dd AS (SELECT symbol, unnest(generate_series(min(ts::DATE), max(ts::DATE), INTERVAL 1 DAY))::DATE AS day FROM sig GROUP BY 1)"""


@query("signals_daily_last", f"WITH {BARS}, {SIG}, {DLAST} SELECT dd.symbol, dd.day, coalesce(dl.signal, 0)::INTEGER AS signal FROM dd LEFT JOIN dl USING (symbol, day)")
def daily_last(spark, d):
    return C.daily_last(simple_signals(spark, d))


@query("asof_daily_signal", f"WITH {BARS}, {SIG}, dl AS (SELECT symbol, arg_max(ts, ts) AS ts, arg_max(signal, ts) AS last_signal FROM sig GROUP BY symbol, ts::DATE) SELECT b.symbol, b.ts, coalesce(dl.last_signal, 0)::INTEGER AS last_signal FROM bars b ASOF LEFT JOIN dl ON b.symbol = dl.symbol AND b.ts >= dl.ts")
def asof_daily(spark, d):
    s = simple_signals(spark, d)
    last = s.groupBy("symbol", F.col("ts").cast("date").alias("day")).agg(F.max_by("signal", "ts").alias("last_signal"), F.max("ts").alias("ts"))
    return C.asof(bars(spark, d).select("symbol", "ts"), last, "last_signal").select("symbol", "ts", F.coalesce("last_signal", F.lit(0)).alias("last_signal"))


@query("sector_momentum", f"WITH {DAILY}, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM daily), m AS (SELECT symbol, round(coalesce(max(close) FILTER (n = 1) / max(close) FILTER (n = 20) - 1, 0), 6) AS momentum FROM n GROUP BY symbol) SELECT symbol, momentum, rank() OVER (ORDER BY momentum DESC)::INTEGER AS rank FROM m")
def sector_momentum(spark, d):
    return C.sector_momentum(daily(spark, d))


@query("next_direction_labels", f"WITH {BARS}, n AS (SELECT symbol, ts, close, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM bars) SELECT symbol, ts, (nx > close)::INTEGER AS label FROM n WHERE nx IS NOT NULL")
def next_direction(spark, d):
    return in_blocks(bars(spark, d), L.next_direction, 0, 1).select("symbol", "ts", "label")


@query("walk_forward_folds", f"WITH {DAILY}, r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row, count(*) OVER (PARTITION BY symbol) AS n FROM daily), f AS (SELECT *, unnest(generate_series(0, (n - 400) // 100)) AS fold FROM r) SELECT symbol, row, fold, CASE WHEN row - fold * 100 < 300 THEN 'train' ELSE 'test' END AS role FROM f WHERE row >= fold * 100 AND row < fold * 100 + 400")
def walk_forward(spark, d):
    return L.walk_forward(daily(spark, d), 300, 100).select("symbol", "row", "fold", "role")


@query("classification_scores", f"WITH {SCORED}, c AS (SELECT count(*) FILTER (y = 1 AND p >= .5) AS tp, count(*) FILTER (y <> 1 AND p >= .5) AS fp, count(*) FILTER (y <> 1 AND p < .5) AS tn, count(*) FILTER (y = 1 AND p < .5) AS fn FROM scored) SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c")
def classification(spark, d):
    return rounded(L.classification(scored(spark, d)).select("tp", "fp", "tn", "fn", "accuracy", "precision", "recall"), ())


@query("roc_auc", f"WITH {SCORED} SELECT round((SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) FROM scored a, scored b WHERE a.y = 1 AND b.y <> 1), 6)::DOUBLE AS auc")
def roc_auc(spark, d):
    return rounded(L.roc_auc(scored(spark, d)).select("auc"), ())


@query("kelly_from_returns", f"WITH {DAILY}, {RET.format('daily')} SELECT symbol, count(ret) AS n, round(CASE WHEN count(ret) >= 10 AND var_samp(ret) > 0 THEN greatest(0, least(0.25, 0.5 * avg(ret) / var_samp(ret))) ELSE 0 END, 6) AS kelly FROM ret WHERE ret IS NOT NULL GROUP BY symbol")
def kelly(spark, d):
    from ..operators.indicators import with_returns

    return rounded(A.kelly_from_returns(in_blocks(daily(spark, d), with_returns, 1), "symbol"))


@query("trade_outcomes", f"WITH {TRADES}, m AS (SELECT symbol, avg(price) AS mp FROM trades GROUP BY symbol), o AS (SELECT strategy, symbol, qty * (price - mp) AS pnl FROM trades JOIN m USING (symbol) WHERE side = 'SELL') SELECT strategy, symbol, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses FROM o GROUP BY ALL")
def trade_outcomes(spark, d):
    return A.outcome_stats(A.outcomes(trades(spark, d))).select("strategy", "symbol", "wins", "losses")
