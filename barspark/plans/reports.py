"""Journal, risk and sentiment reports over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journal as J
from ..operators import risk as R
from .inputs import EQUITY, POSTS, TRADES, equity, posts, trades
from .registry import query


@query("journal_top_reasons", f"WITH {TRADES} SELECT reason, count(*) AS count FROM trades WHERE side = 'SELL' GROUP BY reason ORDER BY count DESC, reason LIMIT 5")
def top_reasons(spark, d):
    return J.top_reasons(J.query_trades(trades(spark, d), side="sell"))


@query("journal_cash_flow", f"WITH {TRADES}, c AS (SELECT strategy, side, (CASE WHEN side = 'BUY' THEN -1 ELSE 1 END) * round(qty * price * 100)::BIGINT AS c FROM trades) SELECT strategy, count(*) AS trades, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, sum(c)::DOUBLE / 100 AS net FROM c GROUP BY strategy")
def cash_flow(spark, d):
    return J.cash_flow(trades(spark, d), "strategy").select("strategy", "trades", "buys", "sells", "net")


@query("daily_equity", f"WITH {EQUITY} SELECT * FROM equity")
def daily_equity(spark, d):
    return equity(spark, d)


@query("drawdown_alerts", f"WITH {EQUITY}, x AS (SELECT *, round(1 - equity / max(equity) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING), 9) AS dd FROM equity) SELECT strategy, day, round(dd, 6) AS dd FROM x WHERE dd >= 0.02")
def drawdown_alerts(spark, d):
    return R.drawdown_alerts(equity(spark, d), order="day").select("strategy", "day", F.round("dd", 6).alias("dd"))


@query("distinct_posts", f"WITH {POSTS}, h AS (SELECT post_id, substr(sha256(coalesce(text, '') || coalesce(source, '')), 1, 12) AS hash, ts FROM posts) SELECT post_id, hash FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ts, post_id) = 1")
def distinct_posts(spark, d):
    return J.distinct_posts(posts(spark, d)).select("post_id", "hash")
