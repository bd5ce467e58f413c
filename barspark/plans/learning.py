"""Models, their held-out scores, hierarchical weights, user sources and equity files over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..functions.windows import in_blocks
from ..operators import allocate as A
from ..operators import bars as B
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import models
from ..operators import strategies as T
from ..sources import io, user
from .event_source import EventBars
from .inputs import BARS, EQUITY, POSTS, SCORED, bars, daily, equity, scored, table
from .market import SIG, rounded, simple_signals
from .registry import query


def labelled(spark, d):
    """The model's features of hourly bars, whether the next bar closes higher, and the folds of purged splits."""
    x = L.feature_frame(bars(spark, d)).select("symbol", "ts", "close", *L.FEATURES)
    x = in_blocks(x, L.next_direction, 0, 1)
    return L.purged_splits(x, 3, embargo_share=0.1, gap=1)


@query("boosted_tree_folds")
def boosted_tree_folds(spark, d):
    """Per fold: the test rows' number, and how well a model of the fold's train rows orders and splits them."""
    s = models.held_out(labelled(spark, d), L.FEATURES, maxIter=10, maxDepth=3, stepSize=0.2).withColumn("y", F.col("label"))
    n = s.groupBy("fold").agg(F.count("*").alias("rows"), F.avg("y").alias("up_share"), F.avg("p").alias("mean_p"))
    return n.join(L.roc_auc(s, "fold"), "fold")


@query("stored_model_scores")
def stored_model_scores(spark, d):
    """Every bar's probability by a model that was saved and loaded again, beside that of the model itself."""
    x = labelled(spark, d).where("fold = 2")
    model = models.fit(x.where("role = 'train'"), L.FEATURES, maxIter=10, maxDepth=3, stepSize=0.2)
    path = scratch(spark, "model")
    models.save(model, path)
    both = models.score(models.load(spark, path), models.score(model, x, "p_own"), "p")
    return both.select("symbol", "ts", "role", "p_own", "p")


BY_LANG = SCORED.replace("SELECT doc_id,", "SELECT doc_id, lang,")


@query("roc_auc_by_language", f"""WITH {BY_LANG}, a AS (SELECT a.lang, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)::DOUBLE AS auc FROM scored a JOIN scored b ON a.lang = b.lang WHERE a.y = 1 AND b.y <> 1 GROUP BY 1),
s AS (SELECT lang, p, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM scored GROUP BY 1, 2), c AS (SELECT lang, pos, sum(pos) OVER w / sum(n) OVER w AS pr FROM s WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT lang, sum(pos * pr) / nullif(sum(pos), 0) AS average_precision FROM c GROUP BY 1) SELECT lang, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision FROM ap LEFT JOIN a USING (lang)""")
def roc_auc_by_language(spark, d):
    x = scored(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(L.roc_auc(x, "lang"), ("lang",))


@query("hrp_weights")
def hrp_weights(spark, d):
    """Weights of all brands for each year from the year's daily returns."""
    x = in_blocks(daily(spark, d), I.with_returns, 1).withColumn("year", F.year("ts"))
    return rounded(A.hierarchical_risk_parity(x, "year"), ("year", "symbol"))


USER = "ub AS (SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS volume FROM events GROUP BY 1, 2)"


@query("user_source_bars", f"WITH {USER} SELECT * FROM ub WHERE symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05'")
def user_source_bars(spark, d):
    return user.read_source(spark, EventBars, path=d, days=7).where("symbol in ('click', 'view') and ts >= timestamp_ntz '2024-01-05'")


@query("user_source_stream", f"WITH {USER} SELECT * FROM ub")
def user_source_stream(spark, d):
    from ..streaming import jobs

    return jobs.run(user.stream_source(spark, EventBars, path=d, days=7), scratch(spark, "user-stream"))


@query("user_source_fallback", f"WITH {BARS}, {USER}, u AS (SELECT *, 0 AS p FROM bars WHERE symbol = 'click' UNION ALL SELECT *, 1 AS p FROM ub) SELECT * EXCLUDE (p) FROM u QUALIFY p = min(p) OVER (PARTITION BY symbol)")
def user_source_fallback(spark, d):
    """Hourly bars where there are any, else the user's."""
    return B.first_source([bars(spark, d).where("symbol = 'click'"), user.read_source(spark, EventBars, path=d)]).select("symbol", "ts", "open", "high", "low", "close", "volume")


@query("equity_files", f"WITH {EQUITY} SELECT strategy, day::TIMESTAMP AS ts, equity FROM equity WHERE extract(day FROM day) <> 13")
def equity_files(spark, d):
    """Curves appended to CSV files in two goes; rows whose number can't be read are skipped."""
    e = equity(spark, d).select("strategy", F.col("day").cast("timestamp_ntz").alias("ts"), F.col("equity").cast("string").alias("equity"))
    path = scratch(spark, "equity")
    io.append_curves(e.where("day(ts) < 13"), path)
    io.append_curves(e.where("day(ts) >= 13").withColumn("equity", F.when(F.day("ts") == 13, "n/a").otherwise(F.col("equity"))), path)
    return io.read_curves(spark, path)


@query("equity_json", f"WITH {EQUITY} SELECT strategy, day::TIMESTAMP AS ts, equity FROM equity")
def equity_json(spark, d):
    """Curves as one JSON document a strategy and year, and back."""
    e = equity(spark, d).select("strategy", F.col("day").cast("timestamp_ntz").alias("ts"), "equity")
    return io.curves_from_json(io.curves_to_json(e)).select("strategy", F.to_timestamp_ntz("ts").alias("ts"), "equity")


@query("sentiment_gated_signals", f"""WITH {BARS}, {SIG}, {POSTS}, s AS (SELECT symbol, (count(*) FILTER (length(text) % 3 = 0) - count(*) FILTER (length(text) % 3 = 1)) / count(*) AS net FROM posts GROUP BY 1),
m AS (SELECT sig.*, s.net FROM sig LEFT JOIN s ON s.symbol = CASE sig.symbol WHEN 'click' THEN 'en' WHEN 'view' THEN 'de' WHEN 'error' THEN 'fr' ELSE sig.symbol END)
SELECT symbol, ts, (CASE WHEN signal = 1 AND coalesce(net, 0) < -0.02 THEN 0 ELSE signal END)::INTEGER AS signal FROM m""")
def sentiment_gated_signals(spark, d):
    """Longs are held back by the net score of the posts that stand for a symbol, found from the posts themselves."""
    n = F.char_length("text") % 3
    s = table(spark, d, "documents").groupBy(F.col("lang").alias("symbol")).agg(((F.count_if(n == 0) - F.count_if(n == 1)) / F.count("*")).alias("net"))
    s = s.withColumn("symbol", F.when(F.col("symbol") == "en", "click").when(F.col("symbol") == "de", "view").when(F.col("symbol") == "fr", "error").otherwise(F.col("symbol")))
    return T.sentiment_filter(simple_signals(spark, d), s, -0.02).select("symbol", "ts", "signal")
