"""Running values by blocks against the plain windows over whole series, and that a series is many tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.functions import running as R
from barspark.functions import windows
from barspark.functions.windows import ROW, in_blocks, numbered, ordered, upto


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_ROWS", 5)


def series(spark, sizes, seed=1):
    r = random.Random(seed)
    rows = []
    for symbol, n in sizes.items():
        t = datetime(2024, 1, 1)
        for _ in range(n):
            t += timedelta(hours=r.choice([1, 5, 400]))
            rows.append((symbol, t, r.choice([None, 1.0, 2.0, -3.0, 0.5]), float(r.randint(-4, 9)), r.choice([None, None, -1, 1])))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double, b double, s int").cache()


SIZES = {"long": 53, "full": 10, "one": 1, None: 12, "five": 5}


def test_running_values_equal_plain_windows(spark, small_blocks):
    df = series(spark, SIZES)
    a, b, s, w, u = F.col("a"), F.col("b"), F.col("s"), ordered(), upto()
    got = R.running(df, {
        "total": R.total(a), "peak": R.peak(a), "first": R.first(a), "latest": R.latest(s), "latest1": R.latest(s, 1), "latest3": R.latest(s, 3), "lag1": R.lag(a), "lag4": R.lag(a, 4),
        "lead": R.lead(a), "pt": R.peak_of_total(b), "both": R.total(b),
    })
    back = lambda k: F.last(s, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -k))
    want = df.withColumns({
        "total": F.sum(a).over(u), "peak": F.max(a).over(u), "first": F.first(a).over(u), "latest": F.last(s, ignorenulls=True).over(u), "latest1": back(1), "latest3": back(3), "lag1": F.lag(a).over(w),
        "lag4": F.lag(a, 4).over(w), "lead": F.lead(a).over(w), "both": F.sum(b).over(u),
    }).withColumn("pt", F.max("both").over(u)).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert R.running(df.limit(0), {"t": R.total(a)}).count() == 0


def test_a_series_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_ROWS", 64)
    df = series(spark, {"only": 3000})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = R.running(df, {"t": R.total(F.col("b"))}).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(out) >= 6 and max(r["count"] for r in out) < 1500
        out = in_blocks(df, lambda x: x.withColumn("m", F.max("b").over(ordered().rowsBetween(-9, 0))), 9).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(out) >= 6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_are_kept_and_given_once(spark, small_blocks):
    df = series(spark, SIZES)
    x = numbered(df)
    assert numbered(x) is x
    rows = x.orderBy("symbol", ROW).collect()
    for symbol, n in SIZES.items():
        mine = [r for r in rows if r.symbol == symbol]
        assert [r[ROW] for r in mine] == list(range(n)) and [r.ts for r in mine] == sorted(r.ts for r in mine)
    assert ROW in R.running(x, {"t": R.total(F.col("b"))}).columns and ROW in in_blocks(x, lambda y: y, 1).columns
    assert ROW not in R.running(df, {"t": R.total(F.col("b"))}).columns and ROW not in in_blocks(df, lambda y: y, 1).columns


@pytest.mark.parametrize("rows", [23, 64])
def test_strategies_and_backtests_do_not_depend_on_blocks(spark, monkeypatch, rows):
    import numpy as np
    import pandas as pd

    from barspark.operators import labels, metrics
    from barspark.operators import strategies as S
    from barspark.plans.inputs import bars

    S.register("three_ups", lambda f: pd.Series(np.where(f.close.diff().rolling(3).min() > 0, 1, -1)), look_back=3)
    S.register_columns("two_ups", lambda b: F.when((F.col("close") > F.lag("close").over(ordered())) & (F.lag("close").over(ordered()) > F.lag("close", 2).over(ordered())), 1).otherwise(0), look_back=2)
    b = bars(spark, "/root/testdata/sf0.001").cache()

    def everything():
        x = numbered(b)
        out = {n: sorted((r.symbol, r.ts, r.signal) for r in S.STRATEGIES[n](x).collect()) for n in (*S.STRATEGIES,) if n != "up_bar"}
        s = b.withColumn("signal", F.when(F.col("volume") % 5 == 0, 1).when(F.col("volume") % 7 == 0, -1).otherwise(0).cast("int"))
        out["trades"] = sorted(map(repr, metrics.trades(metrics.with_position(s)).collect()))
        for name, df in (("backtest", metrics.backtest(s)), ("features", labels.feature_frame(b))):
            out[name] = sorted(repr([round(v, 8) if isinstance(v, float) else v for v in r]) for r in df.collect())
        return out

    want = everything()
    monkeypatch.setattr(windows, "BLOCK_ROWS", rows)
    got = everything()
    for name in want:
        assert got[name] == want[name], name
