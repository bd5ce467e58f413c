"""Exact vectors, and results that must not depend on how rows are ordered, blocked or partitioned."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators import allocate, combine, indicators, labels, search


def test_timeframe_votes(spark):
    tf = {"5m": [1, 1, -1, 0, 1], "1h": [1, -1, -1, 1, 1], "1d": [1, 1, 1, 1, 1]}
    frames = {k: spark.createDataFrame([("A", i, s) for i, s in enumerate(v)], "symbol string, day int, signal int") for k, v in tf.items()}
    got = combine.votes(combine.aligned(frames), {k: combine.TIMEFRAME_WEIGHTS[k] for k in tf}).orderBy("day").collect()
    assert [r.majority for r in got] == [1, 1, -1, 1, 1] and [r.unanimous for r in got] == [1, 0, 0, 0, 1] and [r.any_long for r in got][:3] == [1, -1, -1]


def test_daily_last(spark):
    t = pd.date_range("2024-01-01", periods=48, freq="h")
    s = spark.createDataFrame([("A", x.to_pydatetime(), 1 if i < 24 else -1) for i, x in enumerate(t)], "symbol string, ts timestamp_ntz, signal int")
    assert [r.signal for r in combine.daily_last(s).orderBy("day").collect()] == [1, -1]


def test_sector_momentum(spark):
    t = pd.date_range("2024-01-01", periods=6, freq="D")
    b = spark.createDataFrame([("A", x.to_pydatetime(), float(c)) for x, c in zip(t, (99, 100, 101, 102, 103, 106))], "symbol string, ts timestamp_ntz, close double")
    assert combine.sector_momentum(b, 5).first().momentum == 0.06


@pytest.mark.parametrize("block", ["hour", "day", "year"])
def test_recursive_mean_does_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(0)
    t = pd.date_range("2024-01-01", periods=200, freq="17min")
    x = rng.normal(size=200)
    x[rng.random(200) < 0.1] = np.nan
    df = spark.createDataFrame([(s, a.to_pydatetime(), None if np.isnan(v) else float(v)) for a, v in zip(t, x) for s in "AB"], "symbol string, ts timestamp_ntz, close double").orderBy(F.rand(3))
    got = indicators.ewm(df, [("e", "close", 0.2)], block=block).where("symbol = 'A'").orderBy("ts").toPandas()
    want = pd.Series(x).ewm(alpha=0.2, adjust=False, ignore_na=True).mean()
    np.testing.assert_allclose(got.e, want, equal_nan=True)
    assert got.n.tolist() == list(range(1, 201))
    assert indicators.ewm(df.limit(0), [("e", "close", 0.2)]).count() == 0


def test_walk_forward_folds(spark):
    t = pd.date_range("2024-01-01", periods=100, freq="D")
    df = spark.createDataFrame([("A", x.to_pydatetime()) for x in t], "symbol string, ts timestamp_ntz")
    f = labels.walk_forward(df, 40, 20)
    got = {(r.fold, r.role): (r.lo, r.hi) for r in f.groupBy("fold", "role").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).collect()}
    assert got == {(0, "train"): (0, 39), (0, "test"): (40, 59), (1, "train"): (20, 59), (1, "test"): (60, 79), (2, "train"): (40, 79), (2, "test"): (80, 99)}


def test_sizes_and_stops(spark):
    one = spark.range(1)
    r = one.select(allocate.position_size(F.lit(100_000.0), F.lit(100.0), F.lit(2.0)).alias("n"), *[c.alias(k) for k, c in allocate.stops(F.lit(100.0), F.lit(5.0)).items()]).first()
    assert (r.n, r.stop, r.target) == (250, 90.0, 115.0)
    assert one.select(allocate.scaled_risk(F.lit(0.01), F.lit(0.25)).alias("r")).first().r == pytest.approx(0.0125)


def test_grid_and_windows(spark):
    g = search.grid(spark, {"fast": [5, 9], "slow": [20, 30, 40]}).orderBy("params_id").collect()
    assert [(r.params_id, r.fast, r.slow) for r in g] == [(0, 5, 20), (1, 5, 30), (2, 5, 40), (3, 9, 20), (4, 9, 30), (5, 9, 40)]
    w = search.windows(spark, "2023-01-01", "2024-01-01", 90, 30).collect()
    assert len(w) == 9 and str(w[1].train_start) == "2023-01-31"


def test_blocks_give_what_whole_series_give(spark):
    from pyspark.sql import functions as F

    from barspark.functions.windows import in_blocks
    from barspark.operators import indicators, labels

    b = spark.range(700).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("symbol"), (F.lit("2024-01-30").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") * 7 % 700).cast("int"))).alias("ts"), (F.col("id") * 37 % 101 + 10.0).alias("close"))
    b = b.withColumns({"high": F.col("close") + 1, "low": F.col("close") - F.col("close") % 5})
    work = lambda x: labels.triple_barrier(indicators.with_atr(x).withColumns(indicators.bollinger()))
    cols = ("symbol", "ts", "atr", "bb_upper", "label")
    rows = lambda x: sorted(repr((r.symbol, r.ts, *(None if v is None else round(v, 9) for v in r[2:]))) for r in x.select(*cols).collect())
    want = rows(work(b))
    for size in (20, 33, 4096):
        got = in_blocks(b, work, 19, 20, size=size)
        assert rows(got) == want
    seen = in_blocks(b, lambda x: x.withColumn("where", F.col("symbol.block")), 19, 20, size=20)
    assert seen.count() == 700 and seen.select("symbol", "where").distinct().count() >= 34
