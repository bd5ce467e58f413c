"""State by key over several micro-batches and restarts: late and repeated rows, idle keys, finished trades."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from barspark.streaming import jobs

BARS = "symbol string, ts timestamp_ntz, close double"
T0 = datetime(2024, 1, 1)


def feed(spark, path, rows):
    spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(path)


def crossed(spark, path, out):
    """One more run from the checkpoint: what arrived since is the next micro-batch."""
    return jobs.run(jobs.running_cross(spark.readStream.schema(BARS).parquet(path)), out)


@pytest.fixture
def paths(tmp_path):
    return f"file://{tmp_path}/in", f"file://{tmp_path}/out"


def ema(x, n):
    return pd.Series(x).ewm(span=n, adjust=False).mean().to_numpy()


def test_state_goes_on_over_restarts_and_drops_late_and_repeated_rows(spark, paths):
    r = np.random.default_rng(2)
    close = {s: np.round(50 + np.cumsum(r.normal(size=60)), 3) for s in "ab"}
    bar = lambda s, i: (s, T0 + timedelta(hours=i), float(close[s][i]))
    feed(spark, paths[0], [bar(s, i) for s in "ab" for i in range(25)])
    assert crossed(spark, *paths).count() == 50
    feed(spark, paths[0], [bar(s, i) for s in "ba" for i in range(20, 40)] + [bar("a", 39), ("b", T0 + timedelta(hours=3), 999.0)])
    crossed(spark, *paths)
    feed(spark, paths[0], [bar("a", i) for i in range(40, 60)])
    rows = crossed(spark, *paths).collect()
    for s, n in (("a", 60), ("b", 40)):
        got = sorted((x.ts, x.fast, x.slow) for x in rows if x.symbol == s)
        assert [g[0] for g in got] == [T0 + timedelta(hours=i) for i in range(n)]
        assert np.allclose([g[1] for g in got], ema(close[s][:n], 9)) and np.allclose([g[2] for g in got], ema(close[s][:n], 21))


def test_idle_keys_are_forgotten(spark, paths):
    later = T0 + timedelta(days=jobs.IDLE_DAYS + 5)
    feed(spark, paths[0], [("a", T0 + timedelta(hours=i), 10.0 + i) for i in range(5)])
    crossed(spark, *paths)
    for k in range(2):  # the watermark moves after the batch that brings later rows
        feed(spark, paths[0], [("b", later + timedelta(hours=k), 5.0)])
        crossed(spark, *paths)
    feed(spark, paths[0], [("a", later + timedelta(hours=3), 100.0)])
    rows = {(x.symbol, x.ts): x for x in crossed(spark, *paths).collect()}
    new = rows["a", later + timedelta(hours=3)]
    assert (new.fast, new.slow) == (100.0, 100.0)  # starts anew
    assert rows["b", later + timedelta(hours=1)].fast == 5.0 and len(rows) == 8


def test_a_trade_leaves_once(spark, paths):
    trades = spark.createDataFrame([("a", 1, T0, 100.0)], "symbol string, trade_id long, entry_ts timestamp_ntz, entry_price double")

    def left():
        return jobs.run(jobs.exits(spark.readStream.schema(BARS).parquet(paths[0]), trades), paths[1])

    feed(spark, paths[0], [("a", T0 + timedelta(days=d), 101.0) for d in (1, 2)])
    assert left().count() == 0
    feed(spark, paths[0], [("a", T0 + timedelta(days=3), 85.0), ("a", T0 + timedelta(days=4), 80.0)])
    assert [(x.exit_ts, x.exit_price, x.why) for x in left().collect()] == [(T0 + timedelta(days=3), 85.0, "stop")]
    feed(spark, paths[0], [("a", T0 + timedelta(days=5), 70.0)])
    assert left().count() == 1
