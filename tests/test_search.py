"""The walk-forward search against the operators that it stands for, with more combinations than one chunk holds, and rows of ranges cut into batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.functions.intervals import join_ranges
from barspark.operators import metrics, search
from barspark.operators import strategies as S
from barspark.plans.inputs import daily

SF = "/root/testdata/sf0.001"


def figures(rows):
    return {(r.params_id, r.symbol, r.fold, r.role): tuple(round(float(v), 7) for v in (r.bars, r.sharpe, r.total_return, r.max_drawdown)) for r in rows}


def test_search_equals_a_backtest_of_each_range(spark):
    bars = daily(spark, SF).where("symbol < 'Brand#23'").cache()
    folds = search.windows(spark, "1996-01-01", "1998-01-01", 360, 120).where("fold = 1")
    params = search.grid(spark, {"fast": [3, 5], "slow": [8, 9], "entry_max": [55, 70]})
    got = figures(search.evaluated(bars, folds, params).collect())
    want = {}
    for f in folds.collect():
        for role, lo, hi in (("train", f.train_start, f.train_end), ("test", f.train_end, f.test_end)):
            day = F.col("ts").cast("date")
            part = bars.where((day >= F.lit(lo)) & (day < F.lit(hi)))
            for p in (params.collect()[0], params.collect()[-1]):
                s = S.STRATEGIES["ema_cross_rsi"](part, p.fast, p.slow, 14, p.entry_max)
                for r in metrics.backtest(s).collect():
                    want[p.params_id, r.symbol, f.fold, role] = tuple(round(float(v), 7) for v in (r.bars, r.sharpe, r.total_return, r.max_drawdown))
    assert want and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert {k[1:] for k in got} == {k[1:] for k in want} and len(got) == 8 * len({k[1:] for k in want})


def test_a_range_does_not_depend_on_batches():
    r = np.random.default_rng(3)
    close = np.round(np.exp(np.cumsum(r.normal(0, 0.02, 400))), 3)
    close[50:60] = close[50]
    params = [(i, f, s, m) for i, (f, s, m) in enumerate([(3, 8, 70.0), (5, 9, 55.0), (9, 21, 100.0)])]
    key = {"symbol": "a", "fold": 0, "role": "train"}
    whole = search._Range(params, 14, 75, 0.0005)
    whole.add(close)
    for cuts in ([1], [5, 14, 15, 16, 200], list(range(1, 400))):
        part = search._Range(params, 14, 75, 0.0005)
        for a, b in zip([0, *cuts], [*cuts, 400]):
            part.add(close[a:b])
        got, want = part.figures(key), whole.figures(key)
        assert (got.bars == want.bars).all() and all(np.allclose(got[c], want[c], atol=1e-12) for c in ("sharpe", "total_return", "max_drawdown"))


def test_the_whole_grid_runs(spark):
    bars = daily(spark, SF).where("symbol < 'Brand#12'").cache()
    folds = search.windows(spark, "1996-01-01", "1997-01-01", 180, 60)
    values = {"fast": list(range(5, 29)), "slow": list(range(20, 80, 2)), "entry_max": list(range(60, 84, 2))}
    res = search.walk_forward_search(bars, folds, search.grid(spark, values))
    n = 24 * 30 * 12
    assert n == 8640 and res.select("params_id").distinct().count() == n
    assert res.count() == n * res.select("fold", "role").distinct().count()
    best = search.best_per_fold(res).collect()
    train = {}
    for r in res.where("role = 'train'").collect():
        train.setdefault(r.fold, []).append((-r.score, r.params_id))
    assert {(r.fold, r.params_id) for r in best} == {(f, min(v)[1]) for f, v in train.items()}
    assert search.top(res).count() == 10
    assert search.walk_forward_search(bars.limit(0), folds, search.grid(spark, values)).count() == 0


def test_ranges_join_by_buckets(spark):
    rows = spark.createDataFrame([(i, f"1996-{m:02d}-{d:02d}") for i, (m, d) in enumerate([(1, 1), (1, 31), (2, 1), (5, 5), (12, 31)])] + [(9, None)], "i int, day string").withColumn("day", F.to_date("day"))
    ranges = spark.createDataFrame([("a", "1996-01-01", "1996-02-01"), ("b", "1996-02-01", "1997-06-01"), ("c", "1996-05-05", "1996-05-05"), ("d", "1990-01-01", "2000-01-01")], "n string, s string, e string")
    ranges = ranges.withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    out = join_ranges(rows, ranges, F.col("day"), "s", "e")
    assert sorted((r.i, r.n) for r in out.collect()) == [(0, "a"), (0, "d"), (1, "a"), (1, "d"), (2, "b"), (2, "d"), (3, "b"), (3, "d"), (4, "b"), (4, "d")]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
