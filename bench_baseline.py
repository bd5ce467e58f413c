
import os
import tempfile
import time

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barspark.functions.windows import in_blocks
from barspark.operators import allocate, labels, metrics, search
from barspark.operators import indicators as ind
from barspark.operators import strategies as S
from barspark.plans.inputs import bars, daily

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
GRID = {"fast": [5, 9, 12], "slow": [20, 26, 50], "entry_max": [60, 65, 70]}
START, END = "1995-01-01", "1999-01-01"


def timed(f) -> float:
    began = time.time()
    f()
    return round(time.time() - began, 2)


def returns_of(f: pd.DataFrame, fast: int = 9, slow: int = 21, most: float = 70) -> float:
    c = f.close
    a, b, d = c.ewm(span=fast, adjust=False).mean(), c.ewm(span=slow, adjust=False).mean(), c.diff().fillna(0)
    up, down = d.clip(lower=0).rolling(14).sum(), (-d).clip(lower=0).rolling(14).sum()
    rsi = 100 * up / (up + down)
    enter, leave = (a > b) & (a.shift() <= b.shift()) & (rsi < most), ((b > a) & (b.shift() <= a.shift())) | (rsi > 75)
    held = pd.Series(np.where(leave, -1.0, np.where(enter, 1.0, np.nan)), c.index).ffill().eq(1).astype(int).shift(fill_value=0)
    r = held * c.pct_change().fillna(0)
    curve = (1 + r).cumprod()
    return float(r.mean() / (r.std() or 1)) + float((curve / curve.cummax() - 1).min())


def barrier(f: pd.DataFrame) -> list:
    tr = pd.concat([f.high - f.low, (f.high - f.close.shift()).abs(), (f.low - f.close.shift()).abs()], axis=1).max(axis=1)
    atr, c, out = tr.rolling(14).mean().to_numpy(), f.close.to_numpy(), []
    for i in range(len(c)):
        later = c[i + 1 : i + 21]
        hit = np.flatnonzero((later >= c[i] + atr[i]) | (later <= c[i] - atr[i]))
        out.append(0 if not len(hit) else 1 if later[hit[0]] > c[i] else -1)
    return out


def main() -> None:
    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.local.dir": tmp, "spark.checkpoint.dir": f"file://{tmp}/shared"}
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    d = daily(spark, SF).cache()
    d.count()
    jobs = {
        "tick to 1 h bars": lambda: noop(bars(spark, SF)),
        "EMA-cross back-test": lambda: noop(metrics.comparison(d, {"x": S.STRATEGIES["ema_cross_rsi"]})),
        "walk-forward, 27 combinations": lambda: noop(search.walk_forward_search(d, search.windows(spark, START, END, 90, 30), search.grid(spark, GRID))),
        "triple barrier": lambda: noop(in_blocks(d, lambda b: labels.triple_barrier(ind.with_atr(b)), 15, 20)),
        "correlations": lambda: noop(allocate.correlation_distance(in_blocks(d, ind.with_returns, 1))),
    }
    mine = {name: [timed(job), timed(job)][1] for name, job in jobs.items()}
    e = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    p = d.orderBy("symbol", "ts").toPandas()
    series = [f.reset_index(drop=True) for _, f in p.groupby("symbol")]
    folds = [(r.train_start, r.train_end, r.test_end) for r in search.windows(spark, START, END, 90, 30).orderBy("fold").collect()]
    spark.stop()

    def ticks():
        e["hour"] = e.ts.dt.floor("h")
        e["k"] = e.props.str.extract(r'"k":\s*(\d+)')[0].astype(float)
        e.sort_values(["ts", "event_id"]).groupby(["event_type", "hour"]).agg(open=("value", "first"), high=("value", "max"), low=("value", "min"), close=("value", "last"), volume=("k", "sum"))

    def walk(some):
        for a, c, z in some:
            for f in series:
                day = f.ts.dt.date
                for part in (f[(day >= a) & (day < c)], f[(day >= c) & (day < z)]):
                    for fast in GRID["fast"]:
                        for slow in GRID["slow"]:
                            for most in GRID["entry_max"]:
                                returns_of(part, fast, slow, most)

    other = {
        "tick to 1 h bars": timed(ticks),
        "EMA-cross back-test": timed(lambda: [returns_of(f) for f in series]),
        "walk-forward, 27 combinations": round(timed(lambda: walk(folds[:1])) * len(folds), 1),
        "triple barrier": timed(lambda: [barrier(f) for f in series]),
        "correlations": timed(lambda: p.assign(r=p.groupby("symbol").close.pct_change()).pivot(index="ts", columns="symbol", values="r").corr()),
    }
    for name in jobs:
        print(f"{name}: Spark {mine[name]} s, pandas loop {other[name]} s{f' (one fold times {len(folds)})' if 'walk' in name else ''}")


if __name__ == "__main__":
    main()
