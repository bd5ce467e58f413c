"""Models, areas under curves, block products and hierarchical weights against brute force; user sources in batch and stream."""

import random
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.functions.ranges import prefix_totals
from barspark.operators import allocate, labels, models
from barspark.plans.event_source import EventBars
from barspark.sources import io, user
from barspark.streaming import jobs

SF = "/root/testdata/sf0.001"
NAMES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 3))
    out = []
    for i in range(600):
        f = [float(v) for v in x[i]]
        f[1] = None if i % 17 == 0 else float("nan") if i % 19 == 0 else f[1]
        y = int(x[i, 0] + 0.2 * r.normal() > 0.8)
        out.append((i, *f, None if i % 50 == 0 else y, i % 3, "test" if i % 3 == (i // 3) % 3 else "train"))
    return spark.createDataFrame(out, "id int, f0 double, f1 double, f2 double, label int, part int, role string").cache()


def test_a_model_scores_saves_and_loads(spark, rows, tmp_path):
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    m = models.fit(train, NAMES, maxIter=8, maxDepth=3, stepSize=0.3)
    s = models.score(m, test.select("f2", "id", "f0", "label", "f1"))
    assert s.columns == ["f2", "id", "f0", "label", "f1", "p"] and s.count() == test.count()
    auc = labels.roc_auc(s.where("label is not null").withColumn("y", F.col("label"))).first().auc
    assert auc > 0.95
    models.save(m, f"file://{tmp_path}/m")
    models.save(m, f"file://{tmp_path}/m")
    again = models.load(spark.newSession(), f"file://{tmp_path}/m")
    assert models.feature_names(again) == NAMES
    assert {r.id: r.p for r in models.score(again, test).collect()} == {r.id: r.p for r in s.collect()}
    assert max(models.importances(m), key=models.importances(m).get) == "f0"
    with pytest.raises(ValueError, match="f1"):
        models.score(m, test.drop("f1"))
    with pytest.raises(ValueError, match="both classes"):
        models.fit(train.where("label = 1"), NAMES)


def test_balanced_classes_weigh_alike(spark, rows):
    low, high = models.class_weights(rows, "label")
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    assert low * n[0] == pytest.approx(high * n[1]) and low * n[0] + high * n[1] == pytest.approx(n[0] + n[1])


def test_folds_are_held_out(spark, rows):
    x = rows.withColumn("fold", F.col("part"))
    s = models.held_out(x, NAMES, parallel=2, maxIter=4, maxDepth=2)
    assert sorted((r.fold, r.id) for r in s.collect()) == sorted((r.part, r.id) for r in rows.where("role = 'test'").collect())
    assert s.where("p is null or p < 0 or p > 1").count() == 0
    assert models.held_out(x.where("label = 0"), NAMES).count() == 0


def test_areas_by_group_equal_all_pairs(spark):
    r = random.Random(2)
    data = [(g, r.choice([0, 1]), r.choice([0.1, 0.2, 0.5, 0.9]) if g != "c" else 0.5) for g in "aabbbc" for _ in range(30)] + [("one", 1, 0.3), ("one", 1, None)]
    df = spark.createDataFrame(data, "g string, y int, p double").repartition(5)
    got = {x.g: x for x in labels.roc_auc(df, "g").collect()}
    for g in "abc":
        pos, neg = ([p for k, y, p in data if k == g and y == v] for v in (1, 0))
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        ap = sum(sum(q >= p for q in pos) / (sum(q >= p for q in pos) + sum(q >= p for q in neg)) for p in pos) / len(pos)
        assert got[g].auc == pytest.approx(auc) and got[g].average_precision == pytest.approx(ap)
    assert got["one"].auc is None and got["one"].average_precision == 1.0
    assert "SinglePartition" not in labels.roc_auc(df, "g")._jdf.queryExecution().toString()


def test_prefix_totals(spark):
    r = random.Random(4)
    data = [(i, r.choice(["a", "b", None]), r.randint(0, 40), r.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "i int, g string, v int, w int").repartition(7)
    for keys in ((), ("g",)):
        got = {x.i: (x.t_before, x.t_all) for x in prefix_totals(df, ["v", "i"], {"t": F.col("w")}, *keys).collect()}
        for i, g, v, _ in data:
            mine = [x for x in data if not keys or x[1] == g]
            assert got[i] == (sum(x[3] for x in mine if (x[2], x[0]) < (v, i)), sum(x[3] for x in mine))


def returns(spark, symbols=9, days=40, seed=3, keys=1):
    r = np.random.default_rng(seed)
    common = r.normal(size=(days, 3))
    out = []
    for s in range(symbols):
        for d in range(days):
            if r.random() < 0.9:
                v = float(common[d, s % 3] + 0.5 * r.normal()) if s else 0.25
                out.append((d % keys, f"s{s}", datetime(2020 + d // 20, 1, 1 + d % 20), None if r.random() < 0.05 else v))
    return out, spark.createDataFrame(out, "day int, symbol string, ts timestamp_ntz, ret double")


@pytest.mark.parametrize("block", [64, 2])
def test_block_products_equal_pairs(spark, monkeypatch, block):
    data, df = returns(spark)
    got = {(x.a, x.b): x for x in allocate.gram(df, block=block).collect()}
    at = {}
    for _, s, t, v in data:
        at.setdefault(s, {})[t] = v
    names = sorted(at)
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    for (a, b), x in got.items():
        common = set(at[a]) & set(at[b])
        both = [(at[a][t], at[b][t]) for t in common if at[a][t] is not None and at[b][t] is not None]
        assert x.n == len(common) and x.m == len(both)
        c = x.sab / x.m - x.sa * x.sb / x.m**2
        want = np.cov(*np.array(both).T, bias=True)[0, 1]
        assert c == pytest.approx(want, abs=1e-9)


def by_hand(names, corr):
    """Ward's merges by sums of squares of all pairs, and weights from the root down, leaf by leaf."""
    d2 = {(a, b): (1 - corr[a][b]) / 2 for a in names for b in names}
    clusters = [[n] for n in names]
    merges = []

    def between(x, y):
        cross = sum(d2[a, b] for a in x for b in y) / (len(x) * len(y))
        inner = lambda z: sum(d2[a, b] for a in z for b in z) / (2 * len(z) ** 2)
        return 2 * len(x) * len(y) / (len(x) + len(y)) * (cross - inner(x) - inner(y))

    while len(clusters) > 1:
        pairs = [(round(between(x, y), 10), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j]
        _, i, j = min(pairs)
        merges.append((clusters[i], clusters[j]))
        clusters[i] = clusters[i] + clusters[j]
        del clusters[j]
    w = dict.fromkeys(names, 1.0)
    var = lambda m: max(sum(corr[a][b] for a in m for b in m) / len(m) ** 2, 1e-12)
    for left, right in merges:
        for m, other in ((left, right), (right, left)):
            for s in m:
                w[s] *= var(other) / (var(left) + var(right))
    return w


def test_hierarchical_weights_by_hand(spark):
    data, df = returns(spark, symbols=8, days=40, keys=2)
    got = {}
    for x in allocate.hierarchical_risk_parity(df, "day").collect():
        got.setdefault(x.day, {})[x.symbol] = x.weight
    corr = {}
    for x in allocate.correlation_distance(df, "day").collect():
        corr.setdefault(x.day, {})[x.a, x.b] = x.corr or 0.0
    assert set(got) == {0, 1}
    for day, w in got.items():
        names = sorted(w)
        c = {a: {b: 1.0 if a == b else corr[day].get((min(a, b), max(a, b)), 0.0) for b in names} for a in names}
        want = by_hand(names, c)
        assert sum(w.values()) == pytest.approx(1) and all(w[n] == pytest.approx(want[n] / sum(want.values()), abs=1e-9) for n in names)


def test_hierarchical_weights_edges(spark):
    one = spark.createDataFrame([(1, "a", datetime(2020, 1, d), 0.1 * d) for d in (1, 2, 3)] + [(2, s, datetime(2020, 1, d), 0.1 * d) for s in "xyz" for d in (1, 2, 3)] + [(3, "n", datetime(2020, 1, 1), None)], "day int, symbol string, ts timestamp_ntz, ret double")
    got = {(r.day, r.symbol): r.weight for r in allocate.hierarchical_risk_parity(one, "day").collect()}
    assert got[1, "a"] == 1.0 and (3, "n") not in got
    assert sum(got[2, s] for s in "xyz") == pytest.approx(1)
    assert allocate.hierarchical_risk_parity(one.limit(0), "day").count() == 0


def test_a_user_source_in_batch_and_stream(spark, tmp_path):
    every = user.read_source(spark, EventBars, path=SF, days=3)
    rows = {(r.symbol, r.ts): r.volume for r in every.collect()}
    assert len({s for s, _ in rows}) == 5 and every.rdd.getNumPartitions() > 10
    few = user.read_source(spark, EventBars, path=SF, days=3).where("symbol = 'click' and ts < timestamp_ntz '2024-01-09'")
    assert {(r.symbol, r.ts) for r in few.collect()} == {k for k in rows if k[0] == "click" and k[1] < datetime(2024, 1, 9)}
    assert few.rdd.getNumPartitions() <= 4
    assert user.read_source(spark, EventBars, path=SF).where("symbol = 'nothing'").count() == 0
    out = jobs.run(user.stream_source(spark, EventBars, path=SF, days=10), f"file://{tmp_path}/s")
    assert {(r.symbol, r.ts): r.volume for r in out.collect()} == rows
    again = jobs.run(user.stream_source(spark, EventBars, path=SF, days=10), f"file://{tmp_path}/s")
    assert again.count() == len(rows)


def test_event_bars_hold_a_batch_and_not_the_file(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from barspark.plans import event_source

    n = 200_000
    rng = np.random.default_rng(3)
    ts = np.datetime64("2024-01-01", "us") + rng.integers(0, 4 * 86_400_000_000, n).astype("timedelta64[us]")
    events = pd.DataFrame({"event_id": np.arange(n), "event_type": rng.choice(["a", "b"], n), "ts": np.sort(ts), "value": rng.normal(size=n).round(2), "props": [f'{{"k": {k}}}' + " " * 400 for k in rng.integers(-5, 50, n)]})
    events.loc[rng.random(n) < 0.01, "value"] = None
    events.loc[rng.random(n) < 0.01, "props"] = None
    shuffled = events.sample(frac=1, random_state=1)
    (tmp_path / "events.parquet").mkdir()
    for i, half in enumerate((shuffled[: n // 2], shuffled[n // 2 :])):
        pq.write_table(pa.Table.from_pandas(half, preserve_index=False), tmp_path / "events.parquet" / f"{i}.parquet", row_group_size=30_000)
    monkeypatch.setattr(event_source, "BATCH", 1000, raising=False)
    source = EventBars({"path": str(tmp_path)})
    assert source.symbols() == ["a", "b"] and source.days() == (date(2024, 1, 1), date(2024, 1, 5))
    f = events[(events.event_type == "a") & (events.ts >= "2024-01-02") & (events.ts < "2024-01-04")].copy()
    f["qty"] = f.props.str.extract(r'"k": (-?\d+)')[0].astype(float)
    want = []
    for day, g in f.groupby(f.ts.dt.normalize()):
        v = g.value.dropna()
        want.append(("a", day.to_pydatetime(), v.iloc[0], v.max(), v.min(), v.iloc[-1], int(g.qty.sum())))
    list(source.bars("a", date(2024, 1, 2), date(2024, 1, 3)))
    pool = pa.proxy_memory_pool(pa.default_memory_pool())
    before, old = pool.max_memory(), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        assert list(source.bars("a", date(2024, 1, 2), date(2024, 1, 4))) == want
    finally:
        pa.set_memory_pool(old)
    assert (pool.max_memory() or 0) - (before or 0) < 30 << 20  # the texts alone are 80 MB


def test_pushed_filters_leave_partitions_out():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    reader = user._Reader({"class": f"{EventBars.__module__}:EventBars", "path": SF, "days": "1"})
    whole = reader.partitions()
    kept = list(reader.pushFilters([In(("symbol",), ("click", "view")), EqualTo(("symbol",), "click"), GreaterThanOrEqual(("ts",), datetime(2024, 1, 3, 5)), LessThan(("ts",), datetime(2024, 1, 5, 1))]))
    parts = reader.partitions()
    assert [type(f) for f in kept] == [GreaterThanOrEqual, LessThan] and len(whole) > 100
    assert {p.symbol for p in parts} == {"click"} and [p.start for p in parts] == ["2024-01-03", "2024-01-04", "2024-01-05"] and parts[-1].end == date(2024, 1, 6).isoformat()


def test_equity_files_append_and_skip_bad_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    rows = lambda *v: spark.createDataFrame([("s", datetime(2024, 1, i + 1), x) for i, x in enumerate(v)], "strategy string, ts timestamp_ntz, equity string")
    io.append_curves(rows("1.5", "bad"), path)
    io.append_curves(rows("", "2"), path)
    assert sorted(r.equity for r in io.read_curves(spark, path).collect()) == [1.5, 2.0]
    c = io.read_curves(spark, path)
    assert sorted(r.equity for r in io.curves_from_json(io.curves_to_json(c)).collect()) == [1.5, 2.0]
