"""Queries over trades join them once: rows that leave the join are counted as the query runs."""

import pytest

from barspark.plans import registry  # noqa: F401, I001  loads the plans in their order
from barspark.plans import decisions, inputs, planning

SF = "/root/testdata/sf0.001"


@pytest.fixture
def joined(spark, monkeypatch):
    """Counts the rows that leave ``trades`` wherever the plans use it."""
    n, plain = spark.sparkContext.accumulator(0), inputs.trades

    def count(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    def counted(spark, d):
        t = plain(spark, d)
        return t.mapInArrow(count, t.schema)

    for module in (inputs, planning, decisions):
        monkeypatch.setattr(module, "trades", counted)
    return n


def test_day_summary_joins_trades_once(spark, joined):
    rows = planning.day_summary(spark, SF).collect()
    every = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sum(r.trades for r in rows) == every and joined.value == every


def test_equity_joins_trades_once(spark, joined):
    inputs.equity(spark, SF).collect()
    assert joined.value == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_rebalance_plan_joins_trades_once(spark, joined):
    assert decisions.rebalance_plan(spark, SF).count() == 25
    assert joined.value == spark.read.parquet(f"{SF}/lineitem.parquet").count()
