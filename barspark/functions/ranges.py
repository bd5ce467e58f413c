"""Totals over all rows that come before in an order of values, without ordering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settled
from .windows import _series


def prefix_totals(df: DataFrame, order: list[Column | str], totals: dict[str, Column], *keys: str) -> DataFrame:
    """``df`` with ``{name}_before``, the sum over the rows before in the order (of a key, if any), and ``{name}_all``, that over all rows.

    Rows are sorted by ranges of values and written; each range adds its own rows to the sums of the ranges before, which are as few as Spark's partitions."""
    x = df.withColumns({f"__o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)} | {f"__t{n}": c for n, c in totals.items()})
    by = [*keys, *[f"__o{i}" for i in range(len(order))]]
    x = settled(x.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    series = _series(keys) if keys else F.struct(F.lit(0).alias("k0"))
    x = x.withColumn("__part", F.struct(series.alias("series"), F.shiftright("__at", 33).alias("range")))
    own, every = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("__part.series")
    before = every.orderBy("__part.range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    t = x.groupBy("__part").agg(*[F.sum(f"__t{n}").alias(f"__s{n}") for n in totals])
    t = t.select("__part", *[zero(F.sum(f"__s{n}").over(before)).alias(f"__b{n}") for n in totals], *[zero(F.sum(f"__s{n}").over(every)).alias(f"{n}_all") for n in totals])
    x = x.join(t, "__part").withColumns({f"{n}_before": F.col(f"__b{n}") + zero(F.sum(f"__t{n}").over(own)) for n in totals})
    return x.select(*df.columns, *[f"{n}_{end}" for n in totals for end in ("before", "all")])
