"""Window frames by symbol and time, with explicit rows, and full-window aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scratch import settled


def trailing(n: int, *keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order).rowsBetween(1 - n, 0)


def ordered(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def upto(*keys: str, order: str = "ts") -> WindowSpec:
    return ordered(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, counted: Column, n: int, w: WindowSpec) -> Column:
    """``value`` over ``w`` where all ``n`` rows are there and not null."""
    return F.when(F.count(counted).over(w) == n, value.over(w))


def mean(c: Column, n: int, *keys: str) -> Column:
    return full(F.avg(c), c, n, trailing(n, *keys))


def crosses_up(a: Column, b: Column, w: WindowSpec) -> Column:
    """Above now and not above in the row before; equal within 1e-9 counts as equal."""
    a, b = F.round(a, 9), F.round(b, 9)
    return F.coalesce((a > b) & (F.lag(a).over(w) <= F.lag(b).over(w)), F.lit(False))


#: Rows of a series in one task's block.
BLOCK_ROWS = 4096
#: A row's number within its series, from 0 in time order.
ROW = "__row"


def _series(keys: Sequence[str]) -> Column:
    """The keys of a series as one value that is never null and that joins and groups by nulls too."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def numbered(df: DataFrame, *keys: str, order: str | Sequence[str] = "ts", piece: str = "month") -> DataFrame:
    """``df`` with ``ROW``, written once, so that all blocks of a job are cut alike; a table that has it already is returned as it is.

    Rows are numbered by the counts of the pieces of time before their own and their place within it, so no series is sorted in one task. Null keys are a series,
    null times its first piece; rows of equal times are numbered in any order, which stays once written."""
    if ROW in df.columns:
        return df
    order = [order] if isinstance(order, str) else list(order)
    kinds = dict(df.dtypes)
    time = F.col(order[0]) if kinds[order[0]] in ("date", "timestamp", "timestamp_ntz") else F.timestamp_seconds(order[0])
    x = df.withColumn("__piece", F.struct(_series(keys or ("symbol",)).alias("series"), F.date_trunc(piece, time).alias("piece")))
    n = x.groupBy("__piece").agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy("__piece.series").orderBy("__piece.piece").rowsBetween(Window.unboundedPreceding, -1))
    x = x.join(n.select("__piece", F.coalesce(earlier, F.lit(0)).alias("__base")), "__piece")
    row = F.col("__base") + F.row_number().over(Window.partitionBy("__piece").orderBy(*order)) - 1
    return settled(x.withColumn(ROW, row).drop("__piece", "__base"), "numbered")


def in_blocks(df: DataFrame, work: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int | None = None, piece: str = "month", order: str = "ts") -> DataFrame:
    """``work(df)`` for windows by symbol that look at most ``before`` rows back and ``after`` ahead, in blocks of ``size`` rows: a series isn't one task.

    Rows near a block's ends are copied to its neighbours. ``work`` sees the symbol and the block together as ``symbol``, adds columns, keeps the others, and may drop rows.
    Null symbols are a series; ``size`` grows to the longer halo if that is larger. A table with ``ROW`` keeps it; others are numbered first."""
    size = max(size or BLOCK_ROWS, before, after)
    x = numbered(df, order=order, piece=piece).withColumns({"__at": F.floor(F.col(ROW) / size), "__place": F.col(ROW) % size})
    home, up, down = (F.struct((F.col("__at") + k).alias("block"), F.lit(k == 0).alias("home")) for k in (0, 1, -1))
    copies = F.array_compact(F.array(home, F.when(F.col("__place") >= size - before, up), F.when(F.col("__place") < after, down)))
    x = x.withColumn("__copy", F.explode(copies)).drop("__at", "__place")
    x = work(x.withColumn("symbol", F.struct(F.col("symbol").alias("name"), F.col("__copy.block").alias("block"))).withColumn("__home", F.col("__copy.home")).drop("__copy"))
    x = x.where("__home").withColumn("symbol", F.col("symbol.name")).drop("__home")
    return x if ROW in df.columns else x.drop(ROW)
