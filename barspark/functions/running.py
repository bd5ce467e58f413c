"""Values that run from a series' first row to its current one, found block by block: no window holds a whole series.

Each block of rows is folded to a few numbers, the blocks of a series (a few thousandths of its rows) are composed in order, and what comes out is carried into
each block, where windows hold the block alone. ``running`` finds any number of such values in one pass: the series' rows are shuffled once, by series and block."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import windows
from .windows import ROW, _series, numbered


class Frame(NamedTuple):
    """Windows and columns that a value is made of."""

    size: int  #: rows of a block; all but a series' last have so many
    place: Column  #: a row's place in its block, from 0
    block: WindowSpec  #: the rows of a block in order
    upto: WindowSpec  #: those up to the current row
    before: WindowSpec  #: the blocks of a series before the current one
    blocks: WindowSpec  #: the blocks of a series in order


class Value(NamedTuple):
    """A running value: columns that its block needs first, the block's figures, what they add up to over the blocks (columns in steps), and a row's value.

    Names stand for columns of this value alone; each function gets the frame and a function from name to column."""

    local: Callable[[Frame], dict[str, Column]]
    figures: Callable[[Frame, Callable[[str], Column]], dict[str, Column]]
    carry: list[Callable[[Frame, Callable[[str], Column]], dict[str, Column]]]
    value: Callable[[Frame, Callable[[str], Column]], Column]


def _none(_: Frame) -> dict[str, Column]:
    return {}


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def total(c: Column) -> Value:
    """The sum of the values so far, null before the first."""
    return Value(_none, lambda f, k: {"t": F.sum(c)}, [lambda f, k: {"t0": F.sum(k("t")).over(f.before)}], lambda f, k: _plus(k("t0"), F.sum(c).over(f.upto)))


def peak(c: Column) -> Value:
    """The largest value so far."""
    return Value(_none, lambda f, k: {"m": F.max(c)}, [lambda f, k: {"m0": F.max(k("m")).over(f.before)}], lambda f, k: F.greatest(k("m0"), F.max(c).over(f.upto)))


def peak_of_total(c: Column) -> Value:
    """The largest of the sums so far; ``c`` without nulls."""
    return Value(
        lambda f: {"s": F.sum(c).over(f.upto)},
        lambda f, k: {"t": F.sum(c), "m": F.max(k("s"))},
        [lambda f, k: {"t0": F.coalesce(F.sum(k("t")).over(f.before), F.lit(0.0))}, lambda f, k: {"m0": F.max(k("t0") + k("m")).over(f.before)}],
        lambda f, k: F.greatest(k("m0"), k("t0") + F.max(k("s")).over(f.upto)),
    )


def first(c: Column) -> Value:
    """The value of the series' first row, null or not."""
    v = F.struct(c.alias("v"))
    return Value(_none, lambda f, k: {"v": F.min_by(v, F.col(ROW))}, [lambda f, k: {"v0": F.first(k("v")).over(f.blocks)}], lambda f, k: k("v0")["v"])


def latest(c: Column, back: int = 0) -> Value:
    """The last value that isn't null, at or before the row ``back`` rows before the current one."""

    def figures(f: Frame, k: Callable[[str], Column]) -> dict[str, Column]:
        # v{j} leaves out a full block's last j rows
        return {f"v{j}": F.max_by(c, F.when(c.isNotNull() & (f.place < f.size - j), F.col(ROW))) for j in range(max(back, 1))}

    def earlier(f: Frame, k: Callable[[str], Column]) -> dict[str, Column]:
        return {"e": F.last(k("v0"), ignorenulls=True).over(f.before)}

    def carry(f: Frame, k: Callable[[str], Column]) -> dict[str, Column]:
        return {"w": F.array(*[F.lag(F.coalesce(k(f"v{j}"), k("e"))).over(f.blocks) for j in range(max(back, 1))])}

    def value(f: Frame, k: Callable[[str], Column]) -> Column:
        here = F.last(c, ignorenulls=True).over(f.block.rowsBetween(Window.unboundedPreceding, -back))
        return F.coalesce(here, F.get(k("w"), F.greatest(F.lit(back - 1) - f.place, F.lit(0)).cast("int")))

    return Value(_none, figures, [earlier, carry], value)


def lag(c: Column, n: int = 1) -> Value:
    """The value ``n`` rows before, null or not."""
    v = F.struct(c.alias("v"))
    return Value(
        _none,
        lambda f, k: {f"v{j}": F.max(F.when(f.place == f.size - j, v)) for j in range(1, n + 1)},
        [lambda f, k: {"w": F.array(*[F.lag(k(f"v{j}")).over(f.blocks) for j in range(1, n + 1)])}],
        lambda f, k: F.when(f.place >= n, F.lag(c, n).over(f.block)).otherwise(F.get(k("w"), (F.lit(n - 1) - f.place).cast("int"))["v"]),
    )


def lead(c: Column) -> Value:
    """The next row's value, null or not."""
    v = F.struct(c.alias("v"))
    return Value(
        _none, lambda f, k: {"v": F.max(F.when(f.place == 0, v))}, [lambda f, k: {"n": F.lead(k("v")).over(f.blocks)}],
        lambda f, k: F.when(f.place < f.size - 1, F.lead(c).over(f.block)).otherwise(k("n")["v"]),
    )


def running(df: DataFrame, values: dict[str, Value], *keys: str, order: str = "ts") -> DataFrame:
    """``df`` with a column for each of ``values``. A table with ``ROW`` keeps it; others are numbered by ``keys`` (by default the symbol) and ``order`` first."""
    size = windows.BLOCK_ROWS
    at = F.struct(_series(keys or ("symbol",)).alias("series"), F.floor(F.col(ROW) / size).alias("block"))
    x = numbered(df, *keys, order=order).withColumn("__at", at)
    block, blocks = Window.partitionBy("__at").orderBy(ROW), Window.partitionBy("__at.series").orderBy("__at.block")
    f = Frame(size, F.col(ROW) % size, block, block.rowsBetween(Window.unboundedPreceding, 0), blocks.rowsBetween(Window.unboundedPreceding, -1), blocks)
    named = lambda i: lambda n: F.col(f"__v{i}_{n}")
    local = {f"__v{i}_{n}": c for i, v in enumerate(values.values()) for n, c in v.local(f).items()}
    x = x.withColumns(local) if local else x
    b = x.groupBy("__at").agg(*[c.alias(f"__v{i}_{n}") for i, v in enumerate(values.values()) for n, c in v.figures(f, named(i)).items()])
    made = []
    for step in range(max(len(v.carry) for v in values.values())):
        new = {f"__v{i}_{n}": c for i, v in enumerate(values.values()) if step < len(v.carry) for n, c in v.carry[step](f, named(i)).items()}
        b, made = b.withColumns(new), [*made, *new]
    x = x.join(b.select("__at", *made), "__at")
    x = x.withColumns({name: v.value(f, named(i)) for i, (name, v) in enumerate(values.items())}).drop("__at", *local, *made)
    return x if ROW in df.columns else x.drop(ROW)
