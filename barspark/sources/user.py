"""Bars of a user's own source, through Spark's Python data sources: in partitions, with pushed-down filters, in batch or as a stream."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .io import BARS

#: Batches of Arrow rows that a source hands over at once.
Row = tuple


class BarSource(ABC):
    """What a user writes: the symbols there are, and the bars of one symbol within days. Instances are made on executors from the options alone.

    Bars are ``(symbol, ts, open, high, low, close, volume)``; those outside of the days are dropped by Spark."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    @abstractmethod
    def symbols(self) -> Iterable[str]: ...

    @abstractmethod
    def days(self) -> tuple[date, date]:
        """The first day, and the day after the last: for a stream, as of now."""

    @abstractmethod
    def bars(self, symbol: str, start: date, end: date) -> Iterator[Row]:
        """Bars with ``start <= day < end``."""


@dataclass
class Part(InputPartition):
    symbol: str
    start: str
    end: str

    def __init__(self, symbol: str, start: date, end: date):
        super().__init__(None)
        self.symbol, self.start, self.end = symbol, start.isoformat(), end.isoformat()


def _source(options: dict[str, str]) -> BarSource:
    module, name = options["class"].rsplit(":", 1)
    return getattr(import_module(module), name)(options)


def _parts(symbols: Iterable[str], start: date, end: date, days: int) -> list[Part]:
    spans = [start + timedelta(k) for k in range(0, max((end - start).days, 0), days)]
    return [Part(s, a, min(a + timedelta(days), end)) for s in symbols for a in spans]


def _read(options: dict[str, str], part: Part) -> Iterator[Row]:
    return _source(options).bars(part.symbol, date.fromisoformat(part.start), date.fromisoformat(part.end))


class _Reader(DataSourceReader):
    """A partition a symbol and span of days; filters on ``symbol`` and bounds on ``ts`` leave partitions out."""

    def __init__(self, options: dict[str, str]):
        self.options, self.only, self.low, self.high = options, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = f.attribute if hasattr(f, "attribute") else None
            if at == ("symbol",) and isinstance(f, EqualTo | In):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = found if self.only is None else self.only & found
                continue
            if at == ("ts",) and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.low = max(filter(None, (self.low, f.value.date())))
            if at == ("ts",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.high = min(filter(None, (self.high, f.value.date() + timedelta(1))))
            yield f  # within a day Spark compares the times itself

    def partitions(self) -> Sequence[Part]:
        s = _source(self.options)
        start, end = s.days()
        start, end = max(filter(None, (start, self.low))), min(filter(None, (end, self.high)))
        return _parts([x for x in s.symbols() if self.only is None or x in self.only], start, end, int(self.options.get("days", 365))) or [Part("", start, start)]

    def read(self, part: Part) -> Iterator[Row]:
        return _read(self.options, part) if part.start < part.end else iter(())


class _StreamReader(DataSourceStreamReader):
    """The offset is a day: a micro-batch holds the days that have come since, each of them once, also after a restart."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"day": _source(self.options).days()[0].isoformat()}

    def latestOffset(self) -> dict:
        return {"day": _source(self.options).days()[1].isoformat()}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        return _parts(_source(self.options).symbols(), date.fromisoformat(start["day"]), date.fromisoformat(end["day"]), int(self.options.get("days", 365)))

    def read(self, part: Part) -> Iterator[Row]:
        return _read(self.options, part)

    def commit(self, end: dict) -> None:
        pass


class BarDataSource(DataSource):
    """``spark.read.format("bars").option("class", "module:Class")``: bars of a ``BarSource``; ``days`` is a partition's span."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def _options(source: type[BarSource], options: dict) -> dict[str, str]:
    return {"class": f"{source.__module__}:{source.__qualname__}"} | {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}


def read_source(spark: SparkSession, source: type[BarSource], **options) -> DataFrame:
    """All bars of a user's source; its module must be importable on the executors."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarDataSource)
    return spark.read.format("bars").options(**_options(source, options)).load()


def stream_source(spark: SparkSession, source: type[BarSource], **options) -> DataFrame:
    """The same as a stream: each trigger brings the days that are new."""
    spark.dataSource.register(BarDataSource)
    return spark.readStream.format("bars").options(**_options(source, options)).load()
