"""A user's source over the events table, imported by executors on its own."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, time, timedelta

from ..sources import user

#: Rows that a reader holds at once.
BATCH = 1 << 16


class EventBars(user.BarSource):
    """Daily bars of the events of one type, read from their Parquet files by whichever executor a partition goes to.

    A reader holds a batch of rows and a few figures a day, however large the files are; row groups whose bounds rule out the type or the days aren't read."""

    def _files(self):
        import pyarrow.dataset as ds
        import pyarrow.parquet as pq

        data = ds.dataset(f"{self.options['path']}/events.parquet", format="parquet")
        for path in data.files:
            with data.filesystem.open_input_file(path) as f:
                yield pq.ParquetFile(f, pre_buffer=False, buffer_size=1 << 20, coerce_int96_timestamp_unit="us")

    @staticmethod
    def _bounds(file, group: int, column: str) -> tuple | None:
        """The least and the largest value of a row group by its statistics; ``None`` without them."""
        at = next((i for i in range(file.metadata.num_columns) if file.metadata.schema.column(i).path == column))
        s = file.metadata.row_group(group).column(at).statistics
        if s is None or not s.has_min_max:
            return None
        return tuple(x.replace(tzinfo=None) if isinstance(x, datetime) else x for x in (s.min, s.max))

    def _batches(self, file, groups: list[int], *columns: str):
        return file.iter_batches(BATCH, row_groups=groups, columns=list(columns), use_threads=False)

    def symbols(self):
        import pyarrow.compute as pc

        found = {s for f in self._files() for b in self._batches(f, list(range(f.num_row_groups)), "event_type") for s in pc.unique(b.column(0)).to_pylist()}
        return sorted(found, key=lambda s: (s is None, s))

    def days(self):
        import pyarrow as pa
        import pyarrow.compute as pc

        found = []
        for f in self._files():
            bounds = [self._bounds(f, g, "ts") for g in range(f.num_row_groups)]
            found += [t for b in bounds if b for t in b]
            for b in self._batches(f, [g for g, x in enumerate(bounds) if x is None], "ts"):
                low, high = pc.min_max(b.column(0).cast(pa.timestamp("us"), safe=False)).as_py().values()
                found += [low, high] if low is not None else []
        return min(found).date(), max(found).date() + timedelta(1)

    def bars(self, symbol: str, start: date, end: date) -> Iterator[tuple]:
        low, high = datetime.combine(start, time()), datetime.combine(end, time())
        days: dict[datetime, list] = {}
        for file in self._files():
            groups = []
            for g in range(file.num_row_groups):
                s, t = self._bounds(file, g, "event_type"), self._bounds(file, g, "ts")
                if not (symbol is not None and s and not s[0] <= symbol <= s[1]) and not (t and (t[1] < low or t[0] >= high)):
                    groups.append(g)
            for batch in self._batches(file, groups, "event_id", "event_type", "ts", "value", "props"):
                for day, *new in _by_day(batch, symbol, low, high):
                    days[day] = _folded(days[day], new) if day in days else new
        for day, (first, last, top, least, qty) in sorted(days.items()):
            yield symbol, day, first and first[2], top, least, last and last[2], qty


def _folded(a: list, b: list) -> list:
    """Two parts of a day as one; what a part lacks is ``None``."""
    kinds = (min, max, max, min, lambda x: sum(x))
    return [f([v for v in x if v is not None]) if x != (None, None) else None for f, x in zip(kinds, zip(a, b, strict=True), strict=True)]


def _by_day(batch, symbol: str | None, low: datetime, high: datetime) -> Iterator[tuple]:
    """Of a batch's events of the type within the times, by day: the first and the last ``(ts, id, value)``, the largest and the least value, and the quantity."""
    import pyarrow as pa
    import pyarrow.compute as pc

    t = pa.Table.from_batches([batch])
    ts = t["ts"].cast(pa.timestamp("us"), safe=False)
    own = pc.is_null(t["event_type"]) if symbol is None else pc.equal(t["event_type"], symbol)
    keep = pc.and_(own, pc.and_(pc.greater_equal(ts, pa.scalar(low, pa.timestamp("us"))), pc.less(ts, pa.scalar(high, pa.timestamp("us")))))
    t = t.set_column(t.schema.get_field_index("ts"), "ts", ts).filter(keep)
    if not t.num_rows:
        return
    qty = pc.struct_field(pc.extract_regex(t["props"], r'"k":\s*"?(?P<k>-?\d+)'), "k").cast(pa.int64())
    t = t.select(["event_id", "ts", "value"]).append_column("qty", qty).append_column("day", pc.floor_temporal(t["ts"], unit="day"))
    t = t.sort_by([("ts", "ascending"), ("event_id", "ascending")])
    priced = t.filter(pc.is_valid(t["value"])).group_by("day", use_threads=False)
    priced = priced.aggregate([(c, f) for f in ("first", "last") for c in ("ts", "event_id", "value")] + [("value", "max"), ("value", "min")])
    price = {r["day"]: r for r in priced.to_pylist()}
    for r in t.group_by("day", use_threads=False).aggregate([("qty", "sum")]).to_pylist():
        p = price.get(r["day"])
        ends = [tuple(p[f"{c}_{f}"] for c in ("ts", "event_id", "value")) for f in ("first", "last")] if p else [None, None]
        yield r["day"], *ends, p and p["value_max"], p and p["value_min"], r["qty_sum"]
