"""Repeated passages: every byte that lies in a string of ``length`` bytes which also starts anywhere else is removed.

The suffixes are ordered column by column: each round inserts one symbol of every text, from right to left, and updates the collection's
Burrows-Wheeler order and the common prefixes of neighbours from those of the round before (a stable sort by the new symbol, and minima over the prefixes that it
brings together). Two suffixes with a common prefix of ``length`` bytes are a repeated passage.

So that this runs on many machines, texts are first cut into pieces at anchors: of the grams of ``gram`` bytes within a window of ``length`` bytes, the leftmost with the
least hash. Equal windows have equal anchors at equal places, so a piece (all windows of one anchor, some hundred bytes more than ``length``) need only be
compared to those of an equal anchor, and only to their suffixes of the same column: rounds count columns from the anchor, and a round's order holds that column's suffixes.
Pieces whose anchor stands but once go; equal pieces are one with a weight. An anchor with more than ``KINDS`` different pieces is cut anew by longer grams, up to the whole window,
where equal anchors are equal windows: no group is gathered, and none is left out. Whole texts are shuffled once, into buckets by their place, which pieces and spans then come to. What a round reads and writes in sequence are Spark's sorted shuffle files and one matrix of columns a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize
from .text_bytes import BYTES, column_bytes, frees, mixed, parts

LENGTH, GRAM = 400, 32
#: Different pieces of one anchor that are ordered together, bytes of pieces in one batch of rounds, and bytes of text that are hashed at once.
KINDS, BATCH, STRETCH = 1024, 1 << 21, 1 << 18
#: Bits of a row's place within its partition, in bytes of text.
PLACE_BITS = 40
_M = 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_M, pow(_M, -1, 1 << 64)))
        _POWERS[0] = have
    return have


def pieces(x: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The pieces of the texts ``x[ends[i]:ends[i + 1]]`` (from 0): anchor's hash, content's hash, start in ``x``, the anchor's offset in the piece, and its number of windows."""
    size = len(x)
    if size < length:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    power, inverse = _powers(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(BYTES[x] * power[:size], out=total[1:])
    raw = (total[gram:] - total[:-gram]) * inverse[: size - gram + 1]
    key = raw ^ (raw >> np.uint64(31))
    key *= np.uint64(0x9E3779B97F4A7C15)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(key), dtype=np.uint64)
    w = length - gram + 1
    full = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(key)] = key
    block = full.reshape(-1, w)
    head = np.minimum.accumulate(block, axis=1).ravel()
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = size - length + 1
    least = np.minimum(tail[:n], head[w - 1 : w - 1 + n])
    mark = np.zeros(n + 1, np.int8)
    long = np.diff(ends) >= length
    np.add.at(mark, ends[:-1][long], 1)
    np.add.at(mark, ends[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(mark[:-1]))
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(first)
    windows, start, anchor = np.diff(begin, append=len(at)), at[first], anchor[first]
    content = mixed((total[start + windows + length - 1] - total[start]) * inverse[start])
    return mixed(raw[anchor] + np.uint64(gram)), content, start, anchor - start, windows


def _stretches(size: int, length: int) -> list[tuple[int, int]]:
    """A long text's parts, each with the bytes that its last window reaches."""
    return [(a, min(a + STRETCH + length - 1, size)) for a in range(0, max(1, size - length + 1), STRETCH)]


@frees
def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << PLACE_BITS
    for b in batches:
        ends = column_bytes(b.column(b.num_columns - 1))[1]
        sizes = np.maximum(np.diff(ends), 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at + np.cumsum(sizes) - sizes, pa.int64())], [*b.schema.names, "at"])
        at += int(sizes.sum())


def _place(texts: DataFrame) -> DataFrame:
    """``texts``, whose last column is the text, with ``at``: its place among all bytes, a number of its own and in the order of places. To be written before use."""
    return texts.mapInArrow(_placed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", at long")


def _cut(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """All pieces of ``texts`` (``at, text, weight``): ``h, c, at, start, lo, n, weight``."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "at", "start", "lo", "n", "weight"]
        for b in batches:
            data, ends = column_bytes(b.column(1))
            at, weight = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for i, j in parts(ends, STRETCH):
                a, z = int(ends[i]), int(ends[j])
                spans = [(0, z - a)] if j - i > 1 else _stretches(z - a, length)
                for p, q in spans:
                    edges = ends[i : j + 1] - a if j - i > 1 else np.array([0, q - p])
                    h, c, start, lo, n = pieces(data[a + p : a + q], edges, length, gram)
                    row = np.searchsorted(edges, start, "right") - 1
                    cols = [h.view(np.int64), c.view(np.int64), at[i + row], start - edges[row] + p, lo.astype(np.int32), n.astype(np.int32), weight[i + row]]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names)

    return texts.select("at", "text", "weight").mapInArrow(run, "h long, c long, at long, start long, lo int, n int, weight int")


def rounds(texts: list[bytes], groups: np.ndarray, lo: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Columns from the right to the left, each with the texts whose suffix from there shares ``length`` bytes with a neighbour's of its group.

    ``groups`` ascends; ``lo`` is each text's offset of the anchor, which stands in one column for all. Texts that have no symbol in a column stand first in their group
    and share nothing."""
    m = len(texts)
    size = np.array([len(t) for t in texts])
    shift = int(lo.max()) - lo
    width = int((shift + size).max())
    columns = np.zeros((width, m), np.uint16)  # a symbol is its byte and one
    flat = np.frombuffer(b"".join(texts), np.uint8)
    who = np.repeat(np.arange(m), size)
    columns[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + shift[who], who] = flat.astype(np.uint16) + 1
    groups = np.unique(groups, return_inverse=True)[1]
    groups = groups.astype(np.uint16 if m <= 1 << 16 else np.int64)
    together = np.zeros(m, bool)
    together[1:] = groups[1:] == groups[:-1]
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    for j in range(width - 1, -1, -1):
        s = columns[j][order]
        same = together.copy()
        same[1:] &= (s[1:] == s[:-1]) & (s[1:] > 0)
        fell = together[1:] & (s[1:] < s[:-1])
        new = np.where(same, common[:-1] + 1, 0)
        if fell.any():
            mixed_up = np.zeros(int(groups[-1]) + 1, bool)
            mixed_up[groups[1:][fell]] = True
            sub = np.flatnonzero(mixed_up[groups])
            by = np.argsort(s[sub], kind="stable")
            old = sub[by[np.argsort(groups[sub][by], kind="stable")]]
            s_new = s[old]
            alike = np.zeros(len(sub), bool)
            alike[1:] = (s_new[1:] == s_new[:-1]) & (s_new[1:] > 0) & (groups[old[1:]] == groups[old[:-1]])
            new[sub] = 0
            t = np.flatnonzero(alike)
            if len(t):
                pairs = np.empty(2 * len(t), np.int64)
                pairs[::2], pairs[1::2] = old[t - 1] + 1, old[t] + 1
                new[sub[t]] = np.minimum.reduceat(common, pairs)[::2] + 1
            order[sub] = order[old]
        common[:-1] = new
        if width - j >= length:
            hit = new >= length
            if hit.any():
                hit[:-1] |= hit[1:]
                yield j, order[hit]


def _found(groups: np.ndarray, lo: np.ndarray, windows: np.ndarray, weight: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of repeated windows of a batch's pieces: which piece, the first and the last."""
    most = int(lo.max())
    hits = np.zeros((len(texts), int(windows.max()) + 1), bool)
    for j, who in rounds(texts, groups, lo, length):
        hits[who, j - most + lo[who]] = True
    again = np.flatnonzero(weight > 1)  # suffixes of a text that stands twice share all of it
    for i in again:
        hits[i, : windows[i]] = True
    edge = np.diff(np.pad(hits, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    who, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return who, first, last


def _ordered(found: DataFrame, length: int) -> DataFrame:
    """``h, c, first, last``: the runs of repeated windows of the pieces ``h, c, lo, n, weight, text``, whole anchors in one task, many in a batch."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.Table) -> pa.RecordBatch:
            h, c, lo, n, weight = (batch.column(i).to_numpy() for i in range(5))
            who, first, last = _found(h, lo, n, weight, batch.column(5).to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (h[who], c[who], first.astype(np.int32), last.astype(np.int32))], ["h", "c", "first", "last"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                h = b.column(0).to_numpy()
                reach = np.cumsum(np.diff(column_bytes(b.column(5))[1]))
                room = BATCH - sum(x.nbytes for x in held)
                cut = np.flatnonzero(h[1:] != h[:-1]) + 1
                if held and (len(held[-1]) and held[-1].column(0)[-1].as_py() != h[0]):
                    cut = np.concatenate([[0], cut])
                over = cut[reach[np.maximum(cut - 1, 0)] >= room] if room > 0 else cut
                if not len(over):
                    held.append(b)
                    break
                at = int(over[0])
                if at:
                    held.append(b.slice(0, at))
                yield out(pa.Table.from_batches(held))
                held, b = [], b.slice(at)
        if held:
            yield out(pa.Table.from_batches(held))

    cols = ["h", "c", "lo", "n", "weight", "text"]
    return found.select(*cols).repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, c long, first int, last int")


def _fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The pieces ``wanted`` (``h, c, at, start, lo, n, weight``) with their bytes, cut out of the texts in which they stand."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "lo", "n", "weight", "text"]
        for b in batches:
            data, ends = column_bytes(b.column(1))
            lists = b.column(0)
            edge, f = lists.offsets.to_numpy(), lists.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(edge))
            start = f.field("start").to_numpy() + ends[:-1][row]
            size = f.field("n").to_numpy().astype(np.int64) + length - 1
            stop = np.cumsum(size)
            for i, j in parts(np.concatenate([[0], stop]), BATCH):
                text = [data[s : s + z].tobytes() for s, z in zip(start[i:j].tolist(), size[i:j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(f.field(c).slice(i, j - i) for c in names[:-1]), pa.array(text, pa.binary())], names)

    lists = wanted.groupBy("at").agg(F.collect_list(F.struct("h", "c", "start", "lo", "n", "weight")).alias("list"))
    return texts.select("at", "text").join(lists, "at").select("list", "text").mapInArrow(run, "h long, c long, lo int, n int, weight int, text binary")


def _windows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``at, first, last``: runs of repeated windows of each of ``texts`` (a written table ``at, text, weight``), by their offsets in the text."""
    cut = _cut(texts, length, gram)
    kinds = cut.groupBy("h", "c").agg(F.sum("weight").alias("w"), F.min("at").alias("at"), F.min(F.col("at") + F.col("start")).alias("place"), F.max("lo").alias("lo"), F.max("n").alias("n"))
    kinds = materialize(kinds.select("h", "c", "at", (F.col("place") - F.col("at")).alias("start"), "lo", "n", F.least("w", F.lit(2)).cast("int").alias("weight")), "pieces")
    # Written before the join, so that Spark can split an anchor of very many pieces.
    anchors = materialize(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("weight").alias("all")).where("`all` > 1").drop("all"), "anchors")
    wanted = materialize(kinds.join(anchors, "h"), "candidates")
    discard(kinds)
    discard(anchors)
    found = _ordered(_fetched(texts, wanted.where(F.col("kinds") <= KINDS), length), length)
    hot = wanted.where(F.col("kinds") > KINDS)
    if not hot.isEmpty():
        longer = min(length, (gram + length + 1) // 2)
        again = materialize(_place(_fetched(texts, hot, length).select("h", "c", "weight", "text")), "hot-pieces")
        deeper = _windows(again, length, longer).join(again.select("at", "h", "c"), "at").select("h", "c", "first", "last")
        found = found.unionByName(deeper.select("h", "c", F.col("first").cast("int"), F.col("last").cast("int")))
    runs = materialize(found.groupBy("h", "c").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    discard(wanted)
    each = cut.select("h", "c", "at", "start").join(runs, ["h", "c"]).select("at", "start", F.explode("runs").alias("run"))
    return each.select("at", (F.col("start") + F.col("run.first")).alias("first"), (F.col("start") + F.col("run.last")).alias("last"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes`` of its text in UTF-8, ``spans`` (start and end of each maximal removed run) and ``kept``, the
    remaining bytes (cuts may fall within a character).

    Strings are judged on the input, may overlap and never cross documents. A null text is empty; ids stay as they are, null and repeated ones too; equal rows are repeats of each
    other; texts shorter than ``length`` stay whole; further columns are ignored. ``docs`` must give a repeated task the same rows in the same order, as files do."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.lit(1).alias("weight"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # The whole texts move here and nowhere else: the pieces wanted, anew for anchors of many pieces, and the spans found go to their buckets.
    texts = bucketed(_place(d), "at", "texts")
    spans = _windows(texts, length, min(gram, length)).groupBy("at").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            data, ends = column_bytes(b.column(1))
            for i in range(b.num_rows):
                x, spans = data[ends[i] : ends[i + 1]], []
                runs = b.column(2)[i]
                if runs.is_valid:
                    f = runs.values
                    first, stop = f.field("first").to_numpy(), f.field("last").to_numpy() + length
                    by = np.argsort(first, kind="stable")
                    first, stop = first[by], np.maximum.accumulate(stop[by])
                    new = np.ones(len(first), bool)
                    new[1:] = first[1:] > stop[:-1]
                    at = np.flatnonzero(new)
                    spans = [{"start": int(p), "end": int(q)} for p, q in zip(first[at], stop[np.append(at[1:], len(first)) - 1], strict=True)]
                edges = [0, *(v for s in spans for v in (s["start"], s["end"])), len(x)]
                kept = b"".join(x[p:q].tobytes() for p, q in zip(edges[::2], edges[1::2], strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([len(x)], pa.int64()), pa.array([spans], kind), pa.array([kept], pa.binary())], ["id", "n_bytes", "spans", "kept"])

    kind = d.schema["id"].dataType.simpleString()
    out = texts.join(spans, "at", "left").select("id", "text", "runs").mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
