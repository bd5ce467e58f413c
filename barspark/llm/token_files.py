"""Token-id shards with a minimal perfect hash index: keyed access over raw id payloads.

A shard is one row of a Parquet table, so that Spark's committer keeps the files whole when executors are lost and any store Spark
reads will do: ``part, seq`` (their order is the documents'), ``keys`` (int64), ``occurrence`` (uint32), ``index`` and ``ids``, the payload: ids
of one document after the other, little-endian, ``width`` bytes each.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK, WIDE, ChunkEncoder, ragged
from .text_bytes import column_bytes, frees, parts

assert sys.byteorder == "little"

#: A shard is closed when its payload reaches so many bytes; one document is never split.
SHARD_BYTES = 4 << 20
GAMMA = 1.5
#: A slot of the index: fingerprint of the key's hash, the document's place in the shard, and start and count of its ids.
SLOT = np.dtype([("print", "<u4"), ("row", "<u4"), ("start", "<u8"), ("count", "<u4")])
#: Chunks without other white space than a space before are given to the library some at a time, one a line: the pattern leaves a line's end alone
#: before a space or a word, so its one id parts the chunks' ids.
LINES = 16
SCHEMA = "part int, seq int, n_docs long, n_ids long, width int, first long, last long, keys binary, occurrence binary, index binary, ids binary"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64 bits of a key and of how many equal keys the shard holds before it."""
    return _mix(keys.astype(np.int64).view(np.uint64), 1) ^ _mix(occurrence.astype(np.uint64), 2)


def build_index(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    """A minimal perfect hash over distinct ``hashes``, with a ``SLOT`` each, in the documents' order.

    Level by level, keys that are alone at their place in a bit array of ``GAMMA`` places a key set its bit; the others go to
    the next level. A key's slot is the number of bits set before its own."""
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two keys of a shard have one hash")
    left, levels = np.arange(len(hashes)), []
    slot, taken = np.empty(len(hashes), np.int64), 0
    while len(left):
        size = max(8, int(GAMMA * len(left)) + 7 & ~7)
        at = (_mix(hashes[left], 16 + len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        order = np.cumsum(bits) - 1
        alone = bits[at]
        slot[left[alone]] = taken + order[at[alone]]
        taken += int(bits.sum())
        levels.append(np.packbits(bits, bitorder="little").tobytes())
        left = left[~alone]
    table = np.empty(len(hashes), SLOT)
    table["print"][slot] = (_mix(hashes, 3) >> np.uint64(32)).astype(np.uint32)
    table["row"][slot], table["start"][slot], table["count"][slot] = np.arange(len(hashes)), starts, counts
    return struct.pack("<II", len(levels), len(hashes)) + b"".join(struct.pack("<I", len(x)) + x for x in levels) + table.tobytes()


class Index:
    """Reads what ``build_index`` wrote."""

    def __init__(self, raw: bytes):
        n, self.n = struct.unpack_from("<II", raw)
        at, self.levels, before = 8, [], 0
        for _ in range(n):
            (size,) = struct.unpack_from("<I", raw, at)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at + 4), bitorder="little")
            ranks = before + np.cumsum(bits) - bits
            self.levels.append((bits, ranks))
            before += int(bits.sum())
            at += 4 + size
        self.table = np.frombuffer(raw, SLOT, self.n, at)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Found or not (by fingerprint), and the slot of each hash, in constant time a hash."""
        slot = np.full(len(hashes), -1, np.int64)
        for i, (bits, ranks) in enumerate(self.levels):
            left = np.flatnonzero(slot < 0)
            if not len(left):
                break
            at = (_mix(hashes[left], 16 + i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            slot[left[hit]] = ranks[at[hit]]
        if not self.n:
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), SLOT)
        row = self.table[np.maximum(slot, 0)]
        return (slot >= 0) & (row["print"] == (_mix(hashes, 3) >> np.uint64(32)).astype(np.uint32)), row


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class LibraryEncoder(ChunkEncoder):
    """The library's ids by chunk of text: words repeat, and the library reads each one once while it is remembered.

    The library finds its added tokens before anything else, so texts are cut at them first; where one of them reaches beyond its own
    characters (``lstrip``, ``rstrip``, ``single_word``), a text that holds any goes to the library whole."""

    def __init__(self, tokenizer, width: int):
        added = tokenizer.get_added_tokens_decoder().values()
        names = sorted((x.content for x in added if x.content), key=len, reverse=True)
        cut = None if any(x.lstrip or x.rstrip or x.single_word for x in added) else re.compile(f"({'|'.join(map(re.escape, names))})")
        kind = {2: "<u2", 4: "<u4"}[width]

        def special(text: str) -> list[str]:
            return [text] if cut is None else [c for i, part in enumerate(cut.split(text)) for c in ([part] if i % 2 else CHUNK.findall(part))]

        self.ids = lambda texts: [np.array(e.ids, kind) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.line = self.ids(["\n"])[0].tolist()
        super().__init__(lambda chunks: [x.tobytes() for x in self.ids([c.decode("utf-8", "surrogatepass") for c in chunks])], kind, special, [n.encode() for n in names])

    def _fresh(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, begin = x[ragged(starts, lengths)], np.cumsum(lengths) - lengths
        raw = flat.tobytes()
        if len(self.line) != 1 or WIDE.search(raw) or (self.marks and self.marks.search(raw)):
            return super()._fresh(x, starts, lengths)
        other = (flat <= 32) | (flat == 127)
        other[begin] &= (flat[begin] != 32) | (lengths == 1)
        other = np.logical_or.reduceat(other, begin)
        plain, rest = np.flatnonzero(~other), np.flatnonzero(other)
        size = lengths[plain] + 1
        at = np.cumsum(size) - size
        text = np.full(int(size.sum()), 10, np.uint8)
        text[ragged(at, size - 1)] = flat[ragged(begin[plain], size - 1)]
        text, edges = text.tobytes(), [*at[::LINES].tolist(), len(text)]
        got = self.ids([text[i:j].decode("utf-8", "surrogatepass") for i, j in zip(edges[:-1], edges[1:], strict=True)])
        ids = np.concatenate([*got, np.empty(0, self.kind)])
        ends = np.flatnonzero(ids == self.line[0])
        of = np.searchsorted(np.cumsum([len(g) for g in got]), ends, "right")
        if not np.array_equal(of, np.arange(len(plain)) // LINES):  # a line has other parts than its chunks
            return super()._fresh(x, starts, lengths)
        count = np.zeros(len(lengths), np.int64)
        count[plain] = np.diff(ends, prepend=-1) - 1
        alone, count[rest] = super()._fresh(x, starts[rest], lengths[rest])
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), self.kind)
        out[ragged(first[plain], count[plain])] = ids[ids != self.line[0]]
        out[ragged(first[rest], count[rest])] = alone
        return out, count


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", by_chunk: bool = True, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every text with the ``tokenizers`` file ``tokenizer`` (no special tokens added, ``end_id`` after each document) and writes
    the shards to ``path`` in ascending order of the id, nulls first.

    ``by_chunk``: the tokenizer cuts at white space as byte-level BPE does, so words can be encoded once each between added tokens; else whole texts go to the
    library. Null texts are empty and hold the end id alone. Rows of one id are told apart by their place among
    them, in the order of their texts' hash; ids are cast to long; further columns are ignored.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        width = 2 if max(t.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        encoder = LibraryEncoder(t, width)
        end = end_id.to_bytes(width, "little")
        part, seq, keys, sizes, payload, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            k = np.array([x or 0 for x in keys], np.int64)
            null = np.array([x is None for x in keys])
            same = np.zeros(len(k), np.uint32)
            for i in range(1, len(k)):  # equal keys stand together
                same[i] = same[i - 1] + 1 if keys[i] == keys[i - 1] else 0
            same |= null.astype(np.uint32) << np.uint32(31)
            counts = np.array(sizes, np.uint64)
            starts = np.cumsum(counts) - counts
            row = [part, seq, len(k), int(counts.sum()), width, keys[0], keys[-1], k.tobytes(), same.tobytes(), build_index(key_hash(k, same), starts, counts), b"".join(payload)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], type=y) for v, y in zip(row, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            data, ends = column_bytes(b.column(1))
            for i, j in parts(ends):
                ids = b.column(0).slice(i, j - i).to_pylist()
                if by_chunk:
                    encoded = [x.tobytes() for x in encoder.encode(data, ends[i : j + 1])]
                else:
                    texts = [data[ends[k] : ends[k + 1]].tobytes().decode("utf-8", "surrogatepass") for k in range(i, j)]
                    encoded = [array({2: "H", 4: "I"}[width], e.ids).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                for key, got in zip(ids, encoded, strict=True):
                    keys.append(key), sizes.append(len(got) // width + 1), payload.append(got + end)
                    held += len(got) + width
                    if held >= shard_bytes:
                        yield shard()
                        seq, keys, sizes, payload, held = seq + 1, [], [], [], 0
        if keys:
            yield shard()

    d.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text").mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """One row per document in the shards at ``path``: ``id, start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Every document is looked up by its key in its shard's index; a fingerprint that disagrees is an error."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, same = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["occurrence"], np.uint32)
                found, slots = Index(row["index"]).find(key_hash(keys, same))
                starts, counts = slots["start"], slots["count"]
                if not found.all() or (slots["row"] != np.arange(len(keys))).any():
                    raise ValueError(f"shard {row['part']}/{row['seq']}: its index lacks a key")
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                crc = [zlib.crc32(ids[int(s) : int(s) + int(c)].astype("<u4").tobytes()) for s, c in zip(starts, counts, strict=True)]
                null = same >> np.uint32(31) == 1
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)), pa.array(keys, mask=null), pa.array(starts.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "seq", "id", "local", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p"))
    order = Window.partitionBy("part").orderBy("seq")
    starts = shards.select("part", "seq", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("s")).join(parts, "part").select("part", "seq", (F.col("s") + F.col("p")).alias("base"))
    docs = shards.select("part", "seq", "width", "keys", "occurrence", "index", "ids").mapInArrow(run, "part int, seq int, id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, path: str, keys: list[int]) -> DataFrame:
    """``(id, occurrence, ids)`` of a short list of keys, each found in constant time in a shard; shards whose range holds none are not read
    beyond their bounds. Keys that no document has give no row; rows that repeat an id give one each; null ids can't be asked for."""
    wanted = np.array(sorted(set(keys)), np.int64)

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                index, ids, out, left, turn = Index(row["index"]), np.frombuffer(row["ids"], f"<u{row['width']}"), [], wanted, 0
                stored, same = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["occurrence"], np.uint32)
                while len(left):
                    found, slots = index.find(key_hash(left, np.full(len(left), turn, np.uint32)))
                    # 32 bits of a fingerprint let one in four billion strangers pass: the slot's own key decides.
                    found &= (stored[slots["row"]] == left) & (same[slots["row"]] == turn)
                    out += [(int(k), turn, ids[int(s["start"]) : int(s["start"]) + int(s["count"])].astype(np.int64).tolist()) for k, s in zip(left[found], slots[found], strict=True)]
                    left, turn = left[found], turn + 1
                yield pa.RecordBatch.from_pylist([{"id": a, "occurrence": b_, "ids": c} for a, b_, c in out], pa.schema([("id", pa.int64()), ("occurrence", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    if not len(wanted):
        return spark.createDataFrame([], "id long, occurrence long, ids array<long>")
    shards = spark.read.schema(SCHEMA).parquet(path).where((F.coalesce(F.col("first"), F.lit(-(2**63))) <= int(wanted[-1])) & (F.col("last") >= int(wanted[0])))
    return shards.mapInArrow(run, "id long, occurrence long, ids array<long>")
