"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .text_bytes import column_bytes, frees, parts

#: Pieces of up to so many bytes are merged together, by the thousand; a longer one by itself.
TOGETHER, AT_ONCE = 64, 4096
NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the leftmost pair of the lowest rank is merged until none is left.

    Leaf ``i`` of the tree holds ``rank * width + i`` of the pair of live tokens that begins at byte ``i``; the root
    so is the next merge. A merge changes the leaves of the token, of its right part and of the token before."""
    n, get = len(piece), ranks.get
    if n == 1:
        return [ranks[piece]]
    width = 1 << (n - 1).bit_length()
    never = 1 << 62
    tree = [never] * (2 * width)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end, before = list(range(1, n + 1)), list(range(-1, n))

    while (top := tree[1]) < never:
        at = top % width
        middle = end[at]
        stop = end[at] = end[middle]
        changed = [(width + middle, never), (width + at, never)]
        if stop < n:
            before[stop] = at
            r = get(piece[at : end[stop]])
            if r is not None:
                changed[1] = (width + at, r * width + at)
        p = before[at]
        if p >= 0:
            r = get(piece[p:stop])
            changed.append((width + p, never if r is None else r * width + p))
        for i, key in changed:
            tree[i] = key
            while i > 1:
                b = tree[i ^ 1]
                i >>= 1
                if b < key:
                    key = b
                if tree[i] == key:
                    break
                tree[i] = key
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PairRanks:
    """The rank of what two tokens make, in numpy: all pairs of tokens that make a token, sorted by both ids."""

    def __init__(self, ranks: dict[bytes, int]):
        get, keys, made = ranks.get, array("q"), array("q")
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b), made.append(r)
        key, rank = np.frombuffer(keys, np.int64), np.frombuffer(made, np.int64)
        # A table of places by hash, sparse enough that most keys are found at the first look.
        self.bits = max(4, int(len(key) * 2).bit_length())
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        left, at = np.arange(len(key)), self._place(key)
        while len(left):
            free = left[self.key[at[left]] < 0]
            self.key[at[free]] = key[free]
            won = left[self.key[at[left]] == key[left]]
            self.rank[at[won]] = rank[won]
            left = left[self.key[at[left]] != key[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.byte = np.array([ranks.get(bytes([c]), -1) for c in range(256)], np.int64)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``NEVER`` where the pair makes no token."""
        key = left << 32 | right
        at = self._place(key)
        held = self.key[at]
        out = np.where(held == key, self.rank[at], NEVER)
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.key[at[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


def merge_together(pieces: list[bytes], pairs: PairRanks) -> list[bytes]:
    """What ``merge`` gives for each piece, as raw int32: one segment tree a row, and a step merges once in every row that has a pair left.

    All pieces have one tree width, a power of two of at least their length."""
    size = np.array([len(p) for p in pieces])
    width = max(2, 1 << int(size.max() - 1).bit_length())
    rows = len(pieces)
    x = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
    place = np.arange(width)
    ids = np.where(place < size[:, None], pairs.byte[x], -1)
    after = np.broadcast_to(place + 1, (rows, width)).copy()  # where the next live token begins
    before = np.broadcast_to(place - 1, (rows, width)).copy()
    tree = np.full((rows, 2 * width), NEVER, np.int64)
    r, c = np.nonzero(place[:-1] + 1 < size[:, None])
    rank = pairs(ids[r, c], ids[r, c + 1])
    tree[r, width + c] = np.where(rank < NEVER, rank * width + c, NEVER)
    for level in range(width.bit_length() - 2, -1, -1):
        k = 1 << level
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])

    def put(row: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
        tree[row, leaf] = key
        while leaf[0] > 1:
            leaf = leaf >> 1
            tree[row, leaf] = np.minimum(tree[row, 2 * leaf], tree[row, 2 * leaf + 1])

    live = np.flatnonzero(tree[:, 1] < NEVER)
    while len(live):
        top = tree[live, 1]
        at = top % width
        gone = after[live, at]
        stop = after[live, gone]
        ids[live, at], ids[live, gone], after[live, at] = top // width, -1, stop
        put(live, width + gone, np.full(len(live), NEVER))
        right = stop < size[live]
        key = np.full(len(live), NEVER)
        row, a, b = live[right], at[right], stop[right]
        before[row, b] = a
        rank = pairs(ids[row, a], ids[row, b])
        key[right] = np.where(rank < NEVER, rank * width + a, NEVER)
        put(live, width + at, key)
        p = before[live, at]
        left = p >= 0
        row, p = live[left], p[left]
        if len(row):
            rank = pairs(ids[row, p], ids[row, at[left]])
            put(row, width + p, np.where(rank < NEVER, rank * width + p, NEVER))
        live = live[tree[live, 1] < NEVER]
    kept = ids >= 0
    flat, ends = ids[kept].astype(np.int32), np.cumsum(kept.sum(axis=1)).tolist()
    return [flat[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)]


class Pieces:
    """Encodes chunks: cut by the pattern, whole tokens at once, short pieces together, long ones each by its own tree."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.pairs = ranks, regex.compile(pattern), PairRanks(ranks)
        self.words = r"| ?\p{L}+|" in pattern

    def __call__(self, chunks: list[bytes]) -> list[bytes]:
        # Most chunks are ASCII letters after a space or none, which the pattern leaves whole.
        cut = [(c,) if self.words and c[c[:1] == b" " :].isalpha() else [p.encode("utf-8", "surrogatepass") for p in self.split.findall(c.decode("utf-8", "surrogatepass"))] for c in chunks]
        done: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for p in {p for ps in cut for p in ps}:
            whole = self.ranks.get(p)
            if whole is not None:
                done[p] = array("i", (whole,)).tobytes()
            elif len(p) > TOGETHER:
                done[p] = array("i", merge(p, self.ranks)).tobytes()
            else:
                by_width.setdefault((len(p) - 1).bit_length(), []).append(p)
        for group in by_width.values():
            for i in range(0, len(group), AT_ONCE):
                done.update(zip(group[i : i + AT_ONCE], merge_together(group[i : i + AT_ONCE], self.pairs), strict=True))
        return [done[ps[0]] if len(ps) == 1 else b"".join(map(done.__getitem__, ps)) for ps in cut]


class Encoder(ChunkEncoder):
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(Pieces(ranks, pattern), "<i4")


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    token = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        token[r] = t
    return token


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id and ``ids``, the token ids of the whole text, without special tokens; if ``decoded``, also the bytes that the ids decode to.

    ``vocabulary`` is a file of base64 tokens and ranks that every executor has; ``pattern`` cuts a text into pieces that are
    merged separately, and must not match across a change from other characters to white space (see ``chunks``). What a task remembers of chunks
    is bounded in bytes and goes when the task ends. A null text is an empty one, and has no ids. Rows stay as they
    are, null and repeated ids too; further columns are ignored.
    """
    kept = ["id", "ids", "decoded"] if decoded else ["id", "ids"]

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocabulary)
        encoder, token = Encoder(ranks, pattern), _tokens(ranks)
        for b in batches:
            data, ends = column_bytes(b.column(1))
            for i, j in parts(ends):
                got = encoder.encode(data, ends[i : j + 1])
                cols = [b.column(0).slice(i, j - i), _lists(got)]
                if decoded:
                    cols.append(pa.array([b"".join(map(token.__getitem__, ids.tolist())) for ids in got], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, kept)

    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded binary" * decoded).select(F.col("id").alias(id_col), *kept[1:])


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: its id, its ids and ``decoded``, their bytes; null ids count as none."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(load_ranks(vocabulary))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = [b"".join(map(token.__getitem__, ids.values.tolist() if ids.values is not None else ())) for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["id", "ids", "decoded"])

    d = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")
