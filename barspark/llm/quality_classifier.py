"""Quality classifier: hashed word and character n-gram vectors, averaged per document, under a softmax; trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_bytes import frees

BUCKETS, DIM, GRAMS = 1 << 15, 16, (3, 5)
#: Labelled documents that the model is fitted on at most: those with the smallest hashes of their ids. Whole texts.
SAMPLE = 3000
_SAME = 0  # the bucket of a word that stands right after itself


#: Multipliers of a gram's code points (multiply-shift hashing), of a word's positions, and the numbers that set lengths apart.
_K = np.random.default_rng(5).integers(1, 1 << 63, GRAMS[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Code points that are hashed at once; blocks end between words.
BLOCK = 1 << 16


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((((h >> np.uint64(32)) * np.uint64(BUCKETS - 1)) >> np.uint64(32)) + np.uint64(1)).astype(np.int64)


def _blocks(text: str) -> Iterator[np.ndarray]:
    """Code points of the text with one space before, between and after its words; blocks share the space between them."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    cp = np.concatenate([[32], np.where(space, 32, cp), [32]])
    edge = cp == 32
    cp = cp[~(edge & np.concatenate([[False], edge[:-1]]))].astype(np.uint64)
    ends = np.flatnonzero(cp == 32)
    at = 0
    while at < len(cp) - 1:
        stop = int(ends[min(np.searchsorted(ends, max(at + BLOCK, at + 1)), len(ends) - 1)])
        yield cp[at : stop + 1]
        at = stop


def buckets_of(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of each word, of its character n-grams (word ends marked) and, as ``_SAME``, of each word that repeats the one before.

    Whole text, block by block; nothing for a text without words."""
    last = None
    for cp in _blocks(text or ""):
        p = np.flatnonzero(cp == 32)
        long = np.diff(p)
        left = np.repeat(p[1:], long) - np.arange(len(cp) - 1)  # places to the next word end
        h = cp * _K[0]
        for n in range(2, GRAMS[1] + 1):
            h = h[:-1] + cp[n - 1 :] * _K[n - 1]
            if n >= GRAMS[0]:
                yield _bucket((h[left[: len(h)] >= n - 1] + np.uint64(n)) * _STEP)
        power = np.cumprod(np.full(int(long.max()), _STEP))
        w = np.add.reduceat(cp[:-1] * power[np.arange(len(cp) - 1) - np.repeat(p[:-1], long)], p[:-1])
        w = (w ^ (w >> np.uint64(29))) * _MIX
        yield _bucket(w)
        same = int((w[1:] == w[:-1]).sum()) + (last == w[0])
        last = w[-1]
        yield np.full(same, _SAME)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The document's buckets and how often each occurs."""
    count = np.zeros(BUCKETS, np.int64)
    for b in buckets_of(text):
        count += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at]


@dataclass
class Model:
    vectors: np.ndarray  # one row per bucket
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray

    def scorer(self) -> Callable[[str | None], float]:
        """The softmax of a text's mean vector. It is linear up to the softmax, so each bucket's share of the logit is found once."""
        side = self.weights[:, 1].astype(np.float64) - self.weights[:, 0]
        share, bias = self.vectors.astype(np.float64) @ side, float(self.bias[1]) - float(self.bias[0])

        def score(text: str | None) -> float:
            total, n = 0.0, 0
            for b in buckets_of(text):
                total, n = total + float(share[b].sum()), n + len(b)
            return float(1 / (1 + np.exp(np.clip(-(total / max(n, 1) + bias), -50, 50))))

        return score


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.5, seed: int = 3) -> Model:
    """SGD over documents, the rate falling to zero; without both labels the score is the share of label 1 (1 without labels)."""
    rng = np.random.default_rng(seed)
    m = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    share = float(labels.mean()) if len(labels) else 1.0
    if share in (0.0, 1.0):
        m.bias[1] = 40.0 if share else -40.0
        return m
    m.bias[:] = np.log([1 - share, share])
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, times = bags[i]
            now = rate * (1 - step / steps)
            step += 1
            if not len(at):
                continue
            part = (times / times.sum()).astype(np.float32)
            mean = part @ m.vectors[at]
            z = mean @ m.weights + m.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = m.weights @ p
            m.weights -= now * np.outer(mean, p)
            m.bias -= np.float32(now * 0.1) * p
            # Rare buckets move as far as frequent ones: the step is scaled by the document's number of buckets.
            m.vectors[at] -= np.float32(now) * np.outer(np.minimum(part * len(at), 4.0) / np.sqrt(len(at)), back).astype(np.float32)
    return m


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of ``label_col`` (0 or 1) from up to ``sample`` labelled ids that aren't held out, drawn among those that have a document.

    The sampled ids, a bounded table, are broadcast to the documents; what returns to the driver is their bags of buckets. An id that several
    rows carry gives one of them, that of the smallest hash of its text, so rows are bounded as ids are."""
    y = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    y = y.groupBy("id").agg(F.min("y").alias("y")).join(d.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    d = d.join(F.broadcast(y), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = d.schema["id"].dataType.simpleString()

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [bag(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([at.astype("<u2").tobytes() for at, _ in got], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in got], pa.binary())], ["id", "y", "at", "n"])

    rows = d.select("id", "text", "y").mapInArrow(run, f"id {kind}, y int, at binary, n binary").collect()
    rows.sort(key=lambda r: r["id"])
    bags = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<u4")) for r in rows]
    return train(bags, np.array([r["y"] for r in rows]))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with all its columns and ``__verdict``, a struct of ``held_out``, ``score`` (0 to 1) and ``predicted``.

    A null or empty text gets the score of no evidence. A null id is not held out. Repeated rows repeat."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = sent.value.scorer()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                score = pa.array([rate(t.as_py()) for t in part.column(part.schema.names.index(text_col))], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, "__score"])

    x = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))
    verdict = F.struct(held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
    return x.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias("__verdict"))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and what ``scored`` says of it; further columns are ignored."""
    d = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias(text_col))
    return scored(d, model, threshold, id_col, text_col).select(F.col(f"`{id_col}`").alias(id_col), "__verdict.*")
