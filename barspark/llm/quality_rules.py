"""Quality rules whose cutoffs are certified on labelled documents: exact binomial bounds limit false rejections per stratum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .text_bytes import BYTES, SPACE, WORDS, column_bytes, frees, hash_spans, mixed, parts, word_starts

SYMBOLS = "#*$%&|<>"
#: Larger is worse in each. A marked word ends in a sign that is no sentence's, or shouts with "!!".
SIGNALS = ("symbols", "capitals", "marked_words", "repeated_words", "repeated_runs", "repeated_lines")
#: Cutoffs are tried from the laxest, and in steps of a 1/64.
STEPS = 64
#: The base rule: so many words at least, and at most so many of a hundred words in repeated windows.
LEAST_WORDS, MOST_REPEAT = 50, 50
#: So many labelled ids (some 40 bytes each) are broadcast.
SMALL = 400_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _STOP, _CAPITAL = _flags(SYMBOLS), _flags(".,;:?!"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALNUM = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LINES = np.where(np.arange(256) == 10, np.uint64(0), BYTES)
_STEPS = mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _code_points(x: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of the UTF-8 sequences of two to four bytes that begin at ``lead``."""
    pad = np.concatenate([x, np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c, d = (pad[lead + i] for i in range(4))
    low = [v & 63 for v in (b, c, d)]
    return np.where(a < 0xE0, (a & 31) << 6 | low[0], np.where(a < 0xF0, (a & 15) << 12 | low[0] << 6 | low[1], (a & 7) << 18 | low[0] << 12 | low[1] << 6 | low[2]))


def _that(code_points: np.ndarray, test) -> np.ndarray:
    """Which code points pass a test of single characters, which is asked once for each that occurs."""
    seen, back = np.unique(code_points, return_inverse=True)
    return np.fromiter((test(chr(c)) for c in seen.tolist()), bool, len(seen))[back]


def measure(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts (``COUNTS``) and signals (``SIGNALS``, shares from 0 to 1) of the whole texts ``x[ends[i]:ends[i + 1]]``; signals are 0 without words."""
    base, docs = int(ends[0]), len(ends) - 1
    x, at = x[base : int(ends[-1])], ends - base
    size = len(x)
    if not size:
        return np.zeros((docs, len(COUNTS)), np.int64), np.zeros((docs, len(SIGNALS)))
    inside, starts = ~SPACE[x], word_starts(x, at)
    per = lambda flags, edges: np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])  # noqa: E731  sums by text
    w_at = np.searchsorted(starts, at)
    n, words = np.diff(w_at), len(starts)
    chars = per(inside & ((x & 0xC0) != 0x80), at)
    symbols = per(_SYMBOL[x], at)
    capital = _CAPITAL[x]
    lead = np.flatnonzero(x >= 0xC2)
    if len(lead):
        capital[lead] = _that(_code_points(x, lead), str.isupper)
    capitals = per(capital, at)
    marked = repeats = runs = np.zeros(docs, np.int64)
    if words:
        place = np.arange(size)
        end = np.maximum.reduceat(np.where(inside, place, -1), starts)
        last = np.maximum.reduceat(np.where(inside & ~_STOP[x], place, -1), starts)
        some = last >= starts
        good = some & _ALNUM[x[last]]
        wide = np.flatnonzero(some & (x[last] >= 0x80))
        if len(wide):
            begin = last[wide]
            for _ in range(3):
                begin = np.where((x[begin] & 0xC0) == 0x80, begin - 1, begin)
            good[wide] = _that(_code_points(x, begin), str.isalnum)
        shout = (end > starts) & (x[end] == 33) & (x[end - 1] == 33)
        marked = per(~good | shout, w_at)
        ids = hash_spans(x, starts, WORDS)
        doc = np.repeat(np.arange(docs, dtype=np.uint64), n)
        again = np.zeros(words, bool)
        again[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
        runs = per(again, w_at)
        if words >= 3:
            window = mixed(ids[:-2] * _STEPS[0] + ids[1:-1] * _STEPS[1] + ids[2:] * _STEPS[2] + doc[2:] * _STEPS[3])
            whole = doc[:-2] == doc[2:]
            _, back, count = np.unique(window, return_inverse=True, return_counts=True)
            twice = (np.bincount(back[whole], minlength=len(count))[back] > 1) & whole
            cover = np.zeros(words, bool)
            for j in range(3):
                cover[j : j + words - 2] |= twice
            repeats = per(cover, w_at)
    first = np.zeros(size, bool)
    first[at[:-1][at[:-1] < size]] = True
    first[1:] |= x[:-1] == 10
    begin = np.flatnonzero(first)
    told = np.add.reduceat(inside.astype(np.int64), begin) > 0
    of = np.searchsorted(at, begin, "right") - 1
    key = mixed(hash_spans(x, begin, _LINES) + of.astype(np.uint64) * _STEPS[3])[told]
    lines = np.bincount(of[told], minlength=docs)
    _, at_first = np.unique(key, return_index=True)
    dup = lines - np.bincount(of[told][at_first], minlength=docs)
    share = lambda a, b: a / np.maximum(b, 1)
    counts = np.stack([n, chars, symbols, dup, repeats], axis=1)
    counts[n == 0] = 0
    signals = np.stack([np.minimum(share(symbols, chars), 1.0), share(capitals, chars), share(marked, n), share(repeats, n), share(runs, n), share(dup, lines)], axis=1)
    signals[n == 0] = 0
    return counts, signals


def measures(text: str | None) -> tuple[list[int], list[float]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts, signals = measure(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return counts[0].tolist(), signals[0].tolist()


MEASURES = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in SIGNALS)


def measured(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """Every row of ``docs`` with all its columns and ``name``, a struct of the text's counts and signals."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = column_bytes(b.column(b.schema.names.index(text_col)))
            for i, j in parts(ends):
                counts, signals = measure(data, ends[i : j + 1])
                cols = [pa.array(c, pa.int64()) for c in counts.T] + [pa.array(c, pa.float64()) for c in signals.T]
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(cols, [*COUNTS, *SIGNALS])], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL(MEASURES))]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a binomial rate at confidence ``1 - delta``."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:  # P(X <= k)
        a, b = math.log(p), math.log1p(-p)
        terms = [c + i * a + (n - i) * b for i, c in enumerate(logs)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    lo, hi = k / n, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0 < mid < 1 and tail(mid) > delta else (lo, mid)
    return hi


def certified_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float, cost: float = 20.0) -> float | None:
    """The step from which a signal rejects, or None. ``good`` and ``bad``: labelled documents by step.

    Tests go from the laxest cutoff on and stop at the first whose bound on good documents rejected exceeds ``risk``
    (fixed sequence: no correction within it). Among the certified, the one that rejects most bad documents
    beyond ``cost`` times the good ones it rejects (a good document lost is dearer than a bad one kept, which later stages may still catch); the laxer
    one if equal; None if none rejects any bad one."""
    n, best = int(good.sum()), (0.0, None)
    if not n:
        return None
    lost = np.cumsum(good[::-1])[::-1]
    gone = np.cumsum(bad[::-1])[::-1]
    checked: dict[int, float] = {}
    for step in range(len(good) - 1, 0, -1):
        k = int(lost[step])
        if k not in checked:
            checked[k] = upper_bound(k, n, delta)
        if checked[k] > risk:
            break
        if (gain := float(gone[step]) - cost * k) > best[0]:
            best = (gain, step / STEPS)
    return best[1]


def fit_cutoffs(docs: DataFrame, labels: DataFrame, risk: float, delta: float, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", cost: float = 20.0) -> DataFrame:
    """``(stratum, <signal> ...)``: each stratum's certified cutoffs, null where none is.

    Labelled documents that pass the base rule are counted by stratum, signal and step in Spark; a test sees only those
    counts. Equal texts of one stratum and label are one trial, however many rows or ids carry them. ``risk`` is split over the signals, ``delta`` over all strata and signals (Bonferroni), so with
    confidence ``1 - delta`` no stratum loses more than ``risk`` of its good documents. Labels up to ``SMALL`` ids are broadcast to the documents."""
    y = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y")).where("__id is not null and __y in (0, 1)").distinct()
    y = F.broadcast(y) if y.count() <= SMALL else y
    d = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{stratum_col}`").cast("string").alias("stratum"), F.col(f"`{text_col}`").cast("string").alias("text"))
    x = measured(d.join(y, "__id").drop("__id"), "text", "m").select("stratum", F.col("__y").alias("y"), F.xxhash64("text").alias("h"), "m.*").where(~base_failed())
    x = x.dropDuplicates(["stratum", "y", "h", "n_words", "word_chars"])
    step = lambda s: F.least(F.floor(F.col(s) * STEPS), F.lit(STEPS - 1)).cast("int")
    long = x.select("stratum", "y", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), step(s).alias("step")) for s in SIGNALS])).alias("e")).select("stratum", "y", "e.*")
    counts = long.groupBy("stratum", "signal", "step").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))
    counts = materialize(counts, "label-counts")
    tests = max(1, counts.select("stratum", "signal").distinct().count())

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(STEPS, np.int64), np.zeros(STEPS, np.int64)
        good[f.step], bad[f.step] = f.good, f.bad
        return pd.DataFrame({"stratum": f.stratum.iloc[:1], "signal": f.signal.iloc[:1], "cutoff": [certified_cutoff(good, bad, risk / len(SIGNALS), delta / tests, cost)]})

    chosen = counts.groupBy("stratum", "signal").applyInPandas(choose, "stratum string, signal string, cutoff double")
    return chosen.groupBy("stratum").pivot("signal", list(SIGNALS)).agg(F.first("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = 0.03, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", small: int = 10_000) -> DataFrame:
    """Every row of ``docs`` with all its columns and ``__verdict``, a struct of the counts, ``base_failed``, ``rejected_by`` (signals) and ``kept``.

    A document is kept if the base rule passes it and no signal reaches its stratum's cutoff. Without labels, or too few
    for a certificate, signals reject nothing. A null stratum is one; a null or empty text has counts 0 and fails the base rule. A document with contradicting
    labels counts under each; rows that repeat an id are judged each by its text. Cutoffs of up to ``small`` strata are broadcast; more are joined by stratum."""
    cut = materialize(fit_cutoffs(docs, labels, risk, delta, id_col, text_col, stratum_col), "cutoffs").select(F.col("stratum").alias("__s"), *[F.col(s).alias(f"__{s}") for s in SIGNALS])
    cut = F.broadcast(cut) if cut.count() <= small else cut
    x = measured(docs, text_col, "__m").join(cut, F.col(f"`{stratum_col}`").cast("string").eqNullSafe(F.col("__s")), "left")
    by = F.array_compact(F.array(*[F.when((F.col(f"__{s}").isNotNull()) & (F.floor(F.col(f"__m.{s}") * STEPS) >= F.col(f"__{s}") * STEPS), F.lit(s)) for s in SIGNALS]))
    failed = (F.col("__m.n_words") < LEAST_WORDS) | (100 * F.col("__m.n_repeat_words") > MOST_REPEAT * F.col("__m.n_words"))
    verdict = F.struct(*[F.col(f"__m.{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), by.alias("rejected_by"), (~failed & (F.size(by) == 0)).alias("kept"))
    return x.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias("__verdict"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.03, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", small: int = 10_000) -> DataFrame:
    """One row per row of ``docs``: its id and what ``judged`` says of it; further columns are ignored."""
    d = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col, stratum_col))])
    return judged(d, labels, risk, delta, id_col, text_col, stratum_col, small).select(F.col(f"`{id_col}`").alias(id_col), "__verdict.*")
