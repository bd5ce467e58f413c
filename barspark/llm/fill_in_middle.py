"""Fill-in-middle: texts are cut into prefix, middle and suffix at unit borders that one match of all units yields.

``fullmatch`` of ``(?:(unit))*`` keeps every repetition of its group, so ``ends(1)`` is the list of all units' ends: its length is the number of
units and two of its entries are the cuts. No loop walks over units."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, permutations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_bytes import column_bytes, frees, parts

#: Fixed values of the transformation: the markers of prefix, suffix and middle, and a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Code points that one match takes; the library keeps some 80 bytes for each repetition, so a longer text is matched stretch by stretch.
STRETCH = 1 << 20


def _check(markers: tuple[str, str, str]) -> None:
    """Markers that could be read elsewhere than where they were written are an error: one within another, or one's end another's begin."""
    for a, b in [*permutations(markers, 2), *((m, m) for m in markers)]:
        if not a or (a in b and a is not b) or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b) + 1)) if i < len(b)):
            raise ValueError(f"markers {markers} can overlap")


class Units:
    """Finds a text's units: how many there are, and the offset after the k-th."""

    def __init__(self, unit: str = UNIT, border: str = "[^A-Za-z]"):
        self.all, self.border = regex.compile(f"(?:({unit}))*+"), regex.compile(border)

    def stretches(self, text: str) -> list[int]:
        """Where the stretches that are matched by themselves end: after a character that is a unit of its own."""
        out, at = [], 0
        while len(text) - at > STRETCH:
            m = self.border.search(text, at + STRETCH - 1)
            if m is None:
                break
            at = m.end()
            out.append(at)
        return [*out, len(text)]

    def __call__(self, text: str) -> tuple[int, object]:
        stops = self.stretches(text)
        if len(stops) == 1:
            ends = self._ends(text, 0, len(text))
            return len(ends), lambda k: ends[k - 1] if k else 0
        starts = [0, *stops[:-1]]
        counts = list(accumulate((len(self._ends(text, a, b)) for a, b in zip(starts, stops, strict=True)), initial=0))

        def after(k: int) -> int:
            i = next(i for i, c in enumerate(counts[1:]) if k <= c)
            return self._ends(text, starts[i], stops[i])[k - counts[i] - 1] if k > counts[i] else starts[i]

        return counts[-1], after

    def _ends(self, text: str, a: int, b: int) -> list[int]:
        m = self.all.fullmatch(text, a, b)
        if m is None:
            raise ValueError("the unit pattern must match every text")
        return m.ends(1)


def draws(doc_id: object, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document: the first digits of the SHA-256 of ``seed:id``; a null id has no digits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n`` (units of the whole text), ``form``, ``prefix_chars`` and ``middle_chars`` (code points; null if
    plain) and ``output``, the transformed text.

    ``percent`` of the documents are transformed, ``spm_percent`` of these with the suffix first; a document's cuts and form follow from its id and
    ``seed`` alone, so rows that repeat an id are cut alike in units, each by its own text, and reruns agree. Plain, and unchanged, are also the texts that are
    empty or hold a marker, so that ``restore`` is exact. A null text is empty, a null id is a document like others; further columns are ignored."""
    _check(markers)
    p, s, m = markers

    def cut(units: Units, doc_id: object, text: str) -> tuple:
        h = draws(doc_id, seed)
        n, after = units(text)
        if not text or any(x in text for x in markers) or h[2] % 100 >= percent:
            return n, "plain", None, None, text
        a, b = map(after, sorted((h[0] % (n + 1), h[1] % (n + 1))))
        pre, mid, suf = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm_percent:
            return n, "spm", a, b - a, f"{s}{suf}{p}{pre}{m}{mid}"
        return n, "psm", a, b - a, f"{p}{pre}{s}{suf}{m}{mid}"

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for i, j in parts(column_bytes(batch.column(1))[1]):
                ids, texts = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                rows = [cut(units, k, t or "") for k, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *cols], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    out = d.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of."""
    _check(markers)
    x = F.split(output, "|".join(re.escape(k) for k in markers), -1)
    whole = F.when(form == "psm", F.concat(x[1], x[3], x[2])).when(form == "spm", F.concat(x[2], x[3], x[1]))
    return F.coalesce(whole, output)
