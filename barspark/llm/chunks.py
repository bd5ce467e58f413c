"""Cutting texts where the tokenizers' splitting pattern cuts them at white space, and encoding each distinct chunk of a part once.

The pattern (``public_tokenizers.PATTERN``, and the byte-level pre-tokenizer, which has the same) never matches across the start of a run of white
space, nor across the last character of a run before a word, which belongs to the word if it is a space."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from .text_bytes import BYTES, SPACE, hash_spans

#: Unicode white space, as ``\s`` has it in the tokenizers' patterns.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: White space beyond ASCII: texts that hold any are cut by the pattern above.
WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Bytes of chunks and ids that an encoder remembers; beyond, the half that has not been met for longest is forgotten. Longer chunks aren't remembered.
REMEMBERED, LONGEST = 24 << 20, 64


def chunk_starts(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the chunks of texts without wide white space begin; ``at``: where the texts do, and the end."""
    n = len(x)
    space = SPACE[x]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    before = np.empty(n, bool)  # white space before, in the same text
    before[0], before[1:] = False, space[:-1]
    after = np.empty(n, bool)  # no white space after, in the same text
    after[-1], after[:-1] = False, ~space[1:]
    edge = begins[:n]
    first = edge | (space & ~before)
    first |= space & after & ~begins[1:]
    word = ~space & before
    word[1:] &= x[:-1] != 32
    return np.flatnonzero(first | word)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...``: the places of all spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Memory:
    """Chunks and their ids in a few flat arrays, ordered by hash: some 45 bytes a chunk. A chunk is found only if its bytes are equal."""

    def __init__(self, kind: np.dtype):
        self.hash, self.at, self.length, self.first, self.count, self.met = (np.empty(0, k) for k in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64))
        self.text, self.ids, self.turn = np.empty(0, np.uint8), np.empty(0, kind), 0

    def find(self, h: np.ndarray, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the sorted hashes ``h``, and whether they are those of the chunks."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        e = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = (self.hash[e] == h) & (self.length[e] == lengths)
        k = np.flatnonzero(hit)
        if len(k):
            n = lengths[k]
            same = x[ragged(starts[k], n)] == self.text[ragged(self.at[e[k]], n)]
            hit[k] = np.logical_and.reduceat(same, np.cumsum(n) - n)
            self.turn += 1
            self.met[e[k]] = self.turn
        return e, hit

    def add(self, h: np.ndarray, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        new = lengths <= LONGEST
        h, starts, lengths, first, count = h[new], starts[new], lengths[new], first[new], count[new]
        at = len(self.text) + np.cumsum(lengths) - lengths
        self.text = np.concatenate([self.text, x[ragged(starts, lengths)]])
        ids, first = ids[ragged(first, count)], len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        self._order(*(np.concatenate(v) for v in ((self.hash, h), (self.at, at), (self.length, lengths), (self.first, first), (self.count, count), (self.met, np.full(len(h), self.turn)))))
        if 48 * len(self.hash) + self.text.nbytes + self.ids.nbytes > REMEMBERED:
            k = np.flatnonzero(self.met > np.median(self.met))
            text, ids = self.text[ragged(self.at[k], self.length[k])], self.ids[ragged(self.first[k], self.count[k])]
            n, m = self.length[k], self.count[k]
            self.text, self.ids = text, ids
            self._order(self.hash[k], np.cumsum(n) - n, n, np.cumsum(m) - m, m, self.met[k])

    def _order(self, *columns: np.ndarray) -> None:
        _, k = np.unique(columns[0], return_index=True)
        self.hash, self.at, self.length, self.first, self.count, self.met = (c[k] for c in columns)


class ChunkEncoder:
    """Ids of whole texts by chunk. ``new`` encodes a list of chunks (UTF-8) that are not remembered, each to raw little-endian ids of ``kind``."""

    def __init__(self, new: Callable[[list[bytes]], list[bytes]], kind: str, special: Callable[[str], list[str]] | None = None, marks: list[bytes] | None = None):
        self.new, self.kind, self.special = new, np.dtype(kind), special
        self.marks = re.compile(b"|".join(map(re.escape, marks))) if marks else None
        self.memory = Memory(self.kind)

    def _fresh(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = x.tobytes()
        ids = self.new([raw[i : i + n] for i, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
        return np.frombuffer(b"".join(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize

    def spans(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks from each start to the next, one after the other, and how many each has; distinct chunks are encoded once."""
        length = np.diff(starts, append=len(x))
        h, rep, back = np.unique(hash_spans(x, starts, BYTES), return_index=True, return_inverse=True)
        s, n = starts[rep], length[rep]
        if (length != n[back]).any() or (x[np.arange(len(x)) + np.repeat(s[back] - starts, length)] != x).any():
            return self._fresh(x, starts, length)  # two chunks have one hash
        entry, hit = self.memory.find(h, x, s, n)
        flat, first, count = self.memory.ids, np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        first[hit], count[hit] = self.memory.first[entry[hit]], self.memory.count[entry[hit]]
        gaps = np.flatnonzero(~hit)
        if len(gaps):
            ids, many = self._fresh(x, s[gaps], n[gaps])
            begin = np.cumsum(many) - many
            first[gaps], count[gaps] = len(flat) + begin, many
            flat = np.concatenate([flat, ids])
            self.memory.add(h[gaps], x, s[gaps], n[gaps], ids, begin, many)
        return flat[ragged(first[back], count[back])], count[back]

    def _one(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "surrogatepass")
        chunks = [c.encode("utf-8", "surrogatepass") for c in (self.special(text) if self.special and self.marks and self.marks.search(raw) else CHUNK.findall(text)) if c]
        if not chunks:
            return np.empty(0, self.kind)
        size = np.array([len(c) for c in chunks])
        return self.spans(np.frombuffer(b"".join(chunks), np.uint8), np.cumsum(size) - size)[0]

    def encode(self, x: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of each of the texts ``x[ends[i]:ends[i + 1]]``."""
        base = int(ends[0])
        x, at = x[base : int(ends[-1])], ends - base
        raw = x.tobytes()
        hard = {int(np.searchsorted(at, m.start(), "right")) - 1 for p in (WIDE, self.marks) if p for m in p.finditer(raw)}
        if hard:
            easy = [i for i in range(len(at) - 1) if i not in hard]
            size = np.array([at[i + 1] - at[i] for i in easy], np.int64)
            got = dict(zip(easy, self.encode(np.frombuffer(b"".join(raw[at[i] : at[i + 1]] for i in easy), np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), strict=True)) if easy else {}
            return [got[i] if i in got else self._one(raw[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
        if not len(x):
            return [np.empty(0, self.kind)] * (len(at) - 1)
        starts = chunk_starts(x, at)
        ids, count = self.spans(x, starts)
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, at)].tolist()
        return [ids[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)]
