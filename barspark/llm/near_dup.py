"""Near-duplicate documents: MinHash bands, verification on full shingle sets, components by large-star and small-star."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .text_bytes import LOWER_WORDS, column_bytes, frees, mixed, parts, word_hashes

#: 32 bands of 4 minima: a pair at similarity 0.75 shares no band with a chance of (1 - 0.75**4)**32, or 5e-6.
BANDS, ROWS = 32, 4
#: Groups of documents are compared in square tiles of so many documents a side, fewer if their sets are long.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: A group is dealt into so many blocks at most, and a row is sent once to each, until a block holds so many documents (signatures: 16 MB) or full tiles
#: of sets (32 MB). So rows are copied 16 times in groups of up to 524,288 documents and ``size / 32,768`` times beyond, not ``size / 256``.
COPIES, BLOCK_ROWS, BLOCK_TILES = 16, 1 << 15, 4
#: A table of so many ids at most (some 40 bytes each in memory) is broadcast; a larger one is joined by a shuffle.
SMALL = 400_000
#: Keys with more than a 1/1000 of the rows are joined by a broadcast, which then has at most 1000 of them for each row's keys.
HOT, FEW = 1000, 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = mixed(np.arange(1, 65, dtype=np.uint64) * _MIX) | np.uint64(1)


def shingle_sets(x: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes: ``width`` words each, ASCII letters lower-cased.

    Fewer words give one shingle of them all; a text without words has none."""
    words, at = word_hashes(x, ends, LOWER_WORDS)
    n = len(words) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        h += words[j : j + n] * _STEPS[j]
    h, out = mixed(h), []
    for i, k in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if k - i >= width:
            out.append(np.unique(h[i : k - width + 1]))
        elif k > i:
            out.append(mixed((words[i:k] * _STEPS[: k - i]).sum(keepdims=True) + np.array([k - i], np.uint64) * _MIX))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _coefficients(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of universal hashes ``a x + b`` of a set, modulo 2**32; long sets go through in blocks."""
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        h = x[i : i + 2048, None] * a
        h += b
        np.minimum(best, h.min(axis=0), out=best)
    return best


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sign(width: int, bands: int, rows: int, seed: int):
    a, b = _coefficients(bands * rows, seed)
    salt = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _MIX

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = column_bytes(batch.column(1))
            for i, j in parts(ends):
                sets = shingle_sets(data, ends[i : j + 1], width)
                sigs = np.stack([signature(s, a, b) for s in sets])
                h = np.repeat(salt[None, :], len(sets), axis=0)
                for r in range(rows):
                    h = mixed(h + sigs.reshape(-1, bands, rows)[:, :, r].astype(np.uint64) * _MIX)
                full = [len(s) > 0 for s in sets]
                pick = lambda values: pa.array([v if ok else None for v, ok in zip(values, full, strict=True)])  # noqa: B023, E731
                keys = pa.array([k if ok else None for k, ok in zip(h.view(np.int64), full, strict=True)], pa.list_(pa.int64()))
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, pick(map(_digest, sets)).cast(pa.binary()), pick(x.tobytes() for x in sigs).cast(pa.binary()), keys], ["id", "n_shingles", "same", "sig", "keys"])

    return run


def _sets(width: int, most: int = 1 << 23):
    """Each row's set in the place of its text, in batches of bounded size."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = column_bytes(batch.column(1))
            for i, j in parts(ends, most >> 4):
                sets = [s.tobytes() for s in shingle_sets(data, ends[i : j + 1], width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary()), *[c.slice(i, j - i) for c in batch.columns[2:]]], ["id", "held", *batch.schema.names[2:]])

    return run


def _sets_alike(share: tuple[int, int]) -> Callable[[bytes, bytes], bool]:
    def alike(x: bytes, y: bytes) -> bool:
        m, n = len(x) // 8, len(y) // 8
        if share[1] * min(m, n) < share[0] * max(m, n):
            return False
        both = m + n - len(np.union1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
        return share[1] * both >= share[0] * (m + n - both)

    return alike


def _signatures_alike(least: int) -> Callable[[bytes, bytes], bool]:
    return lambda x, y: int((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum()) >= least


def _against_heads(alike: Callable[[bytes, bytes], bool]):
    """Streams sorted rows ``(a, salt, member, id, held)``: a star's head comes first, then its members; yields the stars' true links.

    What is kept is one head (one set for each text of its id), never the members."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, []
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            a, b = [], []
            for star, salt, member, i, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (star, salt) != now:
                    now, heads = (star, salt), []
                if not member:
                    if held not in heads:
                        heads.append(held)
                elif any(alike(h, held) for h in heads):
                    a.append(star), b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def agreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places each signature of ``x`` agrees with each of ``y``, by the last 8 bits: never fewer than there are."""
    x, y = x.astype(np.uint8).T.copy(), y.astype(np.uint8).T.copy()
    out = np.zeros((x.shape[1], y.shape[1]), np.uint16)
    for p, q in zip(x, y, strict=True):
        out += p[:, None] == q[None, :]
    return out


def intersections(sets: list[np.ndarray], first: int, cells: int = 1 << 21) -> np.ndarray:
    """The exact sizes of the intersections of the ``first`` sets with the others, or of all with all if there are no others.

    Products of membership matrices, some columns at a time."""
    n, rest = len(sets), first if first < len(sets) else 0
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    begin = np.flatnonzero(new)
    times = np.diff(begin, append=len(flat))
    shared = np.repeat(times > 1, times)
    col = np.repeat(np.cumsum(times > 1) - 1, times)[shared]
    row, out, k = row[shared], np.zeros((first, n - rest), np.int64), max(1, cells // n)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, k):
        i, j = np.searchsorted(col, [at, at + k])
        m = np.zeros((n, int(col[j - 1]) - at + 1), np.float32)
        m[row[i:j], col[i:j] - at] = 1
        out += np.rint(m[:first] @ m[rest:].T).astype(np.int64)
    return out


def forest(alike: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span each component of a symmetric matrix: from its first row to every other, fewer than there are rows."""
    left, a, b = alike.any(axis=1), [], []
    while left.any():
        first = int(np.argmax(left))
        left[first] = False
        todo, seen = np.array([first]), []
        while len(todo):
            todo = np.flatnonzero(alike[todo].any(axis=0) & left)
            left[todo] = False
            seen.append(todo)
        b.append(ids[np.concatenate(seen)])
        a.append(np.full(len(b[-1]), ids[first]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _by_block(link: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]], names: tuple[str, ...]):
    """Streams sorted rows ``(group, i, j, ...)``, one block pair after the other, and yields what ``link`` makes of each."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def edges() -> pa.RecordBatch:
            cols = [c for c in zip(*held, strict=True)]
            f = {k: list(chunk for c in v for chunk in c.to_pylist()) if k == "held" else np.concatenate([c.to_numpy(zero_copy_only=False) for c in v]) for k, v in zip(names, cols, strict=True)}
            a, b = link(f)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]])
            cut = [0, *(np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cut, cut[1:], strict=False):
                if (key := tuple(g[:, i].tolist())) != now:
                    if held:
                        yield edges()
                    now, held = key, []
                held.append([c.slice(i, j - i) for c in batch.columns[1:]])
        if held:
            yield edges()

    return run


def _tiled(cost: np.ndarray) -> list[np.ndarray]:
    """Rows in runs of no more than a tile each; one row may be more than that by itself."""
    return np.split(np.arange(len(cost)), np.flatnonzero(np.diff((np.cumsum(cost) - cost) // 1)) + 1)


def _tiles(f: dict[str, np.ndarray], cost: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tile pairs of a block pair ``(i, j)``: rows of one against rows of the other, a block with itself by its tiles and their pairs."""
    i, j = f["i"][0], f["j"][0]
    side = [np.flatnonzero(f["at"] == k) for k in (i, j)]
    x, y = [[s[t] for t in _tiled(cost[s])] if len(s) else [] for s in side]
    for k, p in enumerate(x):
        for q in x[k:] if i == j else y:
            yield p, q


def _merged(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``tree`` with the names ``a`` and ``b`` made one, pair by pair."""
    over: dict[int, int] = {}

    def top(k: int) -> int:
        while k in over:
            k = over[k]
        return k

    for k, m in zip(map(top, a.tolist()), map(top, b.tolist()), strict=True):
        if (k := top(k)) != (m := top(m)):
            over[m] = k
    name = np.arange(tree.max() + 1)
    name[list(over)] = [top(k) for k in over]
    return name[tree]


def _spanned(f: dict[str, np.ndarray], cost: np.ndarray, node: str, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the values of ``node`` that span what is ``alike`` across labels in a block pair, fewer than its rows.

    What a tile has linked is one tree in the tiles after it; pairs of one tree aren't linked again, and tiles of one tree aren't compared."""
    tree, a, b = np.unique(f[node], return_inverse=True)[1], [], []
    for p, q in _tiles(f, cost):
        across = (f["label"][p][:, None] != f["label"][q][None, :]) & (tree[p][:, None] != tree[q][None, :])
        if not across.any() or not (ok := alike(p, q) & across).any():
            continue
        both = p
        if p is not q:
            both, n, part = np.concatenate([p, q]), len(p), ok
            ok = np.zeros((len(both), len(both)), bool)
            ok[:n, n:], ok[n:, :n] = part, part.T
        u, v = (both[k] for k in forest(ok, np.arange(len(both))))
        a.append(f[node][u]), b.append(f[node][v])
        tree = _merged(tree, tree[u], tree[v])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _candidates(least: int, share: tuple[int, int]):
    """Spans what may be alike across components, by signatures and set sizes."""

    def link(f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sig, n = np.frombuffer(b"".join(f["held"]), np.uint32).reshape(len(f["id"]), -1), f["n"]

        def alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            x, y = n[p][:, None], n[q][None, :]
            return (agreements(sig[p], sig[q]) >= least) & (share[1] * np.minimum(x, y) >= share[0] * np.maximum(x, y))

        return _spanned(f, np.full(len(n), 1 / BLOCK), "id", alike)

    return link


def _links(share: tuple[int, int]):
    """Spans what is alike across components, by full sets."""

    def link(f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(s, np.uint64) for s in f["held"]]
        n = np.array([len(s) for s in sets])

        def alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            both = intersections([sets[k] for k in (p if p is q else np.concatenate([p, q]))], len(p))
            return share[1] * both >= share[0] * (n[p][:, None] + n[q][None, :] - both)

        return _spanned(f, np.maximum(1 / BLOCK, n / BLOCK_SHINGLES), "label", alike)

    return link


def _blocks(load: Column, least: int, most: int) -> Column:
    """How many blocks a group of this load is dealt into: of ``least`` each, larger ones from ``COPIES`` blocks on, up to ``most``."""
    return F.ceil(load / F.least(F.greatest(load / COPIES, F.lit(float(least))), F.lit(float(max(least, most))))).cast("int")


def _paired(blocks: str = "blocks", at: str = "at") -> Column:
    """The block pairs ``(i, j)``, i at most j, that a row of block ``at`` takes part in."""
    return F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda o: F.struct(F.least(o, F.col(at)).alias("i"), F.greatest(o, F.col(at)).alias("j")))


def _few(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= SMALL else small


def join_hot(rows: DataFrame, small: DataFrame, key: str, times: str, total: int) -> DataFrame:
    """``rows`` joined to ``small``, which has each key once and says in ``times`` how many rows carry it.

    The keys of more than ``1 / HOT`` of ``total`` rows, so fewer than ``HOT``, are broadcast and spread no rows; the others are shuffled.
    Up to ``FEW`` rows, a few MB, can't be many for one task, whatever their keys."""
    if total <= FEW:
        return rows.join(small.drop(times), key)
    most = max(256, total // HOT)
    hot, cold = small.where(F.col(times) > most).drop(times), small.where(F.col(times) <= most).drop(times)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` of every node in ``edges(a, b)``: the smallest id it can reach.

    Alternates large-star and small-star until the edges stand still, however many rounds that takes; minima come from partial aggregates, and
    a hub's minimum is broadcast to its edges, so a hub is never one group in a task. Edges of earlier rounds are deleted. Nodes without an edge have no row."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("d"))
        big = materialize(join_hot(both.where("v > u"), least, "u", "d", now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = join_hot(big, least, "u", "d", now[0]).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e), discard(big)
        e = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: tuple[int, int] = (75, 100), bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents with equal shingle sets form a class and go on as their smallest id. Band buckets link every member to the bucket's smallest id, its
    head; members stream past their head, whose signature screens them and whose full set confirms the link. Buckets that then still hold several
    components are compared block against block by signatures; what may be alike across components is spanned by a forest, whose
    trees are groups that no true link leaves. Each group's full sets meet block against block, exactly, and again only a forest comes out.
    So no bucket has a cap, none is expanded into its pairs, a row is copied once for each of a few large blocks (``COPIES``), which a task compares
    tile by tile, and links never outnumber documents by more than the number of blocks they meet.

    Null or word-less texts have 0 shingles and are linked with nothing. Rows that repeat an id count as one
    node; each gets its row. A null id gets a null component and is kept. Other columns are ignored.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = materialize(base.mapInArrow(_sign(width, bands, rows, seed), "id long, n_shingles long, same binary, sig binary, keys array<long>"), "signatures")
    named = signed.where("id is not null and same is not null")
    total = named.count()
    classes = named.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    scratch: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        scratch.append(materialize(df, name))
        return scratch[-1]

    several = kept(classes.where("times > 1").select("same", "rep", "times"), "classes")
    of_class = join_hot(named.select("id", "same"), several, "same", "times", total).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    # One row a class: those of single documents, and of the others the row of their smallest id.
    twins = several.count()
    reps = named.join(_few(several.select("same", "rep"), twins), "same", "left").where("rep is null or rep = id")
    alone, twin = reps.where("rep is null"), reps.where("rep is not null")
    reps = alone.unionByName(twin.dropDuplicates(["same"])) if twins else alone
    if twins:
        reps = kept(reps.select("id", "n_shingles", "sig", "keys"), "reps")

    members = reps.select("id", F.explode("keys").alias("key"))
    heads = members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("times")).where("z > a").select("key", "a", "times")
    shared = kept(join_hot(members, heads, "key", "times", total * bands), "buckets")
    in_buckets = shared.count()
    stars = kept(shared.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "stars")

    mean = bands * rows * share[0] / share[1]
    least = int(np.ceil(mean - 5.5 * np.sqrt(mean * (1 - share[0] / share[1]))))

    def confirmed(pairs: DataFrame, by_set: bool) -> DataFrame:
        n = pairs.count()
        # A head of very many members stands once for each of their parts.
        most = max(4096, n // HOT)
        hubs = pairs.groupBy("a").agg(F.count("*").alias("d")).where(F.col("d") > most).select("a", F.ceil(F.col("d") / most).cast("int").alias("parts"))
        p = pairs.join(F.broadcast(hubs), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        member = p.select(F.col("b").alias("id"), F.struct("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("member")).alias("at"))
        head = p.select("a", "parts").distinct().select(F.col("a").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: F.struct(F.col("a"), s.alias("salt"), F.lit(0).alias("member")))).alias("at"))
        where = kept(member.unionByName(head).groupBy("id").agg(F.collect_list("at").alias("at")), "roles")
        few = _few(where, where.count())
        if by_set:
            rows_ = base.join(few, "id").select("id", "text", "at").mapInArrow(_sets(width), "id long, held binary, at array<struct<a: long, salt: int, member: int>>")
        else:
            rows_ = reps.select("id", F.col("sig").alias("held")).join(few, "id")
        rows_ = rows_.withColumn("at", F.explode("at")).select("at.a", "at.salt", "at.member", "id", "held")
        alike = _sets_alike(share) if by_set else _signatures_alike(least)
        out = rows_.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(_against_heads(alike), "a long, b long")
        return kept(out.distinct(), "links" if by_set else "screened")

    links = confirmed(confirmed(stars, False), True)
    labels = kept(components(links), "labels")
    few = _few(labels, labels.count())
    placed = shared.select("key", "id").join(few, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed_ = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("times")).where("hi > lo").select("key", "times", _blocks(F.col("times"), block, BLOCK_ROWS).alias("blocks"))
    dealt = kept(join_hot(placed, mixed_, "key", "times", in_buckets).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "mixed")
    seen = kept(dealt.select("id").distinct(), "ids")
    sig = reps.join(_few(seen, seen.count()), "id", "left_semi").select("id", F.col("n_shingles").alias("n"), F.col("sig").alias("held"))
    names = "i int, j int, at int, id long, label long, n long, held binary"
    cols = [c.split()[0] for c in names.split(", ")]
    pairs = dealt.join(sig, "id").withColumn("p", F.explode(_paired())).select(F.col("key").alias("g"), "p.i", "p.j", "at", "id", "label", "n", "held")
    spans = pairs.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_by_block(_candidates(least, share), tuple(cols)), "a long, b long").distinct()
    groups = components(spans).select("id", F.col("label").alias("g"))
    known = reps.select("id", F.col("n_shingles").alias("n")).join(few, "id", "left").select("id", "n", F.coalesce("label", "id").alias("label"))
    held = kept(groups.join(known, "id"), "groups")
    size = held.groupBy("g").agg(_blocks(F.sum(F.greatest(F.lit(1 / block), F.col("n") / BLOCK_SHINGLES)), 1, BLOCK_TILES).alias("blocks"), F.count("*").alias("times"))
    # Blocks by the ids' hash; a group's documents are told by their place, so none is left out.
    held = join_hot(held, size, "g", "times", total).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    held = kept(held.select("id", "g", "label", "n", "at", "blocks"), "blocks")
    sets = base.join(_few(held, held.count()), "id").select("id", "text", "g", "label", "n", "at", "blocks").mapInArrow(_sets(width), "id long, held binary, g long, label long, n long, at int, blocks int")
    full = sets.withColumn("p", F.explode(_paired())).select("g", "p.i", "p.j", "at", "id", "label", "n", "held")
    extra = kept(full.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_by_block(_links(share), tuple(cols)), "a long, b long").distinct(), "links")
    label = components(labels.select(F.col("label").alias("a"), F.col("id").alias("b")).unionByName(extra).unionByName(of_class))
    for done in scratch:
        discard(done)
    out = signed.select("id", "n_shingles").join(label, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("label", "id").alias("component_id"), F.coalesce(F.coalesce("label", "id") == F.col("id"), F.lit(True)).alias("kept"))
