"""Fill-in-middle, the Merkle manifest and repeated passages against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import fill_in_middle as fim
from barspark.llm import merkle, queries, suffix_dedup

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, h string, k string, at long, id long, leaf int"


def frame(spark, rows):
    """Documents (id, text, source) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "en", 3, "h", "k", 7, -1, 0) for i, t, s in rows], SCHEMA)


# --- fill-in-middle


def fim_by_hand(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = ["", None, "a", "ab cd", "<P>x", "x <M> y", "<", "<<S", "P> <P", "ä\n\r\x00z", "😀😀 b", "  ", "Zz" * 50, "a1b2", "<P", "S>"]


def test_fim_by_hand_and_restored(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "s") for i in range(320)] + [(None, "n u l l", "s"), (5, "ab cd", "s"), (5, "ab cd", "s")]
    out = fim.fill_in_middle(frame(spark, rows)).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5])
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key)
    assert got == sorted(((i, *fim_by_hand(i, t)) for i, t, _ in rows), key=key)
    assert Counter(r.back for r in out) == Counter(t or "" for _, t, _ in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame(spark, [])).count() == 0


def test_fim_of_texts_longer_than_a_stretch(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice(["ab", " ", "c", "1", "ü"]) for _ in range(n)) for n in (0, 1, 9, 10, 11, 200)] + ["x" * 64, "x" * 30 + " " + "y" * 30, " " * 40]
    for stretch in (1, 3, 10, 1 << 20):
        monkeypatch.setattr(fim, "STRETCH", stretch)
        for t in texts:
            n, after = fim.Units()(t)
            ends = np.cumsum([0, *map(len, re.findall("[A-Za-z]+|[^A-Za-z]", t))])
            assert n == len(ends) - 1 and [after(k) for k in range(n + 1)] == ends.tolist()


def test_fim_of_a_very_long_text(spark):
    t = "ab, " * 1_500_000
    r = fim.fill_in_middle(frame(spark, [(3, t, "s")])).first()
    assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (3, *fim_by_hand(3, t))


def test_fim_markers_and_shares(spark):
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(frame(spark, []), markers=bad)
    out = fim.fill_in_middle(frame(spark, [(i, "a b c d", "s") for i in range(2000)]), percent=50, spm_percent=50, markers=("[pre]", "[suf]", "[mid]"))
    n = Counter(r.form for r in out.collect())
    assert 900 < n["plain"] < 1100 and 400 < n["psm"] < 600 and 400 < n["spm"] < 600
    back = out.select(fim.restore(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("t")).distinct().collect()
    assert [r.t for r in back] == ["a b c d"]


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    """Root, and each leaf's siblings level by level with its place."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, a in enumerate(at):
            lo = a - a % fanout
            paths[i].append((a % fanout, level[lo:a] + level[a + 1 : lo + fanout]))
            at[i] = a // fanout
        level = [h(*level[j : j + fanout]) for j in range(0, len(level), fanout)]
    return level[0], paths


def manifest_by_hand(rows, fanout):
    """rows: (group, id, leaf, claimed); gives sorted (id, leaf, subroot, root, proof, folded)."""
    groups = {}
    for g, i, leaf, claimed in rows:
        groups.setdefault((g is not None, (g or "").encode()), []).append((i is not None, i or 0, leaf, claimed))
    made = {g: tree([r[2] for r in sorted(rs)], fanout) for g, rs in groups.items()}
    order = sorted(made)
    root, above = tree([made[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, above):
        for (has, i, leaf, claimed), path in zip(sorted(groups[g]), made[g][1]):
            f = claimed
            for place, others in path + up:
                f = h(*others[:place], f, *others[place:])
            out.append((i if has else None, leaf, made[g][0], root, "".join("".join(o) for _, o in path + up), f))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout,local", [(2, 1), (2, 3), (3, 0), (16, 3)])
def test_manifest_by_hand(spark, fanout, local):
    r = random.Random(fanout)
    rows = [(g, i, h("x", g or "-", str(i)), h("y", str(i)) if i % 5 == 0 else h("x", g or "-", str(i))) for g, n in (("a", 37), ("b", 1), (None, 9), ("ä", 16), ("Z", 2), ("", 17)) for i in range(n)]
    rows += [("a", None, h("null"), h("null")), ("a", 3, h("again"), h("again")), ("a", 4, *[h("x", "a", "4")] * 2), ("a", 4, *[h("x", "a", "4")] * 2)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "k", 1, 2) for x in rows], "source string, doc_id long, leaf string, claimed string, k string, pos int, n int")
    got = merkle.prove(df, "source", "doc_id", claimed_col="claimed", fanout=fanout, local=local).collect()
    assert sorted(((x.doc_id, x.leaf, x.subroot, x.root, x.proof.hex(), x.folded_root) for x in got), key=repr) == manifest_by_hand(rows, fanout)
    for x in got:
        assert merkle.verify(x.leaf, bytes(x.proof), x.places, x.runs) == x.root
    assert {x.source for x in got} == {g for g, *_ in rows}
    assert len({x.root for x in got}) == 1


def test_manifest_query_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    rows = []
    for d in docs:
        fields = [part(v) for v in (d.doc_id, d.source, d.lang, d.n_chars)]
        bad = zlib.crc32(str(d.doc_id).encode()) % 5 == 0
        rows.append((d.source, d.doc_id, h(*fields, part(d.text)), h(*fields, part(low(d.text) if bad else d.text))))
    got = queries.op12_merkle_manifest(spark, SF).collect()
    want = [(i, leaf, s, r, h(p), f) for i, leaf, s, r, p, f in manifest_by_hand(rows, 16)]
    assert sorted(((x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root) for x in got), key=repr) == sorted(want, key=repr)
    assert all(x.verified == (x.folded_root == x.root) for x in got) and 0 < sum(not x.verified for x in got) < len(got) / 4


def test_manifest_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.prove(empty, "source", "doc_id").count() == 0
    one = merkle.prove(spark.createDataFrame([(None, None, h("a"))], "doc_id long, source string, leaf string"), "source", "doc_id").first()
    assert (one.subroot, one.root, one.folded_root, bytes(one.proof), one.places) == (h("a"), h("a"), h("a"), b"", [])
    values = spark.createDataFrame([(None, "ä", ""), (12, None, "x" * 3_000_000)], "a long, b string, c string")
    got = [r[0] for r in values.select(merkle.leaf_hash(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [h("-", "2:ä", "0:"), h("2:12", "-", "3000000:" + "x" * 3_000_000)]


# --- repeated passages


def repeats_by_hand(texts, length):
    n = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if n[hash(t[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        edge = np.diff(np.concatenate([[0], mask.astype(int), [0]]))
        out.append((len(t), list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), np.frombuffer(t, np.uint8)[~mask].tobytes()))
    return out


def repeats(spark, texts, ids=None, **kw):
    d = frame(spark, [(i, t, "s") for i, t in zip(ids or range(len(texts)), texts)])
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(d, **kw).collect()]


@pytest.mark.parametrize("kinds,stretch,batch", [(1024, 1 << 18, 1 << 21), (2, 64, 256), (1, 17, 1)])
def test_repeats_by_hand(spark, monkeypatch, kinds, stretch, batch):
    for name, v in (("KINDS", kinds), ("STRETCH", stretch), ("BATCH", batch)):
        monkeypatch.setattr(suffix_dedup, name, v)
    r = random.Random(stretch)
    words = ["ab", "c", "ä", " ", "\x00", "😀", "xyz"]
    base = "".join(r.choice(words) for _ in range(120))
    texts = ["", None, "short", "a" * 500, base, base, base[:50] + "!" + base[50:], base[:90] + "?" + base[91:], base[30:]]
    texts += ["".join(r.choice(words) for _ in range(r.choice([5, 40, 200]))) + base[i : i + 25] for i in range(12)] + ["a" * 7 + base, "abcabc" * 30]
    got = sorted(repeats(spark, texts, length=20, gram=5))
    want = repeats_by_hand([(t or "").encode() for t in texts], 20)
    assert got == [(i, *w) for i, w in enumerate(want)]


def test_columns_order_suffixes_and_prefixes():
    """What ``rounds`` says of each column equals comparing all pairs of suffixes."""
    r = random.Random(5)
    for _ in range(150):
        m, length = r.randint(1, 9), r.randint(1, 6)
        texts = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(length, 14))) for _ in range(m)]
        groups, lo = np.array(sorted(r.randint(0, 2) for _ in range(m))), np.array([r.randint(0, 4) for _ in range(m)])
        got = {(j - int(lo.max()) + int(lo[i]), int(i)) for j, who in suffix_dedup.rounds(texts, groups, lo, length) for i in who}
        want = set()
        for i in range(m):
            for s in range(len(texts[i]) - length + 1):
                for k in range(m):
                    at = s - lo[i] + lo[k]
                    if k != i and groups[k] == groups[i] and at >= 0 and at + length <= len(texts[k]) and texts[k][at : at + length] == texts[i][s : s + length]:
                        want.add((s, i))
        assert got == want


def test_repeats_query_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = repeats_by_hand([(d.text or "").encode() for d in docs], 400)
    got = {r.doc_id: r for r in queries.op13_suffix_dedup(spark, SF).collect()}
    assert len(got) == len(docs) and any(w[1] for w in want)
    for d, (n, spans, kept) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_repeats_edges(spark):
    assert repeats(spark, []) == []
    assert sorted(repeats(spark, ["x" * 500, "x" * 500, None], ids=[None, 4, 4]), key=repr) == sorted([(None, 500, [(0, 500)], b""), (4, 500, [(0, 500)], b""), (4, 0, [], b"")], key=repr)
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh ") for _ in range(900_000))
    got = dict((i, (n, s)) for i, n, s, _ in repeats(spark, [long, "y" + long[600_000:600_500], "z" * 399]))
    assert got == {0: (900_000, [(600_000, 600_500)]), 1: (501, [(1, 501)]), 2: (399, [])}


def test_repeats_move_whole_texts_once(spark, monkeypatch):
    """Whole texts are dealt out when they are written; neither the fetch of pieces, of anchors with few or many of them, nor the spans' join shuffles them again."""
    monkeypatch.setattr(suffix_dedup, "KINDS", 2)
    fetches, fetched = [], suffix_dedup._fetched
    monkeypatch.setattr(suffix_dedup, "_fetched", lambda *a: fetches.append(fetched(*a)) or fetches[-1])
    r = random.Random(3)
    noise = lambda n: "".join(chr(r.randrange(33, 1000)) for _ in range(n))
    base = noise(60)
    texts = [noise(9) + base[i : i + 30] + noise(9) for i in range(12)] + [base, base, base[:30] + "!" + base[30:]]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tables = {t.name for t in spark.catalog.listTables()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = suffix_dedup.remove_repeats(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), length=20, gram=5)
        got = sorted((x.doc_id, x.n_bytes, [(s.start, s.end) for s in x.spans], bytes(x.kept)) for x in out.collect())
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (*fetches[:2], out)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == [(i, *w) for i, w in enumerate(repeats_by_hand([t.encode() for t in texts], 20))]
    assert len(plans) == 3
    for plan in plans:
        initial = plan.rpartition("== Initial Plan ==")[2]
        assert initial.count("Exchange hashpartitioning(at") == 1 and "Bucketed: true" in plan
    assert {t.name for t in spark.catalog.listTables()} == tables
