"""Results are the same on both sides of every switch by size: what is broadcast or plain for few rows is joined or split for many."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm import html_extract, mix_sources, near_dup, quality_rules, topk_search

SF = "/root/testdata/sf0.01"


def documents(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or ["a"] * len(texts))[i], "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")


def alike(rng, n, changes):
    """``n`` texts, each the same sixty words with so many changed."""
    words = [f"w{k}" for k in range(60)]
    out = []
    for _ in range(n):
        own = list(words)
        for k in rng.sample(range(60), changes):
            own[k] = f"v{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def grouped(n, pairs):
    """Each of ``n`` nodes' smallest reachable one."""
    label = list(range(n))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return [root(i) for i in range(n)]


def components(texts):
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    return grouped(len(texts), ((i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])))


def test_near_duplicates_with_hot_keys(spark, monkeypatch):
    """A hub of 600 texts that are alike through their first one, and 300 that share most words and are mostly not alike, with every switch at its least."""
    rng = random.Random(6)
    texts = alike(rng, 1, 0) + alike(rng, 600, 1) + [t.replace("w", "x") for t in alike(rng, 300, 3)] + [f"alone {i} " * 20 for i in range(40)]
    want = components(texts)
    monkeypatch.setattr(near_dup, "FEW", 0)
    monkeypatch.setattr(near_dup, "HOT", 10**9)
    for small in (near_dup.SMALL, 0):
        monkeypatch.setattr(near_dup, "SMALL", small)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("copies, tile", [(1, 256), (2, 7), (16, 3)])
def test_near_duplicates_in_large_blocks_of_small_tiles(spark, monkeypatch, copies, tile):
    """Few blocks of many tiles give what many blocks of one tile give: texts around the threshold, of which some are alike and most are not."""
    rng = random.Random(8)
    texts = alike(rng, 1, 0) + alike(rng, 60, 1) + [t.replace("w", "x") for t in alike(rng, 90, 2) + alike(rng, 60, 3)]
    monkeypatch.setattr(near_dup, "COPIES", copies)
    sets = [np.unique(np.array([hash(g) & (2**63 - 1) for g in zip(*[t.split()[k:] for k in range(5)])], np.uint64)) for t in texts]
    for same in (True, False):
        f = {"at": np.arange(len(texts)) % 2, "i": np.zeros(1), "j": np.array([0 if same else 1]), "id": np.arange(len(texts)), "label": np.arange(len(texts)), "held": [s.tobytes() for s in sets]}
        if same:
            f["at"] = f["at"] * 0
        monkeypatch.setattr(near_dup, "BLOCK", tile)
        a, b = near_dup._links((75, 100))(f)
        assert len(a) < len(texts)
        want = [[i for i in range(len(texts)) if i == j or ((same or i % 2 != j % 2) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])))] for j in range(len(texts))]
        assert grouped(len(texts), zip(a.tolist(), b.tolist(), strict=True)) == grouped(len(texts), ((j, i) for j, w in enumerate(want) for i in w))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, texts), block=tile).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_candidates_span_ids_and_not_labels():
    """Of labels 1 and 2 one pair may be alike and prove false, so that another pair of the same labels must be spanned too."""
    sig = np.array([[1] * 128, [1] * 128, [2] * 128, [2] * 128], np.uint32)
    f = {"at": np.zeros(4, int), "i": np.zeros(1), "j": np.zeros(1), "id": np.array([5, 6, 7, 8]), "label": np.array([1, 2, 1, 2]), "n": np.full(4, 9), "held": [s.tobytes() for s in sig]}
    a, b = near_dup._candidates(69, (75, 100))(f)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(5, 6), (7, 8)]


def test_copies_of_a_row_stay_few(spark):
    """Blocks of a group: 256 documents each up to 16 blocks, then 16 larger ones, then blocks of 32,768."""
    sizes = [1, 256, 4096, 4097, 500_000, 1_000_000, 100_000_000]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", near_dup._blocks(F.col("n"), near_dup.BLOCK, near_dup.BLOCK_ROWS).alias("b")).collect()
    assert [r.b for r in sorted(got)] == [1, 1, 16, 16, 16, 31, 3052]


def test_join_hot_joins_hot_and_cold_keys(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FEW", 0)
    monkeypatch.setattr(near_dup, "HOT", 4)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    least = rows.groupBy("k").agg(F.min("id").alias("m"), F.count("*").alias("n"))
    got = near_dup.join_hot(rows, least, "k", "n", 3000).collect()
    assert len(got) == 3000 and all(r.m == (0 if r.k == 0 else r.id) for r in got)


@pytest.mark.parametrize("module, name", [(mix_sources, "SMALL"), (quality_rules, "SMALL"), (topk_search, "SHARD_BYTES")])
def test_constants(spark, monkeypatch, module, name):
    docs, labels, vectors = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "embeddings"))
    run = {
        mix_sources: lambda: mix_sources.mix(docs, shard_words=20_000),
        quality_rules: lambda: quality_rules.judge(docs, labels),
        topk_search: lambda: topk_search.top_k(vectors),
    }[module]
    many = Counter(map(str, run().collect()))
    monkeypatch.setattr(module, name, 1)
    assert Counter(map(str, run().collect())) == many


def test_parameters(spark):
    docs, labels, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages"))
    assert Counter(map(str, quality_rules.judge(docs, labels, small=0).collect())) == Counter(map(str, quality_rules.judge(docs, labels).collect()))
    assert Counter(html_extract.extract(pages, small=0).collect()) == Counter(html_extract.extract(pages).collect())


def test_pipeline_stages(spark, monkeypatch):
    rng = random.Random(7)
    texts = [t.replace("w", f"y{i // 3}") for i, t in enumerate(alike(rng, 60, 1))]
    docs = documents(spark, texts, ["a", "b", None] * 20)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.mixing):
        monkeypatch.setattr(near_dup, "SMALL", 400_000)
        few = Counter(stage(spark, docs, SF).collect())
        monkeypatch.setattr(near_dup, "SMALL", 0)
        assert Counter(stage(spark, docs, SF).collect()) == few


def test_hidden_inline_elements_go():
    page = lambda body: html_extract.Page(f"<article><p>{body}</p><p>end</p></article>").text(None)
    assert page('a <span hidden>x <span>y</span> z</span>b <b>c</b>') == "a b c\nend"
    assert page('a <span style="display: none">x</span><em aria-hidden="true">q</em>b <span class="display">c</span>') == "a b c\nend"
    assert page("a <span hidden>x") == "a\nend" and page("a </span>b<i hidden/>c") == "a bc\nend"
    assert page('a<span hidden><div>x</span>b') == "a\nb\nend" and page("<span>a <i hidden>x</i></span> b") == "a b\nend"
