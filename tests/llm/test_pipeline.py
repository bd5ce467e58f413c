"""The corpus pipeline against what its stages' operators decide one by one."""

import hashlib

import corpus_pipeline
from barspark.llm import near_dup, quality_classifier, quality_rules
from barspark.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.01"


def test_every_stage_acts_on_what_the_one_before_kept(spark):
    import public_tokenizers as P
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    a = stages["quality rules"](spark, docs, SF)
    assert a.columns == docs.columns
    assert ids(a) == ids(quality_rules.judge(docs, labels).where("kept"))
    b = stages["quality classifier"](spark, a, SF)
    assert set(ids(b)) <= set(ids(a)) and b.columns == docs.columns
    c = stages["near-duplicates"](spark, b, SF)
    assert ids(c) == ids(near_dup.near_duplicates(b).where("kept"))
    d = stages["mixing"](spark, c, SF)
    assert d.columns == docs.columns and set(ids(d)) <= set(ids(c))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={k: v for k, v in __import__("barspark.llm.byte_bpe", fromlist=["x"]).load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken")).items()}, special_tokens={})
    text = {r.doc_id: r.text for r in docs.collect()}
    e = stages["encoding"](spark, d, SF).collect()
    assert sorted(r.doc_id for r in e) == ids(d)
    for r in e[::17]:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, lib.encode_ordinary(text[r.doc_id]))).encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark):
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


WORDS = "river stone market window garden letter bridge winter copper island planet orchard".split()


def plain(seed, n=80):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + "abcdefghij"[rng.randrange(10)] for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")


def test_near_duplicates_drop_by_text_not_by_id(spark):
    a, b, c, d, e = (plain(k) for k in range(5))
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (9, e), (8, e), (None, e), (None, None), (None, "")]
    got = corpus_pipeline.near_duplicates(spark, documents(spark, rows), SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in [(None, a), (None, b), (7, c), (7, d), (8, e), (None, None), (None, "")])


def test_rejections_take_effect_row_by_row(spark, monkeypatch):
    good, short = plain(1), "too short"
    rows = [(-1, good), (-1, short), (None, good), (None, short), (None, short)]
    assert corpus_pipeline.rules(spark, documents(spark, rows[:0]), SF).count() == 0
    wide = documents(spark, rows).selectExpr("*", "1 AS stratum", "2 AS n_words", "3 AS id")
    assert corpus_pipeline.rules(spark, wide, SF).columns == wide.columns and corpus_pipeline.rules(spark, wide, SF).count() == 2
    got = corpus_pipeline.rules(spark, documents(spark, rows), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("-1", good), ("None", good)]
    bags = [quality_classifier.bag(t) for t in (good, short)] * 60
    model = quality_classifier.train(bags, __import__("numpy").array([1, 0] * 60))
    monkeypatch.setattr(quality_classifier, "fit", lambda *a, **b: model)
    got = corpus_pipeline.classifier(spark, documents(spark, rows), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("-1", good), ("None", good)]


def test_mixing_takes_each_row_at_most_three_times(spark):
    from collections import Counter

    rows = [(7, plain(k)) for k in range(20)] + [(None, plain(k)) for k in range(20, 40)]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixing(spark, documents(spark, rows), SF).collect())
    assert set(got) <= set(rows) and max(got.values()) <= 3 and 30 <= sum(got.values()) <= 50


def test_classifier_learns_from_the_whole_table(spark, monkeypatch):
    seen, fit = [], quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda docs, labels: seen.append(docs.count()) or fit(docs, labels))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = "Click here!!! $$$ FREE FREE FREE ### " * 40
    stage = corpus_pipeline.classifier(spark, documents(spark, [(-1, bad)]).unionByName(docs.limit(5).select("doc_id", "text", "lang", "source")), SF)
    assert stage.count() <= 6 and seen == [docs.count()]
