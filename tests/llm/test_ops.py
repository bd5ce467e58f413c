"""Each training-data operator against brute force, a library, a round trip or held-out labels, and its edge cases."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.llm import byte_bpe, chat_format, html_extract, mix_sources, near_dup, quality_classifier, quality_rules, token_files, topk_search, url_filter

SF = "/root/testdata/sf0.01"
P = pytest.importorskip("public_tokenizers")
TEXT = "doc_id long, text string, lang string, source string, id long, h string, v double, label string"


def docs_frame(spark, texts, ids=None, sources=None, langs=None):
    """Documents with further columns whose names clash with the operators' own."""
    n = len(texts)
    ids = range(n) if ids is None else ids
    return spark.createDataFrame([(i, t, g, s, -1, "h", 0.5, "x") for i, t, s, g in zip(ids, texts, sources or ["a"] * n, langs or ["en"] * n)], TEXT)


# --- URLs


def test_url_parts_and_rules(spark):
    urls = [
        ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://net", "net", "", None, "allow"),
        ("http://subnet/", "subnet", "/", None, "allow"),
        ("ftp://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        ("x.org/fr/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://b.org/fr/\n?q", "b.org", "/fr/\n", "org/fr/", "allow"),
        ("a://b.net?x=://c.org/fr/", "b.net", "", None, "allow"),
    ]
    from barspark.llm.queries import URL_RULES

    pages = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    for inline in (500, 0):
        got = {r.page_id: r for r in url_filter.filter_urls(pages, URL_RULES, inline_rules=inline).collect()}
        for i, u in enumerate(urls):
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == u[1:], u
        assert url_filter.filter_urls(pages.limit(0), URL_RULES, inline_rules=inline).count() == 0
    assert url_filter.filter_urls(pages, ()).where("verdict = 'allow' and rule is null").count() == 20


def test_a_host_with_a_nul_is_a_subdomain(spark):
    rows = [(0, "http://a\x00.net/x"), (1, "http://net\x00/x"), (2, "http://a\nb.example.net/en/q"), (3, None)]
    pages = spark.createDataFrame(rows, "page_id long, link string")
    rules = (url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"))
    for inline in (500, 0):
        got = {r.page_id: r.rule for r in url_filter.filter_urls(pages, rules, url_col="link", inline_rules=inline).collect()}
        assert got == {0: "net/", 1: None, 2: "example.net/en/", 3: None}
    assert pages.select(url_filter.url_parts(F.col("link"))[0]).first()[0] == "a\x00.net"


def test_url_index_finds_what_trying_every_rule_finds(spark):
    rng = random.Random(1)
    label = lambda: rng.choice("abcd")
    rules = list({(h, p): url_filter.Rule(rng.choice(("allow", "block")), h, p) for h, p in ((".".join(label() for _ in range(rng.randint(1, 3))), "/" + "".join(label() + "/" for _ in range(rng.randint(0, 2))) + rng.choice(("", "a"))) for _ in range(60))}.values())
    urls = ["http://" + ".".join(label() for _ in range(rng.randint(1, 4))) + "/" + "/".join(label() for _ in range(rng.randint(0, 3))) for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for inline in (500, 0):
        for r in url_filter.filter_urls(pages, rules, inline_rules=inline).collect():
            fits = [x for x in rules if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
            best = min(fits, key=lambda x: (-len(x.text), x.text), default=None)
            assert (r.rule, r.verdict) == ((best.text, best.action) if best else (None, "allow"))


def test_url_index_is_looked_up_however_many_rules(spark, monkeypatch):
    """4,000 rules against 40 on the same URLs: equal verdicts by index, by table and by salted table, and no growth with the rules."""
    rng = random.Random(5)
    rules = [url_filter.Rule(rng.choice(("allow", "block")), f"s{i}.x{i % 97}.org", rng.choice(("/", f"/d{i % 7}/"))) for i in range(4000)]
    urls = [f"http://{rng.choice(('', 'a.'))}s{rng.randrange(8000)}.x{rng.randrange(97)}.org/d{rng.randrange(7)}/q" for _ in range(3000)]
    urls += [f"http://s{i}.x{i % 97}.org/d{i % 7}/q" for i in range(0, 4000, 9)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by_host = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    want = {}
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        labels = host.split(".")
        fit = [r for k in range(len(labels)) for r in by_host.get(".".join(labels[k:]), ()) if ("/" + path).startswith(r.path)]
        want[i] = max((r.text for r in fit), key=len, default=None)
    assert sum(v is not None for v in want.values()) > 400
    for inline, sent in ((20_000, 1), (0, 100_000), (0, 1)):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", sent)
        assert {r.page_id: r.rule for r in url_filter.filter_urls(pages, rules, inline_rules=inline).collect()} == want
    many = spark.range(200_000).select(F.concat(F.lit("http://a"), F.col("id") % 5000, F.lit(".y.net/q/"), F.col("id")).alias("url")).cache()
    many.count()
    took = {}
    for n in (40, 40, 4000):
        t = time.monotonic()
        url_filter.filter_urls(many, rules[:n]).write.format("noop").mode("overwrite").save()
        took[n] = time.monotonic() - t
    many.unpersist()
    assert took[4000] < 2 * took[40] + 2, took


# --- near duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((root(a), root(b)))
            label[q] = p
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choices(words, k=rng.randint(20, 120)) for _ in range(20)]
    texts = [None, "", "  \n ", "one two", "ONE two", "É one", "é one"]
    passage = rng.choices(words, k=60)
    for b in base:
        chain = list(b)
        for _ in range(12):  # drifts: neighbours are alike, the ends are not
            chain = list(chain)
            chain[rng.randrange(len(chain))] = rng.choice(words)
            texts.append(" ".join(chain))
        texts.append(" ".join(b[:10] + passage))
        texts += [texts[-2]] * 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for block in (512, 3):
        got = near_dup.near_duplicates(docs_frame(spark, [t for _, t in rows], [i for i, _ in rows]), block=block).collect()
        want = brute_components(rows)
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_edges(spark):
    got = near_dup.near_duplicates(docs_frame(spark, ["a b c", "a b c", "a b c", None, "x y"], [3, 3, None, 5, 1])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [(-1, 1, -1, True), (1, 1, 1, True), (3, 1, 3, True), (3, 1, 3, True), (5, 0, 5, True)]
    assert near_dup.near_duplicates(docs_frame(spark, [], [])).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(260, 7), (5, 5), (300, 299), (300, 299)]
    got = {r.id: r.label for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 261)) and got[300] == got[299] == 299 and got[7] == 7


# --- quality rules


def brute_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    cover = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)]


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a a a a", "x\nx\nx\n\n\ny é\u00a0z", "# | a <b>"] + ["".join(rng.choices(["a ", "b ", "c\n", "é#", "\x0b", "a b c "], k=rng.randint(1, 400))) for _ in range(60)]
    for t in texts:
        assert quality_rules.measures(t)[0] == brute_counts(t), t
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge(docs_frame(spark, texts), labels).collect():
        c = brute_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and r.kept == (not r.base_failed)
    assert quality_rules.judge(docs_frame(spark, []), labels).count() == 0


def test_binomial_bound_and_certificate():
    for k, n, d in ((0, 100, 0.05), (3, 200, 0.01), (17, 40, 0.1)):
        p = quality_rules.upper_bound(k, n, d)
        assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - d) < 1e-6
    assert quality_rules.upper_bound(5, 5, 0.1) == 1.0
    good, bad = np.zeros(64, int), np.zeros(64, int)
    good[0], good[5], bad[30], bad[2] = 5000, 40, 100, 100
    cut = quality_rules.certified_cutoff(good, bad, 0.01, 0.001)
    assert 5 / 64 < cut <= 30 / 64
    assert quality_rules.certified_cutoff(good // 500, bad, 0.01, 0.001) is None


def test_cutoffs_limit_false_rejections_in_every_stratum(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts, y, langs = [], [], []
    for i in range(6000):
        bad = rng.random() < 0.2
        texts.append(" ".join(word() + ("%%%" if bad or rng.random() < 0.002 else "") for _ in range(60)))
        y.append(0 if bad else 1), langs.append("en" if i % 2 else None)
    labels = spark.createDataFrame(list(zip(range(6000), y, itertools.repeat(0))), "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(docs_frame(spark, texts, langs=langs), labels, 0.03).collect()}
    for lang in ("en", None):
        good = [got[i].kept for i in range(6000) if y[i] and langs[i] == lang]
        bad = [got[i].kept for i in range(6000) if not y[i] and langs[i] == lang]
        assert sum(good) >= 0.97 * len(good) and sum(bad) == 0


# --- chat


def chat_rows(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, label int")


def test_chat_round_trip(spark):
    t = chat_format.Template()
    controls = [*t.controls(), "\\", "</turn>\n", "#", "<", "\n", "a", "\\0", ""]
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for k in range(rng.randint(1, 6)):
            rows.append((c, k, rng.choice(("user", "assistant", "system", "tool </turn>", None, "\\0", " says: ")), rng.choice((None, "".join(rng.choices(controls, k=rng.randint(0, 12)))))))
    out = chat_format.format_turns(chat_rows(spark, rows))
    reader = chat_format.Reader(t)
    by = {}
    for r in out.collect():
        written = "".join(s.text for s in r.segments)
        by.setdefault(r.conv_id, []).append((r.turn, written))
    for c in range(60):
        want = [(role, text or "") for i, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert reader.turns("".join(w for _, w in by[c])) == want
    for r in chat_format.read_back(out).collect():
        turns = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_order_and_edges(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, "user", None), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(chat_rows(spark, rows))).collect()}
    assert got[1].in_order and not got[2].in_order and not got[None].in_order and got[None].n_turns == 2
    assert chat_format.read_back(chat_format.format_turns(chat_rows(spark, []))).count() == 0


# --- mixing


def test_sainte_lague_against_dealing_one_by_one(spark):
    rng = random.Random(8)
    for seats in (0, 1, 7, 40, 333):
        w = [rng.choice((0, 1, 2, 3, 10, 1000)) for _ in range(12)]
        got = mix_sources.apportion(spark.createDataFrame([(i, float(x), seats, 0) for i, x in enumerate(w)], "i long, w double, s long, g long"), "w", "s", ["i"], ["g"])
        want = [0] * 12
        for _ in range(seats):
            best = max(range(12), key=lambda i: (w[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert {r.i: r.quota for r in got.collect()} == dict(enumerate(want))


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(400)]
    texts = [None if rng.random() < 0.02 else "w " * rng.randint(0, 400) for _ in range(400)]
    d = docs_frame(spark, texts, sources=sources)
    for shard in (10**6, 3000):
        got = mix_sources.mix(d, shard_words=shard).collect()
        assert len(got) == 400
        assert Counter(got) == Counter(mix_sources.mix(d.repartition(13, F.rand(3)), shard_words=shard).collect())
        size = Counter()
        for s, t in zip(sources, texts):
            size[s] += len((t or "").split())
        order = sorted((s for s in size if s), key=str) + [None]
        weight = dict(zip(order, itertools.cycle((5, 2, 1))))
        target, open_ = {}, set(order)
        rest = sum(size.values())
        while True:
            level = rest / sum(weight[s] for s in open_)
            over = {s for s in open_ if weight[s] * level > 3 * size[s]}
            if not over:
                break
            for s in over:
                target[s] = 3 * size[s]
                rest -= 3 * size[s]
            open_ -= over
        target |= {s: weight[s] * level for s in open_}
        taken = Counter()
        for r in got:
            assert 0 <= r.taken <= 3 * r.size and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
            taken[r.source] += r.taken
        for s in order:
            assert abs(taken[s] - target[s]) <= 1
    assert mix_sources.mix(d.limit(0)).count() == 0
    assert mix_sources.mix(docs_frame(spark, [None, ""], [None, None], [None, None])).count() == 2


def test_small_sources_meet_their_targets_to_the_word(spark, monkeypatch):
    """Sources of 1 to 100 words beside a large one, in one shard and in many, with blocks from one word to more than a source has."""
    monkeypatch.setattr(mix_sources, "GROUP", 2)
    words = {"a": [20], "b": [40], "c": [30], "d": [1], "e": [5, 3, 2], "f": [100], "g": [90] * 60 + [7] * 77, None: [1, 0]}
    rows = [(s, n) for s, ns in words.items() for n in ns]
    d = docs_frame(spark, ["w " * n for _, n in rows], sources=[s for s, _ in rows])
    for shard, block in ((10**6, 64), (300, 64), (50, 7), (300, 1)):
        got = mix_sources.mix(d, shard_words=shard, block_words=block).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
        assert abs(sum(r.taken for r in got) - sum(r.size for r in got)) <= len(words)
        for s in words:
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1, (s, shard, block)


def test_a_shard_gives_exactly_its_words_wherever_the_short_block_stands(spark):
    """One source in one shard, its short block before, between or after the blocks taken."""
    for n, want in ((1, 1), (65, 1), (65, 64), (65, 129), (200, 130), (63, 126)):
        d = docs_frame(spark, ["w " * k for k in (n // 3, n - n // 3)])
        got = mix_sources.mix(d, share=want / n).collect()
        assert sum(r.taken for r in got) == want and all(want // n * r.size <= r.taken <= -(-want // n) * r.size for r in got)


def test_mix_of_one_row_many_times_and_a_text_longer_than_a_shard(spark, monkeypatch):
    """Rows without an id and of one size are dealt over a source's shards and groups; a text may be longer than a shard."""
    monkeypatch.setattr(mix_sources, "COPIES", 100)
    monkeypatch.setattr(mix_sources, "GROUP", 3)
    texts = ["w " * 10] * 1000 + ["v " * 50_000] + [None] * 300
    d = docs_frame(spark, texts, [None] * 1000 + [7] + [None] * 300, ["a"] * 1000 + ["b"] + [None] * 300)
    got = mix_sources.mix(d, block_words=16, shard_words=500).collect()
    assert len(got) == len(texts) and Counter(got) == Counter(mix_sources.mix(d.repartition(5, F.rand(4)), block_words=16, shard_words=500).collect())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for source in ("a", "b"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    keyed = mix_sources.mix(d.withColumn("key", F.monotonically_increasing_id()), block_words=16, shard_words=500, row_col="key").collect()
    assert len({r.key for r in keyed}) == len(keyed) == len(texts)


# --- pages


def test_extract_pages(spark):
    rows = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows.assign(text="x", path="y", n_chars=1))).collect()}
    import html as h

    for p in rows.itertuples():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_extract_drops_what_is_not_the_article(spark):
    page = """<html><head><title>no</title></head><body class=x><header>no</header><div id="cookie-notice">no</div><div class="wrap-7"><aside>no</aside>
    <div class='post-12'><h1>Head</h1><p>One &amp; two&nbsp;three<p>Four <a href="x">five</a> &lt;b&gt;</p><form><input>no<button>no</button></form><script>if (a<b) "no</p>"</script>
    <div class="advert-3">no</div><pre>a  b
    c</pre></div><div class="comments"><p>no</p></div></div><footer>no</footer></body></html>"""
    want = "Head\nOne & two three\nFour five <b>\na b c"
    other = page.replace("post-12", "post-9").replace("One", "Uno")
    rows = [(1, "http://h/1", page), (2, "http://h/2", other), (3, None, None), (4, "http://h/3", ""), (5, "http://h/4", "<p>only"), (1, "http://h/1", page), (6, "http://k", "<div class=\"a><p>x's</p> < y</div>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 7 and by[1] == want and by[2] == want.replace("One", "Uno") and by[3] == by[4] == "" and by[5] == "only" and "x's" in by[6]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hosts_share_a_path(spark):
    long, short = "<div class=main-1><p>" + "word " * 80 + "</div>", "<div class=main-2><p>few</div>"
    box = "<div class=box><p>" + "other text here " * 5 + "</div>"
    rows = [(i, "http://h/", f"<body>{long}{box}") for i in range(5)] + [(9, "http://h/", f"<body>{short}{box}")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "few"


# --- tokens

STRINGS = ["", " ", "  ", "a", " a", "don't  stop\n\n x\t\ty ", "\u00a0x \u2003 y", "été über 12three 4½ ²", "a" * 3000, "<|endoftext|> </s>", "\x1c\x1d x", "🙂🙂 한국어 العربية\r\n\r\n ", " \n", "x \n y", "''''ll's"]


def test_bpe_matches_the_library(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = STRINGS + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:300]
    rng = random.Random(6)
    texts += ["".join(rng.choices(["a", "B", " ", "  ", "\n", "'s", "é", "1", "½", "\u3000", "!!", "\t", "<"], k=40)) for _ in range(300)]
    d = docs_frame(spark, [None, *texts])
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(d, path, P.PATTERN), path).collect()}
    assert got[0].ids == [] and got[0].decoded == b""
    for i, t in enumerate(texts, 1):
        assert got[i].ids == lib.encode_ordinary(t), repr(t)
        assert bytes(got[i].decoded) == t.encode()
    assert byte_bpe.decode(byte_bpe.encode(d.limit(0), path, P.PATTERN), path).count() == 0


def test_merge_takes_the_leftmost_lowest_pair():
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 300, b"ba": 301, b"aba": 302, b"aa": 299, b"aaa": 303, b"aaaa": 298}

    def plain(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        while True:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                return [ranks[x] for x in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 10):
        for p in itertools.product(b"abc", repeat=n):
            assert byte_bpe.merge(bytes(p), ranks) == plain(bytes(p))


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = STRINGS + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:200] + [None, None]
    ids = [(i * 37) % len(texts) for i in range(len(texts))]
    want, start = {}, 0
    for i, t in sorted(zip(ids, texts)):
        x = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(x), zlib.crc32(x.tobytes()), x.tolist())
        start += len(x)
    for k, (by_chunk, size) in enumerate(((True, 4 << 20), (False, 2000))):
        token_files.write_shards(docs_frame(spark, texts, ids), p := f"file://{tmp_path}/s{k}", P.path("byte_bpe_50k.json"), by_chunk=by_chunk, shard_bytes=size)
        got = token_files.read_documents(spark, p).collect()
        assert {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == {i: w[:3] for i, w in want.items()}
        found = {r.id: r.ids for r in token_files.lookup(spark, p, [0, 5, 77, 10**12, -3]).collect()}
        assert found == {i: want[i][3] for i in (0, 5, 77)}


def test_token_files_edges(spark, tmp_path):
    d = docs_frame(spark, ["a", "a", "b", "c", None], [1, 1, 1, None, None])
    token_files.write_shards(d, p := f"file://{tmp_path}/e", P.path("byte_bpe_50k.json"))
    got = token_files.read_documents(spark, p).collect()
    assert sorted((r.id or -1, r.start, r.n_tokens) for r in got)[2:] == [(1, 3, 2), (1, 5, 2), (1, 7, 2)] and len(got) == 5
    assert sorted(r.occurrence for r in token_files.lookup(spark, p, [1]).collect()) == [0, 1, 2]
    token_files.write_shards(d.limit(0), p := f"file://{tmp_path}/f", P.path("byte_bpe_50k.json"))
    assert token_files.read_documents(spark, p).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    index = token_files.Index(token_files.build_index(h, np.arange(len(h)), np.ones(len(h), int)))
    found, slots = index.find(h)
    assert found.all() and (slots["start"] == np.arange(len(h))).all() and (slots["row"] == np.arange(len(h))).all() and len(index.table) == len(h)
    assert token_files.Index(token_files.build_index(h[:0], h[:0], h[:0])).find(h)[0].sum() == 0
    assert index.find(h + np.uint64(2**63))[0].mean() < 0.01


def test_a_slot_leads_to_its_key_and_a_wrong_fingerprint_to_none(spark, tmp_path):
    token_files.write_shards(docs_frame(spark, ["a", "b c"], [1, 2]), p := f"file://{tmp_path}/s", P.path("byte_bpe_50k.json"))
    real = token_files.key_hash
    row = spark.read.parquet(p).where("`first` <= 2 and `last` >= 2").first()
    found, slots = token_files.Index(bytes(row["index"])).find(real(np.array([2]), np.array([0], np.uint32)))
    assert found.all() and np.frombuffer(row["keys"], np.int64)[slots["row"]].tolist() == [2]
    bad = bytearray(row["index"])
    at = len(bad) - token_files.SLOT.itemsize * row["n_docs"]
    bad[at : at + 4] = bytes(x ^ 255 for x in bad[at : at + 4])
    keys = np.frombuffer(row["keys"], np.int64)
    assert token_files.Index(bytes(bad)).find(real(keys, np.zeros(len(keys), np.uint32)))[0].sum() == len(keys) - 1
    assert [r.id for r in token_files.lookup(spark, p, [2, 3]).collect()] == [2]


# --- search


def test_top_k_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.4, (700, 6)).round(1)
    v[100:300] = v[100]
    names = [*range(697), 0, 0, 20]  # three rows repeat an id, with other vectors
    rows = [(i, [float(x) for x in r]) for i, r in zip(names, v)]
    rows += [(1000, None), (1020, [None] + [0.1] * 5), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (None, [0.1] * 6), (1080, [])]
    e = spark.createDataFrame([(*r, 1, "s", 7) for r in rows], "vec_id long, embedding array<float>, label int, shard string, row long")
    q = np.floor(64 * v.astype(np.float32).astype(float)).astype(int)
    want = Counter()
    for i in range(700):
        if names[i] % 20 == 0:
            best = sorted((-int(s), names[j]) for j, s in enumerate(q @ q[i]) if j != i)[:20]
            want.update((names[i], rank, j, -x) for rank, (x, j) in enumerate(best, 1))
    for shard_rows, leaf in ((8192, 256), (90, 7)):
        assert Counter(tuple(r) for r in topk_search.top_k(e, shard_rows=shard_rows, leaf=leaf, block=9).collect()) == want
    assert topk_search.top_k(e.limit(0)).count() == 0
    few = topk_search.top_k(e.where("vec_id in (1, 2) or vec_id = 40"))
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]


def test_top_k_of_huge_values_and_several_lengths(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e18, 2.0]), (2, [-1e30, 0.5]), (3, [0.25, 0.5]), (20, [0.5]), (21, [3.0]), (4, [1e6, 1e6 + 0.25])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=2, leaf=1).collect()
    whole = {i: [int(64 * x) for x in v] for i, v in rows}  # every one of them is an integer already
    for query in (0, 20):
        s = {j: sum(a * b for a, b in zip(whole[query], v)) for j, v in whole.items() if j != query and len(v) == len(whole[query])}
        s = {j: max(-(2**63) + 1, min(2**63 - 1, x)) for j, x in s.items()}
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == query] == sorted(s.items(), key=lambda x: (-x[1], x[0]))


def test_tree_nodes_are_tight_and_prune():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(0, 30, (500, 3)))
    t = topk_search.KDTree(points, np.arange(500), np.arange(500), leaf=16)
    assert sum(len(x[0]) for x in t.leaves.values()) == 500 and len(t.leaves) * 2 - 1 == len(t.child)

    def under(i):
        return t.leaves[i][0] if i in t.leaves else np.concatenate([under(t.child[i]), under(t.child[i] + 1)])

    for i in range(len(t.child)):
        assert (under(i).min(axis=0) == t.lo[i]).all() and (under(i).max(axis=0) == t.hi[i]).all()
    seen, real = [], topk_search.products
    try:
        topk_search.products = lambda a, b: (seen.append(len(b)), real(a, b))[1]
        t.search(points[:1], np.array([0]), np.array([topk_search.LOWEST]), 5)
    finally:
        topk_search.products = real
    assert sum(seen) < 250  # the boxes leave more than half of the points unseen


# --- classifier


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    y = {r.doc_id: r.quality for r in labels.collect()}
    out = quality_classifier.score(docs, model).collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, y[r.doc_id]) for r in out if r.held_out and r.doc_id in y]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(bad) > 5 and auc > 0.9
    assert sum(s >= 0.7 for s in good) >= 0.97 * len(good)


def test_classifier_edges(spark):
    texts = [None, "", "good words here", "x" * 100_000, "good words here"]
    none = quality_classifier.fit(docs_frame(spark, texts), spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_classifier.score(docs_frame(spark, texts, [1, 2, 3, None, 3]), none).collect()
    assert len(got) == 5 and all(r.score > 0.99 for r in got)
    assert quality_classifier.score(docs_frame(spark, []), none).count() == 0


def test_scores_equal_those_of_a_single_bag(monkeypatch):
    bags = [quality_classifier.bag(t) for t in ("a b b c", "D E!! F", "a c", "E!! E!!")] * 20
    model = quality_classifier.train(bags, np.array([1, 0, 1, 0] * 20))
    rate = model.scorer()
    texts = ("a b b c", "E!! x", "zz zz zz", "one two two three " * 50)
    for t in texts:
        at, n = quality_classifier.bag(t)
        z = (n / n.sum()) @ model.vectors[at] @ model.weights + model.bias
        assert abs(rate(t) - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-6
    assert rate("a b c") > 0.7 > rate("E!! F")
    whole = [quality_classifier.bag(t) for t in texts]
    monkeypatch.setattr(quality_classifier, "BLOCK", 7)
    for t, (at, n) in zip(texts, whole):
        got = quality_classifier.bag(t)
        assert np.array_equal(at, got[0]) and np.array_equal(n, got[1])


@pytest.mark.parametrize("text", [None, "", " \n", "a", "a a a  b\n", " x \x1c y", "h\u00e9llo w\u00f6rld " * 3, "x" * 400 + " y y", "\ud800 z"])
def test_buckets_are_words_grams_and_repeats(text):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    grams = [f"<{w.decode('utf-8', 'surrogatepass')}>"[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w.decode("utf-8", "surrogatepass")) + 3 - n)]
    got = [b for part in quality_classifier.buckets_of(text) for b in part.tolist()]
    assert len(got) == len(words) + len(grams) + sum(x == y for x, y in zip(words, words[1:]))
    assert len(set(got)) <= len(set(words)) + len(set(grams)) + 1


def test_sample_is_drawn_among_labelled_documents(spark, monkeypatch):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    have, seen = ids[::50], []
    monkeypatch.setattr(quality_classifier, "train", lambda bags, y: seen.append(y.tolist()))
    quality_classifier.fit(docs_frame(spark, ["some words"] * len(have), have), labels, sample=40)
    assert len(seen[0]) == 40 and set(seen[0]) == {0, 1}


def test_a_hot_id_takes_one_place_in_the_sample(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda bags, y: seen.append((len(bags), y.tolist())))
    d = docs_frame(spark, [f"word{k} text" for k in range(300)] + ["other words"] * len(ids), [ids[0]] * 300 + ids)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    for n in (len(ids), 2):
        quality_classifier.fit(d, labels, sample=n)
    assert seen[0] == (len(ids), [i % 2 for i in ids]) and seen[1][0] == 2


@pytest.mark.parametrize("strip", [False, True])
def test_chunks_stop_at_added_tokens(strip):
    from tokenizers import AddedToken, Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.add_special_tokens([AddedToken("<|end|>", lstrip=strip, rstrip=strip), AddedToken("<|end|>of")])
    rng = random.Random(4)
    texts = ["a\n\n<|endoftext|>b", "\n\n<|endoftext|>", "<|endoftext|><|endoftext|>  x", "x  <|end|>of  y", "a \n<|end|> \n b", "<|endoftext|"]
    texts += ["".join(rng.choices(["<|endoftext|>", "<|end|>", "\n", " ", "a", "of", "it's", "\t"], k=30)) for _ in range(300)]
    encoder = token_files.LibraryEncoder(lib, 4)
    raw = [t.encode() for t in texts]
    for t, got in zip(texts, encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))):
        assert got.tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


MAIN = "<p>" + "The main text of this page goes on and on. " * 8 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content has-sidebar'>{MAIN}</div>",
        f"<div class='no-comments'>{MAIN}</div><div>x</div>",
        f"<div class='entry-with-ads'>{MAIN}</div>",
        f"<section class=social-policy><p>Short.</p></section><div>{MAIN}</div>",
        f"<form action=x><nav>no</nav><div id=content>{MAIN}</div></form>",
        f"<main><h1>Head</h1><form>{MAIN}</form></main>",
        f"<div class=content-sidebar-wrap><div class=sidebar>no</div><div class=post>{MAIN}</div></div>",
        f"<div class=sidebar-wrapper><div class=box>{MAIN}</div></div>",
        f"<blockquote cite='https://x.org/hidden/1'>{MAIN}</blockquote>",
        f"<div title='A hidden gem'>{MAIN}</div>",
        f"<div data-hidden='false' data-class=\"menu\">{MAIN}</div>",
        f"<div title=hidden>{MAIN}</div>",
        f"<p class=advert>no<p>{MAIN}",
    ],
)
def test_main_text_is_not_hidden_by_a_name(page):
    p = html_extract.Page(f"<html><body>{page}</body></html>")
    got = p.text(p.votes()[0][0])
    assert "The main text of this page goes on" in got and not re.search(r"\bno\b", got)


def test_chrome_stays_hidden():
    junk = "".join(f"<{t}>no</{t.split()[0]}>" for t in ("div class=site-footer", "div id=cookie-notice", "div class='x main-nav'", "div role=search", "div hidden", "p style='display: none'", "div class=\"a\" aria-hidden=true", "form", "div class=related-posts"))
    p = html_extract.Page(f"<body><div class=post>{MAIN}</div><div class=comments>{MAIN.replace('main', 'no') * 3}</div>{junk}")
    assert "no" not in p.text(None).split() and p.text(None).startswith("The main text")


def test_a_page_whose_host_path_is_empty_gives_its_own(spark):
    usual = f"<div class=a>{MAIN}</div>"
    rows = [(i, "http://h/", usual) for i in range(5)] + [(9, "http://h/", f"<div class=a>tiny</div><div class=b>{MAIN}</div>"), (10, "http://h/", "<div class=a>tiny</div><div class=b>also tiny, more</div>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].startswith("The main text") and got[10] == "tiny"


def test_article_parts_named_like_chrome_stay():
    page = html_extract.Page(f"<body><article>{MAIN}<div class='share-price-table'><p>Price rose</p></div><section id='related-work'><p>Others too</p></section></article>")
    assert page.text(None).split("\n")[1:] == ["Price rose", "Others too"]


@pytest.mark.parametrize("page", ["<div>x" * 100_000, '<a "' * 100_000, "<a \"'" * 50_000 + ">", "<form>x" * 50_000, "</div>" * 100_000 + "x", "<div class=menu>x" * 30_000])
def test_pages_are_read_in_linear_time(page):
    import time

    began = time.process_time()
    html_extract.Page(page[: len(page) // 8]).text(None)
    base = time.process_time() - began
    began = time.process_time()
    html_extract.Page(page).text(None)
    assert time.process_time() - began < 40 * max(base, 0.05)


def test_every_path_of_a_page_votes(spark):
    inner = "".join(f"<div class=k{'abcdefgh'[i]}><p>{'some words here ' * (9 - i)}</div>" for i in range(8))
    pages = spark.createDataFrame([(i, "http://h/", f"<body>{inner}") for i in range(3)] + [(9, None, None)], "page_id long, url string, html string")
    votes = html_extract.Page(f"<body>{inner}").votes()
    assert len(votes) == 9
    assert {r.host: r.path for r in html_extract.host_paths(pages).collect()} == {"h": votes[0][0]}
