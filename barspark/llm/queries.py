"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, fill_in_middle, html_extract, merkle, mix_sources, near_dup, quality_classifier, quality_rules, suffix_dedup, token_files, topk_search, url_filter
from .common import LOWER, UPPER, WORD, scratch_root, table

URL_RULES = (url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"))
#: Three conversations in a hundred would be the most that anyone would accept to lose to a rule.
RISK, CONFIDENCE = 0.03, 0.95


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), RISK, 1 - CONFIDENCE)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_turns(c.unionByName(extra)))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True))


def bpe_digests(decoded: DataFrame) -> DataFrame:
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/barspark-token-shards-{uuid.uuid4().hex}"
    token_files.write_shards(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return token_files.read_documents(spark, path).withColumnRenamed("id", "doc_id")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    whole = fill_in_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.leaf_hash(*fields, F.col("text")).alias("leaf"), merkle.leaf_hash(*fields, claimed).alias("claimed"))
    out = merkle.prove(leaves, "source", "doc_id", claimed_col="claimed")
    digest = F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", digest, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_url_filter, op2_minhash_near_dedup, op3_quality_rules, op4_chat_format, op5_mix_sources, op6_html_extract, op7_byte_bpe, op8_token_files, op9_exact_topk, op10_quality_classifier, op11_fill_in_middle, op12_merkle_manifest, op13_suffix_dedup, pipeline)
    return {f.__name__: f for f in ops}


_WORDS = f"regexp_extract_all(text, '{WORD}')"

OP1 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, host, path, first(h || p ORDER BY length(h || p) DESC) AS rule, first(action ORDER BY length(h || p) DESC) AS action
      FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, r.p) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id, host, path)"""

OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM d),
k AS (SELECT doc_id, hash(list_sort(s)) AS h, s FROM s WHERE len(s) > 0),
c AS (SELECT min(doc_id) AS rep, h, any_value(s) AS s FROM k GROUP BY h),
x AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM c),
pair AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
        HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(id, label) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.label FROM reach r JOIN e ON e.a = r.id WHERE r.label < e.b),
l AS (SELECT id, min(label) AS label FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.label, s.doc_id) AS component_id, coalesce(l.label, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.h = k.h LEFT JOIN l ON l.id = c.rep"""

OP4 = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
k(s) AS (VALUES ('### System: '), ('### User: '), ('### Assistant: '), ('### Role '), (' says: '), ('</turn>'), ('\')),
f AS (SELECT c.*, (SELECT sum((length(text) - length(replace(text, s, ''))) // length(s)) FROM k) AS escapes,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + escapes + length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' ELSE '### Assistant: ' END) + 8)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN pos = 1 THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant' ELSE role = 'user' END) AS in_order
FROM f GROUP BY conv_id"""


def _apportion(rows: str, weight: str, seats: str, order: str, by: str, keys: str) -> str:
    """SQL of ``mix_sources.apportion``: a table ``<rows>_q`` with ``quota``."""
    return f"""
{rows}_w AS (SELECT *, sum({weight}) OVER (PARTITION BY {by}) AS w_, sum(CASE WHEN {weight} > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY {by}) AS n_ FROM {rows}),
{rows}_b AS (SELECT *, CASE WHEN w_ > 0 AND {seats} > n_ / 2 THEN floor({weight} * ({seats} - n_ / 2) / w_ + 0.5::DOUBLE) ELSE 0 END::BIGINT AS b_,
    CASE WHEN {weight} > 0 THEN ceil({weight} * n_ / w_) + 1 ELSE 0 END::BIGINT AS m_ FROM {rows}_w),
{rows}_c AS (SELECT *, {seats} - sum(b_) OVER (PARTITION BY {by}) AS r_ FROM {rows}_b),
{rows}_k AS (SELECT *, unnest(range(-1, m_)) AS k_ FROM {rows}_c),
{rows}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY (k_ < 0), {weight} / (2 * (b_ + k_) + 1) DESC, {order}, k_) AS i_ FROM {rows}_k),
{rows}_q AS (SELECT {keys}, b_ + sum(CASE WHEN k_ >= 0 AND i_ <= r_ THEN 1 ELSE 0 END)::BIGINT AS quota FROM {rows}_r GROUP BY {keys}, b_)"""


_B, _S = mix_sources.BLOCK_WORDS, mix_sources.SHARD_WORDS


def _deal(rows: str, order: str, by: str) -> str:
    """SQL of ``mix_sources.deal_words``: a table ``<rows>_d`` with ``words``."""
    return f"""
{rows}_s AS (SELECT *, want // {_B} AS seats FROM {rows}),
{_apportion(rows + '_s', 'held', 'seats', order, by, f'{by}, {order}, held, want')},
{rows}_f AS (SELECT *, least(quota * {_B}, (3 * held)::BIGINT) AS base FROM {rows}_s_q),
{rows}_o AS (SELECT *, (3 * held)::BIGINT - base AS room, want - sum(base) OVER (PARTITION BY {by}) AS rest FROM {rows}_f),
{rows}_d AS (SELECT * EXCLUDE (want), (base + greatest(0, least(room, rest - coalesce(sum(room) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS words FROM {rows}_o)"""


OP5 = rf"""
WITH d AS (SELECT doc_id, source, coalesce('v' || source, 'n') AS s, coalesce(len({_WORDS}), 0)::BIGINT AS size FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM d),
h AS (SELECT *, md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR || '|' || copy::VARCHAR) AS h FROM c),
o AS (SELECT s, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
o1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM o),
o2 AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(sid - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS cap FROM o1),
o3 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM o2),
o4 AS (SELECT *, first(CASE WHEN cap > weight * lv THEN lv END) OVER (ORDER BY (cap > weight * lv) DESC, cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM o3),
src AS (SELECT s, sid, source_size, CASE WHEN cap > weight * lv THEN weight * level ELSE cap END AS target, (SELECT coalesce(sum(size), 0) FROM d)::BIGINT AS seats, 0 AS al FROM o4),
{_apportion('src', 'target', 'seats', 'sid', 'al', 's, sid, source_size, target')},
x AS (SELECT doc_id, size, h, sid, source_size, target, least(quota, 3 * source_size) AS want, ('0x' || substr(h, 1, 8))::BIGINT % greatest(1, (source_size + {_S - 1}) // {_S}) AS shard FROM h JOIN src_q USING (s)),
held AS (SELECT sid, shard, shard // {mix_sources.GROUP} AS grp, sum(size)::DOUBLE AS held, any_value(want) AS want FROM x WHERE size > 0 GROUP BY sid, shard),
g AS (SELECT sid, grp, sum(held) AS held, any_value(want) AS want FROM held GROUP BY sid, grp),
{_deal('g', 'grp', 'sid')},
gh AS (SELECT held.sid, held.shard, held.grp, held.held, g_d.words AS want FROM held JOIN g_d ON held.sid = g_d.sid AND held.grp = g_d.grp),
{_deal('gh', 'shard', 'sid, grp')},
p AS (SELECT sid, shard, held::BIGINT AS t, (held::BIGINT + {_B - 1}) // {_B} AS n, words FROM gh_d),
e AS (SELECT *, sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS fin FROM x WHERE size > 0),
b AS (SELECT *, fin - size AS beg, ((n - 1) * {mix_sources.STRIDE} + sid * 7919 + shard + 7) % n AS last FROM e JOIN p USING (sid, shard)),
i AS (SELECT *, unnest(range(beg // {_B}, (fin - 1) // {_B} + 1)) AS i FROM b WHERE words % t > 0),
j AS (SELECT *, (i * {mix_sources.STRIDE} + sid * 7919 + shard + 7) % n AS place FROM i),
k AS (SELECT *, least({_B}, words % t - place * {_B} + CASE WHEN place > last THEN n * {_B} - t ELSE 0 END) AS cut FROM j),
l AS (SELECT doc_id, sid, shard, h, fin, sum(greatest(0, least(fin, i * {_B} + cut) - greatest(beg, i * {_B}))) AS part FROM k GROUP BY ALL)
SELECT b.doc_id, b.size, b.source_size, b.target, (b.size * (b.words // b.t) + coalesce(l.part, 0))::BIGINT AS taken
FROM b LEFT JOIN l ON b.sid = l.sid AND b.shard = l.shard AND b.fin = l.fin
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM x WHERE size = 0"""

OP9 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS pre, coalesce(array_to_string(u[a + 1 : b], ''), '') AS mid, coalesce(array_to_string(u[b + 1 : n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""


def _merkle_levels(name: str, nodes: str, proofs: str, levels: int) -> str:
    """SQL that climbs ``levels`` levels from ``nodes`` (g, idx, h, n) and takes along each row of ``proofs`` (row, g, idx, f, p: folded hash and siblings so far)."""
    out = []
    for i in range(levels):
        a, p = (f"{name}_n{i - 1}", f"{name}_p{i - 1}") if i else (nodes, proofs)
        out.append(f"""{name}_r{i} AS (SELECT g, idx // 16 AS idx, list(h ORDER BY idx) AS hs, any_value(n) AS n FROM {a} GROUP BY ALL),
{name}_n{i} AS (SELECT g, idx, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 15) // 16 AS n FROM {name}_r{i}),
{name}_p{i} AS (SELECT row, p.g, p.idx // 16 AS idx,
    CASE WHEN n > 1 THEN sha256(coalesce(array_to_string(hs[1 : p.idx % 16], ''), '') || f || coalesce(array_to_string(hs[p.idx % 16 + 2 :], ''), '')) ELSE f END AS f,
    CASE WHEN n > 1 THEN p || coalesce(array_to_string(hs[1 : p.idx % 16], ''), '') || coalesce(array_to_string(hs[p.idx % 16 + 2 :], ''), '') ELSE p END AS p
    FROM {p} AS p JOIN {name}_r{i} AS r ON r.g = p.g AND r.idx = p.idx // 16)""")
    return ",\n".join(out)


_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
#: DuckDB has no CRC-32: eight bits a step by the polynomial's table, which a query derives.
_CRC = """t(i, c) AS (SELECT range, list_reduce(list_prepend(range, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM range(256)),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t),
ids AS (SELECT DISTINCT doc_id FROM documents),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM ids, tab)"""
OP12 = f"""
WITH {_CRC},
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('v' || source, 'n') AS g, sha256({_FIELDS} || {_TEXT.format("text")}) AS leaf,
    sha256({_FIELDS} || {_TEXT.format(f"CASE WHEN crc % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")}) AS claimed FROM documents LEFT JOIN crc USING (doc_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
l0 AS (SELECT g, idx, leaf AS h, n FROM l),
q0 AS (SELECT row, g, idx, claimed AS f, '' AS p FROM l),
{_merkle_levels("a", "l0", "q0", 6)},
s AS (SELECT g AS k, h, '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM a_n5),
s0 AS (SELECT g, idx, h, n FROM s),
t0 AS (SELECT row, s.g, s.idx, f, p FROM a_p5 JOIN s ON s.k = a_p5.g),
{_merkle_levels("b", "s0", "t0", 4)}
SELECT d.doc_id, d.leaf, s.h AS subroot, b_n3.h AS root, sha256(b_p3.p) AS proof_sha256, b_p3.f AS folded_root, b_p3.f = b_n3.h AS verified
FROM d JOIN s ON s.k = d.g JOIN b_p3 USING (row) CROSS JOIN b_n3"""


def oracle_sql() -> dict[str, str]:
    out = {"op1_url_filter": OP1, "op2_minhash_near_dedup": OP2, "op4_chat_format": OP4, "op5_mix_sources": OP5, "op9_exact_topk": OP9, "op11_fill_in_middle": OP11, "op12_merkle_manifest": OP12}
    import corpus_pipeline

    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
