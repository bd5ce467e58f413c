"""A training corpus from raw documents: rules, classifier, near-duplicates, mixing, token ids. Each stage reads what the one before kept.

In every stage a row is judged by its own text and, where it has one, its label: ids may be null, or repeat with equal or other texts, without
touching other rows. Null and word-less texts fail the rules; a stage alone takes them as it says. Tables without rows give tables without rows.
Further columns of the documents pass through all stages but the last; names that begin with two underscores are the stages' own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import byte_bpe, mix_sources, near_dup, quality_classifier, quality_rules
from barspark.llm.common import materialize, scratch_root, table
from barspark.llm.queries import CONFIDENCE, RISK, bpe_digests, tokenizer_file

#: Cutoffs, labels and the mix go beyond what SQL can express.
ORACLE_SQL = None


#: A row's own key within a stage: ids may repeat or be null.
ROW = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW``, written to the scratch folder so that every later read finds the same keys."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def few(keys: DataFrame) -> DataFrame:
    """A written table of row keys, to be broadcast if it has no more than ``near_dup.SMALL`` rows."""
    return F.broadcast(keys) if keys.count() <= near_dup.SMALL else keys


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the certified cutoffs keep. Rows that repeat an id with a label count with it, each by its own text;
    a null language is a stratum. Without labels only the base rule rejects."""
    return quality_rules.judged(docs, table(spark, sf_dir, "labels"), RISK, 1 - CONFIDENCE).where("__verdict.kept").drop("__verdict")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as good. The model learns from the whole documents table of ``sf_dir``, which holds both labels, never from held-out ids;
    without labels every row stays, and a row without words gets the score of no evidence."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model).where("__verdict.predicted = 1").drop("__verdict")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts: that with the smallest id, null last (ties: the first row read). Rows without words all stay."""
    keyed = _keyed(docs)
    groups = near_dup.near_duplicates(keyed, id_col=ROW).select(ROW, "component_id").join(keyed.select(ROW, "doc_id"), ROW)
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))[ROW].alias("__first"), F.count("*").alias("__n"))
    several = first.where("__n > 1").drop("__n")
    gone = materialize(groups.join(several, "component_id").where(F.col(ROW) != F.col("__first")).select(ROW), "copies")
    return keyed.join(few(gone), ROW, "left_anti").drop(ROW)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, and one more by a seeded draw for the part beyond them.

    A null source is a source; rows without words are never taken; rows that repeat an id are documents of their own."""
    keyed = _keyed(docs)
    m = few(materialize(mix_sources.mix(keyed, row_col=ROW).where("taken > 0").select(ROW, (F.col("taken") / F.col("size")).alias("__part")), "parts"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    out = keyed.join(m, ROW).withColumn("__times", F.floor(F.col("__part") + draw).cast("int")).where("__times > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, as ``op7`` has them; a null text is empty."""
    import public_tokenizers

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written to the shared scratch folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{scratch_root(spark)}/barspark-stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
