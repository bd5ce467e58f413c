"""What the training-data operators share: scratch tables, words, sizes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of code points other than the ASCII white space that ``bytes.split()`` cuts at.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which a cluster shares.

    A local session without the setting gets a temporary folder; a cluster without it is an error,
    since a machine-local folder would lose rows there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-barspark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/barspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` dealt out by ``key``, written to the shared scratch folder in as many buckets as the session's shuffles have partitions, and read again: later joins by
    ``key`` move the other side only. The table is in the catalog no longer than it takes to write it. ``df`` must give a repeated task the same rows with the same keys."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    as_table = f"barspark_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).options(path=f"{scratch_root(spark)}/{as_table}", compression="zstd").saveAsTable(as_table)
    out = spark.table(as_table)
    spark.sql(f"DROP TABLE {as_table}")  # its files, in a folder given by path, stay
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote, once nothing will read it again."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
