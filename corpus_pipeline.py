"""A corpus made ready for training, in stages that are each written and read again.

Every stage but the last returns the columns of ``documents``.  ``run`` writes
each stage into the shared checkpoint folder and removes what came before it,
its shuffles too.
Rows with equal id and text are the same document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import mixed
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_good, train_quality
from tidemark.llm.runtime import passing_shuffles, prepare, table
from tidemark.llm.secrets import redact
from tidemark.llm.simhash import near_duplicates


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"pipe_id": F.col("doc_id").cast("long"), "pipe_key": F.xxhash64("text")})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go."""
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    kept = near_duplicates(docs).filter("kept").select("doc_id", "text_key").distinct()
    # plain keys, so that the texts are shuffled once for the join and the repeats
    def keys(rows: DataFrame, own: str, key: str) -> DataFrame:
        return rows.withColumns({"pipe_key": F.col(key), "pipe_some": F.coalesce(own, F.lit(0).cast("long")), "pipe_none": F.col(own).isNull()})

    on = ["pipe_key", "pipe_some", "pipe_none"]
    rows = keys(_keyed(docs), "pipe_id", "pipe_key").join(keys(kept, "doc_id", "text_key").select(*on), on, "left_semi")
    return rows.dropDuplicates(on).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials are replaced by a mark; every document stays."""
    size = F.length("text").cast("long")
    return redact(docs).withColumn("n_chars", F.coalesce(size, F.col("n_chars").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the weaker sources are repeated; none is dropped."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of powers of two, a sequence each."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_duplicate), ("secret scan", secrets), ("source mixing", mixing), ("packing", packing)]
#: Neither the trained classifier nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        with passing_shuffles(spark):
            made.write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
