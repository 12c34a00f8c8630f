"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents; the last adds epoch, domain and n_tokens.

Edge cases are those of the operators: null texts pass the filters (they hold nothing to reject), and texts that the
line stage leaves without any line that is not blank go, as nothing of them is left.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leadlens.llm import decontamination, line_dedup, queries, simhash, toxicity  # noqa: E402
from leadlens.session import checkpoint_root  # noqa: E402


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score >= 0.3) go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows, and texts of which nothing is left go."""
    out = line_dedup.dedup_lines(docs, removed_col="lines_gone")
    gone = out.columns[-1]
    out = out.where((F.col(gone) == 0) | (F.ltrim("text", F.lit(" \t\n\r\x0b\x0c")) != ""))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, length).otherwise(F.col("n_chars")))
    return out.drop(gone)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 4 or fewer differing bits (shingles of 4 words) the least doc_id stays."""
    return simhash.near_dedup(docs, words=simhash.SHINGLE_WORDS, max_bits=simhash.MAX_BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ten words, or a whole short item, of the benchmark go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, once for each epoch in which they are used."""
    return queries.registered_mix(docs)[0]


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The first stage is a trained network, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written into the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}")
    return docs
