"""A corpus pipeline: toxic documents go, near copies go, benchmark leaks go, secrets are masked, the rest is packed.

Every stage but the last returns the columns of documents, whatever they are called. Defined cases, for each stage: a
null or empty text is no evidence of anything and stays, as the class of its own that it is; of rows that repeat one
stays after the second stage; ties between copies go to the least doc_id, nulls last; very long texts are whole
documents; an empty table passes through, and gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, packing, secrets, toxicity
from tidemark.llm.common import discard, prepare, staged
from tidemark.llm.queries import held_out


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under a half; clean ones stay."""
    prepare(spark)
    field = toxicity.fit(docs.filter(~held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, field)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of documents linked at a similarity of 0.8 or more."""
    prepare(spark)
    return jaccard.deduplicate(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by a mark, and ``n_chars`` counted again."""
    prepare(spark)
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    prepare(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_copies),
    ("benchmark decontamination", without_leaks),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

# The tokenizer and the field are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read by the next, which deletes it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        done = staged(stage(spark, docs, sf_dir))
        discard(docs)
        docs = done
    return docs
