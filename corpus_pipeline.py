"""The corpus pipeline: quality classifier, SimHash near-dedup, substring dedup, source mixing, BPE.

Every stage takes (spark, docs, sf_dir). Stages return the columns of documents; the last one returns doc_id, lang, source and the
token ids of each document in the mixture, with the digests of ids and of the bytes that they decode to.

Defined cases: a null or empty text, or one of white space, is scored and dealt with like any other, and has no tokens; a very long
text is read whole by every stage; rows without doc_id are never dropped as copies; of several rows of one doc_id the near-dedup
keeps one; equal rows go the same way at the classifier and tie in the mixture; an empty table passes through all stages; columns of
any other name, those that stages use themselves included, stay until the last stage, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from draftlake.llm import bpe, kneser_ney, mixing, simhash, substrings
from draftlake.llm.common import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return kneser_ney.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: sets of shingles of five words, exact Jaccard similarity of 0.8 at least, candidates by SimHash."""
    return simhash.keep_first(docs, simhash.near_copies(docs, words=5, percent=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that documents of smaller doc_id have too."""
    return substrings.dedup(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture uses it, once at least, in the order of its block permutations."""
    return mixing.mix_in_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("source mixing", mixture), ("byte-level BPE", tokens)]

#: The tokenizer, among others, is beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
    return docs
