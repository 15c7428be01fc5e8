"""The corpus pipeline: every stage takes all that the one before kept, and its decisions take effect.

STAGES is a list of (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever their names; an
empty table stays empty, and the last stage gives its columns without rows. Null and empty texts pass every stage (they are
not toxic, similar to nothing, hold no item and no personal data, and have no token); rows with a null id are judged by their
text alone and stay where a stage compares ids; rows that repeat stay together or go together in the stages that judge a text,
and in the Jaccard join while theirs is the smallest id of its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from looma.llm import bpe, decontaminate, ngram_join, pii, toxicity
from looma.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The classifier learns from the labelled ones among docs."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: that with the smallest id."""
    return ngram_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are replaced by their kind; n_chars follows."""
    return pii.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded text."""
    return bpe.token_digests(docs)


STAGES = [("toxicity", toxicity_stage), ("jaccard_join", jaccard_stage), ("decontamination", benchmark_stage), ("pii", pii_stage), ("bpe", bpe_stage)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
