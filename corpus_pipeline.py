"""The corpus pipeline: five stages, each over all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of `documents`. Between stages the rows are written as Parquet in the shared folder and read again.

Null ids, null and empty texts: not toxic by themselves, no duplicates, not contaminated, mixed at size 0, encoded as the
end id alone. Repeated rows of one id count as copies of it: one stays. Ties go to the smaller id. Very long texts are whole
in every stage. Columns of any other names are kept up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from tidemark.llm.common import free_name, keep, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the toxicity classifier (4), trained on these documents' labels, predicts to be toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of the n-gram Jaccard join (3)."""
    return ngram_join.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item (7)."""
    name = free_name(docs, "_hits")
    return decontaminate.screen(docs, table(spark, sf_dir, "benchmark"), name=name).where(F.size(name) == 0).drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents to their sources' target weights (8); a document taken twice is two rows."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files with Elias-Fano boundaries (1); the rows are what the files hold."""
    return token_files.token_files(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: A trained classifier and a tokenizer can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
