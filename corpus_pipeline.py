"""The training-corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import jaccard, linededup, mixing, packing, quality
from rosterloom.llm.common import SPACE, protected, stored, table, written_order
from rosterloom.llm.queries import tokenizer_paths


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.kept_documents(docs, quality.trusted_documents(table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; so do documents that held nothing else."""

    def step(d: DataFrame) -> DataFrame:
        emptied = (F.col("lines_removed") > 0) & (F.btrim("text", F.lit(SPACE)) == "")
        return linededup.dedup(d).filter(~emptied).select(*d.columns)

    return protected(docs, ("doc_id", "text", "n_chars"), step)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in the order of training: so are the files that they are written to."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens.

    Ranges of sequences follow the order in which the documents were written;
    neighbours along the curve are packed together inside a range.  ``position``
    is that order, and tells copies of a document apart.
    """
    return packing.pack(docs, **tokenizer_paths(), order=written_order(docs))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("mixing sources to target weights", mix), ("packing", pack)]

#: SQL has neither the sampled joins nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
