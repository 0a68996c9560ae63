"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
``docs``; it is written as Parquet and read again as the next one's input, so a
stage that loses executors repeats only itself and no lineage spans two stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.llm import decontaminate, linededup, mixing, paragraphs, quality, simhash
from patchlight.llm.registry import QUERIES, query, table
from patchlight.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or a judge reject go. Judges learn from the labelled documents among those given.

    Null and wordless texts go; without labels only the base rules judge; an empty table stays empty.
    """
    return quality.kept_documents(docs, quality.fit_judges(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go; so does a document that loses all its words this way.

    Rows without an id or a text stay as they are, rows that repeat both are one document.
    """
    return linededup.deduplicated_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a five-word Jaccard similarity of 0.8 the one with the least id stays.

    Documents meet if their SimHash fingerprints (of op9) link them, or if they share a band of
    their signatures, since similar texts may be more bits apart than fingerprints can be searched for.
    Null and wordless texts are one group; rows without an id stay; rows that share the least id all stay.
    """
    near = simhash.near_copies(docs.where("doc_id is not null"), shingle=paragraphs.SHINGLE)
    return paragraphs.one_of_each(docs, met=near.select("doc_id", F.col("component_id").alias("bucket")).distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go; null and empty texts hold none and stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities that are raked to source, language and topic.

    Null sources and languages are categories of their own; a document in a cell without a token is not drawn.
    """
    return mixing.sampled_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
]

#: Regressions, patience diff, fingerprints and banded alignment have no SQL form; the stages are tested against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


@query
def pipeline(spark, sf_dir):
    """Documents that all stages keep."""
    return run(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "STAGES", "run"]
