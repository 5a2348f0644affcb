"""Corpus pipeline: documents to packed training sequences, by the operators of larkstead.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkstead.llm import stages
from larkstead.llm.common import saved, table

STAGES = [
    ("quality classifier", stages.quality_stage),
    ("line dedup", stages.line_dedup_stage),
    ("n-gram Jaccard join", stages.jaccard_stage),
    ("mixing sources to target weights", stages.mixing_stage),
    ("best-fit packing", stages.packing_stage),
]
#: SQL can't express the stages' methods; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each on a written table of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs
