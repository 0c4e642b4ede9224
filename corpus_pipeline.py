"""A corpus pipeline: quality, repeated lines, near copies, benchmark passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return documents
with their columns; the last returns the packed pieces.

Defined cases, in every stage: an empty table gives no rows; repeated rows each get a decision of their own;
other columns, of any name, are carried; a very long text is worked on whole. What the stages do with nulls
and ties is stated at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convolens.llm import decontaminate, line_dedup, near_dedup, packing, quality
from convolens.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as low quality or toxic go.

    A null or empty text is judged as one without words; a posterior at the threshold is rejected.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the texts; every document stays.

    A null text stays null; a null doc_id keeps its lines; of equal lines the smallest doc_id's stays.
    """
    return line_dedup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    Documents without words or without a doc_id stay; of a group the smallest doc_id does, with all its rows.
    """
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    A null or empty text stays; items without words have no window.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences.

    A null or empty text is its end id alone.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
