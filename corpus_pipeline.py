"""Corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents; the last adds mix_copies (how often the
mix takes the document) and mix_finish (its virtual finish time), and is in
the order of the latter.

Tables without rows, null texts, repeated rows and extra columns pass through
as each operator's docstring says; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.decontaminate import remove_leaks
from tallyframe.llm.mixing import mixed_documents
from tallyframe.llm.near_dup import keep_first_of_group
from tallyframe.llm.quality_rules import keep_quality
from tallyframe.llm.suffix_dedup import remove_repeats
from tallyframe.session import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or leave their language's bands go."""
    return keep_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id."""
    return keep_first_of_group(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that occurred earlier are cut out."""
    return remove_repeats(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans shared with benchmark items are cut out; documents that mostly are such spans go."""
    return remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What weighted fair queueing takes from each source."""
    return mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeat_stage),
    ("benchmark_leaks", leak_stage),
    ("source_mix", mix_stage),
]

#: Tokenisers and sketches have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
