"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, source mix.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns what
it keeps of ``docs``.  ``run`` writes each stage's result as Parquet into the shared folder and
reads it again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kdframe.llm import decontam, mixing, passages, quality, simhash
from kdframe.llm.common import drop_written, read_table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity fits the trusted documents of their language; the others go."""
    return quality.kept(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints at three or fewer differing bits."""
    return simhash.one_of_each(docs, shingle=3, max_bits=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an other document keeps are cut out; a document with nothing left goes."""
    return passages.cut_repeats(docs, written(passages.repeated_passages(docs), "links"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each copy of a document, numbered in ``copy``."""
    return mixing.emit(docs, written(mixing.mix(docs), "mixed"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
]

#: Near-duplicate search and the language model are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            drop_written(before)
    return docs
