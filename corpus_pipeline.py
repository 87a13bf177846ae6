"""A corpus cleaned and mixed for training, one operator after another.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; between stages the rows are
written as Parquet in the shared folder and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm._common import small_batches, written
from assayframe.llm.decontaminate import drop_contaminated
from assayframe.llm.langid import keep_identified, train
from assayframe.llm.mixing import mix_sources
from assayframe.llm.nearcopies import keep_one_each
from assayframe.llm.secrets import drop_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the models reject go."""
    small_batches(spark)
    return keep_identified(docs, train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: candidates by SimHash blocks and by MinHash bands; of each group of near copies (five-word shingles, Jaccard 0.8 or more) one document stays."""
    small_batches(spark)
    return keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a benchmark item go."""
    small_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: documents with secrets, plain or encoded, go."""
    small_batches(spark)
    return drop_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: sources at weights of nine tenths of the greatest entropy, none repeated more than four times, within the corpus's own tokens."""
    return mix_sources(docs, entropy=0.9, repetition=4.0)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]
#: None: models, encodings and fingerprints are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
