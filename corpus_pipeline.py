"""A training-data pipeline over ``documents``: clean, deduplicate, decontaminate, mix, pack.

Every stage takes what its predecessor kept, as a table, and returns what it keeps of it. All
stages but the last return the columns of ``documents``.
"""

from collections.abc import Callable
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import colloquy
from colloquy.llm.decontaminate import decontaminate
from colloquy.llm.mixing import mix
from colloquy.llm.near_dedup import deduplicate
from colloquy.llm.packing import pack
from colloquy.llm.quality_rules import quality_rules
from colloquy.llm.shared import Scratch, table

# The workers get the functions they need with the task; they need not have the package.
cloudpickle.register_pickle_by_value(colloquy)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: texts that a rule rejects go."""
    judged = quality_rules(spark, docs, table(spark, sf_dir, "labels"))
    return judged.where("rejected_by is null").select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates, from a similarity of 0.85 on: the document with the smallest id of each component stays."""
    return deduplicate(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: passages of test items are cut, documents of little else go."""
    return decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: rows are repeated or left out until each source has its target, and shuffled."""
    return mix(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in rows of equal length."""
    return pack(spark, docs)


def configured(stage: Stage) -> Stage:
    """The stage with the package's settings, which bound what a task holds at a time."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(colloquy.configure(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", configured(clean)),
    ("near_dedup", configured(dedup)),
    ("decontamination", configured(decontaminated)),
    ("mixing", configured(mixed)),
    ("packing", configured(packed)),
]

# Cutoffs from exact tests and packed token ids are not for SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
