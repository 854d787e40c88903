"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of
``documents``.  Its functions run over whole tables and whole texts.

Defined results, beyond those of the operators' own docstrings: a null text, or one without letters, has
no language and goes in the first stage; of texts that are the same, or near-duplicates, the row with the
smallest ``doc_id`` stays, a null one only if there is no other; rows that repeat an id and a text are
reduced to one; texts of any length are taken whole; an empty table gives an empty result; extra columns,
of whatever name, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import exact_dedup, language, near_dedup, packing, pseudonyms
from tidewell.llm.common import small_batches, table, written
from tidewell.llm.queries import RANKS, VOCABULARY


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.keep_known(docs, language.train(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.deduplicate(docs)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pseudonyms.with_pseudonyms(docs, pseudonyms.KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pseudonyms", pseudonym_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the language, near-duplicate, pseudonym and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
