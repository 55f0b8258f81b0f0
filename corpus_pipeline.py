"""A pipeline for training data: documents through five stages of the operators in lodestrata.llm.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again for the next one. All but the
last return the columns of documents: language ID drops documents without a recognisable language, near-duplicates leave
the one with the smallest id of each group, secret scans mask what they find, mixing repeats or drops documents to meet the
sources' targets, and packing returns the pieces of all that is left in their sequences.

Defined results: documents with a null or empty text are rejected by the first stage, as are those without letters; null ids
are kept and never duplicates of others; of rows that bear one id the least text stays; null sources are one source, the
last; ties go by id; very long texts are read whole; further columns are carried along up to packing, whatever their names;
an empty table gives no piece. What a stage stored for itself is removed once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import common, dedup, language, mixing, packing, secrets


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.unique(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(common.stored(packing.cut(docs, packing.tokenizer_path())))


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("secrets", mask), ("mixing", mix), ("packing", pack)]

#: The tokenizer and the model of languages can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with common.intermediate(spark) as tables:
            after = common.stored(stage(spark, docs, sf_dir))
            tables.remove(after._lodestrata_path)
        common.discard(docs)
        docs = after
    return docs
