"""Documents to training sequences: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fanweave.llm.common import bounded_batches, durable
from fanweave.llm.decontam import keep_uncontaminated
from fanweave.llm.exact_dedup import keep_first_copies
from fanweave.llm.language import keep_identified
from fanweave.llm.near_texts import keep_dissimilar
from fanweave.llm.packing import pack
from fanweave.llm.simhash import not_representatives


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence stay."""
    bounded_batches(spark)
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of close fingerprints, the smallest id stays; of these go the texts similar to one of a smaller id."""
    bounded_batches(spark)
    return keep_dissimilar(docs, besides=not_representatives(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items cover less than a twentieth stay."""
    bounded_batches(spark)
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    bounded_batches(spark)
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack_sequences),
]

#: Fingerprints and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again.

    Null texts count as empty and have no language, so they go with the first stage. Of rows that repeat an id
    and a text one stays; different texts under one id are judged each, but are one document to the
    near-duplicate stage. Ties go to the smallest id, and a null id is never smallest. Further columns, whatever
    their names, pass through all stages but the last. An empty table packs nothing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
