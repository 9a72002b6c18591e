"""The corpus pipeline: five stages, each over all that the one before it kept.

language ID      documents whose language is rejected go
exact dedup      of equal texts the row with the largest doc_id stays
near dedup       of each group of near copies the row with the smallest doc_id stays
mixing           sources are taken to the target weights
packing          what is left is packed into sequences

All stages but the last return the columns of documents; the last returns one
row per piece. A stage's result is written as Parquet and read again as the next
one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import dedup, langid, mixing, packing, simhash
from tempora.llm.queries import tokenizer_file
from tempora.plans.materialize import intermediates, remove

#: Workers that have run other stages before have less memory to spare for words.
PACKING_WORDS = 200_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_rejected(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.drop_exact(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, mixing.PIPELINE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), remembered=PACKING_WORDS)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the trained language model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again.

    What a stage wrote on its way, and the table it read, go once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = None
    for name, stage in STAGES[:-1]:
        with intermediates(spark) as scope:
            docs = scope.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read:
            remove(spark, read)
        read = scope.kept
    return STAGES[-1][1](spark, docs, sf_dir)
