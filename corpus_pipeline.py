"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); docs is what its predecessor kept. All but the last return the columns
of documents. Rows of empty tables and null texts pass or go as each operator's docstring defines. Rows with null or
repeated ids are decided on by id and text, like all others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm import bpe, exact_dedup, lang_id, mixing, near_dedup
from wardstone.llm._rows import row_key
from wardstone.llm._store import written
from wardstone.llm.queries import CLEAN, TARGETS


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or whose nearest language scores under 0.4."""
    return lang_id.accepted(docs, lang_id.learn(docs, F.lit(True)), least=0.4)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: that with the smallest id."""
    return exact_dedup.distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return near_dedup.distinct(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains beyond their target go by chance, by their fitted rate; none is repeated.

    The clean domain is kept whole and sets the budget: documents whose likeliest domain it is all stay, and scarce toxic
    or junk ones never make them go.
    """
    model = mixing.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keyed = docs.withColumn("mx_row", row_key())
    rates = mixing.mix(keyed, model, TARGETS, row_id="mx_row", whole=CLEAN)
    drawn = (F.col("domain") != CLEAN) & (mixing.copies(F.col("rate"), F.col("mx_row")) < 1)
    gone = rates.filter(drawn).select(F.col("mx_row").alias("mx_gone")).distinct()
    return keyed.join(gone, keyed["mx_row"] == gone["mx_gone"], "left_anti").drop("mx_row")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: Models and a byte-pair encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
