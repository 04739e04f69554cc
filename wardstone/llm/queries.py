"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, lang_id, mixing, near_dedup, quality, token_counts, token_files, topk
from ._rows import row_key
from ._store import crc_mod

#: Shares of expected tokens that op10 and the pipeline aim at, by the labels' quality and toxic.
TARGETS = {"quality=1 toxic=0": 0.92, "quality=1 toxic=1": 0.04, "quality=0 toxic=0": 0.04}
#: The domain that is kept in full; the other shares are upper bounds.
CLEAN = "quality=1 toxic=0"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.learn(docs, _table(spark, sf_dir, "labels").filter(crc_mod(5) != 0), crc_mod(5) != 0)
    return quality.classify(docs, model, 0.3, held_out=crc_mod(5) == 0).select("doc_id", "held_out", "score", "predicted")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_probe(_table(spark, sf_dir, "conversations"))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 1024)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, public_tokenizers.PATTERN)
    return token_files.read(manifest, docs.schema["doc_id"].dataType)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.learn(docs, crc_mod(4) != 2)
    return lang_id.identify(docs, model, held_out=crc_mod(4) == 2).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"), percent=85)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = mixing.learn(docs, _table(spark, sf_dir, "labels"))
    out = mixing.mix(docs.withColumn("mx_row", row_key()), model, TARGETS, row_id="mx_row", whole=CLEAN)
    copies = mixing.copies(F.col("rate"), F.col("mx_row"))
    return out.select(F.col("mx_row.id").alias("doc_id"), "n_tokens", "domain", "posterior", "rate", copies.alias("copies"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_chat_formatting, op3_token_counts, op4_token_files, op5_language_id, op6_minhash_near_dedup, op7_exact_topk, op8_byte_bpe, op9_exact_dedup, op10_mixing)}
SQL = {"op2_chat_formatting": chat.ORACLE, "op7_exact_topk": topk.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
