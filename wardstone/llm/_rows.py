"""Keys of rows whose ids are null or repeated, for decisions on single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written


def unique(docs: DataFrame, row_id: str) -> bool:
    """Whether each row has an id, and one of its own."""
    return docs.groupBy(F.col(row_id).alias("id")).agg(F.count("*").alias("c")).filter("c > 1 OR id IS NULL").isEmpty()


def row_key(text: str = "text", row_id: str = "doc_id") -> Column:
    """The id together with a hash of the text: rows of equal keys are the same row given twice."""
    return F.struct(F.col(row_id).alias("id"), F.xxhash64(text).alias("mark"))


def numbered(docs: DataFrame, name: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows with the number of their key in a further column; numbers are in the order of the ids, null ids last."""
    keys = docs.select(row_key(text, row_id).alias("key")).distinct().sort(F.col("key.id").asc_nulls_last(), "key.mark")
    keys = written(keys.withColumn(name, F.monotonically_increasing_id()), "row-keys")
    at = keys.select(F.col("key.id").alias("rk_id"), F.col("key.mark").alias("rk_mark"), name)
    return docs.join(at, docs[row_id].eqNullSafe(at["rk_id"]) & (F.xxhash64(docs[text]) == at["rk_mark"])).drop("rk_id", "rk_mark")
