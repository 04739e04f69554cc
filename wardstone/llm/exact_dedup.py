"""Exact de-duplication: a tree merge of sorted digest runs, in DataFrame operations only.

Each row belongs to one of ``2 ** (fan_bits * rounds)`` runs, by a hash of its id and text.
A run holds one entry for each distinct text: its digest, the smallest id and a row count.
In round j, runs whose numbers agree but for their lowest ``fan_bits`` bits meet (a binomial
tree of that radix): each is sorted by its key and reduced before it is sent, the exchanged runs are
merged in the order of the key, and of neighbours that agree the smallest id is kept (a sort aggregate
on either side: no hash table, so a run may be larger than memory). The key
is a SHA-256 digest together with the byte length and a second, independent 64-bit hash, so
each merge at each level verifies that entries agree in all three. After the last round one
run is left. The answer goes down the same tree, so that a text with a third of all rows is
read by as many keys as there are runs, never by one.

Defined results: a null text counts as empty, and all empty texts are equal. A null id never
wins against another id; it stays if its whole group has none. Rows that repeat the kept id
all count as kept by mark() (the same row given twice); of these, and of a group without an id, distinct() keeps one. An empty table gives an empty result. Other
columns, of whatever name, are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rows import unique
from ._store import written

KEY = ["xd_digest", "xd_bytes", "xd_check"]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _keys(text: Column, row_id: Column, runs: int) -> list[Column]:
    t = normalised(text)
    return [
        F.unhex(F.sha2(t, 256)).alias("xd_digest"),
        F.octet_length(t).cast("long").alias("xd_bytes"),
        F.xxhash64(t).alias("xd_check"),
        F.pmod(F.xxhash64(row_id, F.octet_length(t)), F.lit(runs)).alias("xd_run"),
    ]


def _up(df: DataFrame, fan_bits: int) -> DataFrame:
    """Runs meet at their parents and are merged in order; the smallest id is retained.

    The minimum is one of a struct, which Spark aggregates over sorted input only.
    """
    least = F.min(F.struct(F.col("xd_keep").isNull().alias("none"), F.col("xd_keep").alias("id")))
    merged = df.withColumn("xd_run", F.shiftright("xd_run", fan_bits)).groupBy("xd_run", *KEY).agg(least.alias("xd_least"), F.sum("xd_n").alias("xd_n"))
    return merged.select("xd_run", *KEY, F.col("xd_least.id").alias("xd_keep"), "xd_n")


def tree_merge(entries: DataFrame, fan_bits: int, rounds: int) -> DataFrame:
    """(run, key, id) entries -> for each run of the first round and key: smallest id and row count over all runs."""
    levels = [entries.select("xd_run", *KEY, F.col("xd_id").alias("xd_keep"), F.lit(1).cast("long").alias("xd_n"))]
    for _ in range(rounds):
        levels.append(_up(levels[-1], fan_bits))
    down = levels[-1]
    for level in reversed(levels[1:-1]):
        below = level.select(F.col("xd_run").alias("xd_child"), F.shiftright("xd_run", fan_bits).alias("xd_run"), *KEY)
        down = below.join(down, ["xd_run", *KEY]).select(F.col("xd_child").alias("xd_run"), *KEY, "xd_keep", "xd_n")
    return down


def mark(docs: DataFrame, text: str = "text", row_id: str = "doc_id", fan_bits: int = 3, rounds: int = 3) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    runs = 1 << (fan_bits * rounds)
    entries = written(docs.select(F.col(row_id).alias("xd_id"), *_keys(F.col(text), F.col(row_id), runs)), "digests")
    merged = tree_merge(entries, fan_bits, rounds)
    rows = entries.withColumn("xd_run", F.shiftright("xd_run", fan_bits))
    return rows.join(merged, ["xd_run", *KEY]).select(
        F.col("xd_id").alias(row_id),
        F.col("xd_keep").alias("keep_id"),
        F.col("xd_n").alias("group_size"),
        F.col("xd_id").eqNullSafe(F.col("xd_keep")).alias("kept"),
        F.lower(F.hex("xd_digest")).alias("text_sha256"),
    )


def distinct(docs: DataFrame, text: str = "text", row_id: str = "doc_id", fan_bits: int = 3, rounds: int = 3) -> DataFrame:
    """The rows that stay, one of each text, with their own columns."""
    runs = 1 << (fan_bits * rounds)
    keys = _keys(docs[text], docs[row_id], runs)
    entries = written(docs.select(docs[row_id].alias("xd_id"), *keys), "digests")
    merged = tree_merge(entries, fan_bits, rounds).withColumnRenamed("xd_run", "xd_parent")
    merged = merged.select(F.struct("xd_parent", *KEY).alias("xd_at"), "xd_keep")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("xd_row"), docs[row_id].alias("xd_id"), *keys)
    rows = rows.select("xd_row", "xd_id", F.struct(F.shiftright("xd_run", fan_bits).alias("xd_parent"), *KEY).alias("xd_at"))
    kept = rows.join(merged, "xd_at").filter(F.col("xd_id").eqNullSafe(F.col("xd_keep")))
    if not unique(entries, "xd_id"):
        # Rows of one text that have the kept id, or none, are in one run.
        kept = kept.dropDuplicates(["xd_at"])
    return kept.select("xd_row.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""
