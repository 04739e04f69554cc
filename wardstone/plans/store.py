"""The event store's reads and upkeep: first-wins de-duplication, cursor reads, retention and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with one key the first by ``order``, and in ``duplicates`` how often the key came again.

    An aggregation with partial results in each task, so that a key with a third of all rows does not gather.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    g = df.groupBy(key.alias("__key")).agg(F.min_by(row, order).alias("row"), F.count("*").alias("n"))
    return g.select("row.*", (F.col("n") - 1).alias("duplicates"))


def upsert(new: DataFrame, stored: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """What a batch adds to a store, and its counters: one row of received, added and duplicates.

    Added are the first rows of each key that the store doesn't hold; all others are duplicates. Rows without a key
    are equal to each other, and never to a stored one.
    """
    first = first_wins(new, F.col(key), order)
    known = stored.select(F.col(key).alias("__known")).distinct().withColumn("__held", F.lit(True))
    marked = first.join(known, F.col(key) == F.col("__known"), "left")
    held = F.coalesce("__held", F.lit(False))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counters = marked.agg(
        count(F.col("duplicates") + 1).alias("received"), F.count_if(~held).alias("added"), count(F.col("duplicates") + held.cast("int")).alias("duplicates")
    )
    return marked.filter(~held).select(*new.columns), counters


def since(df: DataFrame, cursor: int, limit: int, source: str | None = None, order: str = "event_id") -> DataFrame:
    """A page: rows beyond the cursor, of one source if given, in order (the filters reach the scan)."""
    page = df.filter(F.col(order) > cursor)
    if source is not None:
        page = page.filter(F.col("source") == source)
    return page.orderBy(order).limit(limit)


def next_cursor(page: DataFrame, cursor: int, order: str = "event_id") -> int:
    last = page.agg(F.max(order)).first()[0]
    return cursor if last is None else last


def newest(df: DataFrame, keep: int, order: str = "event_id", buckets: int = 4096) -> DataFrame:
    """The ``keep`` rows of the largest ids, without a global sort.

    Ids are counted in a bounded number of equal ranges; the range that the cut falls into is counted again,
    finer, until it is a single id. Rows that tie with the last id stay.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return df
    above = 0
    while low < high:
        width = max(1, -(-(high - low + 1) // buckets))
        inside = df.filter(F.col(order).between(low, high))
        place = F.floor((F.col(order) - F.lit(low)) / F.lit(width)).cast("long")
        counts = sorted(((r.b, r["count"]) for r in inside.groupBy(place.alias("b")).count().collect()), reverse=True)
        for b, n in counts:
            if above + n >= keep:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            above += n
        else:
            return df
    return df.filter(F.col(order) >= low)


def routing(df: DataFrame) -> DataFrame:
    """Lines received, parsed, rejected and failed by source; lines without a source count as unrouted."""
    parsed = (F.col("source") != "") & F.col("parse_error").isNull()
    good = parsed & F.col("validation_error").isNull()
    return df.groupBy(F.when(F.col("source") == "", "unrouted").otherwise(F.col("source")).alias("source")).agg(
        F.count("*").alias("received"), F.count_if(good).alias("parsed"), F.count_if(~good).alias("failed")
    )
