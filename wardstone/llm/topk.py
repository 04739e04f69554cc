"""Exact top-k search by integer inner product: tiled matrix products and a tree merge of top lists.

Vectors are quantised to floor(scale * x) and packed into tiles: query tiles of up to 1,024 rows, and shards
of up to 4,096 rows, in the narrowest integers that hold a tile, dealt into groups. Every query tile goes to every group once and meets the group's
shards there, one matrix product each; of each product only the k best of a row are selected, and a task
merges them shard by shard. The lists of the groups then meet in a tree, eight at a time. The query set is
stated by the caller; no pair of rows is ever a row of a table.

Scores tie to the smaller id: a row's place in its id-sorted shard is part of the key it is selected by.
Products are taken in 64-bit floats where they are exact there (all partial sums below 2**53), in 64-bit
integers below 2**62, and in Python's integers beyond; a score outside 64 bits is held at the bound.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part, nor do
rows without an id. Vectors of unlike length are not compared. Rows that repeat an id are each a candidate
for other ids, never for their own; of query rows that repeat an id, one is used, that with the least vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import ship, written

QUERY_TILE, SHARD, FAN = 1024, 4096, 8
TILE = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("m", T.BinaryType())])


def narrow(m: np.ndarray) -> bytes:
    """Whole numbers as little-endian integers of the fewest bytes that hold them all."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return m.astype(f"<i{width}").tobytes()


def wide(m: bytes, rows: int, dim: int) -> np.ndarray:
    """The matrix of narrow(), as 64-bit integers."""
    width = len(m) // (rows * dim) if rows * dim else 8
    return np.frombuffer(m, f"<i{width}").reshape(rows, dim).astype(np.int64)


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, vector of longs) -> tiles, each of one length of vectors, sorted by id."""
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def tile(dim: int, parts: list) -> pa.RecordBatch:
            ids, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_pylist([{"ids": ids[order].tobytes(), "dim": dim, "m": narrow(m[order])}], schema=pa.schema([("ids", pa.binary()), ("dim", pa.int32()), ("m", pa.binary())]))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size).tolist():
                which = np.flatnonzero(size == dim)
                for k in range(0, len(which), rows):
                    some = which[k : k + rows]
                    m = flat[start[some][:, None] + np.arange(dim)]
                    held.setdefault(dim, []).append((ids[some], m))
                    if sum(len(p[0]) for p in held[dim]) >= rows:
                        parts = held.pop(dim)
                        a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                        yield tile(dim, [(a[:rows], b[:rows])])
                        if len(a) > rows:
                            held[dim] = [(a[rows:], b[rows:])]
        for dim, parts in held.items():
            yield tile(dim, parts)

    return run


def product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q with those of m."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(m).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return q @ m.T
    exact = q.astype(object) @ m.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, the k best by score and then smaller id, without its own id: row number, score, id. ids ascend."""
    n, width = scores.shape
    allowed = ids[None, :] != own[:, None]
    if width > 4 * k and int(np.abs(scores).max(initial=0)) < (1 << 62) // max(1, width):
        key = np.where(allowed, scores * width + (width - 1 - np.arange(width)), np.iinfo(np.int64).min)
        at = np.argpartition(key, width - k, axis=1)[:, width - k :]
    else:
        at = np.argsort(np.where(allowed, -np.maximum(scores, -np.iinfo(np.int64).max), np.iinfo(np.int64).max), axis=1, kind="stable")[:, : k + int((~allowed).sum(axis=1).max(initial=0))]
    row = np.repeat(np.arange(n), at.shape[1])
    at = at.reshape(-1)
    ok = allowed[row, at]
    return row[ok], scores[row[ok], at[ok]], ids[at[ok]]


def _top(row: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score.astype(object) if len(score) and score.min() == np.iinfo(np.int64).min else -score, row))
    row, score, vec = row[order], score[order], vec[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], score[keep], vec[keep]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tile, group, query tile, shard) -> a top list for each query, merged over the shards that follow one another."""
        key = own = q = held = None

        def lists() -> pa.RecordBatch:
            row, score, vec = held
            cut = np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32)
            kind = pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])
            top = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(score), pa.array(vec)], fields=list(kind)))
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), key[1], np.int32)), top], ["query_id", "node", "top"])

        for batch in batches:
            for k0 in range(batch.num_rows):
                tile, group, q_ids, q_m, ids, dim, m = (c[k0].as_py() for c in batch.columns)
                if key != (tile, group):
                    if held is not None:
                        yield lists()
                    key, own = (tile, group), np.frombuffer(q_ids, np.int64)
                    q = wide(q_m, len(own), dim)
                    held = (np.zeros(0, np.int64),) * 3
                ids = np.frombuffer(ids, np.int64)
                found = best(product(q, wide(m, len(ids), dim)), ids, own, k)
                held = _top(*(np.concatenate(x) for x in zip(held, found, strict=True)), k)
        if held is not None:
            yield lists()

    return run


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null unless all components are there and finite."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def search(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query, its k best other rows."""
    spark = table.sparkSession
    ship(spark)
    rows = table.select(F.col(row_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("q"))
    rows = rows.filter("v IS NOT NULL AND id IS NOT NULL")
    shards = written(rows.select("id", "v").mapInArrow(_pack(SHARD), TILE), "shards")
    asked = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked, "queries")
    tiles = asked.repartition(max(1, math.ceil(asked.count() / QUERY_TILE))).mapInArrow(_pack(QUERY_TILE), TILE)
    tiles = written(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")

    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards.count()))
    dealt = shards.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    spread = tiles.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    spread = spread.select("tile", "group", "dim", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    pairs = spread.hint("merge").join(dealt, ["group", "dim"]).select("tile", "group", "q_ids", "q_m", "ids", "dim", "m")
    item = T.StructType([T.StructField("score", T.LongType()), T.StructField("vec_id", T.LongType())])
    lists = pairs.mapInArrow(_search(k), T.StructType([T.StructField("query_id", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("top", T.ArrayType(item))]))

    size = groups
    while True:
        size = math.ceil(size / FAN)
        lists = lists.withColumn("node", (F.col("node") / FAN).cast("int")).groupBy("query_id", "node").agg(F.flatten(F.collect_list("top")).alias("top"))
        lists = lists.withColumn("top", F.slice(F.array_sort("top", _order), 1, k))
        if size <= 1:
            break
    out = lists.select("query_id", F.posexplode("top").alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _order(x: Column, y: Column) -> Column:
    by_score = F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1)
    return by_score.when(x["vec_id"] < y["vec_id"], -1).when(x["vec_id"] > y["vec_id"], 1).otherwise(0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
