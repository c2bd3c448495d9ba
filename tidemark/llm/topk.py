"""Exact top-k search by tiled matrix products (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Rows of a shard and queries of a block, scores that a tile holds at once, and lists that one merge takes in.
SHARD_ROWS, BLOCK_QUERIES, CELLS, FAN = 16_384, 16_384, 1 << 22, 16
#: Shards aren't made smaller than this to keep all cores busy.
LEAST_SHARD = 1024
#: Whole numbers up to this are exact in single precision.
SINGLE = 1 << 24
LISTS = "query_id long, shard long, vec_id array<long>, score array<long>"
_ARROW = {"query_id": pa.int64(), "shard": pa.int64(), "vec_id": pa.list_(pa.int64()), "score": pa.list_(pa.int64())}
_LIMIT = 1 << 63


def quantised(embedding: str, scale: int):
    """Each component x (as a double) as floor(scale * x); null if the vector, or a component, is null or isn't finite."""
    parts = F.transform(F.col(embedding), lambda x: x.cast("double") * scale)
    sound = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.col(embedding).isNotNull() & sound, F.transform(parts, lambda x: F.rint(x) - (F.rint(x) > x).cast("double")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), dim)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers, as int64; sums beyond its range end at its ends."""
    most = (np.abs(queries).max(initial=0.0) * np.abs(rows).max(initial=0.0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    if most < 2**62:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    whole = [[int(x) for x in r] for r in rows]
    out = [[sum(a * b for a, b in zip(map(int, q), r, strict=True)) for r in whole] for q in queries]
    return np.array([[min(_LIMIT - 1, max(-_LIMIT, v)) for v in r] for r in out], dtype=np.int64).reshape(len(queries), len(rows))


def best(scores: np.ndarray, ids: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k highest scores of each row, row by row, ties to the smaller id; a row leaves out the columns of its own name.

    ids are sorted, so a smaller column is a smaller id.
    """
    lo, hi = np.searchsorted(ids, names), np.searchsorted(ids, names, side="right")
    for i in np.flatnonzero(lo < hi):
        scores[i, lo[i] : hi[i]] = -_LIMIT
    n = scores.shape[1]
    if n > k:
        row, col = np.nonzero(scores >= np.partition(scores, n - k, axis=1)[:, n - k, None])
    else:
        row, col = np.divmod(np.arange(scores.size), max(n, 1))
    other = ids[col] != names[row]
    row, col = row[other], col[other]
    order = np.lexsort((col, ~scores[row, col], row))  # ~x is -x - 1: descending without overflow
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row of `vectors` (vec_id, embedding) where `is_query` holds.

    Scores are inner products of the components floor(scale * x); a row isn't a candidate for a query of its own vec_id;
    ties go to the smaller vec_id; a query has fewer rows where there are fewer candidates. Rows are dealt into shards by a
    hash of id and vector, queries into blocks; each (block, shard) is one matrix product that keeps k candidates a query, so
    a task holds a tile's input and nothing grows with the table. The lists of a query are merged FAN at a time.

    Rows with a null vec_id, a null vector, or a component that is null or not finite take no part. Vectors of different
    lengths don't meet. Rows that repeat a vec_id: candidates count each by itself; a query id asks with each of its
    distinct vectors, and the best of all answers are kept. Scores beyond 64 bits end at its range. No rows: no rows.
    Other columns are ignored.
    """
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("x"), is_query.alias("asks")).where("x is not null and vec_id is not null")
    sound = written(sound.withColumn("dim", F.size("x")).withColumn("deal", F.xxhash64("vec_id", "x")))
    total = sound.agg(F.count("*"), F.count_if("asks"), F.max(F.aggregate("x", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()
    most = 2 * sound.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-total[0] // shard_rows), min(most, total[0] // min(LEAST_SHARD, shard_rows)))
    blocks = max(1, -(-total[1] // block_queries))
    slim = F.col("x").cast("array<float>" if (total[2] or 0) <= SINGLE else "array<double>")
    rows = sound.select("dim", F.pmod("deal", F.lit(shards)).alias("shard"), "vec_id", slim.alias("x")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    # Both sides of a cogroup need columns of their own.
    asked = sound.where("asks").select(F.col("dim").alias("q_dim"), F.pmod("deal", F.lit(blocks)).alias("q_block"), F.col("vec_id").alias("q_id"), slim.alias("q")).distinct()
    asked = asked.withColumn("q_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))

    def tile(key: tuple, queries: pa.Table, table: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[1].as_py()
        parts = [pa.table({c: pa.array([], t) for c, t in _ARROW.items()})]
        if queries.num_rows and table.num_rows:
            names, ids = np.asarray(queries.column("q_id")), np.asarray(table.column("vec_id"))
            order = np.argsort(ids, kind="stable")
            ids, x, q = ids[order], _matrix(table.column("x"), dim)[order], _matrix(queries.column("q"), dim)
            step = max(1, CELLS // len(ids))
            for at in range(0, len(names), step):
                own, name = products(q[at : at + step], x), names[at : at + step]
                row, col = best(own, ids, name, k)
                ends = pa.array(np.searchsorted(row, np.arange(len(name) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (ids[col], own[row, col])]
                parts.append(pa.table([pa.array(name), pa.array(np.full(len(name), shard)), *lists], names=list(_ARROW)))
        return pa.concat_tables(parts)

    keys = ["dim", "shard", "block"]
    lists = asked.groupBy("q_dim", "q_shard", "q_block").cogroup(rows.groupBy(*keys)).applyInArrow(tile, LISTS)
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("score", "vec_id"))), lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.vec_id < b.vec_id, -1).when(a.vec_id > b.vec_id, 1).otherwise(0))
    while True:
        last = shards <= FAN
        shard = F.lit(0).cast("long") if last else F.expr(f"shard div {FAN}")
        merged = lists.groupBy("query_id", shard.alias("shard")).agg(F.slice(pairs, 1, k).alias("top"))
        if last:
            return merged.select("query_id", F.posexplode("top")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.vec_id", "col.score")
        lists = merged.select("query_id", "shard", F.col("top.vec_id").alias("vec_id"), F.col("top.score").alias("score"))
        shards = -(-shards // FAN)
