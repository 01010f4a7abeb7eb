"""Exact top-k inner-product search by tiled matrix products.

Candidates fall into shards and queries into blocks by a hash of their id; a
tile is one block against one shard. A tile's task multiplies the two integer
matrices a few query rows at a time, keeps each query's best ``k`` rows of the
tile, and the per-query lists are merged up a tree whose nodes join ``fan``
lists each, so no task ever sees more than ``fan * k`` rows of a query. Tile
sides are fixed, so memory does not depend on the size of the tables.

Components become floor(scale * x); products are exact: in float64 where no sum
can reach 2**53, else in Python integers, saturated at the 64-bit limits.

Defined results: vectors that are null or hold a null or non-finite component,
and rows with a null id, take no part; a vector meets only vectors of its own
length; repeated candidate rows stay repeated; of repeated query ids one (the
smallest vector) asks; a query's own id is never its candidate; ties go to the
smaller id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

_LIMIT = 2 ** 63 - 1


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """``(id, dim, v)`` of the rows that take part."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return (df.filter(F.col(f"`{id_col}`").isNotNull() & vec.isNotNull() & F.forall(vec, finite))
            .select(F.col(f"`{id_col}`").cast("long").alias("id"), F.size(vec).alias("dim"), F.transform(vec, lambda x: F.floor(x * scale).cast("long")).alias("v")))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and the rows of their vectors."""
    t = t.combine_chunks()
    ids = t.column("id").to_numpy()
    dim = t.column("dim")[0].as_py()
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if dim else np.empty(0, np.int64)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), dim)[order]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = lambda m: max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    if size(q) * size(c) * max(1, q.shape[1]) < 2 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    whole = q.astype(object) @ c.astype(object).T
    return np.clip(whole, -_LIMIT, _LIMIT).astype(np.int64)


def tile_best(queries: pa.Table, shard: pa.Table, k: int, rows_at_once: int = 128) -> pa.Table:
    """Each query's best k rows of one shard."""
    out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if queries.num_rows and shard.num_rows:
        (q_ids, q), (c_ids, c) = _matrix(queries), _matrix(shard)
        for at in range(0, len(q_ids), rows_at_once):
            scores = _products(q[at:at + rows_at_once], c)
            for own, row in zip(q_ids[at:at + rows_at_once], scores):
                lo, hi = np.searchsorted(c_ids, own, "left"), np.searchsorted(c_ids, own, "right")
                most = k + hi - lo
                least = row[np.argpartition(row, len(row) - most)[len(row) - most]] if len(row) > most else row.min()
                top = np.flatnonzero(row >= least)  # ids ascend, so a stable sort breaks ties by id
                top = top[(top < lo) | (top >= hi)]
                top = top[np.argsort(-row[top].astype(np.float64) if abs(row[top]).max(initial=0) < 2 ** 53 else np.array([-int(x) for x in row[top]], object), kind="stable")][:k]
                out[0].append(np.full(len(top), own))
                out[1].append(c_ids[top])
                out[2].append(row[top])
    return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in out))))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024,
           shard_rows: int = 16_384, block_rows: int = 4_096, fan: int = 32) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best other rows."""
    rows = materialise(integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    asked = integer_vectors(vectors.filter(is_query), id_col, vec_col, scale).groupBy("id", "dim").agg(F.min("v").alias("v"))
    asked = materialise(asked.groupBy("id").agg(F.min(F.struct("v", "dim")).alias("m")).select("id", "m.dim", "m.v"), "queries")
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // block_rows))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "dim", "v", part(blocks).alias("block")).select("*", every(shards).alias("shard"))
    right = rows.select("id", "dim", "v", part(shards).alias("shard")).select("*", every(blocks).alias("block"))
    key = ["dim", "shard", "block"]

    def tile(keys: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        best = tile_best(a, b, k)
        return best.append_column("part", pa.array(np.full(best.num_rows, keys[1].as_py()), pa.int64()))

    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, "query_id long, vec_id long, score long, part long")
    while shards > 1:
        shards = -(-shards // fan)
        best = best.withColumn("part", F.expr(f"part div {fan}"))
        order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
