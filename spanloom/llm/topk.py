"""Exact top-k search by block-at-a-time pruning.

Vectors lie in blocks of neighbouring ids, each with a forward index (its rows)
and its largest and smallest value of every term. A query orders the blocks by
the sum of its bounds over the terms and scores them through the forward index
until the next bound falls below its kth score.

A query first searches the shard of blocks that it lies in, which gives it a
least score. Then only the bounds of the other shards' blocks meet the queries,
and a query moves to a shard only if one of them reaches that score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, table

TOP = 10
#: Vectors in a block; in a shard, the blocks of a task; queries that meet in a task; shards whose bounds meet in a task.
BLOCK, SHARD, QUERIES_AT_ONCE, SHARDS_AT_ONCE = 64, 8192, 2048, 32
_EXACT = float(2**53)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers as float64, padded with 0 to one length."""
    rows = column.combine_chunks()
    lengths = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def _dot(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in float64 where no sum can pass 2**53, else in Python integers."""
    if np.abs(query).sum() * np.abs(rows).max(initial=0) < _EXACT:
        return rows @ query
    q = [int(x) for x in query]
    return np.array([sum(a * int(b) for a, b in zip(q, row, strict=True)) for row in rows], object)


def block_bounds(rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest value of every term in blocks of ``block`` rows."""
    starts = np.arange(0, len(rows), block)
    if not rows.shape[1] or not len(rows):
        return np.zeros((len(starts), 0)), np.zeros((len(starts), 0))
    return np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)


def upper_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of a query with a vector of a block is higher than this, for queries x blocks."""
    width = max(queries.shape[1], high.shape[1])
    queries, high, low = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, high, low))
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    # Float sums may be off; a bound is never taken as lower than it is.
    return np.where(np.abs(bounds) < _EXACT / 4, bounds, bounds + 1e-9 * np.abs(bounds) + 1.0)


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: int, block: int, least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's best ``top`` in the shard, ties to smaller ids; its own row is left out.

    least: scores below it are of no use to the query.
    """
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, rows))
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    starts = np.arange(0, len(ids), block)
    bounds = upper_bounds(queries, *block_bounds(rows, block))
    least = np.full(len(query_ids), -np.inf) if least is None else least
    found = []
    for q, query, bound, floor in zip(query_ids.tolist(), queries, bounds, least.tolist(), strict=True):
        ranked = np.argsort(-bound, kind="stable")
        best_ids, best, at, step = np.empty(0, np.int64), np.empty(0), 0, 1
        while at < len(ranked):
            floor = max(floor, best[-1]) if len(best) >= top else floor
            if bound[ranked[at]] < floor:
                break
            take = ranked[at : at + step]
            take = take[bound[take] >= floor]
            at, step = at + step, min(2 * step, 64)
            members = (starts[take][:, None] + np.arange(block)).ravel()
            members = members[members < len(ids)]
            members = members[ids[members] != q]
            new = _dot(query, rows[members])
            best_ids, best = np.concatenate([best_ids, ids[members]]), np.concatenate([best, new])
            keep = np.lexsort((best_ids, -best))[:top]
            best_ids, best = best_ids[keep], best[keep]
        found += [(q, int(i), int(s)) for i, s in zip(best_ids.tolist(), best.tolist(), strict=True)]
    return found


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _found(rows: list[tuple[int, int, int]]) -> pa.Table:
    return pa.table([pa.array([x[j] for x in rows], pa.int64()) for j in range(3)], schema=_FOUND)


def _at_home(every: int, top: int, block: int):
    """Searches a shard by its own queries, QUERIES_AT_ONCE at a time; a repeated query row is one query."""

    def search(shard: pa.Table) -> pa.Table:
        ids, rows = shard["vec_id"].to_numpy(), _matrix(shard["v"])
        _, first = np.unique(ids, return_index=True)
        asked = first[ids[first] % every == 0]
        out = []
        for low in range(0, len(asked), QUERIES_AT_ONCE):
            at = asked[low : low + QUERIES_AT_ONCE]
            out += search_shard(ids[at], rows[at], ids, rows, top, block)
        return _found(out)

    return search


def _bounds_of(block: int):
    """A shard's block bounds as one row; its blocks are those of its rows in order of ids."""

    def bounds(shard: pa.Table) -> pa.Table:
        rows = _matrix(shard["v"])[np.argsort(shard["vec_id"].to_numpy(), kind="stable")]
        high, low = block_bounds(rows, block)
        return pa.table([shard["shard"][:1].cast(pa.int32()), pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary()), pa.array([len(high)], pa.int32())], names=["shard", "high", "low", "blocks"])

    return bounds


def _worth(asked: pa.Table, bounds: pa.Table) -> pa.Table:
    """(query_id, shard) where a block's bound reaches the query's least score."""
    queries, shards = [], []
    if asked.num_rows and bounds.num_rows:
        ids, rows, least, home = asked["query_id"].to_numpy(), _matrix(asked["v"]), asked["least"].to_numpy(), asked["home"].to_numpy()
        for shard, high, low, n in zip(*(bounds[x].to_pylist() for x in ("shard", "high", "low", "blocks")), strict=True):
            high, low = (np.frombuffer(x).reshape(n, -1) for x in (high, low))
            at = np.flatnonzero((upper_bounds(rows, high, low).max(axis=1) >= least) & (home != shard))
            queries += ids[at].tolist()
            shards += [shard] * len(at)
    return pa.table([pa.array(queries, pa.int64()), pa.array(shards, pa.int32())], names=["query_id", "shard"])


def _search(top: int, block: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([])
        return _found(search_shard(left["query_id"].to_numpy(), _matrix(left["v"]), right["vec_id"].to_numpy(), _matrix(right["v"]), top, block, left["least"].to_numpy()))

    return search


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v) with components floor(scale * x); null, or holding null or non-finite components: left out."""
    x = vectors[vector_col]
    sound = x.isNotNull() & vectors[id_col].isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.filter(sound).select(vectors[id_col].cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, top: int = TOP, scale: float = 1024.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` its best ``top`` other rows, ties to smaller ids.

    Neither side is ever whole in a task: queries and vectors meet in parts of
    bounded size, and only where a shard's bounds reach what a query has already
    found in its own; each shard returns its own best, which are merged. Where
    bounds exclude nothing, all queries still meet all vectors. Vectors of
    other lengths count as padded with 0; an empty vector scores 0. Rows that
    repeat an id are candidates each, but a query's own id is no candidate of
    it, and a repeated query row is one query (any of its rows). An empty table
    gives an empty result.
    """
    with Scratch(vectors.sparkSession) as scratch:
        rows = quantised(vectors, id_col, vector_col, scale)
        n = rows.count()
        shards = max(1, -(-n // SHARD))
        # Ranges of ids: neighbours share blocks. A range in which ids are dense or repeated is split by hash.
        ranged = scratch.save(rows.repartitionByRange(shards, "vec_id", F.xxhash64("v")).withColumn("shard", F.spark_partition_id()), "shards")
        home = scratch.save(ranged.groupBy("shard").applyInArrow(_at_home(every, top, block), "query_id long, vec_id long, score long"), "home")
        queries = ranged.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by(F.struct("v", "shard"), F.struct("shard", F.xxhash64("v"))).alias("x")).select("query_id", "x.v", F.col("x.shard").alias("home"))
        kth = home.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("kth")).filter(F.col("c") >= top)
        queries = scratch.save(queries.join(kth, "query_id", "left").select("query_id", "v", "home", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("least")), "queries")
        found = home
        if ranged.select("shard").distinct().limit(2).count() > 1:
            turns, groups = max(1, -(-queries.count() // QUERIES_AT_ONCE)), max(1, -(-shards // SHARDS_AT_ONCE))
            parts = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
            bounds = ranged.groupBy("shard").applyInArrow(_bounds_of(block), "shard int, high binary, low binary, blocks int")
            bounds = bounds.withColumn("group", (F.col("shard") % groups).cast("int")).withColumn("turn", parts(turns))
            asked = queries.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")).withColumn("group", parts(groups))
            pairs = scratch.save(asked.groupBy("turn", "group").cogroup(bounds.groupBy("turn", "group")).applyInArrow(_worth, "query_id long, shard int"), "pairs")
            needed = pairs.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(float(QUERIES_AT_ONCE))).cast("int").alias("turns"))
            moved = pairs.join(queries.drop("home"), "query_id").join(needed, "shard")
            moved = scratch.save(moved.withColumn("turn", F.pmod(F.xxhash64("query_id"), "turns").cast("int")).drop("turns"), "moved")
            wanted = ranged.join(needed, "shard").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
            found = found.unionByName(moved.groupBy("shard", "turn").cogroup(wanted.groupBy("shard", "turn")).applyInArrow(_search(top, block), "query_id long, vec_id long, score long"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return cut(found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"))


def op3_block_pruned_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_block_pruned_top_k": op3_block_pruned_top_k}
ORACLE = {
    "op3_block_pruned_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
}
