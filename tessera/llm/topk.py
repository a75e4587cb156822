"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

#: Queries scored together; a block's weights stay within this many rows.
QUERY_BLOCK = 2048
#: Rows of the scanned side that get a dense score array at once.
ROW_BLOCK = 2048
#: Queries and rows of a tile of dense scores, which stays in a core's cache while all terms are added to it.
TILE = 64, 1024
#: Packed query blocks are sent to all tasks only up to so many bytes; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of unequal lengths side by side; a missing component counts as zero."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64 if all(abs(r).max(initial=0) < 1 << 25 for r in rows) else object)
    for i, r in enumerate(rows):
        out[i, : len(r)] = [int(x) for x in r] if out.dtype == object else r
    return out


def score_block(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of every query against every row: each term's weighted postings are added to the queries' dense score arrays, tile by tile."""
    terms = min(queries.shape[1], rows.shape[1])
    if object in (queries.dtype, rows.dtype):
        kind = np.dtype(object)
    else:
        # 32 bits where no sum can leave them
        most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * terms
        kind = np.dtype(np.int32) if most < 1 << 31 else np.result_type(queries, rows)
    scores = np.zeros((len(queries), len(rows)), kind)
    by_query, by_row = (np.ascontiguousarray(x[:, :terms].T).astype(kind) for x in (queries, rows))
    for i in range(0, len(queries), TILE[0]):
        for j in range(0, len(rows), TILE[1]):
            tile = np.zeros((min(TILE[0], len(queries) - i), min(TILE[1], len(rows) - j)), kind)
            room = np.empty_like(tile)
            for q, r in zip(by_query[:, i : i + TILE[0]], by_row[:, j : j + TILE[1]], strict=True):
                asking, posted = np.flatnonzero(q), np.flatnonzero(r)
                if 2 * len(asking) * len(posted) > tile.size:
                    tile += np.multiply.outer(q, r, out=room)
                elif len(asking) and len(posted):
                    tile[np.ix_(asking, posted)] += np.multiply.outer(q[asking], r[posted])
            scores[i : i + TILE[0], j : j + TILE[1]] = tile
    return scores if kind == object else scores.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of a row of scores, ties to smaller ids; ids ascend."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        return np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])
    order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), int)
    return order[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "vector", key: str = "vec_id") -> DataFrame:
    """Each query's k rows of the highest inner product, ties to the smaller key.

    vectors, queries: key (long) and vector (array of integral doubles). Vectors that are null, or hold null or
    non-finite components, take no part; so do rows with a null key. Rows with the query's own key are its own row. A
    key that is asked twice with unlike vectors is answered for the smaller vector. Equal rows of the scanned side
    each count. Scores beyond a long are set to its limits. An empty side gives no rows. Other columns don't matter.

    The scanned side is read once, in blocks of ROW_BLOCK rows; each block meets each block of QUERY_BLOCK queries,
    and only k rows for each query leave a task's block. Query blocks are broadcast up to BROADCAST_BYTES and joined by block number beyond.
    """
    sane = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    asked = sane(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "topk-queries")
    sizes = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-sizes.n // QUERY_BLOCK))
    packed = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    scanned = sane(vectors)

    def pack(batches):
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, ROW_BLOCK):
                n = min(ROW_BLOCK, batch.num_rows - at)
                for b in range(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([ids.slice(at, n).to_pylist()], pa.list_(pa.int64())), pa.array([v.slice(at, n).to_pylist()], pa.list_(pa.list_(pa.float64())))], names=["block", "ids", "vs"])

    def score(batches):
        made: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                b = batch.column("block")[row].as_py()
                if b not in made:
                    made.clear()
                    asked = batch.column("asked")[row].as_py()
                    made[b] = np.array([x["id"] for x in asked], np.int64), _matrix([np.asarray(x["v"]) for x in asked])
                qids, q = made[b]
                ids = np.asarray(batch.column("ids")[row].as_py(), np.int64)
                order = np.argsort(ids, kind="stable")
                vs = batch.column("vs")[row].as_py()
                rows = _matrix([np.asarray(vs[i]) for i in order])
                ids = ids[order]
                found = []
                for at in range(0, len(qids), 256):
                    scores = score_block(q[at : at + 256], rows)
                    for i, s in enumerate(scores):
                        other = ids != qids[at + i]
                        s, own = (s, ids) if other.all() else (s[other], ids[other])
                        top = best(s, own, k)
                        found.append((qids[at + i], own[top], s[top]))
                limit = (1 << 63) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64)), pa.array(np.concatenate([x[1] for x in found] or [np.zeros(0, np.int64)])), pa.array([max(-limit - 1, min(limit, int(y))) for x in found for y in x[2]], pa.int64())], names=["query_id", "vec_id", "score"])

    parts = scanned.mapInArrow(pack, "block long, ids array<long>, vs array<array<double>>")
    if sizes.c * 8 + sizes.n * 16 <= BROADCAST_BYTES:
        packed = F.broadcast(packed)
    near = parts.join(packed, "block").mapInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector, each component x turned to floor(256 * x), as double; non-finite components stay for the search to leave out."""
    finite = lambda x: F.floor(F.greatest(F.least(x * 256, F.lit(9e18)), F.lit(-9e18))).cast("double")
    return embeddings.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(finite(x))).alias("vector"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for each whose id is divisible by 50."""
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
