"""Exact top-k inner products by MaxScore.

A query is a set of weighted terms (its components); the posting of a term holds that
component of all vectors of a shard. From the bounds of the postings follow each term's
largest contribution. The terms with the smallest bounds, whose sum stays below the current
k-th best score, are non-essential: all candidates are scored on the essential terms, and the
others are probed only for candidates that can still get among the best. Each shard returns
its best k of each query; shards are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.scratch import stored

#: Queries sent to all tasks at once; more are handled in blocks of about this number.
QUERY_BLOCK = 8192
CHUNK, PROBE = 8192, 8


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec: floor(256 * x) of each component as double. Rows whose id or vector is
    null, or whose vector has a null or non-finite component, take no part."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256).cast("double")).alias("vec"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones get zeros."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(n.max(initial=0)), width or 0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        scores, ids = scores[some], ids[some]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Shard:
    """Postings of some vectors, term by term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.post = ids, np.ascontiguousarray(vectors.T)
        self.high, self.low = self.post.max(1), self.post.min(1)

    def search(self, q: np.ndarray, own: int, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k of the given results and this shard."""
        d = min(len(q), len(self.post))
        q = q[:d]
        bound = np.maximum(q * self.high[:d], q * self.low[:d])
        order = np.argsort(bound, kind="stable")
        upto = np.cumsum(bound[order])
        least = scores[-1] if len(scores) >= k else -np.inf
        free = int(np.searchsorted(np.maximum.accumulate(upto), least)) if np.isfinite(least) else 0
        essential = order[free:]
        got = q[essential] @ self.post[essential] if len(essential) else np.zeros(len(self.ids))
        rest = upto[free - 1] if free else 0.0
        alive = np.flatnonzero((got + rest >= least) & (self.ids != own))
        got = got[alive]
        while free and len(alive):
            some = order[max(0, free - PROBE) : free]
            got = got + q[some] @ self.post[np.ix_(some, alive)]
            free = max(0, free - PROBE)
            rest = upto[free - 1] if free else 0.0
            keep = got + rest >= least
            alive, got = alive[keep], got[keep]
        return _best(np.concatenate((scores, got)), np.concatenate((ids, self.ids[alive])), k)


def _shard_search(vectors: DataFrame, q_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((q_ids, queries))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, queries = sent.value
        best = [(np.empty(0), np.empty(0, np.int64))] * len(q_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                shard = Shard(b.column("vec_id").to_numpy(), _matrix(b.column("vec")))
                best = [shard.search(q, own, k, *have) for q, own, have in zip(queries, q_ids.tolist(), best)]
        n = np.array([len(s) for s, _ in best], np.int64)
        if n.sum():
            yield pa.record_batch([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]).astype(np.int64))], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all vectors but its own id.

    Queries (rows of vec_id, vec) go out in blocks of about QUERY_BLOCK, so the broadcast is
    bounded; each block's merged result is stored. A query id that is there repeatedly is answered
    once, for the least of its vectors (component by component); repeated candidates count each.
    Vectors of fewer components count as filled up with zeros. Other columns are left out. No
    vectors or no queries: no rows. Scores are exact while they stay below 2 ** 53."""
    queries = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    merge = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        block = part.toArrow()
        found = _shard_search(vectors, block.column("vec_id").to_numpy(), _matrix(block.column("vec").combine_chunks()), k)
        ranked = found.withColumn("rank", F.row_number().over(merge)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        ranked = stored(ranked, "topk") if blocks > 1 else ranked
        out = ranked if out is None else out.unionByName(ranked)
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 50; candidates: all vectors."""
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
