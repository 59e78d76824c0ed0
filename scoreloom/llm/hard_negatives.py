"""Hard negatives by an inverted multi-index.

Vectors are halved; a codebook of CODES centroids for each half, fitted on a bounded sample,
gives every vector a cell, a pair of codewords. With the radius of a codeword, the largest
distance of its members' halves, the score of a member with a query q is at most
``q1.c1 + |q1| r1 + q2.c2 + |q2| r2``: two half-scores. Cells are dealt to shards of bounded
size. A query goes to the shards that hold a cell whose bound reaches what the query still
needs; there a heap over the two sorted lists of half-scores visits cells by falling bound,
until no cell left can change the windows that the query asks for.

Two rounds: the first finds each anchor's positives, the second the negatives of the windows
that the positives' scores open. The driver holds the codebooks, one row for each cell, and
the sample, all of fixed size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.arrowtext import ranges
from scoreloom.llm.scratch import stored
from scoreloom.llm.topk import _best, _matrix

#: Centroids of each half, and rows (those with the smallest hashes of their ids) they are fitted on.
CODES, SAMPLE = 32, 8192
#: Vectors of a shard, about; anchors that meet a shard in one task, about.
SHARD_ROWS, BLOCK = 8192, 16_384
#: Rows gathered from cells before they are scored together.
BATCH = 1024
#: Bounds are raised by this share of the lengths involved, so that rounding loses nothing.
SLACK = 1e-9


def labelled_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, vec: floor(256 * x) of each component as double. Rows without id, label or
    vector, or with a null or non-finite component, take no part. Where the id is divisible by
    7, the label becomes (label + 1) % 10."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col(label_col).cast("long")
    label = F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)
    whole = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).where(sound)
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda v: F.floor(v * 256).cast("double")).alias("vec"))


class Codebooks(NamedTuple):
    half: int  # components of the first half
    width: int
    codes: tuple[np.ndarray, np.ndarray]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., : self.half], x[..., self.half :]

    def nearest(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half the codeword of each row and its distance."""
        word, far = [], []
        for part, codes in zip(self.parts(x), self.codes):
            at = np.argmin((codes * codes).sum(1) - 2 * part @ codes.T, axis=1)
            word.append(at)
            far.append(np.sqrt(((part - codes[at]) ** 2).sum(1)))
        return word, far

    def half_bounds(self, q: np.ndarray, radii: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """For each half and codeword the largest half-score that a member can have with q."""
        out = []
        for part, codes, r in zip(self.parts(q), self.codes, radii):
            length = np.sqrt((part * part).sum())
            out.append(codes @ part + length * r + SLACK * (1 + length) * (1 + np.sqrt((codes * codes).sum(1)) + r))
        return out


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from distinct rows; the same at every run."""
    start = np.unique(x, axis=0)
    c = start[np.random.default_rng(11).permutation(len(start))[:k]]
    for _ in range(8):
        at = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, width: int) -> Codebooks:
    half = width // 2
    return Codebooks(half, width, (_centroids(sample[:, :half], CODES), _centroids(sample[:, half:], CODES)))


class Cells(NamedTuple):
    """The directory of cells: what the driver keeps of the index."""

    radii: tuple[np.ndarray, np.ndarray]
    held: np.ndarray  # cells with members, ascending
    first: np.ndarray  # first shard of each
    n_shards: np.ndarray  # shards over which its members are dealt


def _directory(rows: list, books: Codebooks) -> Cells:
    """Small cells share a shard, cells with more than SHARD_ROWS members have several."""
    k = [len(c) for c in books.codes]
    cell, n = np.array([r.cell for r in rows], np.int64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    radii = tuple(np.zeros(m) for m in k)
    np.maximum.at(radii[0], cell // k[1], np.array([r.d1 for r in rows])[order])
    np.maximum.at(radii[1], cell % k[1], np.array([r.d2 for r in rows])[order])
    parts = -(-n // SHARD_ROWS)
    first, shard, room = np.zeros(len(n), np.int64), 0, SHARD_ROWS
    for i, (size, p) in enumerate(zip(n.tolist(), parts.tolist())):
        if p > 1 or size > room:
            shard, room = shard + (room < SHARD_ROWS), SHARD_ROWS
        first[i] = shard
        if p > 1:
            shard += p
        else:
            room -= size
    return Cells(radii, cell, first, parts)


class Shard:
    """A part of the index: vectors in the order of their cells, radii of this part alone."""

    def __init__(self, books: Codebooks, table: pa.Table):
        order = np.argsort(table.column("cell").to_numpy(), kind="stable")
        k2 = len(books.codes[1])
        cell = table.column("cell").to_numpy()[order]
        self.ids, self.labels = table.column("vec_id").to_numpy()[order], table.column("label").to_numpy()[order]
        self.x = _matrix(table.column("vec").combine_chunks(), books.width)[order]
        words = cell // k2, cell % k2
        self.used, radii, place = [], [], []
        for w, d in zip(words, ("d1", "d2")):
            used, at = np.unique(w, return_inverse=True)
            r = np.zeros(len(used))
            np.maximum.at(r, at, table.column(d).to_numpy()[order])
            self.used.append(used), radii.append(r), place.append(at)
        self.books = Codebooks(books.half, books.width, tuple(c[u] for c, u in zip(books.codes, self.used)))
        self.radii = tuple(radii)
        own = place[0] * len(self.used[1]) + place[1]
        bounds = np.searchsorted(own, np.arange(len(self.used[0]) * len(self.used[1]) + 1))
        self.bounds, self.cells = bounds.tolist(), int((np.diff(bounds) > 0).sum())

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Rows of cells by falling bound, with the bound of all rows that follow."""
        b1, b2 = self.books.half_bounds(q, self.radii)
        o1, o2 = np.argsort(-b1), np.argsort(-b2)
        s1, s2, o1, o2 = b1[o1].tolist(), b2[o2].tolist(), o1.tolist(), o2.tolist()
        heap, k2, left = [(-s1[0] - s2[0], 0, 0)], len(o2), self.cells
        starts, sizes, n = [], [], 0
        while heap and left:
            _, i, j = heapq.heappop(heap)
            if j + 1 < k2:
                heapq.heappush(heap, (-s1[i] - s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heapq.heappush(heap, (-s1[i + 1] - s2[0], i + 1, 0))
            at = o1[i] * k2 + o2[j]
            size = self.bounds[at + 1] - self.bounds[at]
            if size:
                left -= 1
                starts.append(self.bounds[at]), sizes.append(size)
                n += size
            if n >= BATCH or (n and not left):
                yield -heap[0][0] if heap and left else -np.inf, ranges(np.array(starts), np.array(sizes))
                starts, sizes, n = [], [], 0

    def positives(self, q: np.ndarray, own: int, label: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of the anchor's label that score `least` or more, but its own."""
        scores, ids = np.empty(0), np.empty(0, np.int64)
        for bound, rows in self.visit(q):
            rows = rows[(self.labels[rows] == label) & (self.ids[rows] != own)]
            got = self.x[rows] @ q
            some = got >= least
            scores, ids = _best(np.concatenate((scores, got[some])), np.concatenate((ids, self.ids[rows[some]])), k)
            if bound < max(least, scores[-1] if len(scores) >= k else -np.inf):
                break
        return scores, ids

    def windows(self, q: np.ndarray, label: int, tops: list[int], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each top score the k best rows of other labels from four fifths of it up to it."""
        low = [-(-80 * t // 100) for t in tops]
        have = [(np.empty(0), np.empty(0, np.int64)) for _ in tops]
        for bound, rows in self.visit(q):
            rows = rows[self.labels[rows] != label]
            got = self.x[rows] @ q
            some = (got >= min(low)) & (got <= max(tops))
            got, ids = got[some], self.ids[rows[some]]
            for w, (t, a) in enumerate(zip(tops, low)):
                fit_in = (got >= a) & (got <= t)
                if fit_in.any():
                    have[w] = _best(np.concatenate((have[w][0], got[fit_in])), np.concatenate((have[w][1], ids[fit_in])), k)
            if all(bound < max(a, s[-1] if len(s) >= k else -np.inf) for a, (s, _) in zip(low, have)):
                break
        return [(t, s, i) for t, (s, i) in zip(tops, have)]


def _meet(vectors: DataFrame, asked: DataFrame, blocks: int, search: Callable, schema: str) -> DataFrame:
    """Shards and the anchors dealt to them, one task for each shard and block of anchors."""
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
    left = vectors.withColumn("block", block).groupBy("shard", "block")
    return left.cogroup(asked.groupBy("shard", "block")).applyInArrow(search, schema)


def mine(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label, vec (see `labelled_vectors`); `anchors` are rows of it. An id
    that several anchors share is answered for the least of them by label, then vector; rows of
    `vectors` count each, but none with the anchor's id. Anchors without a positive, and
    positives without a negative, give no row. Scores are exact below 2 ** 53; vectors of
    different lengths are filled up by zeros. Empty tables give no rows."""
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "vec").limit(SAMPLE).toArrow()
    width = vectors.agg(F.max(F.size("vec"))).first()[0]
    if not width:
        width = 1
    if not sample.num_rows:
        return spark.createDataFrame([], out)
    sample_x, sample_ids, sample_labels = _matrix(sample.column("vec").combine_chunks(), width), sample.column("vec_id").to_numpy(), sample.column("label").to_numpy()
    books = fit(sample_x, width)
    k2 = len(books.codes[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, far = books.nearest(_matrix(b.column("vec"), books.width))
            yield pa.record_batch([*b.columns, pa.array(word[0] * k2 + word[1]), pa.array(far[0]), pa.array(far[1])], names=["vec_id", "label", "vec", "cell", "d1", "d2"])

    indexed = stored(vectors.select("vec_id", "label", "vec").mapInArrow(assign, "vec_id long, label long, vec array<double>, cell long, d1 double, d2 double"), "cells")
    cells = _directory(indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect(), books)
    places = spark.createDataFrame(list(zip(cells.held.tolist(), cells.first.tolist(), cells.n_shards.tolist())), "cell long, first long, parts long")
    dealt = indexed.join(F.broadcast(places), "cell").withColumn("shard", F.col("first") + F.pmod(F.monotonically_increasing_id(), F.col("parts"))).drop("first", "parts")

    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("a")).select(F.col("vec_id").alias("anchor_id"), "a.label", "a.vec")
    one = stored(one, "anchors")
    n_anchors = one.count()
    blocks = max(1, -(-n_anchors // BLOCK))
    one = one.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
    known = spark.sparkContext.broadcast((sample_x, sample_ids, sample_labels))

    def shards_of(q: np.ndarray, least: float) -> np.ndarray:
        b1, b2 = books.half_bounds(q, cells.radii)
        some = b1[cells.held // k2] + b2[cells.held % k2] >= least
        return np.unique(ranges(cells.first[some], cells.n_shards[some]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors and the shards that may hold a positive: the sample gives a first score to reach."""
        sample_x, sample_ids, sample_labels = known.value
        for b in batches:
            q, ids, labels = _matrix(b.column("vec"), books.width), b.column("anchor_id").to_pylist(), b.column("label").to_pylist()
            least, shards = np.full(b.num_rows, -np.inf), []
            for i in range(b.num_rows):
                got = sample_x[(sample_labels == labels[i]) & (sample_ids != ids[i])] @ q[i]
                if len(got) >= n_positives:
                    least[i] = np.partition(got, len(got) - n_positives)[len(got) - n_positives]
                shards.append(shards_of(q[i], least[i]))
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(s) for s in shards]))
            whole = pa.record_batch([*b.columns, pa.array(least)], names=[*b.schema.names, "least"]).take(row)
            yield pa.record_batch([*whole.columns, pa.array(np.concatenate([*shards, np.empty(0, np.int64)]))], names=[*whole.schema.names, "shard"])

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if left.num_rows and right.num_rows:
            shard, q = Shard(books, left), _matrix(right.column("vec").combine_chunks(), books.width)
            for i, (own, label, least) in enumerate(zip(*(right.column(c).to_pylist() for c in ("anchor_id", "label", "least")))):
                scores, ids = shard.positives(q[i], own, label, least, n_positives)
                got.append((np.full(len(ids), own), ids, scores.astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*got)] if got else [np.empty(0, np.int64)] * 3
        return pa.table(list(map(pa.array, cols)), names=["anchor_id", "positive_id", "positive_score"])

    asked = one.select("anchor_id", "label", "vec", "block").mapInArrow(deal, "anchor_id long, label long, vec array<double>, block int, least double, shard long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = _meet(dealt, asked, blocks, find_positives, "anchor_id long, positive_id long, positive_score long")
    positives = stored(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= n_positives), "positives")

    def deal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("vec"), books.width)
            shards = [shards_of(q[i], min(-(-80 * t // 100) for t in tops)) for i, tops in enumerate(b.column("tops").to_pylist())]
            whole = b.take(pa.array(np.repeat(np.arange(b.num_rows), [len(s) for s in shards])))
            yield pa.record_batch([*whole.columns, pa.array(np.concatenate([*shards, np.empty(0, np.int64)]))], names=[*whole.schema.names, "shard"])

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if left.num_rows and right.num_rows:
            shard, q = Shard(books, left), _matrix(right.column("vec").combine_chunks(), books.width)
            for i, (own, label, tops) in enumerate(zip(*(right.column(c).to_pylist() for c in ("anchor_id", "label", "tops")))):
                got += [(np.full(len(ids), own), np.full(len(ids), t), ids, scores.astype(np.int64)) for t, scores, ids in shard.windows(q[i], label, tops, n_negatives)]
        cols = [np.concatenate(c) for c in zip(*got)] if got else [np.empty(0, np.int64)] * 4
        return pa.table(list(map(pa.array, cols)), names=["anchor_id", "positive_score", "negative_id", "negative_score"])

    # below a score of zero no window is open: four fifths of it lie above it
    tops = positives.where("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("tops"))
    opened = one.join(tops, "anchor_id").select("anchor_id", "label", "vec", "block", "tops").mapInArrow(deal_windows, "anchor_id long, label long, vec array<double>, block int, tops array<long>, shard long")
    near = _meet(dealt, opened, blocks, find_negatives, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    negatives = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: every vector whose id is divisible by 100; candidates: all vectors."""
    vectors = labelled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mine(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
