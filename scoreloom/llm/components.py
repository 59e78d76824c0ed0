"""Connected components of a link table: union-find within tasks, and where links fill several tasks alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.scratch import discard, stored

#: Links that a task joins at once.
LINKS = 1 << 20


class Forest:
    """Union-find over numbered nodes."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while len(i):
            a, b = p[i], p[j]
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            if not len(i):
                return
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = p[p]
                if (up == p).all():
                    break
                p[:] = up


def _joined(links: DataFrame) -> DataFrame:
    """Links of the same components: those that a task holds at once become stars about their least nodes."""
    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in "ab")
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        forest = Forest(len(nodes))
        forest.add(at[: len(a)], at[len(a) :])
        some = np.flatnonzero(forest.parent != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[some]), pa.array(nodes[forest.parent[some]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= LINKS:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return links.mapInArrow(run, "a long, b long")


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) pairs of longs, a <> b, to (node, root): every node that has a link, with the
    smallest node of its component. Minima are taken with partial sums, so a node with very
    many links is no burden for one task; each step is stored, so its lineage and its plan are short.
    What tasks have joined is read again by as few tasks as hold it, LINKS links each, before any round:
    rounds shuffle the links nine times and are for tables that no task can hold."""
    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        new = stored(new, "links")
        discard(old)
        return new

    now = stored(_joined(links.where("a <> b").select("a", "b")), "links")
    while True:
        tasks = max(1, -(-now.count() // LINKS))
        now = replaced(now, _joined(now.coalesce(tasks)))
        if tasks == 1 or _are_stars(now):
            break
        for step in (_large, _small):
            now = replaced(now, step(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether each node but the least of its component has one link, to that one (a > b in all links)."""
    ends = links.select(F.posexplode(F.array("a", "b")).alias("up", "node"))
    return ends.groupBy("node").agg(F.sum(1 - F.col("up")).alias("down"), F.max("up").alias("up")).where("down + up > 1 AND down > 0").isEmpty()
