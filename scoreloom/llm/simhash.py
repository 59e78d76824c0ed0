"""Near duplicates by SimHash, linked with vantage-point trees.

Two fingerprints that differ in at most R bits differ in at most R // BLOCKS bits in one of
BLOCKS bit blocks. For each block there is a vantage-point tree: an inner node splits its
fingerprints by their Hamming distance, in the block, from a vantage point; a fingerprint has one home leaf, and
visits as a query each further leaf that the triangle inequality does not rule out. Leaves
are shards: each is searched exactly, by the same rule carried on in memory, with the full distance
decided at the end. Trees are fitted on a bounded sample of fingerprints (this affects only the
balance of the shards); every fingerprint is indexed and queried.

A shard sends no pairs but a spanning forest of its links, so that thousands of near copies
give no more rows than there are fingerprints. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.arrowtext import slices, words
from scoreloom.llm.components import Forest, components
from scoreloom.llm.scratch import stored

#: Fingerprints per leaf that trees aim at; sampled fingerprints per leaf, and at most.
LEAF, PER_LEAF, SAMPLE = 16_384, 128, 1_000_000
BLOCKS = 3
#: Pairs compared at once in a shard.
DENSE = 1 << 20
FULL = np.uint64(2**64 - 1)


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text in turn, repeats included, and how many each has."""
    w = words(pc.ascii_lower(pc.fill_null(texts, "")))
    n, m = np.diff(w.bounds), len(texts)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(w.bounds.astype(np.int32)), w.distinct.take(pa.array(w.codes))), " ")
    size = pc.binary_length(w.distinct).to_numpy(zero_copy_only=False)
    length = size[w.codes].astype(np.int64) if len(size) else np.empty(0, np.int64)
    row = np.repeat(np.arange(m), n)
    first = np.cumsum(length + 1) - (length + 1) - row  # one space less for each earlier row with words
    empty_before = np.cumsum(n == 0)
    first = first + (empty_before[row] if m else 0)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    start = np.repeat(w.bounds[:-1], count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    last = np.minimum(start + shingle, np.repeat(w.bounds[1:], count)) - 1
    if not len(start):
        return np.empty(0, np.uint64), count
    data = memoryview(joined.buffers()[2])
    h = xxhash.xxh64_intdigest
    each = np.fromiter((h(data[a:b], 42) for a, b in zip(first[start].tolist(), (first[last] + length[last]).tolist())), np.uint64, len(start))
    return each, count


def simhash_batch(texts: pa.Array, shingle: int) -> np.ndarray:
    """A 64-bit fingerprint of each text over its word shingles, repeats included."""
    return majority_bits(*shingle_hashes(texts, shingle))


def majority_bits(each: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each `count` hashes in turn the 64 bits that are set in over half of them; none: zero."""
    out = np.zeros(len(count), np.uint64)
    if not len(each):
        return out
    some = np.flatnonzero(count)
    begin = (np.cumsum(count) - count)[some]
    bits = np.unpackbits(each.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > count[some][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). Fewer words than a shingle: the whole
    sequence is one; no words or null: zero."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                yield pa.record_batch([b.column("doc_id"), pa.array(simhash_batch(b.column("text"), shingle).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(hashed, schema)


def distance(a: np.ndarray, b: np.ndarray | np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


class Tree:
    """Inner nodes: vantage point, mask, radius, threshold, children (a negative child is leaf -child - 1)."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, radius: int, full_radius: int, leaves: int, seed: int):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self.mask, self.radius, self.full_radius = mask, radius, full_radius
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(sample, max(2.0, len(sample) / max(1, leaves)))

    def _grow(self, points: np.ndarray, capacity: float) -> int:
        best = None
        if len(points) > capacity:
            for mask, radius in ((self.mask, self.radius), (FULL, self.full_radius)):
                for vantage in self.rng.choice(points, min(8, len(points)), replace=False):
                    d = distance(points, vantage, mask).astype(np.int64)
                    t = int(np.median(d))
                    for cut in (t, t - 1):
                        small = min((d <= cut).sum(), (d > cut).sum())
                        both = ((d > cut - radius) & (d <= cut + radius)).mean()
                        if small >= len(points) // 8 and (best is None or both < best[0]):
                            best = (both, vantage, mask, radius, cut, d)
                if best:
                    break
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, vantage, mask, radius, cut, d = best
        at = len(self.nodes)
        self.nodes.append(())
        left = self._grow(points[d <= cut], capacity)
        right = self._grow(points[d > cut], capacity)
        self.nodes[at] = (vantage, mask, radius, cut, left, right)
        return at

    def place(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf: leaf, indexes of its fingerprints, whether it is their home. A pair in two
        leaves is found in the later one, so only leaves from the home on are visited."""
        def walk(node: int, index: np.ndarray, home: np.ndarray) -> Iterator:
            if node < 0:
                yield -node - 1, index, home
                return
            vantage, mask, radius, cut, left, right = self.nodes[node]
            d = distance(fps[index], vantage, mask).astype(np.int64)
            go = ((d <= cut) & home) | ((d <= cut + radius) & ~home)
            # the left leaves come first: a home on the right never has to visit them
            if go.any():
                yield from walk(left, index[go], home[go])
            here = d > cut
            go = here | (d > cut - radius)
            if go.any():
                yield from walk(right, index[go], (home & here)[go])

        yield from walk(self.root, np.arange(len(fps)), np.ones(len(fps), bool))


def search_shard(fps: np.ndarray, home: np.ndarray, mask: np.uint64, radius: int, most: int, seed: int = 0) -> Forest:
    """All links with at least one end at home, within `most` bits."""
    rng, forest = np.random.default_rng(seed), Forest(len(fps))
    at_home = np.flatnonzero(home)

    def search(points: np.ndarray, queries: np.ndarray, tries: int) -> None:
        if not len(points) or not len(queries):
            return
        if len(points) * len(queries) > DENSE and tries:
            vantage = fps[points[rng.integers(len(points))]]
            dp, dq = (distance(fps[x], vantage, mask).astype(np.int64) for x in (points, queries))
            cut = int(np.median(dp))
            if (dp <= cut).all():
                cut -= 1
            left, right = dp <= cut, dp > cut
            if min(left.sum(), right.sum()) < len(points) // 16:
                search(points, queries, tries - 1)
                return
            search(points[left], queries[dq <= cut + radius], tries)
            search(points[right], queries[dq > cut - radius], tries)
            return
        step = max(1, DENSE // len(points))
        for k in range(0, len(queries), step):
            q = queries[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[points][None, :]) <= most)
            forest.add(q[i], points[j])

    search(at_home, np.arange(len(fps)), 4)
    return forest


def links(nodes: DataFrame, most: int, leaf: int = LEAF) -> DataFrame:
    """Distinct fingerprints (column fp, stored) to a table of links a, b with the same
    connected components as all pairs within `most` bits."""
    n = nodes.count()
    leaves = max(1, -(-n // leaf))
    width = -(-64 // BLOCKS)
    masks = [np.uint64(((1 << min(width, 64 - k * width)) - 1) << (k * width)) for k in range(BLOCKS)]
    bound = min(SAMPLE, PER_LEAF * leaves)
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(bound).collect()], np.int64).view(np.uint64) if leaves > 1 else np.empty(0, np.uint64)
    trees = [Tree(sample, m, most // BLOCKS, most, leaves, seed) for seed, m in enumerate(masks)]
    first = np.cumsum([0] + [max(1, t.leaves) for t in trees])
    sent = nodes.sparkSession.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for base, tree in zip(first.tolist(), sent.value):
                for k, index, home in tree.place(fps):
                    yield pa.record_batch([pa.array(np.full(len(index), base + k, np.int32)), pa.array(fps[index].view(np.int64)), pa.array(home)], names=["leaf", "fp", "home"])

    def search(shard: pa.Table) -> pa.Table:
        tree = int(np.searchsorted(first, shard.column("leaf")[0].as_py(), side="right")) - 1
        fps = shard.column("fp").to_numpy()
        order = np.argsort(fps)
        fps = fps[order]
        root = search_shard(fps.view(np.uint64), shard.column("home").to_numpy()[order], masks[tree], most // BLOCKS, most).parent
        some = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": fps[some], "b": fps[root[some]]})

    return nodes.select("fp").mapInArrow(place, "leaf int, fp long, home boolean").groupBy("leaf").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id of all documents reachable over links of at
    most `most` bits). Rows of a null id stay, and give no component its name."""
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, most, leaf))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`, four-word shingles, links at four or fewer differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """One row of each group of documents with Jaccard similarity 4/5 or more, by SimHash with every link confirmed, and for what
    is too far apart for that by a prefix filter (scoreloom/llm/jaccard.py)."""
    from scoreloom.llm import jaccard

    return jaccard.deduplicate(docs, shingle, text_col)
