"""Periodic runs of words by enumeration of maximal pairs.

A maximal pair is two places i < j of a text from which the same l words follow, l being as
large as can be, with different words before them. A stretch of least period q that no word
extends is such a pair with j - i = q and l = its length less q; so maximal pairs with
l >= 3 (j - i) are exactly the stretches that hold their period four times, and need not be
extended. Pairs at multiples of the least period give the same stretch; the nearest counts.

Pairs are read off the tree of LCP intervals, from the deepest up. An interval keeps its places
in order, as a list cut into stretches of one left word (the class lists); when a child joins
its parent, each place of the smaller list looks for places of another class within a third
of the depth. Occurrences of a word sequence so near each other lie at equal distances and all
but the first have the same left word, so a look finds at most one partner to the left, and to
the right partners only. Depths below five words cannot give a run and are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.arrowtext import slices

#: A run has at least this many words, and its period this many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Least depth of an interval that can hold the pair of a run.
DEPTH = LEAST_WORDS - 1


def _repeating(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next DEPTH words may stand elsewhere in the text too (by a 64-bit hash), and
    how far the nearest such place is."""
    m = len(codes) - DEPTH + 1
    if m < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(DEPTH):
        h = (h + codes[k : k + m].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    gap = np.where(h[order[1:]] == h[order[:-1]], np.diff(order), m)
    near = np.empty(m, np.int64)
    near[order] = np.minimum(np.append(gap, m), np.insert(gap, 0, m))
    some = np.flatnonzero(near < m)
    return some, near[some]


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Places in the order of the suffixes that begin there, by doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:]
        order = np.argsort(key, kind="stable")
        up = np.concatenate(([1], (key[order[1:]] != key[order[:-1]]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(up)
        step *= 2
        if up.all() or step >= n:
            return order


def common_prefixes(codes: list[int], order: list[int]) -> list[int]:
    """Words that the suffix at each rank shares with the one before it."""
    n = len(codes)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, l = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r == 0:
            l = 0
            continue
        j = order[r - 1]
        top = n - max(i, j)
        while l < top and codes[i + l] == codes[j + l]:
            l += 1
        out[r] = l
        l = l - 1 if l else 0
    return out


class _Places:
    """Places of an LCP interval in order; `ends` are those whose successor has another left word."""

    __slots__ = ("all", "ends")

    def __init__(self, place: int):
        self.all, self.ends = [place], []

    def add(self, x: int, left: list[int]) -> None:
        at = bisect_left(self.all, x)
        before, after = (self.all[at - 1] if at else None), (self.all[at] if at < len(self.all) else None)
        if before is not None:
            was, now = after is not None and left[before] != left[after], left[before] != left[x]
            if now and not was:
                insort(self.ends, before)
            elif was and not now:
                del self.ends[bisect_left(self.ends, before)]
        if after is not None and left[x] != left[after]:
            insort(self.ends, x)
        self.all.insert(at, x)

    def partners(self, x: int, reach: int, left: list[int]) -> Iterator[int]:
        """Places of another class than x's, at most `reach` away."""
        at = bisect_left(self.all, x)
        if at and x - self.all[at - 1] <= reach:
            y = self.all[at - 1]
            if left[y] == left[x]:
                e = bisect_left(self.ends, y)
                y = self.ends[e - 1] if e else None
            if y is not None and x - y <= reach:
                yield y
        while at < len(self.all) and self.all[at] - x <= reach and left[self.all[at]] != left[x]:
            yield self.all[at]
            at += 1


def maximal_pairs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, l) of all maximal pairs with i < j, l >= 3 (j - i) and l + j - i >= LEAST_WORDS."""
    words, order = codes.tolist(), suffix_array(codes).tolist()
    lcp = [*common_prefixes(words, order), 0]
    left, out = [-1, *words[:-1]], []
    stack: list[tuple[int, _Places]] = []  # open intervals: depth, places
    for r, place in enumerate(order):
        at, depth = _Places(place), lcp[r + 1]
        while stack and stack[-1][0] > depth:  # intervals that end here close, the deepest first
            closed, places = stack.pop()
            at = _joined(places, at, closed, left, out)
        if depth < DEPTH:
            continue
        if stack and stack[-1][0] == depth:
            at = _joined(stack.pop()[1], at, depth, left, out)
        stack.append((depth, at))
    return out


def _joined(a: _Places, b: _Places, depth: int, left: list[int], out: list[tuple[int, int, int]]) -> _Places:
    """Both lists as one; the pairs between them go to `out`."""
    if len(a.all) < len(b.all):
        a, b = b, a
    reach = depth // (LEAST_TIMES - 1)
    for x in b.all:
        for y in a.partners(x, reach, left):
            if depth + abs(x - y) >= LEAST_WORDS:
                out.append((min(x, y), max(x, y), depth))
    for x in b.all:
        a.add(x, left)
    return a


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    some, near = _repeating(codes)
    found: dict[tuple[int, int], int] = {}
    # a run lies within one stretch of places whose words repeat, no farther off than its period
    cuts = np.flatnonzero(np.diff(some) > 1) + 1
    for part, gaps in zip(np.split(some, cuts), np.split(near, cuts)):
        if not len(part) or LEAST_TIMES * int(gaps.min()) > len(part) + DEPTH - 1:
            continue
        a = max(int(part[0]) - 1, 0)  # with the word before
        for i, j, l in maximal_pairs(codes[a : int(part[-1]) + DEPTH]):
            key = (i + a, l + j - i)
            found[key] = min(j - i, found.get(key, j - i))
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, of one document in ten with a periodic end; a null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = words
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            drop[s + q] += 1
            drop[s + n] -= 1
        kept = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, n, q)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _codes(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli (of the run
    with the greatest exponent; ties: least start, then period), runs_sha256, collapsed_sha256,
    runs (all of them, start, length, period). Each row is worked on by itself and in one pass;
    a document's working memory is in proportion to its words. A null or empty text has no
    words and no runs; repeated rows give repeated results; an empty table none. `plant` gives
    one document in ten a periodic end (see `planted`)."""
    names = ["n_runs", "start", "length", "period", "exponent_milli"]
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in names] + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*fields, T.StructField("runs", T.ArrayType(run))])
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    words = planted(words, doc_id) if plant else words
                    runs = find_runs(_codes(words))
                    rows.append((*_digest(words, runs), [dict(zip(("start", "length", "period"), r)) for r in runs]))
                cols = zip(*rows) if rows else [[]] * len(types)
                yield pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True).drop("runs")
