"""Near duplicates by the Jaccard similarity of their word shingles, all links found and confirmed.

SimHash goes first: each distinct set has a fingerprint, fingerprints within RADIUS bits are linked through the vantage-point trees of
simhash.py, and these links are confirmed on the whole sets. Sets of similarity 4/5 are often farther apart than any radius that
trees can prune by, so what SimHash has left unlinked is searched by a prefix filter.

Prefix filter: with all shingles in one order, two sets of similarity 4/5 or more share one of
their first n - ceil(4n/5) + 1 shingles, n the size of either set. The order is by count in a bounded sample,
then by hash: common shingles come last, which only makes lists short; any order finds the same links.
Candidates share such a shingle; links are those whose whole sets pass. The members of a shingle's list are
never gathered: lists are described by counts and sums, and each is first linked as a star, from its center to the members of other
classes than the center's. In lists that
then still reach over several components, members are compared in pairs of blocks of bounded
size, first by sketches. Blocks in which these leave few pairs name them, and each pair is compared once,
however many lists it shares; in the others whole sets are compared, giving no pairs but a spanning forest of their links.

A sketch holds, for each of its bits, whether an odd number of the set's hashes fall there. Two
sketches differ in at most as many bits as their sets have unshared members, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import simhash
from scoreloom.llm.arrowtext import slices
from scoreloom.llm.components import Forest, components
from scoreloom.llm.scratch import discard, small_side, stored, unused
from scoreloom.llm.simhash import shingle_hashes

#: Differing bits up to which fingerprints are linked: the most that leave one bit for the nearest of three blocks.
RADIUS = 5
#: Documents whose shingles are counted for the order, and most counts kept.
SAMPLE, COMMON = 8_000, 200_000
#: Hashes of a block, at about which members of a list are parted, for sets and for sketches.
BLOCK, SKETCH_BLOCK = 100_000, 4_000_000
#: Members of a block of sketches, at about which they are parted too.
SKETCHES = 2000
#: Shingles of two blocks counted at once.
COLUMNS = 8192
#: Pairs for each member up to which two blocks name them; beyond that their sets are compared block by block.
PAIRS = 4


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending; bounds (m + 1); a digest of each set."""
    each, count = shingle_hashes(texts, shingle)
    row = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((each, row))
    each, row = each[order], row[order]
    new = np.ones(len(each), bool)
    new[1:] = (each[1:] != each[:-1]) | (row[1:] != row[:-1])
    each, row = each[new], row[new]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts))))).astype(np.int64)
    data = memoryview(each.astype("<u8")).cast("B") if len(each) else b""
    digest = np.array([xxhash.xxh64_intdigest(data[8 * a : 8 * b], 42) for a, b in zip(bounds, bounds[1:])], np.uint64)
    return each, bounds, digest


def _mapped(docs: DataFrame, shingle: int, schema: str, make) -> DataFrame:
    """`make(rows, hashes, bounds, digests)` over all (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                yield pa.record_batch(make(b.column("doc_id"), *shingle_sets(b.column("text"), shingle)))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _summaries(docs: DataFrame, shingle: int, common: np.ndarray, weight: np.ndarray) -> DataFrame:
    """doc_id, sig, fp (fingerprint of the set), n (its size), first (the first of its shingles by the order; null where the
    same task has given them for an equal set)."""
    sent = docs.sparkSession.sparkContext.broadcast((common, weight))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, weight), given = sent.value, set()
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                each, bounds, digest = shingle_sets(b.column("text"), shingle)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                w = np.zeros(len(each), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, each), len(common) - 1)
                    w = np.where(common[at] == each, weight[at], 0)
                new = np.fromiter((not (d in given or given.add(d)) for d in digest.tolist()), bool, len(digest))
                order = np.lexsort((each, w, row))
                place = np.arange(len(each)) - bounds[row]
                keep = np.where(new, n - -(-4 * n // 5) + 1, 0)
                keep[n == 0] = 0
                toks = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(keep))).astype(np.int32)), pa.array(each[order][place < keep[row]].view(np.int64)))
                yield pa.record_batch([b.column("doc_id"), pa.array(digest.view(np.int64)), pa.array(simhash.majority_bits(each, n).view(np.int64)), pa.array(n.astype(np.int32)), pc.if_else(pa.array(new), toks, pa.scalar(None, toks.type))], names=["doc_id", "sig", "fp", "n", "first"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sig long, fp long, n int, first array<long>")


def sketches(each: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A sketch of each set: about as many bits as it has hashes, a power of two, 64 at least."""
    n = np.diff(bounds)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(bits)))
    at = np.repeat(base[:-1], n) + (each & (np.repeat(bits, n) - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little")
    return [data[x // 8 : y // 8].tobytes() for x, y in zip(base, base[1:])]


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """sig, sketch, hashes."""
    def make(ids, each, bounds, digest):
        return {"sig": pa.array(digest.view(np.int64)), "sketch": pa.array(sketches(each, bounds), pa.binary()), "hashes": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(each.view(np.int64)))}

    return _mapped(docs, shingle, "sig long, sketch binary, hashes array<long>", make)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words brought to fewer, by the sum without carry of their parts."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, words), axis=1)


def _differ(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Differing bits of pairs of sketches; the longer one of a pair is folded."""
    out, size = np.zeros(len(x), np.int64), np.array([(len(a), len(b)) for a, b in zip(x, y)]).reshape(-1, 2)
    for p, q in np.unique(size, axis=0).tolist():
        some = np.flatnonzero((size == (p, q)).all(1))
        a, b = (np.frombuffer(b"".join(s[k] for k in some), "<u8").reshape(len(some), -1) for s in (x, y))
        w = min(p, q) // 8
        out[some] = np.bitwise_count(_folded(a, w) ^ _folded(b, w)).sum(1)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets have a similarity of 4/5 or more. Sketches go first, so that few sets are moved."""
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                t = batch.slice(lo, 1000)
                d = _differ(t.column("xa").to_pylist(), t.column("xb").to_pylist())
                yield t.select(["a", "b"]).filter(pa.array(9 * d <= t.column("na").to_numpy() + t.column("nb").to_numpy()))

    short = sets.select("sig", "sketch", F.size("hashes").cast("long").alias("n"))
    a, b = (short.select(F.col("sig").alias(c), F.col("sketch").alias(f"x{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    return _alike(pairs.join(a, "a").join(b, "b").select("a", "b", "xa", "xb", "na", "nb").mapInArrow(possible, "a long, b long"), sets)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole sets have a similarity of 4/5 or more."""
    pairs = stored(pairs, "possible")
    # one table for both sides, so that Spark shuffles the sets once
    asked = small_side(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct(), "asked")
    some = sets.join(asked, "sig", "left_semi")
    a, b = (some.select(F.col("sig").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")


def _fits(n: str, m: str) -> Column:
    """Whether the sizes of two sets allow 4/5."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def block_links(a: list[np.ndarray], b: list[np.ndarray], root_a: np.ndarray, root_b: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of a spanning forest of all links of similarity 4/5 between sets of a and b (sorted
    hashes), between roots that are not linked yet."""
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    shared = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for flat, n in ((flat_a, na), (flat_b, nb)):
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        column, row = at[hit], np.repeat(np.arange(len(n)), n)[hit]
        order = np.argsort(column, kind="stable")
        sides.append((column[order], row[order], len(n)))
    for lo in range(0, len(both), COLUMNS):
        dense = []
        for column, row, n in sides:
            x, y = np.searchsorted(column, [lo, lo + COLUMNS])
            d = np.zeros((n, min(COLUMNS, len(both) - lo)), np.float32)
            d[row[x:y], column[x:y] - lo] = 1
            dense.append(d)
        shared += dense[0] @ dense[1].T
    i, j = np.nonzero((9 * shared >= 4 * (na[:, None] + nb[None, :])) & (root_a[:, None] != root_b[None, :]))
    names, coded = np.unique(np.concatenate((root_a, root_b)), return_inverse=True)
    forest, kept = Forest(len(names)), []
    ra, rb = coded[: len(a)], coded[len(a) :]
    while len(i):  # the first pair of each pair of trees, as long as trees meet
        x, y = forest.parent[ra[i]], forest.parent[rb[j]]
        new = x != y
        i, j, x, y = i[new], j[new], x[new], y[new]
        if len(i):
            first = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_index=True)[1]
            kept.append(np.stack((i[first], j[first]), 1))
            forest.add(x[first], y[first])
    return np.concatenate(kept) if kept else np.empty((0, 2), np.int64)


def with_partner(block: np.ndarray, other: np.ndarray, n: np.ndarray, root: np.ndarray, sketch: list[bytes], most: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Which members of two blocks can have, in the other one, a partner of another root; and these pairs
    (i, j), or None if they are more than `most`."""
    out, size = np.zeros(len(n), bool), np.fromiter(map(len, sketch), np.int64, len(sketch))
    pairs, found = [], 0
    words = {}
    for k in np.unique(size).tolist():
        words[k] = {side: np.flatnonzero((size == k) & side_of) for side, side_of in ((0, block), (1, other))}
    packed = {k: np.frombuffer(b"".join(sketch[i] for i in np.flatnonzero(size == k)), "<u8").reshape(-1, k // 8) for k in words}
    place = np.zeros(len(n), np.int64)
    for k in words:
        some = np.flatnonzero(size == k)
        place[some] = np.arange(len(some))
    for p in words:
        for q in (p // 2, p, 2 * p):  # sizes within 4/5 lie in neighbouring classes
            x, y = words[p][0], words.get(q, {1: ()})[1]
            if not len(x) or not len(y):
                continue
            w = min(p, q) // 8
            a, b = _folded(packed[p][place[x]], w), _folded(packed[q][place[y]], w)
            step = max(1, (1 << 21) // (len(y) * w))
            for lo in range(0, len(x), step):
                i = x[lo : lo + step]
                d = np.bitwise_count(a[lo : lo + step, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
                ok = (9 * d <= n[i][:, None] + n[y][None, :]) & (root[i][:, None] != root[y][None, :])
                out[i] |= ok.any(1)
                out[y] |= ok.any(0)
                found += int(ok.sum())
                if found <= most:
                    k, m = np.nonzero(ok)
                    pairs.append(np.stack((i[k], y[m]), 1))
    if found > most:
        return out, None
    return out, np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)


def _dealt(members: DataFrame, parts: Column) -> DataFrame:
    """Members of each list dealt to blocks, each block sent to all pairs of blocks (x <= y) that it is in."""
    told = members.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("c")).where("lo <> hi")
    open_ = members.join(told.select("list", parts.cast("int").alias("parts")), "list").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    return open_.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other", "parts")


def _in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b between different roots within the lists of (list, sig, n, root)."""
    per_member = PAIRS

    def probe(t: pa.Table) -> pa.Table:
        block, n, root, sig = (t[c].to_numpy() for c in ("block", "n", "root", "sig"))
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        hit, pairs = with_partner(block == x, block == y, n.astype(np.int64), root, t["sketch"].to_pylist(), per_member * len(n))
        if pairs is None:  # too many to name
            few = t.select(["list", "sig"]).filter(pa.array(hit))
            return few.append_column("mate", pa.nulls(len(few), pa.int64()))
        a, b = np.sort(sig[pairs], axis=1).T
        return pa.table({"list": pa.array(np.full(len(a), t["list"][0].as_py())), "sig": a, "mate": b})

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sig, root, block = (t[c].to_numpy() for c in ("sig", "root", "block"))
        lists = t["hashes"].chunk(0)
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        some = [np.flatnonzero(block == t[c][0].as_py()) for c in "xy"]
        each = [[flat[bounds[k] : bounds[k + 1]] for k in s] for s in some]
        found = block_links(*each, root[some[0]], root[some[1]]) if len(some[0]) and len(some[1]) else np.empty((0, 2), np.int64)
        return pa.table({"a": sig[some[0]][found[:, 0]], "b": sig[some[1]][found[:, 1]]})

    wide = _dealt(members, F.greatest(F.ceil(F.col("total") / SKETCH_BLOCK), F.ceil(F.col("c") / SKETCHES)))
    probed = stored(wide.join(sets.select("sig", "sketch"), "sig").groupBy("list", "x", "y").applyInArrow(probe, "list long, sig long, mate long"), "probed")
    # two texts share many lists: a pair is named in each of them and compared once
    # each kind of links is stored for itself: one plan with both has the driver run a dozen stages at once
    named = stored(_alike(probed.where("mate IS NOT NULL").select(F.col("sig").alias("a"), F.col("mate").alias("b")).distinct(), sets), "named")
    dense = small_side(probed.where("mate IS NULL").select("list", "sig").distinct(), "dense")
    left = stored(members.join(dense, ["list", "sig"], "left_semi"), "left")
    asked = small_side(left.select("sig").distinct(), "asked")
    dealt = _dealt(left, F.ceil(F.col("total") / BLOCK)).join(sets.join(asked, "sig", "left_semi").select("sig", "hashes"), "sig")
    return named.unionByName(stored(dealt.groupBy("list", "x", "y").applyInArrow(compare, "a long, b long"), "compared"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (sig, fp) that SimHash links: all sets of one fingerprint with the first of them, and these along a
    forest of the fingerprints within RADIUS bits."""
    prints = stored(nodes.groupBy("fp").agg(F.min("sig").alias("sig")), "prints")
    same = nodes.join(prints.select("fp", F.col("sig").alias("a")), "fp").where("sig <> a").select("a", F.col("sig").alias("b"))
    a, b = (prints.select(F.col("fp").alias(f"f{c}"), F.col("sig").alias(c)) for c in "ab")
    near = simhash.links(prints, RADIUS).select(F.col("a").alias("fa"), F.col("b").alias("fb")).distinct()
    return same.unionByName(near.join(a, "fa").join(b, "fb").select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, text) to doc_id, component_id: the smallest id of all documents reachable over pairs
    of Jaccard similarity 4/5 or more. Texts without words are alike."""
    digests, named, least = _grouped(docs, shingle)
    return digests.join(named.select("sig", "root").join(least, "root").select("sig", "component_id"), "sig").select("doc_id", "component_id")


def _grouped(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, text) the sets (doc_id, sig), their components (sig, least, root), and what these are called (root, component_id)."""
    total = max(1, docs.count())
    some = docs if total <= SAMPLE else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < SAMPLE)
    seen = _sets(some, shingle).select("hashes").select(F.explode("hashes").alias("tok")).groupBy("tok").count().where("count > 1").orderBy(F.desc("count"), "tok").limit(COMMON).toPandas()
    common, weight = seen["tok"].to_numpy(np.int64).view(np.uint64), seen["count"].to_numpy(np.int64)
    order = np.argsort(common)

    told = stored(_summaries(docs, shingle, common[order], weight[order]), "summaries")
    digests = told.select("doc_id", "sig")
    nodes = stored(told.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "nodes")

    prefixes = told.where("first IS NOT NULL").select(F.explode("first").alias("tok"), "sig", "n")
    shared = prefixes.groupBy("tok").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").select("tok")
    prefixes = stored(prefixes.join(small_side(shared, "shared"), "tok").distinct(), "prefixes")
    # lists with the same members are one: told by their number and two sums of hashes
    sums = [F.count(F.lit(1)).alias("c"), F.min("sig").alias("center"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("s2")]
    lists = prefixes.groupBy("tok").agg(*sums).groupBy("c", "center", "s1", "s2").agg(F.min("tok").alias("tok"))
    members = stored(prefixes.join(small_side(lists.select("tok", "center"), "lists"), "tok").select(F.col("tok").alias("list"), "center", "sig", "n"), "members")

    discard(prefixes)
    first = members.select("sig").distinct().join(nodes.select("sig", "least"), "sig").select(F.col("least").alias("doc_id"))
    sets = stored(_sets(docs.join(small_side(first, "first"), "doc_id", "left_semi"), shingle), "sets")

    alike = stored(_confirmed(stored(_by_fingerprint(nodes.select("sig", "fp")), "near"), sets), "alike")
    classes = small_side(components(alike), "classes")
    rooted = members.join(classes, members.sig == classes.node, "left").select("list", "center", "sig", "n", F.coalesce("root", "sig").alias("root"))

    centers = rooted.where("sig = center").select("list", F.col("n").alias("cn"), F.col("root").alias("croot"))
    star = rooted.join(centers, "list").where((F.col("root") != F.col("croot")) & _fits("n", "cn")).select(F.col("center").alias("a"), F.col("sig").alias("b")).distinct()
    links = stored(alike.unionByName(_confirmed(star, sets)), "links")
    roots = stored(components(links), "roots")

    spread = stored(members.join(roots, members.sig == roots.node, "left").select("list", "sig", "n", F.coalesce("root", "sig").alias("root")), "spread")
    roots = components(links.unionByName(_in_blocks(spread, sets)))

    for table in (members, sets, links, spread):
        discard(table)
    named = nodes.join(roots, nodes.sig == roots.node, "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    return digests, named, named.groupBy("root").agg(F.min("least").alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: the row with the smallest number in the input.

    Rows are numbered and stored once, so that numbers do not change between the steps. Rows with null or
    empty texts are near duplicates of each other; other columns are kept, whatever their names."""
    row = unused(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    _, _, least = _grouped(rows.select(F.col(row).alias("doc_id"), F.col(text_col).alias("text")), shingle)
    first = least.select(F.col("component_id").alias(row))  # numbers are unique: the row that a component is called after is its first
    return rows.join(first, row, "left_semi").drop(row).select(*docs.columns)
