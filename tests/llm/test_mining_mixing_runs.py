"""Hard negatives, mixing and runs against brute-force versions on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import hard_negatives, mixing, runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- hard negatives


def plain_mining(rows, anchors):
    """rows and anchors: (id, label, ints); all windows by sorting all rows."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in anchors:
        scored = sorted(((-dot(v, w), i, m) for i, m, w in rows if i != a))
        for p_score, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 80 * -p_score <= 100 * -s[0] <= 100 * -p_score][:5]
            out += [(a, p, r, i, -p_score, -s) for r, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8))
    rows = [(int(i), [float(x) for x in middle[i % 12] + 0.6 * rng.normal(size=8)], int(i % 3)) for i in range(900)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(300)]  # one vector many times
    rows += [(None, [1.0] * 8, 1), (1400, None, 1), (1401, [1.0] * 8, None), (1402, [1.0, None], 1), (1403, [float("nan")] * 8, 1), (1404, [float("inf")], 1), (1405, [], 1), (1406, [0.5, 0.5], 2), (1407, [0.1] * 11, 0)]
    rows += [rows[40], rows[40], (40, [2.0] * 8, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("clash")).withColumn("shard", F.lit("clash")).repartition(5)


@pytest.mark.parametrize("codes, shard_rows, block, batch", [(32, 8192, 16_384, 1024), (4, 100, 7, 16), (3, 40, 1000, 1)])
def test_hard_negatives(spark, vectors, monkeypatch, codes, shard_rows, block, batch):
    for name, value in (("CODES", codes), ("SHARD_ROWS", shard_rows), ("BLOCK", block), ("BATCH", batch), ("SAMPLE", 200)):
        monkeypatch.setattr(hard_negatives, name, value)
    table = hard_negatives.labelled_vectors(vectors)
    rows = [(r.vec_id, r.label, r.vec) for r in table.collect()]
    assert {r[0] for r in rows} & {1400, 1401, 1402, 1403, 1404} == set() and {1405, 1406, 1407} <= {r[0] for r in rows}
    assert all(lab == (i % 3 + 1 if i % 7 == 0 else i % 3) for i, lab, _ in rows if i < 900 and i != 40)
    anchors = [r for r in rows if r[0] % 20 == 0 or r[0] > 1400]
    least = {}
    for i, lab, v in anchors:
        least[i] = min(least.get(i, (lab, v)), (lab, v))
    got = hard_negatives.mine(table, table.where("vec_id % 20 = 0 or vec_id > 1400"))
    assert sorted(map(tuple, got.collect())) == plain_mining(rows, [(i, *x) for i, x in least.items()])


def test_hard_negatives_without_rows(spark, vectors):
    table = hard_negatives.labelled_vectors(vectors)
    assert hard_negatives.mine(table.limit(0), table.limit(0)).count() == 0
    assert hard_negatives.mine(table, table.where("vec_id < 0")).count() == 0
    alone = table.where("vec_id = 7")
    assert hard_negatives.mine(alone, alone).count() == 0


def test_cells_are_visited_by_falling_bounds(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BATCH", 1)
    rng = np.random.default_rng(5)
    import pyarrow as pa

    x = np.rint(rng.normal(size=(400, 6)) * 100)
    books = hard_negatives.fit(x[:100], 6)
    word, far = books.nearest(x)
    table = pa.table({"vec_id": np.arange(400), "label": np.zeros(400, np.int64), "vec": pa.array(x.tolist()), "cell": word[0] * len(books.codes[1]) + word[1], "d1": far[0], "d2": far[1]})
    shard = hard_negatives.Shard(books, table)
    for q in x[:20]:
        last, seen = np.inf, []
        for bound, rows in shard.visit(q):
            assert (shard.x[rows] @ q <= last).all() and bound <= last
            last = bound
            seen += rows.tolist()
        assert sorted(seen) == list(range(400))


# --- mixing


def plain_targets(sizes):
    """sizes by source: share by weight, caps filled one round after the other."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        got = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if got[s] > 2 * sizes[s]}
        if not over:
            return {s: float(2 * sizes[s] if s in full else got[s]) for s in order}
        full |= over


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 3, 10, 50, 400]), rng.choice(["a", "b", "b", "b", "b", "é", "Z", "z", None])) for i in range(1500)]
    rows += [(5000, "same words here", "b")] * 2500 + [(None, None, None), (None, "x y", "tiny"), (None, "x y", "tiny"), (5001, "long " * 60_000, "b"), (5002, None, "a"), (5003, "", "empty only")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("u", F.lit("clash")).repartition(6)


@pytest.mark.parametrize("fan", [128, 6])
def test_mixing(spark, mixed_docs, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    got = mixing.mix(mixed_docs).collect()
    docs = mixed_docs.select("doc_id", "text", "source").collect()
    count = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
    want = plain_targets(sizes)
    key = lambda t: (str(t[0]), *t[1:])
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=key) == sorted(((r.doc_id, count(r.text), sizes[r.source]) for r in docs), key=key)
    by_doc = {(r.doc_id, count(r.text)): r.source for r in docs}
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        source = by_doc[r.doc_id, r.size]
        assert r.target == pytest.approx(want[source], rel=1e-9) and r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = mixing.mix(mixed_docs.repartition(2)).collect()
    assert sorted(map(tuple, again), key=key) == sorted(map(tuple, got), key=key)
    other = mixing.mix(mixed_docs, seed=13).collect()
    assert sorted(map(tuple, other), key=key) != sorted(map(tuple, got), key=key)


def test_mixing_is_fair(spark):
    """Over many seeds each document of a source gets its expected number of copies."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), s) for i in range(40) for s in ("p", "q", "r")], "doc_id long, text string, source string")
    total, n = {}, 6
    for seed in range(n):
        for r in mixing.mix(docs, seed=seed).collect():
            rate = r.target / r.source_size
            assert r.copies in (int(rate), int(rate) + 1) or r.copies == rate
            total.setdefault((r.source_size, r.target), []).append((r.copies - rate) * r.size)
    for (size, _), gone in total.items():
        assert abs(sum(gone)) <= 4 * n  # each run misses by half a document of 7 words at most


def test_mixing_without_rows(spark, mixed_docs):
    assert mixing.mix(mixed_docs.limit(0)).count() == 0
    empty = mixing.mix(mixed_docs.where("text is null or text = ''")).collect()
    assert empty and all(r.taken == 0 and r.target == 0 for r in empty)


# --- runs


def plain_runs(w):
    """Every period tried at every place, then checked to be the least."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q) and not any(w[s : s + length - p] == w[s + p : s + length] for p in range(1, q)):
                out.append((s, length, q))
            i = max(i, s + 1)
    return sorted(out)


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 2, 3, 4]), rng.randint(0, 60)
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
            for i in range(a, rng.randint(a, n)):
                w[i] = w[a + (i - a) % p]
        assert runs.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_runs_of_long_texts():
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    blocks = np.concatenate([[0] * 8 + [i + 1] for i in range(4000)])
    assert runs.find_runs(blocks) == [(9 * i, 8, 1) for i in range(4000)]
    passage = np.concatenate([[1, 2, 3, 4, 5, 6, 7, 8 + i] for i in range(4000)])  # repeated, yet no run
    assert runs.find_runs(passage) == []
    assert runs.find_runs(np.tile(np.arange(5000), 4)) == [(0, 20_000, 5000)]


def test_runs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, "la " * 12), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "no break " * 7), (9004, "no break " * 7), (9005, "word " * 20_000), (9006, "\U0001f600 é " * 30), (9007, "a b a b a b a b x y x y x y x y")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("start", F.lit("clash")).repartition(4)
    want = []
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w) if n < 5000 else [(0, n, 1)]
        drop = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.append((doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()))
    got = runs.runs_of(table, plant=True)
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got.drop("runs").collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] for r in want) > 10
    assert runs.runs_of(table.limit(0)).count() == 0
    assert [tuple(r) for r in runs.runs_of(table.where("doc_id = 9007")).first().runs] == [(0, 8, 2), (8, 8, 2)]
