"""Searches in sorted tables and segments by rows: cases worked by hand, and random ones against a plain walk."""

import random

from pyspark.sql import functions as F

from scoreloom.operators import meter as B
from scoreloom.operators import order
from scoreloom.operators import segments as S

ROOM = [
    (list(range(32)), list(range(32)), [(0, 8), (8, 16), (16, 24), (24, 32)]),
    ([i * 2 for i in range(16)], [i * 2 + 1 for i in range(16)], [(0, 8), (8, 16), (16, 24), (24, 32)]),
    ([0, 3, 7, 14], [2, 3, 6, 12, 13, 17], [(0, 7), (7, 14), (14, 18)]),
    ([0, 1, 14, 15], [2, 3, 17], [(0, 4), (1, 18)]),
    ([0, 1, 14, 15], [16, 17], [(0, 17), (15, 18)]),
    ([14, 15], [0, 1, 16, 17], [(14, 18)]),
]


def plain(onsets, releases, target):
    out, start, end = [], None, releases[0] - 1
    while end < releases[-1]:
        if start is None:
            start = onsets[0]
        else:
            later = [x for x in onsets if x > start]
            if not later:
                break
            start = max([x for x in later if x <= end + 1], default=later[0])
        least = max(start, end) + 1
        room = [x for x in releases if x >= least]
        if not room:
            break
        end = max([x for x in room if x <= start + target - 1], default=room[0])
        out.append((start, end + 1))
    return out


def test_segment_indices(spark):
    rng = random.Random(3)
    cases = [(a, b) for a, b, _ in ROOM]
    for _ in range(40):
        n = rng.randint(3, 60)
        cases.append((sorted({0, *rng.sample(range(n), rng.randint(1, n))}), sorted(rng.sample(range(n), rng.randint(1, n)))))
    table = lambda k: spark.createDataFrame([(s, i) for s, c in enumerate(cases) for i in c[k]], "score_id long, i long")
    for target in (8, 3):
        got = {}
        for r in S.segment_indices(table(0), table(1), target).collect():
            got.setdefault(r.score_id, []).append((r.start, r.stop))
        for s, (a, b) in enumerate(cases):
            assert sorted(got.get(s, [])) == plain(a, b, target), (a, b)
        if target == 8:
            assert [sorted(got[s]) for s in range(len(ROOM))] == [w for _, _, w in ROOM]
    assert S.segment_indices(table(0).limit(0), table(1).limit(0), 8).count() == 0


def test_searches(spark):
    marks = spark.createDataFrame([(0, i) for i in (1, 3, 6)], "score_id long, i long")
    rows = spark.createDataFrame([(0, v, m) for v, m in ((3, 0), (4, 0), (10, 0), (0, 0), (4, 2), (4, 4), (4, 8), (0, 1))], "score_id long, v long, m long")
    got = {(r.v, r.m): (r.plain, r.bounded) for r in S.item_leq(S.item_leq(rows, marks, F.col("v"), "plain"), marks, F.col("v"), "bounded", F.col("m")).collect()}
    assert got == {(3, 0): (3, 3), (4, 0): (3, 3), (10, 0): (6, 6), (0, 0): (None, 1), (4, 2): (3, 3), (4, 4): (3, 6), (4, 8): (3, None), (0, 1): (None, 1)}
    rows = spark.createDataFrame([(0, v, m) for v, m in ((3, 9), (4, 9), (7, 9), (4, 2), (4, 6), (4, 0))], "score_id long, v long, m long")
    got = {(r.v, r.m): (r.plain, r.bounded) for r in S.item_geq(S.item_geq(rows, marks, F.col("v"), "plain"), marks, F.col("v"), "bounded", F.col("m")).collect()}
    assert got == {(3, 9): (3, 3), (4, 9): (6, 6), (7, 9): (None, 6), (4, 2): (6, 1), (4, 6): (6, 6), (4, 0): (6, None)}


def test_segment_df(spark):
    rows = [(0, i, "note", 60.0 + i % 2, float(i // 2), float(i // 2 + 1)) for i in range(16)]
    df = order.sort_df(spark.createDataFrame(rows, "score_id long, row_id long, type string, pitch double, onset double, release double"))
    got = S.segment_df(df, 5)
    assert sorted((r.segment, r.seq) for r in got.collect()) == [((i // 4), i + 1) for i in range(16)] and got.columns == [*df.columns, "segment"]


def test_snap_to_musical(spark):
    smooth = [d for d in range(1, 97) if not [p for p in range(11, d + 1) if d % p == 0 and all(p % q for q in range(2, p))]]
    cases = [0.1, 0.3333, 1.2919999999999732, 0.0, -0.3333, 0.5, 2.5, 7 / 48 + 1e-6, 1e6 + 1 / 3, 3 / 11, *(k / 997 for k in range(1, 60))]
    want = [0.1, 1 / 3, 31 / 24] + [min((abs(round(v * d) / d - v), d, round(v * d) / d) for d in smooth)[2] for v in cases[3:]]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(cases)] + [(1000, None, float("inf")), (1001, float("nan"), 1.0)], "row_id long, onset double, release double")
    got = B.snap_times(df.repartition(2)).orderBy("row_id").collect()
    assert [r.onset for r in got[:-2]] == want and got[0].release is None and got[-2].onset is None and got[-2].release == float("inf") and got[-1].onset != got[-1].onset


def test_segment_df_broadcasts_no_table_of_states(spark):
    """The tables of marks, states and cuts grow with the scores, and are small on disk long before they are few."""
    rows = [(s, 16 * s + i, "note", 60.0 + i % 2, float(i // 2), float(i // 2 + 1)) for s in range(5) for i in range(16)]
    df = order.sort_df(spark.createDataFrame(rows, "score_id long, row_id long, type string, pitch double, onset double, release double"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert S.segment_df(df, 5).count() == len(rows)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [ran.apply(k).physicalPlanDescription() for k in range(before, ran.size())]
    assert len(plans) > 4 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
