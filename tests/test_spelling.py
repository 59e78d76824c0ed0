"""Spelling in context against all spellings of small sets, and by cases worked by hand."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import keys as K
from scoreloom.operators import spelling as P

SCHEMA = "score_id long, row_id long, type string, pitch double, onset double, release double"


def notes(spark, pitches, score=1):
    return spark.createDataFrame([(score, i, "note", None if p is None else float(p), float(i), i + 1.0) for i, p in enumerate(pitches)], SCHEMA)


def spelled(df, chunk=32):
    return [r.spelling for r in P.spell_in_context(df.repartition(3), chunk).orderBy("score_id", "row_id").collect()]


@pytest.mark.parametrize("pitches, want", [
    ([64, 68, 71], ["E", "G#", "B"]), ([60, 63, 68], ["C", "Eb", "Ab"]), ([66, 70, 73], ["F#", "A#", "C#"]), ([60, 60, 60], ["C"] * 3),
    ([61, 65, 68], ["Db", "F", "Ab"]), (range(60, 72), ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]), ([60, 64, 68], ["C", "E", "Ab"]), ([None, 62], [None, "D"]),
])
def test_one_stretch(spark, pitches, want):
    assert spelled(notes(spark, pitches)) == want


def test_stretches_are_spelled_one_by_one(spark):
    two = notes(spark, [64, 68, 71, 60, 63, 68])
    assert spelled(two, 3) == ["E", "G#", "B", "C", "Eb", "Ab"]
    bar = spark.createDataFrame([(1, 9, "bar", None, -1.0, 4.0)], SCHEMA)
    # the bar is the first row, so the third note opens the second stretch
    assert spelled(two.unionByName(bar), 3)[:2] == ["E", "G#"] and spelled(two.unionByName(bar), 3)[-1] is None
    other = notes(spark, [66, 70, 73], 2)
    assert spelled(two.unionByName(other), 3)[6:] == ["F#", "A#", "C#"]
    with pytest.raises(ValueError):
        P.spell_in_context(two, 0)


def test_closest_of_all_spellings(spark):
    rng = np.random.default_rng(4)
    sets = [sorted(rng.choice(12, rng.integers(1, 5), replace=False).tolist()) for _ in range(40)]
    df = spark.createDataFrame([(k, i, "note", 60.0 + p, float(i), i + 1.0) for k, s in enumerate(sets) for i, p in enumerate(s)], SCHEMA)
    got = P.spell_in_context(df).withColumn("at", K.spelling_to_line_of_fifths(F.col("spelling"))).orderBy("score_id", "row_id").collect()
    cost = lambda xs: (max(xs) - min(xs), abs(sum(x - 3 for x in xs)))
    for k, s in enumerate(sets):
        mine = [int(r["at"]) for r in got if r.score_id == k]
        assert [(x - 1) * 7 % 12 for x in mine] == s
        places = [[x for x in range(-17, 24) if (x - 1) * 7 % 12 == p] for p in s]
        assert cost(mine) == min(map(cost, itertools.product(*places)))


def test_kern_names(spark):
    cases = [("C", 60, "c"), ("Bb", 70, "b-"), ("Bb", 58, "B-"), ("B#", 60, "B#"), ("Cb", 59, "c-"), ("F##", 91, "fff##"), ("A", 21, "AAAA"), ("Ebb", 62, "e--"), ("na", 60, None), (None, 60, None), ("C", None, None)]
    df = spark.createDataFrame([(1, i, "note", None if p is None else float(p), float(i), i + 1.0, s) for i, (s, p, _) in enumerate(cases)], SCHEMA + ", spelling string")
    assert [r.humdrum_spelling for r in P.spell_df(df).orderBy("row_id").collect()] == [w for *_, w in cases]


def test_names_of_tonal_pitch_classes(spark):
    got = spark.range(1).select(*(K.tpc_to_name(F.lit(n), m).alias(f"n{i}") for i, (n, m) in enumerate([(0, False), (-1, False), (-1, True), (-8, True), (6, False), (13, False), (-2, False)]))).first()
    assert list(got) == ["C", "F", "f", "fb", "F#", "F##", "Bb"]


def test_rows_and_columns_stay(spark):
    bar = spark.createDataFrame([(1, 9, "bar", None, 0.0, 4.0)], SCHEMA)
    df = notes(spark, [58, 62, 65, None, 58, 58]).unionByName(bar).unionByName(notes(spark, [58]))  # a repeated row
    for c in ("seq", "chunk", "bits", "first", "BITS_", "spelling_"):
        df = df.withColumn(c, F.lit("clash"))
    got = P.spell_df(df)
    rows = got.orderBy("row_id").collect()
    assert got.columns == [*df.columns, "humdrum_spelling"] and [r.humdrum_spelling for r in rows] == ["B-", "B-", "d", "f", None, "B-", "B-", ""]
    assert {r.bits for r in rows} == {"clash"} and P.spell_df(df.limit(0)).count() == 0
