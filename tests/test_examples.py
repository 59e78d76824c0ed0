"""Small scores worked by hand: doubles, rests, pickups, annotations, quantizing, sounding basses, parts."""

import pytest

from scoreloom.operators import chords as C
from scoreloom.operators import features as E
from scoreloom.operators import joins as J
from scoreloom.operators import merges as M
from scoreloom.operators import meter as B
from scoreloom.operators import order as O
from scoreloom.operators import stats as A

EVENTS = "score_id long, row_id long, type string, track double, channel double, pitch double, onset double, release double, other string"
FOUR = '{"numerator": 4, "denominator": 4}'


@pytest.fixture(scope="module")
def doubled(spark):
    rows = [(1, 0, "time_signature", 0.0, None, None, 0.0, None, FOUR), (1, 1, "bar", None, None, None, 0.0, None, None), (1, 2, "note", 1.0, 0.0, 50.0, 0.0, 1.0, None), (1, 3, "note", 1.0, 0.0, 50.0, 0.0, 0.99, None), (1, 4, "note", 2.0, 0.0, 50.0, 0.0, 1.0, None), (1, 5, "bar", None, None, None, 3.0, None, None)]
    return spark.createDataFrame(rows, EVENTS)


def test_doubles_stay_within_an_instrument(doubled):
    ids = lambda df: sorted((r.row_id, r.n_doubled) for r in df.collect())
    assert ids(M.dedouble(doubled)) == [(0, 1), (1, 1), (2, 2), (4, 1), (5, 1)]
    assert ids(M.dedouble(doubled, quantize=False)) == [(k, 1) for k in range(6)]
    assert ids(M.dedouble(doubled, instruments=())) == [(0, 1), (1, 1), (2, 3), (5, 1)]
    assert ids(M.dedouble(doubled, release_ticks=4)) == [(0, 1), (1, 1), (2, 2), (4, 1), (5, 1)]


def test_bars_fill_no_rest(spark):
    rows = [(1, i, t, p, o, r) for i, (t, p, o, r) in enumerate([("bar", None, 0.0, 4.0), ("note", 60.0, 0.0, 0.5), ("note", 60.0, 2.0, 3.0), ("bar", None, 4.0, 8.0), ("note", 60.0, 4.75, 5.0)])]
    df = spark.createDataFrame(rows, "score_id long, row_id long, type string, pitch double, onset double, release double")
    assert sorted((r.onset, r.release) for r in M.return_rests(df).collect()) == [(0.5, 2.0), (3.0, 4.75)]
    assert M.return_rests(df.drop("type").where("pitch is not null")).count() == 2


def test_pickups_and_their_bars(spark):
    two = '{"numerator": 4, "denominator": 2}'
    scores = [
        ([("time_signature", 0.0, None, FOUR), ("bar", 0.0, 4.0, None), ("bar", 4.0, 8.0, None)], False),
        ([("time_signature", 0.0, None, FOUR), ("bar", 0.0, 2.0, None), ("bar", 2.0, 6.0, None)], True),
        ([("bar", 0.0, 4.0, None), ("bar", 4.0, 8.0, None)], False),
        ([("bar", 0.0, 4.0, None), ("bar", 4.0, 12.0, None)], True),
        ([("bar", 0.0, 4.0, None)], False),
        ([("time_signature", 0.0, None, FOUR)], None),
        ([("bar", 0.0, 2.0, None), ("bar", 2.0, 4.0, None)], False),  # short bars alone are no pickup
        ([("time_signature", 4.0, None, FOUR), ("bar", 0.0, 2.0, None), ("bar", 2.0, 4.0, None)], False),
        ([("time_signature", 0.0, None, two), ("bar", 0.0, 4.0, None), ("bar", 4.0, 12.0, None)], True),
        ([("bar", 0.0, None, None), ("bar", 2.0, None, None), ("bar", 6.0, None, None)], True),
    ]
    df = spark.createDataFrame([(s, *row) for s, (rows, _) in enumerate(scores) for row in rows], "score_id long, type string, onset double, release double, other string")
    assert {r.score_id: r.pickup for r in E.has_pickup(df).collect()} == {s: p for s, (_, p) in enumerate(scores) if p is not None}
    asked = spark.createDataFrame([(s, t) for s in (0, 8) for t in (0.0, 3.0, 4.0)], "score_id long, t double")
    got = {(r.score_id, r.t): (r.bar_number, r.offset) for r in E.bar_and_offset(df, asked).collect()}
    assert got == {(0, 0.0): (1, 0), (0, 3.0): (1, 3), (0, 4.0): (2, 0), (8, 0.0): (0, 0), (8, 3.0): (0, 3), (8, 4.0): (1, 0)}


def test_annotations(spark):
    rows = [(1, 0.0, "bar", None, None, None, None), (1, 1.0, "note", "a", "V", 0.0, "M"), (1, 2.0, "note", "C", "V", 0.0, "M")]
    df = spark.createDataFrame(rows, "score_id long, onset double, type string, key string, degree string, inversion double, quality string")
    told = lambda d: [r.annotation for r in d.orderBy("onset").collect()]
    assert told(C.merge_annotations(df)) == ["", "a.VM", "C.VM"] and told(C.merge_annotations(df, include_key=False)) == ["", "VM", "VM"]
    rows = [(1, 0, 0.0, None, "bar"), (1, 1, 0.0, 60.0, "IM"), (1, 2, 0.0, 64.0, "IM"), (1, 3, 0.5, 62.0, "IM"), (1, 4, 1.0, 67.0, "VM6"), (1, 5, 1.0, 59.0, "VM6"), (1, 6, 2.0, None, "bar")]
    df = A.unique_annotations_per_onset(spark.createDataFrame(rows, "score_id long, row_id long, onset double, pitch double, rn string"), "rn")
    assert [r.rn for r in df.orderBy("row_id").collect()] == ["", "IM", "", "IM", "", "VM6", ""]


def test_quantized_rows_of_all_types(spark):
    df = spark.createDataFrame([(1, 0, "bar", 0.0, 0.1), (1, 1, "note", 0.0, 0.1), (1, 2, "note", 0.9, 2.2), (1, 3, "bar", 4.0, None)], "score_id long, row_id long, type string, onset double, release double")
    told = lambda d: [(r.row_id, r.onset, r.release) for r in d.orderBy("row_id").collect()]
    assert told(B.quantize_df(df, 1)) == [(0, 0, 1), (1, 0, 1), (2, 1, 2), (3, 4, None)]
    assert told(B.quantize_df(df, 1, "preserve")) == [(0, 0, 0), (1, 0, 0), (2, 1, 2), (3, 4, None)]
    assert told(B.quantize_df(df, 1, "drop")) == [(2, 1, 2), (3, 4, None)]
    ticks = B.quantize_df(df, 4, ticks_out=True)
    assert told(ticks) == [(0, 0, 1), (1, 0, 1), (2, 4, 9), (3, 16, None)] and dict(ticks.dtypes)["onset"] == "bigint"


def test_sounding_bass(spark):
    rows = [(1, 0, "bar", None, 0.0, 4.0, None), (1, 1, "note", 60.0, 0.0, 2.0, None), (1, 2, "note", 48.0, 0.0, 1.5, None), (1, 3, "note", 55.0, 1.0, 2.5, 0), (1, 4, "note", 36.0, 1.0, 2.0, 9), (1, 5, "note", 48.0, 1.0, 1.5, None)]
    df = spark.createDataFrame(rows, "score_id long, row_id long, type string, pitch double, onset double, release double, channel int")
    low = lambda d: [(r.sounding_bass_id, r.sounding_bass) for r in d.orderBy("row_id").collect()]
    assert low(J.add_sounding_bass(df)) == [(None, None), (2, 48), (2, 48), (2, 48), (2, 48), (2, 48)]
    assert low(J.add_sounding_bass(df.drop("channel")))[3:] == [(4, 36)] * 3
    assert low(J.add_sounding_bass(df.drop("type").where("pitch is not null")))[0] == (2, 48)


def test_parts_by_track_and_channel(doubled):
    got = sorted((r.part.track, r.part.channel, r.row_id) for r in O.split_musicdf(doubled).collect())
    assert got == [(1, 0, 2), (1, 0, 3), (2, 0, 4)]
    assert sorted((r.part.track, r.row_id) for r in O.split_musicdf(doubled, by_channel=False).collect()) == [(0, 0), (1, 2), (1, 3), (2, 4)]
    assert O.split_musicdf(doubled.drop("channel")).select("part.track").distinct().count() == 3
    assert {r.part for r in O.split_musicdf(doubled.drop("track")).collect()} == {None}
    with pytest.raises(ValueError):
        O.split_musicdf(doubled, False, False)
    parts = O.split_by(doubled, "track", [1.0, 2.0])
    assert parts[1.0].count() == 2 and parts[2.0].count() == 1


def test_parts_with_marks(spark):
    rows = [(1, 0, "time_signature", None), (1, 1, "bar", None), (1, 2, "note", "view"), (1, 3, "note", "error"), (1, 4, "note", None), (1, 5, None, None)]
    df = spark.createDataFrame(rows, "score_id long, row_id long, type string, instrument string")
    parts = O.split_by(df, "instrument", ["view", "error", "none"], with_marks=True)
    assert {v: sorted(r.row_id for r in p.collect()) for v, p in parts.items()} == {"view": [0, 1, 2, 5], "error": [0, 1, 3, 5], "none": [0, 1, 5]}


def test_crop_sorts_whole_scores_once(spark):
    """After bars are inferred one sort of all rows serves every window of the crop."""
    rows = [(1, 0, "time_signature", 0.0, None, '{"numerator": 4, "denominator": 4}'), (1, 1, "note", 1.0, 9.0, None), (1, 2, "note", 9.0, 10.0, None), (2, 3, "note", 9.5, 10.0, None)]
    df = spark.createDataFrame(rows, "score_id long, row_id long, type string, onset double, release double, other string")
    got = O.crop_df(df, 9.0)
    assert sorted((r.score_id, r.type, r.onset) for r in got.collect()) == [(1, "bar", 8.0), (1, "note", 9.0), (1, "time_signature", 8.0), (2, "note", 9.5)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    spine = got._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert "Window" in plan and spine.count("Sort [") <= 1
