"""Score queries against DuckDB, and operators on small frames with odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from scoreloom import queries as Q
from scoreloom.functions import keys as K
from scoreloom.operators import chords as C
from scoreloom.operators import joins as J
from scoreloom.operators import merges as M
from scoreloom.operators import meter as B
from scoreloom.operators import order as O
from scoreloom.operators import slices as S

SF = "/root/testdata/sf0.001"
NOTE = "score_id long, row_id long, type string, instrument string, channel int, pitch double, onset double, release double"


def notes(spark, rows):
    return spark.createDataFrame([(1, i, "note", "p", 0, float(p), float(a), float(b)) for i, (p, a, b) in enumerate(rows)], NOTE)


def plain(rows):
    return sorted((repr([None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in rows))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in ("events",):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = Q.queries()[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in sorted(got.columns))} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*sorted(got.columns)).collect()) == plain(want)


def test_salami_slice(spark):
    got = S.salami_slice(notes(spark, [(60, 0, 2), (64, 1, 3), (67, 1, 1)])).orderBy("onset", "pitch").collect()
    assert [(r.pitch, r.onset, r.release, r.slice_id) for r in got] == [(60, 0, 1, 0), (60, 1, 2, 1), (64, 1, 2, 1), (64, 2, 3, 2)]


def test_slices_keep_pairs_and_lag(spark):
    n = notes(spark, [(60, 0, 3)])
    assert sorted((r.onset, r.release, r.sliced) for r in S.slice_df(n, [1, 2]).collect()) == [(0, 1, "before"), (0, 2, "before"), (1, 3, "after"), (2, 3, "after")]
    assert sorted((r.onset, r.release) for r in S.slice_into_uniform_steps(n, 1.0).collect()) == [(0, 1), (0, 3), (1, 2)]


def test_merge_notes_touching(spark):
    got = M.merge_notes(notes(spark, [(60, 0, 1), (60, 1, 2), (60, 1.5, 3), (60, 4, 5), (61, 0, 1)])).orderBy("pitch", "onset").collect()
    assert [(r.pitch, r.onset, r.release, r.merged_ids) for r in got] == [(60, 0, 3, [0, 1, 2]), (60, 4, 5, [3]), (61, 0, 1, [4])]


def test_null_pitches_never_merge(spark):
    df = notes(spark, [(60, 0, 1), (60, 1, 2)]).withColumn("pitch", F.lit(None).cast("double"))
    assert M.merge_notes(df).count() == 2 and M.dedouble(df).count() == 2


def test_quantize_half_even_and_min_dur(spark):
    got = B.quantize_df(notes(spark, [(60, 0.125, 0.375), (61, 1, 1.01)]), 4).orderBy("pitch").collect()
    assert [(r.onset, r.release) for r in got] == [(0, 0.5), (1, 1.25)]
    assert B.quantize_df(notes(spark, [(61, 1, 1.01)]), 4, "remove").count() == 0
    with pytest.raises(ValueError):
        B.quantize_df(notes(spark, []), 4, "other")


def test_backfill_and_drop_of_labels(spark):
    chords = spark.createDataFrame([(1, 2.0, "C", "I", "M", 0.0)], "score_id long, onset double, key string, degree string, quality string, inversion double")
    n = notes(spark, [(60, 0, 1), (60, 2, 3)])
    assert J.label_notes_with_chords(n, chords).where("key = 'C'").count() == 2
    assert J.label_notes_with_chords(n, chords, backfill=False).count() == 1


def test_split_overhang_is_dropped(spark):
    df = notes(spark, [(60, 3, 4.001)]).unionByName(spark.createDataFrame([(1, None, "bar", None, None, None, 0.0, 4.0), (1, None, "bar", None, None, None, 4.0, 8.0)], NOTE))
    got = S.split_notes_at_barlines(df, 0.01).where("type = 'note'").collect()
    assert [(r.onset, r.release, r.tie_to_next, r.tie_to_prev) for r in got] == [(3, 4, False, False)]


def test_layers_and_crop(spark):
    got = M.homophonic_layers(notes(spark, [(60, 0, 2), (64, 1, 3), (67, 2, 3)])).orderBy("row_id").collect()
    assert [r.layer for r in got] == [0, 1, 0]
    assert O.crop_df(notes(spark, [(60, 0, 1), (61, 5, 6)]), 3.0).count() == 1


def test_merge_df_keeps_bars_once(spark):
    bar = spark.createDataFrame([(1, None, "bar", None, None, None, 0.0, 4.0)], NOTE)
    a = notes(spark, [(60, 0, 1)]).unionByName(bar)
    assert J.merge_df(a, a).groupBy("type").count().orderBy("type").collect() == [("bar", 1), ("note", 2)]


def test_key_expressions(spark):
    rows = [("C", 0, "0M"), ("Bb", -2, "10M"), ("f#", 3, "6m"), ("a", 0, "9m"), ("Db", -5, "1M"), (None, None, None)]
    got = spark.createDataFrame([(k,) for k, *_ in rows], "k string").select("k", K.key_signature(F.col("k")).cast("int"), K.chromatic_key(F.col("k"))).collect()
    assert [tuple(r) for r in got] == rows
    r = spark.range(1).select(K.line_of_fifths_to_spelling(F.lit(-3)).alias("a"), K.line_of_fifths_to_spelling(F.lit(8)).alias("b"), K.hex_to_pcs(F.lit("72b")).alias("c"), K.fraction_to_float(F.lit("1/4")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("Ab", "C#", [7, 2, 11], 0.25)


def test_degrees_with_nulls(spark):
    df = spark.createDataFrame([(1, 0.0, "bVII/ii"), (1, 1.0, "V"), (1, 2.0, None)], "score_id long, onset double, degree string")
    got = C.join_degrees(C.split_degrees(df)).orderBy("onset").collect()
    assert [(r.primary_alteration, r.primary_degree, r.secondary_degree) for r in got] == [("b", "VII", "ii"), ("_", "V", "I"), ("na", "na", "na")]
    assert got[0].joined_degree == "bVII/ii" and got[1].joined_degree == "V"


@pytest.mark.parametrize("f", [S.salami_slice, M.merge_notes, M.merge_repeated_notes, M.dedouble, M.return_rests, M.outer_voice_flags, J.add_sounding_bass, O.sort_df, M.homophonic_layers])
def test_empty_tables(spark, f):
    assert f(notes(spark, [])).count() == 0


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "flagship" in e.queries()


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_layers_share_onset_and_release(spark):
    # a chord held together stays in one layer; a note over two others takes the next one
    table = notes(spark, [(60, 0, 2), (67, 0, 2), (60, 2, 3), (72, 2, 6), (64, 3, 6), (72, 6, 7)])
    got = {(r.pitch, r.onset): r.layer for r in M.homophonic_layers(table).collect()}
    assert got == {(60, 0): 0, (67, 0): 0, (60, 2): 0, (72, 2): 1, (64, 3): 0, (72, 6): 0}


def test_layers_against_plain_version(spark):
    import random

    rng = random.Random(3)
    table = [(rng.randint(40, 80), k, k + rng.choice([0.5, 1, 1.5, 4])) for k in [x / 2 for x in range(200)] for _ in range(rng.randint(0, 3))]
    layers, want = [], {}
    for i, (pitch, onset, release) in sorted(enumerate(table), key=lambda x: (x[1][1], x[1][0], x[1][2], x[0])):
        k = next((k for k, (o, r) in enumerate(layers) if onset >= r or (o, r) == (onset, release)), len(layers))
        layers[k:] = [(onset, release), *layers[k + 1 :]]
        want[i] = k
    got = {r.row_id: r.layer for r in M.homophonic_layers(notes(spark, table)).collect()}
    low = min(got)
    assert {k - low: v for k, v in got.items()} == want and max(want.values()) > 1


def test_repeated_notes(spark):
    # short 60 repeated while 72 sounds above; from 2 on a deeper note takes the bass
    table = notes(spark, [(60, 0, 0.5), (60, 0.5, 1), (60, 1, 4), (60, 4, 4.5), (72, 0, 5), (48, 1, 5)])
    merged = lambda **k: sorted(rows(M.merge_repeated_notes(table, **k).where("pitch = 60"), "onset", "release"))
    assert merged(preserve_outer_voices=False) == [(0, 4.5)]
    assert merged() == [(0, 1), (1, 4.5)]  # the bass changes at 1
    assert merged(preserve_outer_voices=False, max_note_duration=0.5) == [(0, 4), (4, 4.5)]  # only the earlier note has to be short
    marks = spark.createDataFrame([(0, 100, "bar", None, 0.0, 4.0), (0, 101, "bar", None, 4.0, 8.0), (0, 102, "note", 50.0, 0.0, 1.0), (0, 103, "note", 50.0, 1.0, 2.0)], "score_id long, row_id long, type string, pitch double, onset double, release double").withColumn("instrument", F.lit(None).cast("string"))
    assert sorted(rows(M.merge_repeated_notes(marks), "type", "onset", "release")) == [("bar", 0, 4), ("bar", 4, 8), ("note", 0, 2)]


CHORDS = "score_id long, onset double, primary_degree string, secondary_degree string, secondary_mode string, quality string, key string"


def table_of(spark, *chords):
    return spark.createDataFrame([(0, float(i), *c) for i, c in enumerate(chords)], CHORDS)


def test_expand_tonicizations(spark):
    degrees = lambda *c: rows(C.expand_tonicizations(table_of(spark, *c)).orderBy("onset"), "primary_degree", "secondary_degree", "secondary_mode")
    assert degrees(("III", "I", "_", "m", "F"), ("V", "III", "m", "Mm7", "F")) == [("I", "III", "m"), ("V", "III", "m")]
    assert degrees(("III", "I", "_", "m", "F"), ("V", "III", "m", "Mm7", "C")) == [("III", "I", "_"), ("V", "III", "m")]  # another key
    assert degrees(("III", "I", "_", "M", "F"), ("V", "III", "m", "Mm7", "F"))[0] == ("III", "I", "_")  # another mode
    for quality in ("Mm7", "o7", "Ger65", "+"):
        assert degrees(("III", "I", "_", quality, "F"), ("V", "III", "m", "M", "F"))[0] == ("III", "I", "_")
    v = ("V", "I", "_", "M", "F")
    assert degrees(("V", "V", "M", "M", "F"), v)[1] == ("V", "I", "_")
    assert degrees(("V", "V", "M", "M", "F"), v, ("II", "V", "M", "m", "F"))[1] == ("I", "V", "M")


def test_replace_spurious_tonics(spark):
    got = rows(C.replace_spurious_tonics(table_of(spark, ("I", "iii", "m", "m", "F"), ("I", "I", "_", "M", "F"), ("V", "II", "m", "M", "F"), ("IV", None, "_", "M", "F"))).orderBy("onset"), "primary_degree", "secondary_degree", "secondary_mode")
    assert got == [("III", "I", "_"), ("I", "I", "_"), ("V", "II", "m"), ("IV", "I", "_")]


def test_merge_annotations(spark):
    labels = [("bar", None, None, None, None), ("note", "F", "II", "m7", 1.0), ("note", "F", "II", "m7", 1.0), ("note", "F", "V", "M", 2.0), ("bar", "na", "na", "na", None), ("note", "F", "V/V", "Mm7", 3.0), ("note", "d", "V/V", "Mm7", 3.0)]
    df = spark.createDataFrame([(0, float(i), *x) for i, x in enumerate(labels)], "score_id long, onset double, type string, key string, degree string, quality string, inversion double")
    assert rows(C.merge_annotations(df).orderBy("onset"), "annotation") == [("",), ("F.IIm65",), ("",), ("VM64",), ("",), ("VMm42/V",), ("d.VMm42/V",)]
    assert rows(C.merge_annotations(df, include_key=False).orderBy("onset"), "annotation")[-2:] == [("VMm42/V",), ("VMm42/V",)]
    kept = C.keep_new_elements_only(df.withColumn("key", F.when(F.col("onset") == 2, "").otherwise(F.col("key"))), "key", "-").orderBy("onset")
    assert rows(kept, "key") == [("-",), ("F",), ("-",), ("-",), ("na",), ("F",), ("d",)]


def test_crop_moves_time_signature(spark):
    events = [("time_signature", 0, None), ("bar", 0, 3), ("note", 1, 3), ("bar", 3, 6), ("note", 3, 5), ("note", 5, 6), ("bar", 6, 9), ("note", 7, 9)]
    df = spark.createDataFrame([(0, i, t, float(o), None if r is None else float(r)) for i, (t, o, r) in enumerate(events)], "score_id long, row_id long, type string, onset double, release double")
    assert sorted(rows(O.crop_df(df, start_time=2.0), "row_id", "onset")) == [(0, 3), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7)]
    assert sorted(rows(O.crop_df(df, start_row=5, end_row=6), "row_id", "onset")) == [(0, 3), (3, 3), (5, 5), (6, 6)]
    assert sorted(rows(O.crop_df(df, end_row=2), "row_id", "onset")) == [(0, 0), (1, 0), (2, 1)]
    assert O.crop_df(df, start_time=8.0).count() == 0


def test_crop_infers_bars(spark):
    sign = '{"numerator": 4, "denominator": 4}'
    events = [(1, 0, "time_signature", 0.0, None, sign), (1, 1, "note", 1.0, 2.0, None), (1, 2, "note", 5.0, 6.0, None), (1, 3, "note", 9.0, 10.0, None)]
    events += [(2, 0, "note", 1.0, 2.0, None), (2, 1, "note", 5.0, 6.0, None)]  # no time signature
    events += [(3, 0, "time_signature", 0.0, None, sign), (3, 1, "bar", 0.0, 7.0, None), (3, 2, "note", 6.0, 7.0, None)]  # a bar of its own
    df = spark.createDataFrame(events, "score_id long, row_id long, type string, onset double, release double, other string").withColumn("given", F.lit("clash"))
    got = lambda **o: sorted(rows(O.crop_df(df.repartition(3), **o), "score_id", "type", "onset", "release"), key=repr)
    after = [(1, "bar", 4, 8), (1, "bar", 8, 10), (1, "note", 5, 6), (1, "note", 9, 10), (1, "time_signature", 4, None)]
    rest = [(2, "note", 5, 6), (3, "bar", 0, 7), (3, "note", 6, 7), (3, "time_signature", 0, None)]
    assert got(start_time=5.0) == after + rest
    assert got(start_time=5.0, infer_bars=False) == [(1, "note", 5, 6), (1, "note", 9, 10), (1, "time_signature", 0, None), *rest]
    assert [r for r in got(start_row=2, end_row=2) if r[0] == 1] == [after[0], after[2], after[4]]
    assert not [r for r in got(end_row=1) if r[:2] == (1, "bar")] and O.crop_df(df.limit(0), 1.0).count() == 0
    assert O.crop_df(df, 5.0).columns == df.columns
