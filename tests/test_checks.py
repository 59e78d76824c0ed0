"""Checks of chord tables, key signatures and transposed scores, by cases worked by hand."""

import pytest

from scoreloom.operators import checks as H

JOINED = "score_id long, row_id long, onset double, release double, key string, degree string, quality string, inversion int, chord_pcs string"


def joined(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], JOINED)


def found(df):
    return sorted((r.severity, r.column or "", r.message, r.n_bad, r.place) for r in df.collect())


def test_checks_of_joined_tables(spark):
    good = joined(spark, (0.0, 1.0, "C", "I", "M", 0, "047"), (1.0, 2.0, "na", "na", "M", 1, ""), (2.0, None, None, "V/bIIm", "M", None, None))
    assert H.detect_format(good) == "joined" and found(H.check_chords(good)) == []
    H.assert_valid_chords(good)
    bad = joined(spark, (0.0, 1.0, "X", "I", "M", 0, "04G"), (3.0, 2.0, "D#", "V/V/V", "M", 4, "047"), (2.0, 3.0, "C#", "", "M", 3, "0"))
    assert found(H.check_chords(bad)) == [
        ("error", "chord_pcs", "no hex digits", 1, 1), ("error", "degree", "no degree", 2, 2), ("error", "inversion", "no inversion", 1, 2), ("error", "key", "no key", 3, 1),
        ("warning", "onset", "onsets go back", 1, 3), ("warning", "release", "release before onset", 1, 2),
    ]
    assert {r[1]: r[3] for r in found(H.check_chords(bad, allow_enharmonic=True))}["key"] == 1
    assert {r[0] for r in found(H.check_chords(bad, strict=True))} == {"error"}
    with pytest.raises(ValueError, match="key: no key"):
        H.assert_valid_chords(bad)
    assert found(H.check_chords(bad, check_values=False)) == [] and found(H.check_chords(bad.limit(0))) == []


def test_checks_of_the_schema(spark):
    odd = spark.createDataFrame([(1, "0", 5, "I", "M", "x", "new")], "score_id long, onset string, key int, degree string, quality string, inversion string, more string")
    assert found(H.check_chords(odd)) == [("error", "inversion", "must be a number", None, None), ("error", "key", "must be text", None, None), ("error", "onset", "must be a number", None, None)]
    assert ("error", "more", "unknown column", None, None) in found(H.check_chords(odd, strict=True))
    assert found(H.check_chords(odd.select("score_id", "key"))) == [("error", "", "no known format", None, None)]


def test_checks_of_split_and_numeral_tables(spark):
    split = spark.createDataFrame([(1, 0.0, "C", "V", "x", "V", "b", "Q", "M", 0), (1, 1.0, "C", "V", "_", "V", "##", "m", "M", 0)], "score_id long, onset double, key string, primary_degree string, primary_alteration string, secondary_degree string, secondary_alteration string, secondary_mode string, quality string, inversion int")
    assert found(H.check_chords(split)) == [("error", "primary_alteration", "no alteration", 1, 1), ("error", "secondary_mode", "no mode", 1, 1)]
    rn = spark.createDataFrame([(1, 0.0, "", "I"), (1, 1.0, "", "V"), (2, 0.0, "C", "I"), (2, 1.0, "H", "I")], "score_id long, onset double, key string, rn string")
    assert H.detect_format(rn) == "rn" and found(H.check_chords(rn)) == [("error", "key", "no key", 1, 2), ("error", "key", "the first row needs a key", 1, 1)]


def test_key_signatures(spark):
    a = spark.createDataFrame([(None, None), (0.0, "M"), (9.0, "m"), (9.0, "M"), (8.0, "m"), (3.0, "m")], "key_pc double, mode string")
    assert [r.key_signature for r in H.add_key_signature(a).collect()] == [None, 0, 0, 3, 5, 6]
    b = spark.createDataFrame([(None,), ("C",), ("a",), ("ab",), ("Ab",), ("Cbb",)], "key string")
    assert [r.key_signature for r in H.add_key_signature(b).collect()] == [None, 0, 0, -7, -4, -14]
    with pytest.raises(ValueError):
        H.add_key_signature(b.withColumnRenamed("key", "x"))


def test_transposed_scores(spark):
    df = spark.createDataFrame([(60.0, "C", 0, "C", 0, 0, 0), (62.0, "D", 2, "C", 0, 0, 0), (64.0, "E", 4, "a", 0, 0, 9), (None, "na", None, None, 0, 0, None)], "pitch double, spelling string, pc int, key string, sig int, global_key_sig int, channel int")
    how = {"spelled_columns": ("spelling", "key"), "pc_columns": ("pc",), "key_sig_columns": ("sig",)}
    two = H.transpose_to_key(df, 2, **how)
    told = lambda d: [tuple(r)[:5] for r in d.collect()]
    assert told(two) == [(62, "D", 2, "D", 2), (64, "E", 4, "D", 2), (64, "F#", 6, "b", 2), (None, "na", None, None, 2)]
    far = H.transpose_to_key(two.drop("channel"), -7, **how)
    assert told(far) == [(59, "Cb", 11, "Cb", -7), (61, "Db", 1, "Cb", -7), (61, "Eb", 3, "ab", -7), (None, "na", None, None, -7)]
    assert {(r.global_key_sig, r.transposed_by_n_sharps) for r in far.collect()} == {(-7, -7)}
    assert told(H.transpose_to_key(df, 0, **how)) == told(df)
    up = H.transpose_to_key(df.drop("channel"), 6, key_sig_class_columns=("sig",)).first()
    assert up.pitch == 66 and up.sig == 6


def test_no_notes(spark):
    df = spark.createDataFrame([("bar",)], "type string")
    assert H.no_notes(df) and H.no_notes(df.limit(0)) and not H.no_notes(df.withColumnRenamed("type", "x"))
