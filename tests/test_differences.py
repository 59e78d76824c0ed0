"""Bags of notes, pooled arrays, nested and translated numerals, by cases worked by hand."""

from pyspark.sql import functions as F

from scoreloom.functions import degrees
from scoreloom.operators import differences as D


def notes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "score_id long, row_id long, type string, onset double, release double, pitch double")


def test_note_differences(spark):
    a = notes(spark, [("note", 0.0, 1.0, 60.0), ("note", 0.0, 1.0, 60.0), ("note", 1.0, 2.0, 62.0), ("bar", 0.0, 4.0, None), ("note", 2.0, None, 64.0)])
    b = notes(spark, [("note", 0.0, 1.0, 60.0), ("note", 1.0, 3.0, 62.0), ("note", 2.0, None, 64.0)])
    told = lambda df: sorted((r.onset, r.release, r.pitch, r.n) for r in df.collect())
    # a set of notes would not see the lost double
    assert told(D.note_differences(a, b)) == [(0, 1, 60, 1), (1, 2, 62, 1), (1, 3, 62, -1)]
    assert told(D.note_differences(b, a)) == [(0, 1, 60, -1), (1, 2, 62, -1), (1, 3, 62, 1)]
    assert D.note_differences(a, a).count() == 0 and D.note_differences(a, a.limit(0)).count() == 3


def test_quantize_differences(spark):
    df = notes(spark, [("note", 0.0, 0.1, 60.0), ("note", 0.0, 0.05, 60.0), ("note", 0.0, 2.0, 60.0), ("note", 1.1, 2.0, 62.0), ("bar", 0.0, 0.0, None)])
    assert sorted((r.onset, r.release, r.pitch) for r in D.quantize_differences(df, 1).collect()) == [(0, 0.05, 60), (0, 0.1, 60)]


def test_arrays(spark):
    rows = [(1, 0, 0.0, 0.5, [0.0, 1.0]), (1, 1, 0.0, 1.0, [1.0, 0.0]), (1, 2, 1.0, 2.0, [2.0, -1.0]), (1, 3, 1.0, 2.0, [3.0, -2.0]), (2, 4, None, 2.0, [7.0]), (2, 5, 0.0, 1.0, [])]
    df = spark.createDataFrame(rows, "score_id long, row_id long, onset double, release double, a array<double>").repartition(3)
    got = lambda d: [r.a for r in d.orderBy("row_id").collect()]
    assert got(D.sync_array(df, "a")) == [[0.5, 0.5], [0.5, 0.5], [2.5, -1.5], [2.5, -1.5], [7.0], []]
    assert got(D.sync_array(df, "a", ("onset", "release"))) == [[0, 1], [1, 0], [2.5, -1.5], [2.5, -1.5], [7.0], []]
    assert got(D.sync_array(df, "a", pool="max"))[:4] == [[1, 1], [1, 1], [3, -1], [3, -1]]
    one = D.unique_of_array(df.where("score_id = 1"), "a")
    assert sorted((r.onset, r.row, r.a) for r in one.collect()) == [(0, 0, [0, 1]), (1, 2, [2, -1])]
    assert sorted(r.a for r in D.unique_of_array(df.where("score_id = 1"), "a", ("release",), ("onset",)).collect()) == [[0.5, 0.5], [0.5, 0.5], [2.5, -1.5]]


def test_nested_numerals(spark):
    rows = [("vi/III", "M", "#i"), ("vi/III", "Ab", "#i"), ("V/V", "M", "II"), ("/V/V", "M", "II"), ("V/V/V", "M", "VI"), ("V/V/V/V", "M", "III"), ("v/V", "M", "ii"), ("vi/III", "m", "i"), ("V", "M", "V"), ("", "M", "I"), ("V/ii", "C", "VI"), ("V/x", "M", None), (None, "M", None)]
    df = spark.createDataFrame(rows, "rn string, mode string, want string")
    got = df.select("*", degrees.handle_nested_secondary_rns(F.col("rn"), F.col("mode")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_translated_numerals(spark):
    rows = [("Im", "i"), ("VM", "V"), ("IVm6", "iv6"), ("VIIo642", "viio642"), ("III+", "III+"), ("xaug665", "Ger65"), ("xaug643", "Fr43"), ("xaug63", "It6"), ("xaug642", "It6"), ("A6Ger65", "Ger65"), ("A6Fr43", "Fr43"), ("A6It6", "It6"), ("VM/VM", "V/V"), ("VM/Vm", "V/v"), ("IVm/bIIm", "iv/bii"), ("VM/V", "V/V"), ("bVIIM", "bVII"), ("vM", None), ("VM/v", None), ("na", "na"), (None, None)]
    df = spark.createDataFrame(rows, "rn string, want string")
    got = df.select("*", degrees.translate_rns(F.col("rn")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
