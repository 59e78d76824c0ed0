"""Vocabularies of chords, by cases worked by hand."""

from scoreloom.operators import dictionaries as V


def test_chord_and_bass_dictionaries(spark):
    rows = [(1, 0.0, "C", "I", "M", 0.0), (1, 1.0, "G", "I", "M", 1.0), (2, 0.0, "D", "I", "M", 0.0), (1, 2.0, "a", "V/iv", "Mm7", 1.0), (1, 3.0, "C", "bVII", "M", 2.0), (1, 4.0, "C", "V", "unheard", 0.0), (1, 5.0, None, "I", "M", 0.0), (1, 6.0, "C", "na", "na", 0.0), (1, 7.0, "C", "I", "M", 5.0)]
    df = spark.createDataFrame(rows, "score_id long, onset double, key string, degree string, quality string, inversion double").repartition(3)
    got = {r.mode + r.rn: (r.n_chords, r.n_scores, r.chord_pcs) for r in V.chord_dict(df).collect()}
    assert got == {"MIM": (4, 2, "047"), "mVMm7/iv": (1, 1, "047a"), "MbVIIM": (1, 1, "a25"), "MVunheard": (1, 1, None)}
    rare = {(r.mode, r.quality): r.n_chords for r in V.chord_dict(df, rare=1).collect()}
    assert rare == {("M", "M"): 4, ("M", "(rare)"): 2, ("m", "(rare)"): 1}
    bass = {(r.mode, r.primary_alteration, r.primary_degree, r.inversion): (r.n_chords, r.bass) for r in V.bass_dict(df).collect()}
    assert bass == {("M", "_", "I", 0): (2, "0"), ("M", "_", "I", 1): (1, "4"), ("M", "_", "I", 5): (1, None), ("m", "_", "V", 1): (1, "4"), ("M", "b", "VII", 2): (1, "5"), ("M", "_", "V", 0): (1, None)}
    assert V.chord_dict(df.limit(0)).count() == 0
