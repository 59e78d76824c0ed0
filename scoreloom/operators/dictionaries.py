"""Vocabularies of a corpus: its chords with their pitch classes, and their basses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import keys as K
from scoreloom.functions.numerals import chord_pitch_classes
from scoreloom.operators.chords import split_degrees

FIELDS = ["mode", "quality", "primary_degree", "primary_alteration", "secondary_degree", "secondary_alteration"]


def _bare(c: str) -> Column:
    return F.when(F.col(c).isin("_", "-"), "").otherwise(F.col(c))


def _known(chords: DataFrame) -> DataFrame:
    s = chords if "primary_degree" in chords.columns else split_degrees(chords)
    return s.where("key is not null and key not in ('', 'na') and quality is not null and quality <> 'na'").withColumn("mode", K.get_mode(F.col("key")))


def _degree() -> Column:
    second = F.when(F.col("secondary_degree") == "I", "").otherwise(F.concat(F.lit("/"), _bare("secondary_alteration"), "secondary_degree"))
    return F.concat(_bare("primary_alteration"), "primary_degree", second)


def _tonic() -> Column:
    return F.when(F.col("mode") == "M", "C").otherwise("c")


def chord_dict(chords: DataFrame, rare: int = 0) -> DataFrame:
    """mode, quality, the four degree columns, rn, n_chords, n_scores, chord_pcs: each chord of a corpus once, in C or c;
    chord_pcs is null where its pitch classes can't be told. Rows without key or quality do not count.
    Chords that stand `rare` times or less are one row of their mode with null degrees and quality
    '(rare)', so that counts add up. Tasks count before the exchange; pitch classes are worked out once for each chord."""
    s = _known(chords)
    one = s.groupBy(*FIELDS, "score_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*FIELDS).agg(F.sum("n").alias("n_chords"), F.count(F.lit(1)).alias("n_scores"))
    pcs = chord_pitch_classes(_degree(), F.col("quality"), F.lit(0), _tonic())
    rn = F.concat(_bare("primary_alteration"), "primary_degree", "quality", F.when(F.col("secondary_degree") == "I", "").otherwise(F.concat(F.lit("/"), _bare("secondary_alteration"), "secondary_degree")))
    told = one.withColumns({"rn": rn, "chord_pcs": F.when(pcs.isNotNull(), K.pcs_to_hex(pcs))}).select(*FIELDS, "rn", "n_chords", "n_scores", "chord_pcs")
    if not rare:
        return told
    few = told.where(F.col("n_chords") <= rare).groupBy("mode").agg(F.sum("n_chords").alias("n_chords"), F.max("n_scores").alias("n_scores")).withColumn("quality", F.lit("(rare)")).drop("n_scores")
    return told.where(F.col("n_chords") > rare).unionByName(few, allowMissingColumns=True)


def bass_dict(chords: DataFrame) -> DataFrame:
    """mode, quality, the four degree columns, inversion, n_chords, bass: each chord and inversion once, with the pitch class of
    its bass in C or c as a hex digit; null where the chord has no such inversion or is not known."""
    s = _known(chords).where("inversion is not null")
    one = s.groupBy(*FIELDS, F.col("inversion").cast("int").alias("inversion")).agg(F.count(F.lit(1)).alias("n_chords"))
    pcs = chord_pitch_classes(_degree(), F.col("quality"), F.col("inversion"), _tonic())
    return one.withColumn("bass", F.lower(F.hex(F.get(pcs, F.lit(0)))))
