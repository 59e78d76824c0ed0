"""Spelling of pitches in context, and names of spelled pitches in kern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions import keys as K
from scoreloom.operators import order

#: The middle of the line of fifths (D, where F is 0) and the first places that a stretch of twelve may have.
MIDDLE, FIRST = 3, range(-14, 10)


def kern_spelling(spelling: Column, pitch: Column) -> Column:
    """'Bb' at 70 to 'b-', at 58 to 'B-': letters by octave (middle C is 'c', an octave lower 'C'), then signs. Null and 'na' give null."""
    signs = F.floor(K.spelling_to_line_of_fifths(spelling) / 7).cast("int")
    octave = (F.floor((pitch.cast("int") - signs) / 12) - 1).cast("int")
    letter = F.upper(F.substring(spelling, 1, 1))
    name = F.when(octave >= 4, F.repeat(F.lower(letter), octave - 3)).otherwise(F.repeat(letter, 4 - octave))
    return F.when(spelling != "na", F.concat(name, F.when(signs >= 0, F.repeat(F.lit("#"), signs)).otherwise(F.repeat(F.lit("-"), -signs))))


def _fifth(pitch: Column) -> Column:
    """The place of a pitch class on the line of fifths, modulo 12."""
    return F.pmod(F.pmod(pitch.cast("int"), F.lit(12)) * 7 + 1, F.lit(12))


def stretches(spark: SparkSession) -> DataFrame:
    """For each set of pitch classes (bits by `_fifth`), the first place of the twelve on the line of fifths in which
    the set is spelled: the set's span is least; of equal ones its mean is nearest to D, then it is the flatter one. 4095 rows."""
    members = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda f: F.getbit("bits", f) == 1)

    def cost(s: Column) -> Column:
        placed = F.transform(members, lambda f: s + F.pmod(f - s, F.lit(12)))
        return F.struct((F.array_max(placed) - F.array_min(placed)).alias("span"), F.abs(F.aggregate(placed, F.lit(0), lambda a, x: a + x - MIDDLE)).alias("away"), s.alias("first"))

    best = F.array_min(F.transform(F.array(*map(F.lit, FIRST)), cost))
    return spark.range(1, 4096).select(F.col("id").alias("bits")).select("bits", best["first"].alias("first"))


def spell_in_context(df: DataFrame, chunk_len: int = 32, column: str = "spelling") -> DataFrame:
    """`column`: each note's spelling within its stretch of `chunk_len` rows of the score (rows of all types count, in
    canonical order), whose pitch classes are spelled as closely together on the line of fifths as can be. Null for
    other rows and null pitches. Whole scores would hold all twelve classes, so stretches are spelled one by one.
    A column of this name is replaced."""
    if chunk_len < 1:
        raise ValueError("chunk_len must be positive")
    seq, chunk, bits, first = (order.unused(df, c) for c in ("seq", "chunk", "bits", "first"))
    note = F.col("type") == "note"
    place = F.when(note & F.col("pitch").isNotNull(), _fifth(F.col("pitch")))
    s = df.withColumn(seq, F.row_number().over(order.order(df))).withColumn(chunk, F.floor((F.col(seq) - 1) / chunk_len))
    s = s.withColumn(bits, F.bit_or(F.pow(F.lit(2), place).cast("long")).over(Window.partitionBy("score_id", chunk)))
    table = stretches(df.sparkSession).select(F.col("bits").alias(bits), F.col("first").alias(first))
    s = s.join(F.broadcast(table), bits, "left")
    at = F.col(first) + F.pmod(place - F.col(first), F.lit(12))
    return s.withColumn(column, K.line_of_fifths_to_spelling(at)).select(*dict.fromkeys([*df.columns, column]))


def spell_df(df: DataFrame, chunk_len: int = 32) -> DataFrame:
    """humdrum_spelling: kern names of all notes, from a column spelling if there is one (null where it is null), else in
    context. Other rows: '' in context, what their spelling gives otherwise."""
    if "spelling" in df.columns:
        return df.withColumn("humdrum_spelling", kern_spelling(F.col("spelling"), F.col("pitch")))
    name = order.unused(df, "spelling_")
    s = spell_in_context(df, chunk_len, name)
    shown = F.when(F.col("type") == "note", kern_spelling(F.col(name), F.col("pitch"))).otherwise("")
    return s.withColumn("humdrum_spelling", shown).drop(name)
