"""Joins in time: labels as of an onset, sounding bass, notes against chords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.slices import BUCKET, buckets, salami_slice, sounding


def label_notes_with_chords(notes: DataFrame, chords: DataFrame, columns: tuple[str, ...] = ("key", "degree", "quality", "inversion"), backfill: bool = True) -> DataFrame:
    """Each note gets the columns of the last chord at or before its onset; earlier notes those of the first
    chord, or go. One sorted pass over both tables together, no pairs."""
    label = F.struct(*columns)
    marks = chords.select("score_id", "onset", label.alias("__c"), F.lit(0).alias("__k"))
    both = notes.withColumn("__c", F.lit(None).cast(marks.schema["__c"].dataType)).withColumn("__k", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    per = Window.partitionBy("score_id").orderBy("onset", "__k")
    past = F.last("__c", ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.first("__c", ignorenulls=True).over(per.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("__l", F.coalesce(past, coming) if backfill else past).where("__k = 1")
    if not backfill:
        found = found.where(F.col("__l").isNotNull())
    return found.select(*notes.columns, *(F.col(f"__l.{c}").alias(c) for c in columns))


def add_sounding_bass(notes: DataFrame) -> DataFrame:
    """sounding_bass_id and sounding_bass: row_id (of equals the first) and pitch of the lowest note that sounds at the note's
    onset; null if none, and on rows that are no notes. Percussion (channel 9) is no bass; without a column
    channel, or with a null in it, nothing is percussion."""
    note = F.coalesce(F.col("type") == "note", F.lit(False)) if "type" in notes.columns else F.lit(True)
    tuned = F.coalesce(F.col("channel") != 9, F.lit(True)) if "channel" in notes.columns else F.lit(True)
    t = notes.where(note).select("score_id", F.col("onset").alias("t")).distinct()
    low = F.min(F.struct("pitch", "row_id")).alias("low")
    bass = sounding(notes.where(note & tuned & F.col("pitch").isNotNull()).select("score_id", "row_id", "pitch", "onset", "release"), t).groupBy("score_id", "t").agg(low).withColumnRenamed("t", "onset")
    found = notes.join(bass, ["score_id", "onset"], "left")
    return found.withColumns({"sounding_bass": F.when(note, F.col("low.pitch")), "sounding_bass_id": F.when(note, F.col("low.row_id"))}).drop("low")


def notes_in_chords(notes: DataFrame, chords: DataFrame) -> DataFrame:
    """Parts of notes that lie in chords: columns of the note, with the chord's onset as chord_onset."""
    a = notes.withColumn("__b", F.explode(buckets(F.col("onset"), F.col("release"))))
    c = chords.select("score_id", F.col("onset").alias("chord_onset"), F.col("release").alias("chord_release"), *(x for x in chords.columns if x not in ("score_id", "onset", "release")))
    c = c.withColumn("__b", F.explode(buckets(F.col("chord_onset"), F.col("chord_release"))))
    pairs = a.join(c, ["score_id", "__b"]).where("onset < chord_release AND release > chord_onset")
    once = F.greatest(F.floor(F.col("onset") / BUCKET), F.floor(F.col("chord_onset") / BUCKET)) == F.col("__b")
    return pairs.where(once).withColumn("onset", F.greatest("onset", "chord_onset")).withColumn("release", F.least("release", "chord_release")).drop("__b", "chord_release")


def percent_chord_match(notes: DataFrame, chords: DataFrame) -> DataFrame:
    """Per chord (with chord_pcs, an array) the share of sounding time whose pitch class is in the chord."""
    dur = F.col("release") - F.col("onset")
    hit = F.array_contains("chord_pcs", F.pmod(F.col("pitch"), F.lit(12)).cast("int"))
    return notes_in_chords(notes, chords).groupBy("score_id", "chord_onset").agg((F.sum(F.when(hit, dur).otherwise(0.0)) / F.sum(dur)).alias("match"))


def percent_bass_pc_match(notes: DataFrame, chords: DataFrame) -> DataFrame:
    """Per chord the share of the time of its slices whose lowest pitch is the chord's bass, the first of chord_pcs."""
    low = salami_slice(notes, False).groupBy("score_id", "onset").agg(F.min("pitch").alias("pitch"), F.min("release").alias("release"))
    dur = F.col("release") - F.col("onset")
    hit = F.pmod(F.col("pitch"), F.lit(12)).cast("int") == F.get("chord_pcs", F.lit(0))
    return notes_in_chords(low, chords).groupBy("score_id", "chord_onset").agg((F.sum(F.when(hit, dur).otherwise(0.0)) / F.sum(dur)).alias("match"))


def merge_df(*dfs: DataFrame) -> DataFrame:
    """Rows of all frames; bars and time signatures that are equal in all columns once."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    shared = F.col("type").isin("bar", "time_signature")
    return out.where(~shared).unionByName(out.where(shared).dropDuplicates())
