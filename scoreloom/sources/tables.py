"""Scores from delimited text: event tables and annotated note lists. Files are read by Spark's own reader, many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions.keys import fraction_to_float

#: Columns with numbers or fractions, and with numbers only.
TIMES, NUMBERS = ("onset", "release"), ("pitch", "velocity", "track", "channel", "midi_instrument")


def _number(text: Column) -> Column:
    return F.when(F.trim(text) == "", None).otherwise(text.try_cast("double"))


def read_csv(spark: SparkSession, path: str | list[str], flags: tuple[str, ...] = ("tie_to_next", "tie_to_prev", "grace")) -> DataFrame:
    """Event tables with headers: times may be fractions, columns in `flags` hold True or False (all else is false), nameless index
    columns are left out, rows other than notes lose their release, a null color is empty. score_id is the file's path."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    rows = raw.select("*", F.col("_metadata.file_path").alias("score_id")).drop(*(c for c in raw.columns if c.startswith(("Unnamed:", "_c"))))
    for c in rows.columns:
        if c in TIMES:
            rows = rows.withColumn(c, fraction_to_float(F.col(c)))
        elif c in NUMBERS:
            rows = rows.withColumn(c, _number(F.col(c)))
        elif c in flags:
            rows = rows.withColumn(c, F.coalesce(F.col(c) == "True", F.lit(False)))
    if "release" in rows.columns:
        rows = rows.withColumn("release", F.when(F.col("type") == "note", F.col("release")))
    if "other" in rows.columns:  # literals of another language: single quotes, None
        json = F.replace(F.replace("other", F.lit("'"), F.lit('"')), F.lit("None"), F.lit("null"))
        rows = rows.withColumn("other", F.when(F.col("type") == "time_signature", json).otherwise(F.col("other")))
    if "color" in rows.columns:
        rows = rows.withColumn("color", F.coalesce("color", F.lit("")))
    return rows


def read_annotated_notes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated note lists with quarterbeats, duration_qb, midi, mc, timesig: notes, and rows where the time signature or the bar
    changes. Rows without quarterbeats (first endings) and without length are left out. score_id is the file's path."""
    raw = spark.read.csv(path, header=True, sep="\t")
    rows = raw.select(F.col("_metadata.file_path").alias("score_id"), fraction_to_float(F.col("quarterbeats")).alias("onset"), _number(F.col("duration_qb")).alias("__d"), _number(F.col("midi")).alias("pitch"), F.col("mc").cast("int").alias("mc"), "timesig").where("onset is not null")
    notes = rows.where("__d > 0").select("score_id", F.lit("note").alias("type"), "onset", (F.col("onset") + F.col("__d")).alias("release"), "pitch")
    per = Window.partitionBy("score_id").orderBy("onset", "mc", "pitch")
    before = F.lag(F.struct("mc", "timesig")).over(per)
    marked = rows.withColumn("__p", before).withColumn("__first", F.row_number().over(per) == 1)
    part = lambda k: F.split_part("timesig", F.lit("/"), F.lit(k)).try_cast("int")
    signs = marked.where(F.col("__first") | ~F.col("timesig").eqNullSafe(F.col("__p.timesig"))).where("timesig is not null")
    signs = signs.select("score_id", F.lit("time_signature").alias("type"), F.when(F.col("__first"), F.least(F.lit(0.0), "onset")).otherwise(F.col("onset")).alias("onset"), F.to_json(F.struct(part(1).alias("numerator"), part(2).alias("denominator"))).alias("other"))
    bars = marked.where(F.col("__first") | (F.col("mc") != F.col("__p.mc"))).select("score_id", F.lit("bar").alias("type"), "onset")
    end = notes.groupBy("score_id").agg(F.max("release").alias("__end"))
    bars = bars.join(end, "score_id", "left").withColumn("release", F.coalesce(F.lead("onset").over(Window.partitionBy("score_id").orderBy("onset")), "__end")).drop("__end")
    return notes.unionByName(signs, allowMissingColumns=True).unionByName(bars, allowMissingColumns=True)
