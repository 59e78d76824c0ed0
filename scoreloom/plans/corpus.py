"""Scores and chords as a deterministic view of the provided tables.

`user_id` is the score, `event_id` the row, the event's time in quarters of an hour its onset in
sixteenths. All times are multiples of 1/4, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["C", "G", "a", "F", "e", "Bb", "d"]
DEGREES = ["I", "V", "IV", "V/V", "ii", "vi", "V/ii", "I"]
QUALITIES = ["M", "Mm7", "m", "o7"]
#: A chord lasts this many quarter notes.
CHORD = 8


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes: score_id, row_id, type, instrument, channel, pitch, onset, release."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    secs = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200 * 10**6)) / 1e6
    onset = F.floor(secs / 900) / 4.0
    return e.select(
        F.col("user_id").alias("score_id"), F.col("event_id").alias("row_id"), F.lit("note").alias("type"), F.col("event_type").alias("instrument"),
        F.when(F.col("event_type") == "error", 9).otherwise(0).alias("channel"), (36 + F.pmod(F.floor("value"), F.lit(49))).cast("double").alias("pitch"),
        onset.alias("onset"), (onset + (1 + F.col("event_id") % 16) / 4.0).alias("release"),
    )


def with_meter(notes: DataFrame) -> DataFrame:
    """Notes with time signatures added: 4/4 at 0 and 3/4 at 64 in each score (other: JSON)."""
    each = notes.select("score_id").distinct()
    marks = F.explode(F.array(*(F.struct(F.lit(float(at)).alias("onset"), F.lit(f'{{"numerator": {n}, "denominator": {d}}}').alias("other"), F.lit(-k).alias("k")) for k, (at, n, d) in enumerate([(0, 4, 4), (64, 3, 4)], 1))))
    signs = each.withColumn("m", marks).select("score_id", F.col("m.k").cast("long").alias("row_id"), F.lit("time_signature").alias("type"), F.col("m.onset").alias("onset"), F.col("m.other").alias("other"))
    return notes.withColumn("other", F.lit(None).cast("string")).unionByName(signs, allowMissingColumns=True)


def chords(notes: DataFrame) -> DataFrame:
    """One chord for each stretch of CHORD quarters in which the score has a note."""
    at = notes.select("score_id", F.floor(F.col("onset") / CHORD).alias("b")).distinct()
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("score_id") * 7 + F.floor(F.col("b") / k), F.lit(len(values))) + 1).cast("int"))
    return at.select("score_id", (F.col("b") * CHORD).cast("double").alias("onset"), ((F.col("b") + 1) * CHORD).cast("double").alias("release"), pick(KEYS, 5).alias("key"), pick(DEGREES, 1).alias("degree"), pick(QUALITIES, 1).alias("quality"), F.pmod(F.col("b"), F.lit(4)).cast("double").alias("inversion"))


def _values(values: list[str], k: int) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[(score_id * 7 + b // {k}) % {len(values)} + 1]"


#: The same views in SQL, as common table expressions.
SQL = f"""
ev AS (SELECT user_id AS score_id, event_id AS row_id, 'note' AS type, event_type AS instrument, CASE WHEN event_type = 'error' THEN 9 ELSE 0 END AS channel,
  CAST(36 + CAST(floor(value) AS BIGINT) % 49 AS DOUBLE) AS pitch, floor((epoch_us(ts) - 1704067200000000) / 1e6 / 900) / 4.0 AS onset, floor((epoch_us(ts) - 1704067200000000) / 1e6 / 900) / 4.0 + (1 + event_id % 16) / 4.0 AS release FROM events),
ms AS (SELECT *, NULL::VARCHAR AS other FROM ev UNION ALL SELECT score_id, -k, 'time_signature', NULL, NULL, NULL, mt, NULL, o FROM (SELECT DISTINCT score_id FROM ev),
  (VALUES (1, 0.0, '{{"numerator": 4, "denominator": 4}}'), (2, 64.0, '{{"numerator": 3, "denominator": 4}}')) v(k, mt, o)),
cb AS (SELECT DISTINCT score_id, CAST(floor(onset / {CHORD}) AS BIGINT) AS b FROM ev),
ch AS (SELECT score_id, CAST(b * {CHORD} AS DOUBLE) AS onset, CAST((b + 1) * {CHORD} AS DOUBLE) AS release, {_values(KEYS, 5)} AS key, {_values(DEGREES, 1)} AS degree, {_values(QUALITIES, 1)} AS quality, CAST(b % 4 AS DOUBLE) AS inversion FROM cb)"""
