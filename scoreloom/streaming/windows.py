"""Score operators on streams of notes. `ts` is event time; what comes later than `late` behind it is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_counts(notes: DataFrame, length: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Notes of each score in tumbling windows, or sliding ones where `slide` is given."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return notes.withWatermark("ts", late).groupBy("score_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n_notes"), F.min("pitch").alias("low"), F.max("pitch").alias("high")).select("score_id", F.col("w.start").alias("start"), "n_notes", "low", "high")


def merge_repeated(notes: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Notes of one score, instrument and pitch that follow within `gap` become one: start, end, n_notes."""
    return notes.withWatermark("ts", late).groupBy("score_id", "instrument", "pitch", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_notes")).drop("w")


def dedouble(notes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first of notes with equal score, pitch and time; state is dropped behind the watermark."""
    return notes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["score_id", "pitch", "ts"])


def label_with_chords(notes: DataFrame, chords: DataFrame) -> DataFrame:
    """A stream of notes (onset) with the chord of a static table whose span holds the onset; notes outside chords get nulls.
    Chords are cut into whole quarters first, so the join is on equal keys."""
    cells = chords.withColumn("__q", F.explode(F.sequence(F.floor("onset"), F.ceil("release") - 1)))
    cells = cells.select("score_id", "__q", F.col("onset").alias("__a"), F.col("release").alias("__b"), "key", "degree", "quality", "inversion")
    n, c = notes.withColumn("__q", F.floor("onset")).alias("n"), cells.alias("c")
    on = (F.col("n.score_id") == F.col("c.score_id")) & (F.col("n.__q") == F.col("c.__q")) & (F.col("n.onset") >= F.col("c.__a")) & (F.col("n.onset") < F.col("c.__b"))
    return n.join(c, on, "left").select("n.*", "c.key", "c.degree", "c.quality", "c.inversion").drop("__q")


def fill_forward(events: DataFrame, column: str) -> DataFrame:
    """A stream of (score_id, onset, ..) with nulls of `column` filled from the row before in the same score. Rows
    of one trigger are taken by onset; what comes in a later trigger is filled from what is known by then. State
    is one value a score."""
    from pyspark.sql import types as T
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind, schema = events.schema[column].dataType, events.schema

    def fill(key, frames, state: GroupState):
        import pandas as pd

        pdf = pd.concat(list(frames)).sort_values("onset", kind="stable")
        known = state.get[0] if state.exists else None
        filled = pdf[column].ffill()
        if known is not None:
            filled = filled.fillna(known)
        if len(filled) and pd.notna(filled.iloc[-1]):
            state.update((filled.iloc[-1],))
        yield pdf.assign(**{column: filled})

    state = T.StructType([T.StructField("last", kind)])
    return events.groupBy("score_id").applyInPandasWithState(fill, schema, state, "append", GroupStateTimeout.NoTimeout)


def late_counts(notes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of notes with is_late: whether a note lies behind the watermark of its trigger, which is that of all
    scores together (the newest note of the triggers before, less `late`), as it is for `segment_counts`. Late notes
    are kept and marked, not left out. No state is held."""
    from pyspark.sql import types as T
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = T.StructType([*notes.schema.fields, T.StructField("is_late", T.BooleanType())])
    zone = notes.sparkSession.conf.get("spark.sql.session.timeZone")

    def mark(key, frames, state: GroupState):
        import pandas as pd

        behind = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms", tz="UTC").tz_convert(zone).tz_localize(None)
        for pdf in frames:
            yield pdf.assign(is_late=pdf["ts"] < behind)

    state = T.StructType([T.StructField("none", T.IntegerType())])
    return notes.withWatermark("ts", late).groupBy("score_id").applyInPandasWithState(mark, schema, state, "append", GroupStateTimeout.NoTimeout)
