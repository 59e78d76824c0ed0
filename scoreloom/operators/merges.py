"""Merging of notes: gaps and islands over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.slices import sounding


def merge_notes(notes: DataFrame, on: tuple[str, ...] = ("type", "pitch")) -> DataFrame:
    """Rows of a score equal in `on` that touch or overlap become one: first onset, last release, and
    merged_ids, the rows' ids. Rows with a null in `on` stay as they are."""
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    per = Window.partitionBy("score_id", *on).orderBy("onset", "release", "row_id")
    reach = F.max("release").over(per.rowsBetween(Window.unboundedPreceding, -1))
    rest = [c for c in notes.columns if c not in ("score_id", "onset", "release", *on)]
    marked = notes.where(known).withColumn("__new", F.when(reach.isNull() | (F.col("onset") > reach), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(per))
    first = F.min_by(F.struct(*rest), F.struct("onset", "release", "row_id")).alias("__first")
    out = marked.groupBy("score_id", *on, "__island").agg(F.min("onset").alias("onset"), F.max("release").alias("release"), F.sort_array(F.collect_list("row_id")).alias("merged_ids"), first)
    out = out.select("score_id", *on, "onset", "release", "merged_ids", *(F.col(f"__first.{c}").alias(c) for c in rest))
    return out.unionByName(notes.where(~known).withColumn("merged_ids", F.array("row_id")))


def merge_contiguous_durations(spans: DataFrame, key: str = "score_id") -> DataFrame:
    """Spans of a key merge where the next onset is exactly the release before."""
    per = Window.partitionBy(key).orderBy("onset", "release")
    marked = spans.withColumn("__new", F.when(F.lag("release").over(per).eqNullSafe(F.col("onset")), 0).otherwise(1))
    marked = marked.withColumn("__island", F.sum("__new").over(per))
    return marked.groupBy(key, "__island").agg(F.min("onset").alias("onset"), F.max("release").alias("release")).drop("__island")


# Columns that tell the instruments of doubled notes apart.
APART = ("instrument", "part", "track", "channel")
#: Columns that tell instruments apart, where a table has them.
INSTRUMENTS = ("instrument", "midi_instrument", "track", "channel")


def merge_repeated_notes(df: DataFrame, max_note_duration: float | None = None, max_gap: float = 0.125, instruments: tuple[str, ...] = INSTRUMENTS, preserve_outer_voices: bool = True) -> DataFrame:
    """Consecutive notes of one instrument and pitch merge if they touch, or if the gap is at most
    `max_gap` and no note of the instrument begins in it; with `max_note_duration` only if the earlier
    is no longer. With `preserve_outer_voices` both must agree in being lowest and being highest at their
    onsets. Equal nulls are one instrument; rows that are no notes or have no pitch stay as they are."""
    is_note = F.coalesce(F.col("pitch").isNotNull() & (F.col("type") == "note"), F.lit(False)) if "type" in df.columns else F.col("pitch").isNotNull()
    notes, group = df.where(is_note), [c for c in instruments if c in df.columns]
    marked = outer_voice_flags(notes, "__lowest", "__highest") if preserve_outer_voices else notes
    # the last distinct onset of the instrument before each onset: none begins in a gap if it is before the gap
    whole = Window.partitionBy("score_id", *group)
    onsets = notes.groupBy("score_id", *group, "onset").agg(F.lit(1).alias("__one")).withColumn("__last", F.lag("onset").over(whole.orderBy("onset"))).drop("__one")
    same = F.lit(True)
    for c in ["score_id", *group, "onset"]:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    marked = marked.alias("n").join(onsets.alias("o"), same).select("n.*", "o.__last")
    per = Window.partitionBy("score_id", *group, "pitch").orderBy("onset", "release", "row_id")
    before = lambda c: F.lag(c).over(per)
    gap = F.col("onset") - before("release")
    joins = (gap <= 1e-6) | ((gap <= max_gap) & (F.col("__last").isNull() | (F.col("__last") < before("release"))))
    if max_note_duration is not None:
        joins = joins & (before("release") - before("onset") <= max_note_duration)
    for f in ("__lowest", "__highest") if preserve_outer_voices else ():
        joins = joins & (before(f) == F.col(f))
    marked = marked.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(per))
    keys = ["score_id", *group, "pitch"]
    rest = [c for c in df.columns if c not in (*keys, "onset", "release")]
    place = F.struct("onset", "release", "row_id")
    out = marked.groupBy(*keys, "__island").agg(F.min("onset").alias("onset"), F.max_by("release", place).alias("release"), F.min_by(F.struct(*rest), place).alias("__first"))
    out = out.select(*keys, "onset", "release", *(F.col(f"__first.{c}").alias(c) for c in rest))
    return out.select(*df.columns).unionByName(df.where(~is_note))


def detremolo(df: DataFrame, max_tremolo_note_length: float = 0.25, max_tremolo_note_gap: float = 0.125, instruments: tuple[str, ...] = INSTRUMENTS, preserve_outer_voices: bool = True) -> DataFrame:
    """Rapid repetitions become one note."""
    return merge_repeated_notes(df, max_tremolo_note_length, max_tremolo_note_gap, instruments, preserve_outer_voices)


def dedouble(notes: DataFrame, ticks: int = 16, also: tuple[str, ...] = (), instruments: tuple[str, ...] | None = None, release_ticks: int | None = None, quantize: bool = True) -> DataFrame:
    """Of rows equal in type, pitch, onset and release (quantized, unless told not to), instrument and `also` the first
    stays; n_doubled counts them. Instruments are told apart by those of APART that there are, or by the
    given columns. Rows with a null key are no doubles."""
    apart = [c for c in APART if c in notes.columns] if instruments is None else list(instruments)
    keys = ["score_id", "type", "pitch", "__o", "__r", *dict.fromkeys([*apart, *also])]
    tick = lambda c, n: F.rint(F.col(c) * n) if quantize else F.col(c)
    q = notes.withColumn("__o", tick("onset", ticks)).withColumn("__r", tick("release", release_ticks or ticks))
    known = F.lit(True)
    for c in keys[1:]:
        known = known & F.col(c).isNotNull()
    per = Window.partitionBy(*keys)
    first = q.where(known).withColumn("__k", F.row_number().over(per.orderBy("row_id"))).withColumn("n_doubled", F.count(F.lit(1)).over(per)).where("__k = 1").drop("__k")
    return first.unionByName(q.where(~known).withColumn("n_doubled", F.lit(1).cast("long"))).drop("__o", "__r")


def return_rests(notes: DataFrame, epsilon: float = 1e-7) -> DataFrame:
    """Gaps between the notes of a score: onset, release. Rows of other types do not count."""
    notes = notes.where("type = 'note'") if "type" in notes.columns else notes
    per = Window.partitionBy("score_id").orderBy("onset", "release", "row_id")
    reach = F.max("release").over(per.rowsBetween(Window.unboundedPreceding, -1))
    return notes.withColumn("__from", reach).where(F.col("onset") - F.col("__from") > epsilon).select("score_id", F.col("__from").alias("onset"), F.col("onset").alias("release"))


def homophonic_layers(notes: DataFrame) -> DataFrame:
    """layer: each note goes to the first layer whose last note has ended at its onset, or has its onset and
    release. Where nothing sounds on from before, all layers are free, so a score is parted there into
    islands, which are dealt over all tasks and streamed in order; only the last note of
    each layer is held."""
    import pyarrow as pa
    from pyspark.sql import types as T

    keys = ["onset", "pitch", "release", "row_id"]
    per = Window.partitionBy("score_id").orderBy(*keys)
    reach = F.max("release").over(per.rowsBetween(Window.unboundedPreceding, -1))
    parted = notes.withColumn("__new", F.when(reach.isNull() | (F.col("onset") >= reach), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(per)).drop("__new")
    dealt = parted.repartition("score_id", "__island").sortWithinPartitions("score_id", "__island", *keys)

    names = [*notes.columns, "layer"]

    def place(batches):
        island, layers = None, []
        for b in batches:
            out = []
            for score, k, onset, release in zip(*(b.column(c).to_pylist() for c in ("score_id", "__island", "onset", "release"))):
                if (score, k) != island:
                    island, layers = (score, k), []
                for i, (o, r) in enumerate(layers):
                    if onset >= r or (onset, release) == (o, r):
                        break
                else:
                    i = len(layers)
                    layers.append(None)
                layers[i] = (onset, release)
                out.append(i)
            yield pa.RecordBatch.from_arrays([*b.drop_columns("__island").columns, pa.array(out, pa.int64())], names=names)

    return dealt.select(*notes.columns, "__island").mapInArrow(place, T.StructType([*notes.schema.fields, T.StructField("layer", T.LongType())]))


def outer_voice_flags(notes: DataFrame, low: str = "is_lowest", high: str = "is_highest") -> DataFrame:
    """Columns `low` and `high`: whether a note is the lowest or highest that sounds at its onset, percussion
    (channel 9) left out; without a column channel nothing is percussion."""
    tuned = F.coalesce(F.col("channel") != 9, F.lit(True)) if "channel" in notes.columns else F.lit(True)
    t = notes.select("score_id", F.col("onset").alias("t")).distinct()
    ends = sounding(notes.where(tuned), t).groupBy("score_id", "t").agg(F.min("pitch").alias("__low"), F.max("pitch").alias("__high")).withColumnRenamed("t", "onset")
    told = {low: F.coalesce(tuned & (F.col("pitch") == F.col("__low")), F.lit(False)), high: F.coalesce(tuned & (F.col("pitch") == F.col("__high")), F.lit(False))}
    return notes.join(ends, ["score_id", "onset"], "left").withColumns(told).drop("__low", "__high")
