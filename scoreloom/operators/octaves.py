"""Doublings at the octave, between instruments and within one.

A doubled passage with a note that is the lowest of all that sound at its onset is a bass: its
upper voice goes. In any other the lower voice goes. Octaves are found by equi-joins on onset,
end and pitch moved by the interval, so notes of an onset are not paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.slices import BUCKET, sounding
from scoreloom.plans.stages import staged

OCTAVES = (12, 24, 36)


def _prepared(notes: DataFrame, instruments: tuple[str, ...], ticks: int, release_ticks: int | None) -> DataFrame:
    """Notes as score_id, row_id, inst, pitch, o, r (times in ticks, the end in its own), raw onset, and low, the
    lowest pitch of the score that sounds at o."""
    inst = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in instruments))
    whole = notes.where("type = 'note' and pitch is not null and onset is not null and release is not null")
    q = whole.select("score_id", "row_id", inst.alias("inst"), F.col("pitch").cast("double").alias("pitch"), F.rint(F.col("onset") * ticks).alias("o"), F.rint(F.col("release") * (release_ticks or ticks)).alias("r"), "onset")
    spans = q.select("score_id", "pitch", F.col("o").alias("onset"), (F.col("r") * (ticks / (release_ticks or ticks))).alias("release"))
    at = q.select("score_id", F.col("o").alias("t")).distinct()
    low = sounding(spans, at, BUCKET * ticks).groupBy("score_id", "t").agg(F.min("pitch").alias("low")).withColumnRenamed("t", "o")
    return staged(q.join(low, ["score_id", "o"], "left"))


def octave_streaks(pairs: DataFrame, max_gap: int, max_distance: float | None) -> DataFrame:
    """Adds `streak`, the number of the pair that began it, to pairs (score_id, a, b, interval, at, k, low_pitch, and more).

    Pairs of one interval of the parts a and b are followed from onset to onset, `at` counting the
    onsets that matter. Each streak, the oldest first, goes on with the pair left whose lower pitch
    is nearest to its last one (at most `max_distance` off; of equals the first by `k`); it ends
    when more than `max_gap` onsets pass without one. Pairs that no streak takes begin one. The
    pairs of two parts are streamed in order; open streaks alone are held."""
    keys = ["score_id", "a", "b", "interval"]
    dealt = pairs.repartition(*keys).sortWithinPartitions(*keys, "at", "k")
    names = [*pairs.columns, "streak"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, count, streaks, waiting, done = None, None, 0, [], [], []
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            for *own, at, low in zip(*(b.column(c).to_pylist() for c in (*keys, "at", "low_pitch"))):
                if own != key or at != now:
                    done += _take(streaks, waiting, max_gap, max_distance)
                    waiting = []
                    if own != key:
                        key, count, streaks = own, 0, []
                    now = at
                waiting.append((at, low, count))
                count += 1
            while held and len(done) >= held[0].num_rows:  # all pairs of this batch are settled
                first = held.pop(0)
                yield pa.RecordBatch.from_arrays([*first.columns, pa.array(done[: first.num_rows], pa.int64())], names=names)
                done = done[first.num_rows :]
        done += _take(streaks, waiting, max_gap, max_distance)
        for first in held:
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(done[: first.num_rows], pa.int64())], names=names)
            done = done[first.num_rows :]

    return dealt.mapInArrow(numbered, pairs.withColumn("streak", F.lit(0).cast("long")).schema)


def _take(streaks: list[list], pairs: list[tuple[int, float, int]], max_gap: int, max_distance: float | None) -> list[int]:
    """The streak of each pair of one onset; open streaks (last onset, last lower pitch, number) are brought up to it."""
    if not pairs:
        return []
    at = pairs[0][0]
    free, number = list(range(len(pairs))), [-1] * len(pairs)
    streaks[:] = [s for s in streaks if at - s[0] - 1 <= max_gap]
    for s in streaks:
        near = [(abs(pairs[i][1] - s[1]), i) for i in free if max_distance is None or abs(pairs[i][1] - s[1]) <= max_distance]
        if near:
            _, i = min(near)
            free.remove(i)
            s[0], s[1], number[i] = at, pairs[i][1], s[2]
    for i in free:
        number[i] = pairs[i][2]
        streaks.append([at, pairs[i][1], pairs[i][2]])
    return number


def _lost_in_streaks(pairs: DataFrame, min_length: int, max_gap: int, max_distance: float | None) -> DataFrame:
    """score_id, row_id of the notes to drop for streaks of at least `min_length` pairs."""
    told = octave_streaks(pairs, max_gap, max_distance)
    one = Window.partitionBy("score_id", "a", "b", "interval", "streak")
    told = told.withColumn("length", F.count(F.lit(1)).over(one)).withColumn("bass", F.bool_or(F.coalesce(F.col("low_pitch") <= F.col("low"), F.lit(False))).over(one))
    return told.where(F.col("length") >= min_length).select("score_id", F.when(F.col("bass"), F.col("high_id")).otherwise(F.col("low_id")).alias("row_id")).distinct()


def _octaves(q: DataFrame, intervals: tuple[int, ...], same_part: bool, match_releases: bool) -> DataFrame:
    """Pairs of notes of an onset an interval apart: low_id, high_id, low_pitch, low_inst, high_inst, interval, score_id, o."""
    lower = q.select("score_id", "o", F.col("r").alias("low_r"), F.col("inst").alias("low_inst"), F.col("row_id").alias("low_id"), F.col("pitch").alias("low_pitch"), "low", F.explode(F.array(*map(F.lit, intervals))).alias("interval")).withColumn("high_pitch", F.col("low_pitch") + F.col("interval"))
    upper = q.select("score_id", "o", F.col("r").alias("high_r"), F.col("inst").alias("high_inst"), F.col("row_id").alias("high_id"), F.col("pitch").alias("high_pitch"))
    parts = F.col("low_inst") == F.col("high_inst")
    met = lower.join(upper, ["score_id", "o", "high_pitch"]).where(parts if same_part else ~parts)
    return met.where("low_r = high_r") if match_releases else met


def _without(notes: DataFrame, lost: DataFrame) -> DataFrame:
    return notes.join(lost, ["score_id", "row_id"], "left_anti").select(*notes.columns)


def dedouble_octaves_within_instrument(
    notes: DataFrame, instruments: tuple[str, ...] = ("instrument",), min_length: int = 3, ticks: int = 16, release_ticks: int | None = None, match_releases: bool = True,
    max_gap: int = 0, intervals: tuple[int, ...] = OCTAVES, max_distance: float = 12,
) -> DataFrame:
    """Rows without one voice of each passage that an instrument plays in octaves over at least
    `min_length` onsets of its own. The bass is the lowest of all instruments. Other rows, and
    notes without pitch or times, stay; row_id must be unique in a score."""
    q = _prepared(notes, instruments, ticks, release_ticks)
    own = q.withColumn("at", F.dense_rank().over(Window.partitionBy("score_id", "inst").orderBy("o")).cast("long"))
    at = own.select("score_id", F.col("inst").alias("low_inst"), "o", "at").distinct()
    k = F.row_number().over(Window.partitionBy("score_id", "low_inst", "interval", "o").orderBy("low_pitch", "low_id", "high_id"))
    pairs = _octaves(q, intervals, True, match_releases).join(at, ["score_id", "low_inst", "o"]).withColumn("k", k)
    pairs = pairs.select("score_id", F.col("low_inst").alias("a"), F.col("high_inst").alias("b"), "interval", "at", "k", "low_pitch", "low", "low_id", "high_id")
    return _without(notes, _lost_in_streaks(pairs, min_length, max_gap, max_distance))


def octave_passages(q: DataFrame, min_length: int) -> DataFrame:
    """Passages of at least `min_length` notes in a row that two instruments play alike but for octaves: one row per
    pair of notes, with score_id, a, b, d, run and the notes' pitches and ids. A passage is a
    diagonal of the two instruments' note numbers."""
    own = q.withColumn("k", F.row_number().over(Window.partitionBy("score_id", "inst").orderBy("onset", "pitch", "row_id"))).withColumn("pc", F.pmod("pitch", F.lit(12.0)))
    side = lambda s: own.select("score_id", "o", "r", "pc", *(["low"] if s == "a" else []), *(F.col(c).alias(f"{s}_{c}") for c in ("inst", "k", "pitch", "row_id")))
    met = side("a").join(side("b"), ["score_id", "o", "r", "pc"]).where("a_inst < b_inst").withColumn("d", F.col("a_k") - F.col("b_k"))
    diagonal = Window.partitionBy("score_id", "a_inst", "b_inst", "d").orderBy("a_k")
    runs = met.withColumn("run", F.col("a_k") - F.row_number().over(diagonal))
    one = Window.partitionBy("score_id", "a_inst", "b_inst", "d", "run")
    return runs.withColumn("length", F.count(F.lit(1)).over(one)).where(F.col("length") >= min_length)


def dedouble_octaves(notes: DataFrame, instruments: tuple[str, ...] = ("instrument",), min_length: int = 3, ticks: int = 16, release_ticks: int | None = None, intervals: tuple[int, ...] = OCTAVES) -> DataFrame:
    """Rows without one voice of each passage that two instruments play in octaves or in unison.

    First whole passages, note after note; then, with what is left, streaks of octaves between two
    instruments of which one plays chords, over the onsets that both have. Of a passage in unison
    the instrument that sorts first stays. Each passage is judged as a whole. Other rows, and
    notes without pitch or times, stay; row_id must be unique in a score."""
    q = _prepared(notes, instruments, ticks, release_ticks)
    told = octave_passages(q, min_length)
    one = Window.partitionBy("score_id", "a_inst", "b_inst", "d", "run")
    bass = F.bool_or(F.coalesce(F.least("a_pitch", "b_pitch") <= F.col("low"), F.lit(False))).over(one)
    told = told.withColumns({"bass": bass, "a_mean": F.avg("a_pitch").over(one), "b_mean": F.avg("b_pitch").over(one)})
    drops_a: Column = F.when(F.col("bass"), F.col("a_mean") > F.col("b_mean")).otherwise(F.col("a_mean") < F.col("b_mean"))
    lost = told.select("score_id", F.when(drops_a, F.col("a_row_id")).otherwise(F.col("b_row_id")).alias("row_id")).distinct()
    lost = staged(lost)

    chordal = q.groupBy("score_id", "inst", "o").count().where("count > 1").select("score_id", F.col("inst").alias("chordal")).distinct()
    rest = staged(q.join(lost, ["score_id", "row_id"], "left_anti"))
    pairs = staged(_octaves(rest, intervals, False, True)).withColumns({"a": F.least("low_inst", "high_inst"), "b": F.greatest("low_inst", "high_inst")})
    parts = pairs.select("score_id", "a", "b").distinct().join(chordal, "score_id").where("chordal = a or chordal = b").select("score_id", "a", "b").distinct()
    has = rest.select("score_id", "inst", "o").distinct()
    shared = parts.join(has.withColumnRenamed("inst", "a"), ["score_id", "a"]).join(has.withColumnRenamed("inst", "b"), ["score_id", "b", "o"])
    at = shared.withColumn("at", F.dense_rank().over(Window.partitionBy("score_id", "a", "b").orderBy("o")).cast("long"))
    own = F.when(F.col("low_inst") == F.col("a"), F.col("low_pitch")).otherwise(F.col("high_pitch"))
    k = F.row_number().over(Window.partitionBy("score_id", "a", "b", "interval", "o").orderBy(own, "low_pitch", "low_id", "high_id"))
    pairs = pairs.join(at, ["score_id", "a", "b", "o"]).withColumn("k", k).select("score_id", "a", "b", "interval", "at", "k", "low_pitch", "low", "low_id", "high_id")
    return _without(notes, lost.unionByName(_lost_in_streaks(pairs, min_length, 0, None)).distinct())
