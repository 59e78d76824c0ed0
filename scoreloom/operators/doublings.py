"""Doublings between instruments and repeated bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.order import ffill
from scoreloom.plans.stages import staged

#: Bars searched for repeats at once; a longer score is searched in such chunks.
MOST_BARS = 512


def unison_runs(notes: DataFrame, min_length: int = 2, ticks: int = 16) -> DataFrame:
    """Runs of at least `min_length` notes that two instruments of a score have alike (quantized times, pitch): one row per
    note of a run, with the instruments `a` < `b`. Equal notes of one instrument count once, so a note meets at most one
    of each other instrument; runs are diagonals of the two instruments' note numbers."""
    token = ["__o", "__r", "pitch"]
    q = notes.where("type = 'note' and pitch is not null and instrument is not null").withColumn("__o", F.rint(F.col("onset") * ticks)).withColumn("__r", F.rint(F.col("release") * ticks))
    own = q.select("score_id", "instrument", *token).distinct().withColumn("k", F.row_number().over(Window.partitionBy("score_id", "instrument").orderBy(*token)))
    a, b = own.select("score_id", *token, F.col("instrument").alias("a"), F.col("k").alias("ka")), own.select("score_id", *token, F.col("instrument").alias("b"), F.col("k").alias("kb"))
    met = a.join(b, ["score_id", *token]).where("a < b").withColumn("d", F.col("ka") - F.col("kb"))
    diagonal = Window.partitionBy("score_id", "a", "b", "d").orderBy("ka")
    run = met.withColumn("run", F.col("ka") - F.row_number().over(diagonal))
    size = F.count(F.lit(1)).over(Window.partitionBy("score_id", "a", "b", "d", "run"))
    return run.withColumn("length", size).where(F.col("length") >= min_length).select("score_id", "a", "b", *token, "length")


def dedouble_unisons_across_instruments(notes: DataFrame, min_length: int = 2, ticks: int = 16) -> DataFrame:
    """Notes without the runs of `unison_runs`, which stay in the instrument that sorts first."""
    lost = unison_runs(notes, min_length, ticks).select("score_id", F.col("b").alias("instrument"), "pitch", "__o", "__r").distinct()
    q = notes.withColumn("__o", F.rint(F.col("onset") * ticks)).withColumn("__r", F.rint(F.col("release") * ticks))
    return q.join(lost, ["score_id", "instrument", "pitch", "__o", "__r"], "left_anti").select(*notes.columns)


def bar_fingerprints(df: DataFrame) -> DataFrame:
    """score_id, bar_number, onset, dur, fp: a digest of a bar's length and of its notes (instrument, pitch, times in the bar
    to ten places). Needs bar_number on every row and released bars."""
    bars = df.where("type = 'bar'").select("score_id", "bar_number", F.col("onset").alias("__bar"), (F.col("release") - F.col("onset")).alias("dur"))
    inside = lambda c: F.round(F.col(c) - F.col("__bar"), 10) + 0.0
    note = F.struct("instrument", "pitch", inside("onset").alias("a"), inside("release").alias("b"))
    content = df.where("type = 'note'").join(bars.select("score_id", "bar_number", "__bar"), ["score_id", "bar_number"]).groupBy("score_id", "bar_number").agg(F.sort_array(F.collect_list(note)).alias("n"))
    return bars.join(content, ["score_id", "bar_number"], "left").select("score_id", "bar_number", F.col("__bar").alias("onset"), "dur", F.md5(F.to_json(F.struct(F.round("dur", 10).alias("d"), "n"))).alias("fp"))


def kept_bars(prints: list) -> list[int]:
    """Indices left when, from the first bar on and for the shortest period first, copies of a sequence that follow it at
    once are taken out, again and again until nothing changes. Periods end where the first bar comes again, so only these are
    tried."""
    number: dict = {}
    own, left, before = [number.setdefault(p, len(number)) for p in prints], list(range(len(prints))), None
    while before != len(left):
        before, i = len(left), 0
        while i < len(own):
            size, j, most = 0, i, (len(own) + i) // 2
            for _ in range(own[i + 1 : most + 1].count(own[i])):
                j = own.index(own[i], j + 1)
                if (j == i + 1 or own[i + 1] == own[j + 1]) and own[i:j] == own[j : 2 * j - i]:
                    size = j - i
                    break
            if not size:
                i += 1
                continue
            end = i + size
            while own[end : end + size] == own[i : i + size]:
                end += size
            del own[i + size : end], left[i + size : end]
    return left


def remove_repeated_bars(df: DataFrame, most_bars: int = MOST_BARS) -> DataFrame:
    """Scores without bars that repeat what came right before them; later rows move forward. Python sees only digests,
    of at most `most_bars` bars at a time. Rows before the first bar stay."""
    df = staged(df)
    bars = bar_fingerprints(df).withColumn("__i", F.row_number().over(Window.partitionBy("score_id").orderBy("onset")) - 1).withColumn("__chunk", F.floor(F.col("__i") / most_bars))

    @F.pandas_udf("array<boolean>")
    def search(chunks: pd.Series) -> pd.Series:
        out = []
        for prints in chunks:
            kept = np.zeros(len(prints), bool)
            kept[kept_bars(list(prints))] = True
            out.append(kept)
        return pd.Series(out)

    per = Window.partitionBy("score_id").orderBy("bar_number").rowsBetween(Window.unboundedPreceding, -1)
    chunks = bars.groupBy("score_id", "__chunk").agg(F.sort_array(F.collect_list(F.struct("onset", "bar_number", "dur", F.unhex("fp").alias("fp")))).alias("b"))
    judged = chunks.withColumn("k", search("b.fp")).select("score_id", F.explode(F.arrays_zip("b", "k")).alias("x")).select("score_id", "x.b.bar_number", "x.b.dur", F.col("x.k").alias("kept"))
    shift = judged.withColumn("__shift", F.coalesce(F.sum(F.when(~F.col("kept"), F.col("dur")).otherwise(0.0)).over(per), F.lit(0.0))).select("score_id", "bar_number", "kept", "__shift")
    out = df.join(shift, ["score_id", "bar_number"], "left").where(F.coalesce("kept", F.lit(True)))
    moved = lambda c: F.col(c) - F.coalesce("__shift", F.lit(0.0))
    return out.withColumn("onset", moved("onset")).withColumn("release", moved("release")).select(*df.columns)


def align_onsets(*parts: DataFrame) -> list[DataFrame]:
    """Monophonic parts cut at all onsets and releases of any of them: each row of a part becomes the stretches between
    neighbouring moments that it spans."""
    moments = None
    for p in parts:
        m = p.select("score_id", F.explode(F.array("onset", "release")).alias("t"))
        moments = m if moments is None else moments.unionByName(m)
    moments = moments.distinct()
    out = []
    for p in parts:
        # one sorted pass: each moment meets the row that began last, if it still sounds
        row = F.struct(*p.columns)
        both = moments.withColumn("__side", F.lit(1)).unionByName(p.select("score_id", F.col("onset").alias("t"), F.lit(0).alias("__side"), row.alias("__row")), allowMissingColumns=True)
        at = both.withColumn("__row", ffill("__row", Window.partitionBy("score_id").orderBy("t", "__side"))).where("__side = 1")
        at = at.withColumn("__next", F.lead("t").over(Window.partitionBy("score_id").orderBy("t"))).where("__next is not null and t < __row.release")
        out.append(at.select(*(F.col("t").alias(c) if c == "onset" else F.col("__next").alias(c) if c == "release" else F.col(f"__row.{c}").alias(c) for c in p.columns)))
    return out
