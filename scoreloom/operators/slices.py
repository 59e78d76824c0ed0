"""Operators that cut notes.

Cuts are found by an equi-join on (score, time bucket): notes are put in each bucket they touch,
moments in one, so neither side is compared with a whole score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a time bucket in quarter notes.
BUCKET = 16.0


def buckets(start: Column, end: Column, width: float = BUCKET) -> Column:
    """Numbers of the buckets that [start, end) touches."""
    lo = F.floor(start / width)
    return F.sequence(lo, F.greatest(F.ceil(end / width) - 1, lo))


def sounding(notes: DataFrame, moments: DataFrame, width: float = BUCKET) -> DataFrame:
    """Pairs of notes and moments (score_id, t) with onset <= t < release."""
    a = notes.withColumn("__b", F.explode(buckets(F.col("onset"), F.col("release"), width)))
    b = moments.withColumn("__b", F.floor(F.col("t") / width))
    return a.join(b, ["score_id", "__b"]).where("onset <= t AND t < release").drop("__b")


def moments(notes: DataFrame) -> DataFrame:
    """Distinct onsets and releases of a score's notes, with the next one."""
    t = notes.select("score_id", F.explode(F.array("onset", "release")).alias("t")).distinct()
    return t.withColumn("next", F.lead("t").over(Window.partitionBy("score_id").orderBy("t")))


def salami_slice(notes: DataFrame, label: bool = True) -> DataFrame:
    """Each note cut at every moment at which some note of the score begins or ends. Notes without length
    vanish. Adds slice_id (number of the distinct onset) and original_note_id."""
    cut = sounding(notes.where("release > onset"), moments(notes)).withColumn("original_note_id", F.col("row_id")).withColumn("onset", F.col("t")).withColumn("release", F.col("next")).drop("t", "next")
    out = cut.withColumn("slice_id", (F.dense_rank().over(Window.partitionBy("score_id").orderBy("onset")) - 1).cast("long"))
    return out if label else out.drop("original_note_id")


def undo_salami_slice(sliced: DataFrame) -> DataFrame:
    """Slices of one note put together again: first onset, last release."""
    rest = [c for c in sliced.columns if c not in ("score_id", "original_note_id", "onset", "release", "slice_id")]
    return sliced.groupBy("score_id", "original_note_id").agg(F.min("onset").alias("onset"), F.max("release").alias("release"), *(F.first(c).alias(c) for c in rest))


def _at_grid(notes: DataFrame, step: float) -> DataFrame:
    k = F.sequence(F.floor(F.col("onset") / step), F.greatest(F.ceil(F.col("release") / step) - 1, F.floor(F.col("onset") / step)))
    return notes.withColumn("__k", F.explode(k)).withColumn("__o", F.greatest("onset", F.col("__k") * step)).withColumn("__r", F.least("release", (F.col("__k") + 1) * step))


def subdivide_notes(notes: DataFrame, grid_size: float) -> DataFrame:
    """Notes cut at multiples of `grid_size`."""
    return _at_grid(notes, grid_size).withColumn("onset", F.col("__o")).withColumn("release", F.col("__r")).drop("__k", "__o", "__r")


def slice_into_uniform_steps(notes: DataFrame, step_dur: float) -> DataFrame:
    """Rows each `step_dur` from a note's onset on. As the original has it, each row shows the state before
    its cut: the first keeps the whole release, row k begins at step k - 1 and ends where it does."""
    n = F.ceil((F.col("release") - F.col("onset")) / step_dur)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)))).alias("__k")
    rows = notes.select("*", k)
    first = F.col("__k") == 0
    start = F.col("onset") + F.greatest(F.col("__k") - 1, F.lit(0)) * step_dur
    return rows.withColumn("__o", F.when(first, F.col("onset")).otherwise(start)).withColumn("__r", F.when(first, F.col("release")).otherwise(start + step_dur)).withColumn("onset", F.col("__o")).withColumn("release", F.col("__r")).drop("__k", "__o", "__r")


def slice_df(notes: DataFrame, boundaries: list[float]) -> DataFrame:
    """Notes cut at the given times, `sliced` tells 'no', 'before' or 'after'. A note over k boundaries gives,
    as the original has it, a pair of parts for each boundary."""
    inner = F.filter(F.array(*map(F.lit, sorted(map(float, boundaries)))), lambda b: (b > F.col("onset")) & (b < F.col("release")))
    part = lambda o, r, s: F.struct(o.alias("o"), r.alias("r"), F.lit(s).alias("s"))
    pairs = F.flatten(F.transform(inner, lambda b: F.array(part(F.col("onset"), b, "before"), part(b, F.col("release"), "after"))))
    rows = F.when(F.size(inner) == 0, F.array(part(F.col("onset"), F.col("release"), "no"))).otherwise(pairs)
    return notes.withColumn("__p", F.explode(rows)).withColumn("onset", F.col("__p.o")).withColumn("release", F.col("__p.r")).withColumn("sliced", F.col("__p.s")).drop("__p")


def split_notes_at_barlines(df: DataFrame, min_overhang_dur: float | None = None) -> DataFrame:
    """Notes cut at the onsets and releases of bars, with tie_to_next and tie_to_prev. Parts shorter than
    `min_overhang_dur` are left out and their ties taken off."""
    notes, bars = df.where("type = 'note'"), df.where("type = 'bar'")
    lines = bars.select("score_id", F.explode(F.array("onset", "release")).alias("t")).where("t is not null").distinct()
    # a note's columns go through the join, so its parts need no join back to it
    begins = notes.withColumn("t", F.col("onset")).unionByName(sounding(notes, lines).where("t > onset"))
    per = Window.partitionBy("score_id", "row_id").orderBy("t")
    parts = begins.withColumn("next", F.lead("t").over(per)).withColumn("__r", F.coalesce("next", "release"))
    if min_overhang_dur is not None:
        only = F.count(F.lit(1)).over(Window.partitionBy("score_id", "row_id")) == 1
        parts = parts.withColumn("__only", only).where(F.col("__only") | (F.col("__r") - F.col("t") >= min_overhang_dur)).drop("__only")
    tied = parts.withColumn("tie_to_prev", F.lag("t").over(per).isNotNull()).withColumn("tie_to_next", F.lead("t").over(per).isNotNull())
    done = tied.withColumn("onset", F.col("t")).withColumn("release", F.col("__r")).drop("t", "next", "__r")
    return done.unionByName(df.where("type <> 'note'"), allowMissingColumns=True)
