"""Copies of scores for training: transposed, stretched, shuffled. Random choices hang on `seed` and the row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.features import scale_time_sigs

#: Mean length of a note from which scores are stretched downwards rather than up.
MEAN_DURATION = 0.6547


def _lot(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def aug_within_range(notes: DataFrame, low: float, high: float, min_trans: int = -5, max_trans: int = 6) -> DataFrame:
    """A copy for each transposition of the given bounds that leaves every pitch of a score from low to high."""
    ends = notes.where("type = 'note'").groupBy("score_id").agg(F.min("pitch").alias("__a"), F.max("pitch").alias("__b"))
    lo, hi = F.greatest(F.lit(min_trans), F.ceil(F.lit(low) - F.col("__a"))).cast("int"), F.least(F.lit(max_trans), F.floor(F.lit(high) - F.col("__b"))).cast("int")
    steps = ends.where(lo <= hi).select("score_id", F.explode(F.sequence(lo, hi)).alias("transposed_by"))
    return notes.join(steps, "score_id").withColumn("pitch", F.col("pitch") + F.col("transposed_by"))


def aug_by_trans(notes: DataFrame, n_keys: int, low: float = 21, high: float = 108, seed: int = 0) -> DataFrame:
    """`n_keys` of the twelve transpositions from -5 to 6, drawn for each score, where the score stays in the range."""
    per = Window.partitionBy("score_id").orderBy(_lot(seed, "score_id", "transposed_by"))
    drawn = notes.select("score_id").distinct().withColumn("transposed_by", F.explode(F.sequence(F.lit(-5), F.lit(6)))).withColumn("__k", F.row_number().over(per)).where(F.col("__k") <= n_keys).drop("__k")
    return aug_within_range(notes, low, high).join(drawn, ["score_id", "transposed_by"])


def aug_rhythms(df: DataFrame, n_possibilities: int = 2, threshold: float = MEAN_DURATION) -> DataFrame:
    """Copies of each score with times scaled by 1, 2, 4 … or, where notes are long on the mean, 1, 1/2, 1/4 …"""
    mean = df.where("type = 'note'").groupBy("score_id").agg(F.avg(F.col("release") - F.col("onset")).alias("__mean"))
    powers = F.explode(F.sequence(F.lit(0), F.lit(n_possibilities - 1)))
    factors = mean.withColumn("__p", powers).select("score_id", F.pow(F.lit(2.0), F.when(F.col("__mean") >= threshold, -F.col("__p")).otherwise(F.col("__p"))).alias("rhythms_scaled_by"))
    out = df.join(factors, "score_id")
    if "other" in df.columns:
        parts = [scale_time_sigs(out.where(F.col("rhythms_scaled_by") == f), f) for f in sorted({2.0**s for p in range(n_possibilities) for s in (p, -p)})]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    return out.withColumn("onset", F.col("onset") * F.col("rhythms_scaled_by")).withColumn("release", F.col("release") * F.col("rhythms_scaled_by"))


def shuffle_pitches(notes: DataFrame, seed: int = 0) -> DataFrame:
    """Pitches of a score change places at random; all else stays."""
    place = F.row_number().over(Window.partitionBy("score_id").orderBy("row_id"))
    drawn = F.row_number().over(Window.partitionBy("score_id").orderBy(_lot(seed, "row_id"), "row_id"))
    rows = notes.withColumn("__k", place)
    pitches = notes.select("score_id", "pitch", drawn.alias("__k"))
    return rows.drop("pitch").join(pitches, ["score_id", "__k"]).drop("__k")


def shuffle_slices(sliced: DataFrame, seed: int = 0) -> DataFrame:
    """Slices of a score, rests included, come in random order, one right after the other."""
    per, drawn = Window.partitionBy("score_id").orderBy("onset"), Window.partitionBy("score_id").orderBy(_lot(seed, "score_id", "onset"), "onset")
    one = sliced.groupBy("score_id", "onset").agg(F.max("release").alias("release"))
    rests = one.withColumn("__next", F.lead("onset").over(per)).where("__next > release").select("score_id", F.col("release").alias("onset"), F.col("__next").alias("release"))
    laid = one.unionByName(rests).withColumn("__d", F.col("release") - F.col("onset")).withColumn("__to", F.sum("__d").over(drawn.rowsBetween(Window.unboundedPreceding, 0)))
    moved = sliced.join(laid.select("score_id", "onset", "__to", "__d"), ["score_id", "onset"])
    return moved.withColumn("onset", F.col("__to") - F.col("__d")).withColumn("release", F.col("__to")).drop("__to", "__d")
