"""Histograms, key correlation and group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key profiles from the tonic upwards, major and minor, as published by Krumhansl
# (1990), Aarden (2003) and Temperley (2001, 2007).
PROFILES = {
    "krumhansl": ([6.39, 2.23, 3.48, 2.32, 4.4, 4.11, 2.5, 5.21, 2.37, 3.66, 2.29, 2.88], [6.33, 2.68, 3.51, 5.36, 2.58, 3.5, 2.51, 4.73, 3.96, 2.66, 3.32, 3.14]),
    "aarden": ([12025, 175, 10225, 200, 13400, 7725, 400, 14750, 150, 5525, 325, 3575], [523, 21, 401, 481, 19, 408, 20, 533, 139, 73, 203, 65]),
    "cbms": ([5.0, 2.0, 3.5, 2.0, 4.5, 4.0, 2.0, 4.5, 2.0, 3.5, 1.5, 4.0], [5.0, 2.0, 3.5, 4.5, 2.0, 4.0, 2.0, 4.5, 3.5, 2.0, 1.5, 4.0]),
    "kostka_payne": ([0.748, 0.06, 0.488, 0.082, 0.67, 0.46, 0.096, 0.715, 0.104, 0.366, 0.057, 0.4], [0.712, 0.084, 0.474, 0.618, 0.049, 0.46, 0.105, 0.747, 0.404, 0.067, 0.133, 0.33]),
    "temperley": ([0.811, 0.024, 0.659, 0.074, 0.721, 0.616, 0.117, 0.835, 0.088, 0.43, 0.031, 0.544], [0.786, 0.058, 0.618, 0.734, 0.052, 0.618, 0.185, 0.763, 0.497, 0.104, 0.139, 0.399]),
}
NAMES = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]


def pitch_class(pitch: str | Column = "pitch") -> Column:
    return F.pmod(F.col(pitch) if isinstance(pitch, str) else pitch, F.lit(12)).cast("int")


def pc_distribution(notes: DataFrame, weight_by_duration: bool = True) -> DataFrame:
    """One row per score, pcs: an array of 12 durations (or counts)."""
    w = F.col("release") - F.col("onset") if weight_by_duration else F.lit(1.0)
    bins = [F.sum(F.when(pitch_class() == k, w).otherwise(0.0)) for k in range(12)]
    return notes.groupBy("score_id").agg(F.array(*bins).alias("pcs"))


def all_key_correlations(hist: DataFrame, family: str = "krumhansl") -> DataFrame:
    """score_id, key, r for the 24 keys, from a table with pcs; r is null without variance. Minor keys are
    in lower case. The profiles, turned to each tonic, are a table of 288 rows that is broadcast."""
    turned = [(n if mode == 0 else n.lower(), (tonic + k) % 12, float(p)) for mode, profile in enumerate(PROFILES[family]) for tonic, n in enumerate(NAMES) for k, p in enumerate(profile)]
    table = hist.sparkSession.createDataFrame(turned, "key string, pc int, p double")
    pairs = hist.select("score_id", F.posexplode("pcs").alias("pc", "d")).join(F.broadcast(table), "pc")
    g = pairs.groupBy("score_id", "key").agg(F.covar_pop("d", "p").alias("c"), F.stddev_pop("d").alias("sd"), F.stddev_pop("p").alias("sp"))
    return g.select("score_id", "key", F.when(F.col("sd") > 0, F.col("c") / (F.col("sd") * F.col("sp"))).alias("r"))


def best_key(notes: DataFrame, family: str = "krumhansl") -> DataFrame:
    """score_id, key, r of the best key; ties to the first name."""
    r = all_key_correlations(pc_distribution(notes), family).withColumn("r", F.round("r", 9)).where("r is not null")
    return r.groupBy("score_id").agg(F.max("r").alias("r"), F.min_by("key", F.struct(-F.col("r"), "key")).alias("key"))


def percent_pc_match(notes: DataFrame, pcs: list[int], weight_by_duration: bool = True) -> DataFrame:
    w = F.col("release") - F.col("onset") if weight_by_duration else F.lit(1.0)
    return notes.groupBy("score_id").agg((F.sum(F.when(pitch_class().isin(pcs), w).otherwise(0.0)) / F.sum(w)).alias("match"))


def sync_df(df: DataFrame, by: list[str], value: str, how: str = "mean") -> DataFrame:
    """`value` replaced by its statistic over the rows of the score that are equal in `by`."""
    each = df.groupBy("score_id", *by).agg(getattr(F, how)(value).alias("__v"))
    return df.join(each, ["score_id", *by]).withColumn(value, F.col("__v")).drop("__v")


def find_simultaneous_feature(df: DataFrame, feature: str, values: list) -> DataFrame:
    """Spans (onset, release) of a score whose rows hold all the values in `feature`."""
    have = [F.max(F.when(F.col(feature) == v, 1).otherwise(0)) == 1 for v in values]
    found = df.groupBy("score_id", "onset", "release").agg(F.lit(1).alias("one"), *(h.alias(f"h{k}") for k, h in enumerate(have)))
    for k in range(len(have)):
        found = found.where(f"h{k}")
    return found.select("score_id", "onset", "release")


def figured_bass_class(sliced: DataFrame) -> DataFrame:
    """Per onset the distinct pitch classes above the lowest pitch, as hex digits in order."""
    per = sliced.groupBy("score_id", "onset").agg(F.min("pitch").alias("low"), F.collect_set("pitch").alias("p"))
    pcs = F.array_sort(F.array_distinct(F.transform("p", lambda x: F.pmod(x - F.col("low"), F.lit(12)).cast("int"))))
    return per.select("score_id", "onset", F.array_join(F.transform(pcs, lambda x: F.lower(F.hex(x))), "").alias("figured_bass"))


def appears_salami_sliced(notes: DataFrame) -> DataFrame:
    """score_id, sliced: whether every onset has one release and every release one onset."""
    pairs = notes.select("score_id", "onset", "release").distinct()
    return pairs.groupBy("score_id").agg(((F.count(F.lit(1)) == F.count_distinct("onset")) & (F.count(F.lit(1)) == F.count_distinct("release"))).alias("sliced"))


def unique_annotations_per_onset(df: DataFrame, column: str, fill: str = "") -> DataFrame:
    """`column` only on the lowest note of each onset; rows without a pitch lose it."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("score_id", "onset").orderBy(F.asc_nulls_last("pitch"), "row_id"))
    return df.withColumn("__k", k).withColumn(column, F.when((F.col("__k") == 1) & F.col("pitch").isNotNull(), F.col(column)).otherwise(fill)).drop("__k")


def unique_slices(sliced: DataFrame) -> DataFrame:
    """The first row of each slice: of each onset the row of the least pitch."""
    first = F.min_by(F.struct(*sliced.columns), F.struct("pitch", "row_id")).alias("r")
    return sliced.groupBy("score_id", F.col("onset").alias("__at")).agg(first).select("r.*")
