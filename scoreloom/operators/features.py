"""Derived columns: instruments, programs, scale degrees, time signatures, places in bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import keys as K
from scoreloom.operators.order import ffill, order


def add_default(df: DataFrame, column: str, value: int) -> DataFrame:
    """`column` with nulls replaced by `value`; made where it is missing."""
    old = F.col(column) if column in df.columns else F.lit(None).cast("int")
    return df.withColumn(column, F.coalesce(old, F.lit(value)))


def add_default_velocity(df: DataFrame, velocity: int = 96) -> DataFrame:
    return add_default(df, "velocity", velocity)


def add_default_midi_instrument(df: DataFrame, instrument: int = 0) -> DataFrame:
    return add_default(df, "midi_instrument", instrument)


def instruments_to_midi_instruments(df: DataFrame, translation: dict[str, int], default: int = 0, strict: bool = False) -> DataFrame:
    """midi_instrument by the name in `instrument`; other names get `default`, or end the job where `strict`."""
    table = F.create_map(*(F.lit(x) for pair in translation.items() for x in pair))
    found = F.try_element_at(table, F.col("instrument"))
    if strict:
        found = F.when(found.isNull() & F.col("instrument").isNotNull(), F.raise_error(F.concat(F.lit("no program for "), "instrument")).cast("int")).otherwise(found)
    return df.withColumn("midi_instrument", F.coalesce(found, F.lit(default)))


def make_instruments_explicit(df: DataFrame, default: int = 0) -> DataFrame:
    """midi_instrument of every row: the last `program` of a program_change of its track (null is a track of its own)."""
    over = Window.partitionBy("score_id", "track").orderBy(*order_keys())
    program = F.when(F.col("type") == "program_change", F.col("program"))
    return df.withColumn("midi_instrument", F.coalesce(ffill(program, over), F.lit(default)))


def order_keys() -> list[Column]:
    return [F.asc_nulls_last("onset"), (F.col("type") == "note").cast("int"), F.asc_nulls_last("row_id")]


def explicit_instruments_to_program_changes(df: DataFrame) -> DataFrame:
    """One program_change row (score_id, track, channel, onset, program) wherever midi_instrument changes in a track and channel."""
    over = Window.partitionBy("score_id", "track", "channel").orderBy(*order_keys())
    notes = df.where("type = 'note'").withColumn("__last", F.lag("midi_instrument").over(over))
    return notes.where(~F.col("midi_instrument").eqNullSafe(F.col("__last"))).select("score_id", F.lit("program_change").alias("type"), "track", "channel", "onset", F.col("midi_instrument").alias("program"))


def concatenate_features(df: DataFrame, features: list[str]) -> DataFrame:
    """A column named after all features holds their texts in a row; 'na' if one is null or 'na'."""
    name = "_".join(features)
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    texts = [F.col(c).cast("string") for c in features]
    whole = F.concat(*texts)
    bad = whole.isNull()
    for t in texts:
        bad = bad | (t == "na")
    return df.withColumn(name, F.when(bad, "na").otherwise(whole))


def spell_pitch(pitch: Column) -> Column:
    """The spelling from Ab to C# on the line of fifths; a pitch alone tells no more."""
    i = F.pmod(F.pmod(pitch.cast("int"), F.lit(12)) * 7, F.lit(12)) + 1
    return K.line_of_fifths_to_spelling(F.when(i > 8, i - 12).otherwise(i))


def scale_degree(spelling: Column, key: Column) -> Column:
    """Accidentals and step of a spelled pitch in a key, such as '#4'; minor keys count from natural minor."""
    minor = K.get_mode(key) == "m"
    diff = K.spelling_to_line_of_fifths(spelling) - K.spelling_to_line_of_fifths(key)
    moved = diff + F.when(minor, 4).otherwise(1)
    step = F.when(minor, F.get(F.array(*map(F.lit, (6, 3, 7, 4, 1, 5, 2))), F.pmod(moved, F.lit(7)).cast("int"))).otherwise(F.get(F.array(*map(F.lit, (4, 1, 5, 2, 6, 3, 7))), F.pmod(moved, F.lit(7)).cast("int")))
    signs = F.floor(moved / 7).cast("int")
    return F.concat(F.when(signs < 0, F.repeat(F.lit("b"), -signs)).otherwise(F.repeat(F.lit("#"), signs)), step.cast("string"))


def add_scale_degrees(df: DataFrame) -> DataFrame:
    """scale_degree of notes from spelling and key; 'na' for other rows and where either is null or 'na'."""
    known = (F.col("type") == "note") & (F.col("key") != "na") & (F.col("spelling") != "na")
    return df.withColumn("scale_degree", F.coalesce(F.when(known, scale_degree(F.col("spelling"), F.col("key"))), F.lit("na")))


def decompose_scale_degrees(df: DataFrame, max_alteration: int = 2) -> DataFrame:
    """scale_degree_step and scale_degree_alteration ('_' for none, 'x' for more than `max_alteration` signs)."""
    note = (F.col("type") == "note") & (F.col("scale_degree") != "na")
    signs = F.regexp_extract("scale_degree", r"^(\D*)", 1)
    shown = F.when(signs == "", "_").when(F.length(signs) > max_alteration, "x").otherwise(signs)
    return df.withColumn("scale_degree_step", F.coalesce(F.when(note, F.regexp_extract("scale_degree", r"(\d+)", 1)), F.lit("na"))).withColumn("scale_degree_alteration", F.coalesce(F.when(note, shown), F.lit("na")))


def reduced_time_signature(numerator: Column, denominator: Column, max_exponent: int = 6, notes_per_bar: int = 2) -> Column:
    """struct numerator, denominator: both halved while the denominator is over 2 ** `max_exponent` and both are even;
    then the numerator loses its least prime factor while it is over `notes_per_bar` denominators."""
    start = F.struct(numerator.cast("long").alias("n"), denominator.cast("long").alias("d"))
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, lambda s, _: F.when((s["d"] > 2**max_exponent) & (s["n"] % 2 == 0) & (s["d"] % 2 == 0), F.struct(F.floor(s["n"] / 2).alias("n"), F.floor(s["d"] / 2).alias("d"))).otherwise(s))

    def less(s, _):
        factor = F.array_min(F.filter(F.sequence(F.lit(2).cast("long"), F.greatest(s["n"], F.lit(2).cast("long"))), lambda x: s["n"] % x == 0))
        return F.when(s["n"] > notes_per_bar * s["d"], F.struct(F.floor(s["n"] / factor).alias("n"), s["d"].alias("d"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), halved, less)


def _signature(df: DataFrame, change) -> DataFrame:
    sign = F.from_json("other", "numerator long, denominator long")
    new = change(sign["numerator"], sign["denominator"])
    text = F.to_json(F.struct(new["n"].alias("numerator"), new["d"].alias("denominator")))
    return df.withColumn("other", F.when(F.col("type") == "time_signature", text).otherwise(F.col("other")))


def simplify_time_sigs(df: DataFrame) -> DataFrame:
    return _signature(df, reduced_time_signature)


def scale_time_sigs(df: DataFrame, factor: float) -> DataFrame:
    """Time signatures of music that is stretched `factor` times, a power of two: the denominator takes it, the numerator what is left."""
    from math import log2

    if factor <= 0 or log2(factor) % 1:
        raise ValueError("factor must be a power of two")

    def change(n, d):
        whole = d / factor
        return F.struct((n * F.greatest(F.lit(1.0), 1 / whole)).cast("long").alias("n"), F.greatest(F.lit(1.0), whole).cast("long").alias("d"))

    return _signature(df, change)


def split_long_bars(df: DataFrame) -> DataFrame:
    """Bars longer than their time signature become bars of its length; the last keeps the release. Needs time_sig_dur and released bars."""
    n = F.greatest(F.lit(0), F.ceil((F.col("release") - F.col("onset")) / F.col("time_sig_dur")) - 1).cast("long")
    bars = df.where("type = 'bar'").withColumn("__end", F.col("release")).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    start = F.col("onset") + F.col("__k") * F.col("time_sig_dur")
    cut = bars.withColumn("release", F.least("__end", start + F.col("time_sig_dur"))).withColumn("onset", start)
    return df.where(~F.coalesce(F.col("type") == "bar", F.lit(False))).unionByName(cut.drop("__k", "__end"))


def has_pickup(df: DataFrame) -> DataFrame:
    """score_id, pickup: whether the first bar is shorter than the time signature, if the first of these stands at 0, or else
    than the second bar, if there is one. Bars that tell no release last to the next. Scores without bars are
    not listed."""
    at = Window.partitionBy("score_id", "type").orderBy(F.asc_nulls_last("onset"))
    sign = F.from_json("other", "numerator double, denominator double") if "other" in df.columns else F.struct(F.lit(None).cast("double").alias("numerator"), F.lit(None).cast("double").alias("denominator"))
    marks = df.where("type in ('bar', 'time_signature')").select("score_id", "type", "onset", (F.coalesce("release", F.lead("onset").over(at)) - F.col("onset")).alias("dur"), (sign["numerator"] * 4 / sign["denominator"]).alias("sign"), F.row_number().over(at).alias("k"))
    nth = lambda kind, k, value: F.max(F.when((F.col("type") == kind) & (F.col("k") == k), F.col(value)))
    told = marks.groupBy("score_id").agg(nth("bar", 1, "k").alias("bars"), nth("bar", 1, "dur").alias("a"), nth("bar", 2, "dur").alias("b"), nth("time_signature", 1, "onset").alias("at"), nth("time_signature", 1, "sign").alias("sign"))
    pickup = F.when(F.col("at") == 0, F.col("a") < F.col("sign")).otherwise(F.col("a") < F.col("b"))
    return told.where("bars is not null").select("score_id", F.coalesce(pickup, F.lit(False)).alias("pickup"))


def bar_and_offset(df: DataFrame, moments: DataFrame) -> DataFrame:
    """`moments` (score_id, t) with bar_number and offset in that bar, from the last bar at or before t; one sorted pass. The
    first bar has number 1, or 0 if it is a pickup."""
    bars = df.where("type = 'bar'").select("score_id", F.col("onset").alias("t"), F.lit(0).alias("__side"), F.struct((F.row_number().over(Window.partitionBy("score_id").orderBy("onset"))).alias("n"), "onset").alias("__bar"))
    both = bars.unionByName(moments.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    last = ffill("__bar", Window.partitionBy("score_id").orderBy("t", "__side"))
    found = both.withColumn("__bar", last).where("__side = 1").join(has_pickup(df), "score_id", "left")
    number = F.col("__bar.n").cast("long") - F.when(F.col("pickup"), 1).otherwise(0)
    return found.withColumn("bar_number", number).withColumn("offset", F.col("t") - F.col("__bar.onset")).select(*moments.columns, "bar_number", "offset")


def get_context_bars(df: DataFrame, target_onset: float, n_before: int = 1, n_after: int = 1) -> DataFrame:
    """Rows of the bar that holds `target_onset` and of the bars around it, with the last time signature before them again.
    Needs bar_number on every row."""
    whole = Window.partitionBy("score_id")
    at = F.max(F.when((F.col("type") == "bar") & (F.col("onset") <= target_onset), F.col("bar_number"))).over(whole)
    near = df.withColumn("__at", at).withColumn("__in", F.col("bar_number").between(F.col("__at") - n_before, F.col("__at") + n_after))
    start = F.min(F.when(F.col("__in") & (F.col("type") == "bar"), F.col("onset"))).over(whole)
    sign = F.col("type") == "time_signature"
    last = F.max(F.when(sign & (F.col("onset") <= F.col("__start")), F.col("onset"))).over(whole)
    found = near.withColumn("__start", start).withColumn("__last", last)
    again = sign & (F.col("onset") == F.col("__last"))
    return found.where(F.col("__in") | again).withColumn("onset", F.when(again, F.greatest("onset", "__start")).otherwise(F.col("onset"))).drop("__at", "__in", "__start", "__last")


def add_distinct_slice_ids(sliced: DataFrame) -> DataFrame:
    """distinct_slice_id: a new one at each onset whose set of pitches differs from that of the onset before."""
    one = sliced.groupBy("score_id", "onset").agg(F.sort_array(F.collect_set("pitch")).alias("__set"))
    per = Window.partitionBy("score_id").orderBy("onset")
    ids = one.withColumn("__new", (~F.col("__set").eqNullSafe(F.lag("__set").over(per))).cast("int")).withColumn("distinct_slice_id", F.sum("__new").over(per) - 1)
    return sliced.join(ids.select("score_id", "onset", "distinct_slice_id"), ["score_id", "onset"])


def get_eligible_releases(df: DataFrame) -> DataFrame:
    """score_id, release, row_id: of every release the highest note, the last of equal ones."""
    return df.where("type = 'note'").groupBy("score_id", "release").agg(F.max(F.struct("pitch", "row_id")).alias("m")).select("score_id", "release", "m.row_id")


def label_df(df: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Column `name` from `labels` (row_id, label, place): the label at the highest place wins, rows without one get null."""
    best = labels.groupBy("row_id").agg(F.max_by("label", "place").alias(name))
    return df.join(best, "row_id", "left")


def prime_form(pcs: Column) -> Column:
    """Of the rotations of the distinct pitch classes, each begun at 0, the one that is least when read from its end."""
    s = F.array_sort(F.array_distinct(F.transform(pcs, lambda x: F.pmod(x.cast("int"), F.lit(12)))))
    turns = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.reverse(F.array_sort(F.transform(s, lambda x: F.pmod(x - F.get(s, i), F.lit(12))))))
    return F.when(F.size(s) > 0, F.reverse(F.array_min(turns)))
