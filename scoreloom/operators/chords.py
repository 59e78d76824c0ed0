"""Chord tables: runs, censuses, degrees, tonicizations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.figures import inversion_number_to_figure


def _per() -> Window:
    return Window.partitionBy("score_id").orderBy("onset")


def runs(chords: DataFrame, columns: list[str]) -> DataFrame:
    """Adds run, the number of the run of rows equal in `columns`; a null differs from everything."""
    changed = F.lit(False)
    for c in columns:
        changed = changed | F.coalesce(F.lag(c).over(_per()) != F.col(c), F.lit(True))
    return chords.withColumn("__new", changed.cast("int")).withColumn("run", F.sum("__new").over(_per())).drop("__new")


def modulation_census(chords: DataFrame) -> DataFrame:
    """Runs of one key: onset, key, n_chords, duration (to the next run, the last to its release)."""
    r = runs(chords, ["key"]).groupBy("score_id", "run", "key").agg(F.min("onset").alias("onset"), F.max("release").alias("release"), F.count(F.lit(1)).alias("n_chords"))
    return r.select("score_id", "key", "onset", "n_chords", (F.coalesce(F.lead("onset").over(_per()), "release") - F.col("onset")).alias("duration"))


def split_degrees(chords: DataFrame) -> DataFrame:
    """degree 'bVII/ii' to primary_alteration, primary_degree, secondary_alteration, secondary_degree ('_' and 'I' where absent; null degree: 'na')."""
    first, second = F.split_part("degree", F.lit("/"), F.lit(1)), F.split_part("degree", F.lit("/"), F.lit(2))
    def part(x, pattern, default):
        found = F.regexp_extract(x, r"\A([#b]*)([IViv]*)", pattern)
        return F.coalesce(F.when(found == "", default).otherwise(found), F.lit("na"))
    return chords.withColumn("primary_alteration", part(first, 1, "_")).withColumn("primary_degree", part(first, 2, "I")).withColumn("secondary_alteration", part(second, 1, "_")).withColumn("secondary_degree", part(second, 2, "I"))


def join_degrees(chords: DataFrame) -> DataFrame:
    """The four columns of `split_degrees` to joined_degree; null if one is."""
    return chords.withColumn("joined_degree", _joined())


def tonicization_census(chords: DataFrame) -> DataFrame:
    """Runs of one secondary degree in one key, without those of the tonic."""
    r = runs(split_degrees(chords), ["secondary_alteration", "secondary_degree", "key"])
    g = r.groupBy("score_id", "run", "key", "secondary_alteration", "secondary_degree").agg(F.min("onset").alias("onset"), F.max("release").alias("release"), F.count(F.lit(1)).alias("n_chords"))
    g = g.withColumn("duration", F.coalesce(F.lead("onset").over(_per()), "release") - F.col("onset"))
    return g.where("lower(secondary_degree) <> 'i'").select("score_id", "key", "secondary_degree", "onset", "n_chords", "duration")


def extract_chord_df(labelled: DataFrame, columns: tuple[str, ...] = ("key", "degree", "quality", "inversion")) -> DataFrame:
    """Back from labelled notes to chords: rows at which a label changes, up to the next."""
    one = labelled.groupBy("score_id", "onset").agg(F.max("release").alias("release"), F.min_by(F.struct(*columns), F.struct("pitch", "row_id")).alias("c"))
    flat = one.select("score_id", "onset", "release", *(F.col(f"c.{x}").alias(x) for x in columns))
    r = runs(flat, list(columns)).groupBy("score_id", "run").agg(F.min("onset").alias("onset"), F.first(F.struct(*columns)).alias("c"))
    end = labelled.groupBy("score_id").agg(F.max("release").alias("__end"))
    return r.join(end, "score_id").select("score_id", "onset", F.coalesce(F.lead("onset").over(_per()), "__end").alias("release"), *(F.col(f"c.{x}").alias(x) for x in columns)).where(F.col(columns[0]).isNotNull() & (F.col(columns[0]) != "na"))


#: Qualities that hold one of these are no plausible tonic.
NO_TONIC = r"Mm7|It|Fr|Ger|aug6|o|\+"


def _near(c: str, k: int):
    return F.lag(c).over(_per()) if k < 0 else F.lead(c).over(_per())


def expand_tonicizations(chords: DataFrame, quality: str | None = "quality") -> DataFrame:
    """A chord whose degree a neighbour of the same key has as secondary degree becomes I of it ("vi V/vi" to
    "I/vi V/vi"); V needs both neighbours. Alterations must match, and modes where there is a column
    secondary_mode. With `quality`, chords whose quality fits NO_TONIC stay. Takes split
    degrees, or a column degree, which is then written anew."""
    s = chords if "primary_degree" in chords.columns else split_degrees(chords)
    has = set(s.columns)
    bare = lambda c: c.isin("_", "-", "")
    mode = F.when(F.col(quality).isin("M", "m"), F.col(quality)) if quality else None

    def matches(k: int):
        ok = (F.col("primary_degree") == _near("secondary_degree", k)) & (F.col("key") == _near("key", k))
        if {"primary_alteration", "secondary_alteration"} <= has:
            mine, theirs = F.col("primary_alteration"), _near("secondary_alteration", k)
            ok = ok & ((bare(mine) & bare(theirs)) | (mine == theirs))
        if quality and "secondary_mode" in has:
            ok = ok & (mode == _near("secondary_mode", k))
        return F.coalesce(ok, F.lit(False))

    hit = (F.col("secondary_degree") == "I") & F.when(F.col("primary_degree") == "V", matches(-1) & matches(1)).otherwise(matches(-1) | matches(1))
    if quality:
        hit = hit & ~F.coalesce(F.col(quality).rlike(NO_TONIC), F.lit(False))
    s = s.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    new = {"secondary_degree": F.col("primary_degree"), "primary_degree": F.lit("I")}
    if {"primary_alteration", "secondary_alteration"} <= has:
        new |= {"secondary_alteration": F.col("primary_alteration"), "primary_alteration": F.lit("_")}
    if "secondary_mode" in has:
        last = F.regexp_extract("primary_degree", r"(.)\z", 1)
        new["secondary_mode"] = mode if quality else F.when(last.rlike(r"\p{Lu}"), "M").when(last.rlike(r"\p{Ll}"), "m").otherwise(F.col("secondary_mode"))
    s = s.withColumns({c: F.when(F.col("__hit"), x).otherwise(F.col(c)) for c, x in new.items()})
    if "primary_degree" not in chords.columns:
        s = s.withColumn("degree", F.when(F.col("__hit"), _joined()).otherwise(F.col("degree")))
    return s.select(*chords.columns)


def _joined():
    alt = lambda c: F.when(F.col(c) == "_", "").otherwise(F.col(c))
    full = F.concat(alt("primary_alteration"), "primary_degree", F.lit("/"), alt("secondary_alteration"), "secondary_degree")
    return F.regexp_replace(full, r"/I\z", "")


def merge_annotations(chords: DataFrame, include_key: bool = True) -> DataFrame:
    """annotation: degree, quality (without its 7), figure of the inversion, and the secondary degree
    ("VM6/V"), only where it is new; with the key ("C.") where that is new, and then the degree
    in any case; without the key also where the key is new. Rows that are no notes (by a column type) and labels of 'na' have none of their own."""
    known = lambda c: F.when(F.col(c) != "na", F.col(c))
    first, second = (F.split_part("degree", F.lit("/"), F.lit(k)) for k in (1, 2))
    figure = inversion_number_to_figure(F.col("inversion"), F.col("quality"))
    rn = F.concat(first, F.regexp_replace("quality", "7", ""), F.coalesce(figure, F.lit("")), F.when(second != "", F.concat(F.lit("/"), second)).otherwise(""))
    real = F.coalesce(F.col("type") == "note", F.lit(False)) if "type" in chords.columns else F.lit(True)
    s = chords.withColumn("__rn", F.when(real & known("degree").isNotNull(), rn)).withColumn("__key", known("key"))
    s = s.withColumns({"__all": _filled("__rn"), "__rn": _new_only(F.col("__rn"), ""), "__key": F.concat(_new_only(F.col("__key"), None), F.lit("."))})
    shown = F.when(F.col("__key").isNotNull() & (F.col("__rn") == ""), F.coalesce("__all", F.lit(""))).otherwise(F.col("__rn"))
    text = F.concat(F.coalesce("__key", F.lit("")), shown) if include_key else shown
    return s.withColumn("annotation", text).drop("__rn", "__key", "__all")


def replace_spurious_tonics(chords: DataFrame) -> DataFrame:
    """Split degrees: I of a secondary degree becomes that degree of the key; its alteration comes along."""
    has = set(chords.columns)
    s = chords.withColumn("secondary_degree", F.coalesce("secondary_degree", F.lit("I")))
    s = s.withColumn("__hit", F.coalesce((F.col("primary_degree") == "I") & (F.col("secondary_degree") != "I"), F.lit(False)))
    new = {"primary_degree": F.upper("secondary_degree"), "secondary_degree": F.lit("I")}
    if {"primary_alteration", "secondary_alteration"} <= has:
        new |= {"primary_alteration": F.col("secondary_alteration"), "secondary_alteration": F.lit("_")}
    if "secondary_mode" in has:
        new["secondary_mode"] = F.lit("_")
    return s.withColumns({c: F.when(F.col("__hit"), x).otherwise(F.col(c)) for c, x in new.items()}).select(*chords.columns)


def _filled(column: str):
    return F.last(F.col(column), ignorenulls=True).over(_per().rowsBetween(Window.unboundedPreceding, 0))


def _new_only(value, fill: str | None):
    """`value` where it differs from the last that was not null; elsewhere `fill`."""
    past = F.last(value, ignorenulls=True).over(_per().rowsBetween(Window.unboundedPreceding, -1))
    return F.when(value.isNotNull() & ~past.eqNullSafe(value), value).otherwise(F.lit(fill))


def keep_new_elements_only(df: DataFrame, column: str, fill: str | None = "") -> DataFrame:
    """`column` with `fill` wherever it is null, empty, or repeats the last value that was neither."""
    return df.withColumn(column, _new_only(F.when(F.col(column) != "", F.col(column)), fill))
