"""Formats and checks of chord tables; key signatures and transposition of whole scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions import keys as K

# Columns of the formats, and what may stand in them.
JOINED = ("onset", "key", "degree", "quality", "inversion")
SPLIT = ("onset", "key", "primary_degree", "primary_alteration", "secondary_degree", "secondary_alteration", "quality", "inversion")
RN = ("onset", "key", "rn")
ALTERATIONS = ["_", "#", "b", "##", "bb"]
DEGREE = r"\A[#b]*[IViv]+(/[#b]*[IViv]+[mM]?)?\z"
ANY_KEY = r"\A[A-Ga-g](#*|b*)\z"


def detect_format(chords: DataFrame) -> str:
    """joined (a column degree), split (four columns), rn (one numeral) or unknown."""
    for name, needed in (("joined", JOINED), ("split", SPLIT), ("rn", RN)):
        if set(needed) <= set(chords.columns):
            return name
    return "unknown"


def _of_schema(chords: DataFrame, told: str, check_types: bool, strict: bool) -> list[tuple]:
    out = []
    if told == "unknown":
        out.append(("error", None, "no known format"))
    elif check_types:
        numbers = [c for c in ("onset", "release", "inversion") if c in chords.columns]
        texts = {"joined": ["key", "quality", "degree"], "split": [*SPLIT[1:7], "secondary_mode"], "rn": ["key", "rn"]}[told]
        out += [("error", c, "must be a number") for c in numbers if not isinstance(chords.schema[c].dataType, T.NumericType)]
        out += [("error", c, "must be text") for c in [*texts, "chord_pcs"] if c in chords.columns and not isinstance(chords.schema[c].dataType, T.StringType)]
    if strict:
        known = {"joined": JOINED, "split": (*SPLIT, "secondary_mode"), "rn": RN, "unknown": (*JOINED, *SPLIT, *RN)}[told]
        other = sorted(set(chords.columns) - {*known, "release", "chord_pcs", "score_id", "row_id"})
        out += [("error", c, "unknown column") for c in other]
    return out


def check_chords(
    chords: DataFrame, told: str = "auto", check_types: bool = True, check_values: bool = True, strict: bool = False, null_chord: str = "na", null_alteration: str = "_",
    allow_enharmonic: bool = False,
) -> DataFrame:
    """severity, column, message, n_bad, score_id, place: one row for each rule that the table breaks, with the score
    and place (by row_id, else onset) of its first bad row; rules of the schema have no place. Values are
    checked in one pass. `strict` makes errors of warnings and of unknown columns."""
    told = detect_format(chords) if told == "auto" else told
    schema = _of_schema(chords, told, check_types, strict)
    wrong = {c for _, c, _ in schema}
    has = lambda c: c in chords.columns and c not in wrong
    col = F.col
    rules: list[tuple[str, str, str, Column]] = []
    if check_values and told != "unknown":
        if has("key"):
            sound = (col("key") == null_chord) | (col("key").rlike(ANY_KEY) if allow_enharmonic else col("key").isin([*K.MAJOR_KEYS, *K.MINOR_KEYS]))
            rules.append(("error", "key", "no key", ~sound & ((col("key") != "") if told == "rn" else F.lit(True))))
            if told == "rn":
                rules.append(("error", "key", "the first row needs a key", (col("__place") == 1) & (col("key").isNull() | (col("key") == ""))))
        if told == "joined" and has("degree"):
            rules.append(("error", "degree", "no degree", (col("degree") != null_chord) & ~col("degree").rlike(DEGREE)))
        if told == "split":
            rules += [("error", c, "no alteration", ~col(c).isin([*ALTERATIONS, null_chord, null_alteration])) for c in ("primary_alteration", "secondary_alteration") if has(c)]
            rules += [("error", c, "no mode", ~col(c).isin("m", "M", null_chord, null_alteration)) for c in ("secondary_mode",) if has(c)]
        if told != "rn" and has("inversion"):
            rules.append(("error", "inversion", "no inversion", ~col("inversion").isin(0, 1, 2, 3)))
        if has("chord_pcs"):
            rules.append(("error", "chord_pcs", "no hex digits", ~col("chord_pcs").rlike(r"\A[0-9a-f]*\z")))
        late = "error" if strict else "warning"
        if has("onset"):
            rules.append((late, "onset", "onsets go back", col("onset") < col("__before")))
            if has("release"):
                rules.append((late, "release", "release before onset", col("release") < col("onset")))
    out = "severity string, column string, message string, n_bad long, score_id " + (chords.schema["score_id"].dataType.simpleString() if "score_id" in chords.columns else "long") + ", place long"
    found = chords.sparkSession.createDataFrame([(*s, None, None, None) for s in schema], out)
    if not rules:
        return found
    rows = chords if "score_id" in chords.columns else chords.withColumn("score_id", F.lit(0).cast("long"))
    per = Window.partitionBy("score_id").orderBy("row_id" if "row_id" in chords.columns else "onset")
    rows = rows.withColumns({"__before": F.lag("onset").over(per), "__place": F.row_number().over(per)})
    broken = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("column"), F.lit(m).alias("message"))) for s, c, m, bad in rules)))
    each = rows.select("score_id", F.col("__place").cast("long").alias("place"), F.explode(broken).alias("rule"))
    few = each.groupBy("rule", "score_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    bad = few.groupBy("rule").agg(F.sum("n").alias("n_bad"), F.min(F.struct("score_id", "place")).alias("at"))
    return found.unionByName(bad.select("rule.severity", "rule.column", "rule.message", "n_bad", "at.score_id", "at.place"))


def assert_valid_chords(chords: DataFrame, **how) -> None:
    """ValueError if a check gives an error; one row for each rule reaches the driver."""
    errors = check_chords(chords, **how).where("severity = 'error'").collect()
    if errors:
        told = (f"{r.column or 'table'}: {r.message}" + (f" ({r.n_bad} rows, the first at {r.place} of score {r.score_id})" if r.n_bad else "") for r in errors)
        raise ValueError("the chord table fails: " + "; ".join(sorted(told)))


def no_notes(df: DataFrame) -> bool:
    """Whether there is no note at all (no row, for tables without a column type)."""
    return (df.where("type = 'note'") if "type" in df.columns else df).isEmpty()


def add_key_signature(df: DataFrame) -> DataFrame:
    """key_signature: sharps, flats below zero, from key_pc and mode, else from key; null where these are."""
    if {"key_pc", "mode"} <= set(df.columns):
        return df.withColumn("key_signature", K.key_signature_of(F.col("key_pc"), F.col("mode")))
    if "key" in df.columns:
        return df.withColumn("key_signature", K.key_signature(F.col("key")))
    raise ValueError("a key signature needs key, or key_pc and mode")


def transpose_to_key(
    df: DataFrame, new_key_sig: int, key_sig: str = "global_key_sig", pitch_columns: tuple[str, ...] = ("pitch",), spelled_columns: tuple[str, ...] = (), pc_columns: tuple[str, ...] = (),
    key_sig_columns: tuple[str, ...] = (), key_sig_class_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Rows moved along the line of fifths from the signature in `key_sig` (a column: each score has its own) to
    `new_key_sig`; that column and transposed_by_n_sharps tell it. Pitches go the nearest way, six half tones up
    rather than down; percussion (channel 9) stays. Spellings keep their case; null and 'na' stay, and so do
    rows without a signature."""
    by = F.coalesce(F.lit(new_key_sig) - F.col(key_sig), F.lit(0))
    around = F.pmod(by * 7, F.lit(12))
    step = F.when(around > 6, around - 12).otherwise(around)
    drum = F.coalesce(F.col("channel") == 9, F.lit(False)) if "channel" in df.columns else F.lit(False)
    new = {c: F.when(drum, F.col(c)).otherwise(F.col(c) + step) for c in pitch_columns}
    new |= {c: F.when(by == 0, F.col(c)).otherwise(K.transpose_spelling(F.col(c), by)) for c in spelled_columns}
    new |= {c: F.pmod(F.col(c) + step, F.lit(12)) for c in pc_columns}
    new |= {c: F.col(c) + by for c in key_sig_columns}
    for c in key_sig_class_columns:
        x = F.pmod(F.col(c) + by, F.lit(12))
        new[c] = F.when(x > 6, x - 12).otherwise(x)
    done = F.coalesce(F.col("transposed_by_n_sharps"), F.lit(0)) if "transposed_by_n_sharps" in df.columns else F.lit(0)
    new |= {"transposed_by_n_sharps": done + by, key_sig: F.when(F.col(key_sig).isNotNull(), F.lit(new_key_sig))}
    return df.withColumns(new)
