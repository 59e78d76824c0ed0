"""Pitch classes of Roman numerals, by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.keys import get_mode, key_pc, let

# Places of the seven degrees above the tonic, and the notes of each quality above its root
# (of augmented sixths above the tonic of the key, the flat sixth degree first).
DEGREES = ["I", "II", "III", "IV", "V", "VI", "VII"]
MAJOR = [0, 2, 4, 5, 7, 9, 11]
MINOR = [0, 2, 3, 5, 7, 8, 10]
QUALITIES = {
    "M": [0, 4, 7], "m": [0, 3, 7], "o": [0, 3, 6], "+": [0, 4, 8],
    "Mm7": [0, 4, 7, 10], "MM7": [0, 4, 7, 11], "M7": [0, 4, 7, 11], "mm7": [0, 3, 7, 10], "m7": [0, 3, 7, 10], "mM7": [0, 3, 7, 11], "o7": [0, 3, 6, 9], "ø7": [0, 3, 6, 10],
}
SIXTHS = {"It": [8, 0, 6], "Fr": [8, 0, 2, 6], "Ger": [8, 0, 3, 6]}


def _map(values: dict) -> Column:
    """A constant map of numbers or lists of numbers."""
    shown = {k: f"array({', '.join(map(str, v))})" if isinstance(v, list) else str(v) for k, v in values.items()}
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in shown.items()) + ")")


def _above(degree: Column, minor: Column, raised: Column) -> Column:
    """Half tones from a tonic to a degree with its signs; in minor the sixth and seventh are a half tone
    higher where `raised`. Null if it is no degree."""
    def place(p: Column) -> Column:
        low = F.try_element_at(_map(dict(zip(DEGREES, MINOR))), p["name"]) + F.when(p["raised"] & p["name"].isin("VI", "VII"), 1).otherwise(0)
        step = F.when(p["minor"], low).otherwise(F.try_element_at(_map(dict(zip(DEGREES, MAJOR))), p["name"]))
        return step + F.char_length(F.replace(p["signs"], F.lit("b"), F.lit(""))) * 2 - F.char_length(p["signs"])

    name = F.upper(F.regexp_extract(degree, r"\A[#b]*([IViv]+)", 1))
    return let(F.struct(F.regexp_extract(degree, r"\A([#b]*)", 1).alias("signs"), name.alias("name"), minor.alias("minor"), raised.alias("raised")), place)


def chord_pitch_classes(degree: Column, quality: Column, inversion: Column, key: Column) -> Column:
    """Pitch classes of a chord from its bass up. `degree` may have a secondary degree ("V/ii"), which
    names the key that the degree is of: major if in upper case, else minor. In minor the sixth and
    seventh degrees are raised for chords with a minor third ("viio") and not for those with a major one ("VII").
    Augmented sixths stand on the flat sixth degree whatever `degree` says. Null where a part is
    null or not known, or where the chord has no such inversion.

    Each step is worked out once and handed to the next."""
    first, second = (F.split_part(degree, F.lit("/"), F.lit(k)) for k in (1, 2))
    told = F.struct(first.alias("first"), second.alias("second"), F.regexp_extract(second, r"[#b]*(.*)", 1).rlike("[iv]").alias("small"), (get_mode(key) == "m").alias("minor"), key_pc(key).alias("pc"))

    def tonic(t: Column) -> Column:
        away = t["second"] != ""
        there = t["pc"] + F.when(away, _above(t["second"], t["minor"], t["small"])).otherwise(0)
        return F.struct(t["first"].alias("first"), there.alias("tonic"), F.when(away, t["small"]).otherwise(t["minor"]).alias("minor"))

    def base(t: Column) -> Column:
        """Where the chord's notes are counted from, and the notes."""
        sixth = F.try_element_at(_map(SIXTHS), quality)
        root = t["tonic"] + _above(t["first"], t["minor"], F.coalesce(quality.rlike("^[moø]"), F.lit(False)))
        return F.struct(F.when(sixth.isNotNull(), t["tonic"]).otherwise(root).alias("from"), F.coalesce(sixth, F.try_element_at(_map(QUALITIES), quality)).alias("steps"), inversion.cast("int").alias("i"))

    def turned(t: Column) -> Column:
        pcs = F.transform(F.concat(F.slice(t["steps"], t["i"] + 1, F.size(t["steps"])), F.slice(t["steps"], F.lit(1), t["i"])), lambda x: F.pmod(t["from"] + x, F.lit(12)).cast("int"))
        return F.when(t["from"].isNotNull() & t["i"].between(0, F.size(t["steps"]) - 1), pcs)

    return F.when(quality.isNotNull() & degree.isNotNull() & key.isNotNull(), let(let(let(told, tonic), base), turned))
