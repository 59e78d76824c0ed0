"""Keys, spellings and pitch classes as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once and written once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _count(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def get_mode(key: Column) -> Column:
    return F.when(F.substring(key, 1, 1).rlike("[A-Z]"), "M").otherwise("m")


def spelling_to_line_of_fifths(spelling: Column, flat: str = "b") -> Column:
    """F is 0, C 1, ...; sharps add 7, flats take 7."""
    letter = F.upper(F.substring(spelling, 1, 1))
    rest = F.substring(spelling, 2, 1000)
    return F.instr(F.lit("FCGDAEB"), letter) - 1 + 7 * (_count(rest, "#") - _count(rest, flat))


def line_of_fifths_to_spelling(i: Column) -> Column:
    letter = F.element_at(F.array(*map(F.lit, "FCGDAEB")), (F.pmod(i, F.lit(7)) + 1).cast("int"))
    turns = F.floor(i / 7).cast("int")
    return F.concat(letter, F.when(turns >= 0, F.repeat(F.lit("#"), turns)).otherwise(F.repeat(F.lit("b"), -turns)))


def tpc_to_name(tpc: Column, minor: bool = False) -> Column:
    """The name of a tonal pitch class (C is 0, G 1, F -1); `minor` gives the letter in lower case: -8 to 'fb'."""
    name = line_of_fifths_to_spelling(tpc + 1)
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1000)) if minor else name


def key_signature(key: Column) -> Column:
    """Sharps (flats are negative) of a spelled key; minor keys are in lower case."""
    return spelling_to_line_of_fifths(key) - 1 - F.when(get_mode(key) == "m", 3).otherwise(0)


def enharmonic_key_signature(key: Column) -> Column:
    sig = F.pmod(key_signature(key), F.lit(12))
    return F.when(sig > 6, sig - 12).otherwise(sig)


def key_pc(key: Column) -> Column:
    return F.pmod((spelling_to_line_of_fifths(key) - 1) * 7, F.lit(12))


def chromatic_key(key: Column) -> Column:
    """'Eb' to '3M'."""
    return F.concat(key_pc(key).cast("int").cast("string"), get_mode(key))


def fold6(i: Column) -> Column:
    """An interval modulo 12 in -6 .. 5."""
    return F.pmod(i + 6, F.lit(12)) - 6


def key_pc_interval(a: Column, b: Column) -> Column:
    return fold6(key_pc(b) - key_pc(a))


def key_change_id(a: Column, b: Column) -> Column:
    return F.concat(key_pc_interval(a, b).cast("int").cast("string"), get_mode(a), get_mode(b))


def pcs_to_hex(pcs: Column) -> Column:
    return F.array_join(F.transform(pcs, lambda x: F.lower(F.hex(x))), "")


def hex_to_pcs(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda x: F.conv(x, 16, 10).cast("int"))


def transpose_pcs(pcs: Column, interval: int) -> Column:
    return F.transform(pcs, lambda x: F.pmod(x + interval, F.lit(12)))


def key_pitch_classes(key: Column) -> Column:
    """The seven pitch classes of a key's scale (harmonic minor)."""
    major, minor = ([0, 2, 4, 5, 7, 9, 11], [0, 2, 3, 5, 7, 8, 11])
    scale = F.when(get_mode(key) == "M", F.array(*map(F.lit, major))).otherwise(F.array(*map(F.lit, minor)))
    return F.transform(scale, lambda x: F.pmod(x + key_pc(key), F.lit(12)).cast("int"))


def fraction_to_float(text: Column) -> Column:
    """'' to null, 'a/b' to the quotient."""
    top, bottom = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    return F.when(text == "", None).when(text.contains("/"), top.try_cast("double") / bottom.try_cast("double")).otherwise(text.try_cast("double"))


def chromatic_transpose(pitch: Column, channel: Column, interval: int) -> Column:
    """Pitch moved, percussion (channel 9) not; a null channel is none."""
    return F.when(channel.eqNullSafe(F.lit(9)), pitch).otherwise(pitch + interval)


# Names of keys by the pitch class of their tonic.
MAJOR_KEYS = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
MINOR_KEYS = ["c", "c#", "d", "eb", "e", "f", "f#", "g", "g#", "a", "bb", "b"]


def _named(pc: Column, mode: Column) -> Column:
    at = pc.cast("int")
    return F.when(mode == "M", F.get(F.array(*map(F.lit, MAJOR_KEYS)), at)).otherwise(F.get(F.array(*map(F.lit, MINOR_KEYS)), at))


def pc_and_mode_to_key(text: Column) -> Column:
    """'6.0M' to 'Gb'."""
    return _named(F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.right(text, F.lit(1)))


def simplify_enharmonic_key(key: Column) -> Column:
    """The usual name of a key, one of 24."""
    return _named(key_pc(key), get_mode(key))


def key_sharps_interval(a: Column, b: Column) -> Column:
    return fold6(key_signature(b) - key_signature(a))


def transpose_spelling(spelling: Column, interval: int) -> Column:
    """A spelled pitch moved along the line of fifths; case stays, 'na' and null pass."""
    moved = line_of_fifths_to_spelling(spelling_to_line_of_fifths(spelling) + interval)
    cased = F.when(get_mode(spelling) == "M", moved).otherwise(F.concat(F.lower(F.substring(moved, 1, 1)), F.substring(moved, 2, 1000)))
    return F.when(spelling == "na", spelling).otherwise(cased)


def transpose_fifths(pitch: Column, interval: int) -> Column:
    """A MIDI pitch moved by so many fifths, folded into less than an octave (-5 .. 6)."""
    step = 7 * interval % 12
    return pitch + (step - 12 if step > 6 else step)


# Fifths from the tonic to each step, and steps whose own keys are minor, by mode of the key.
STEPS = {"M": {"I": 0, "II": 2, "III": 4, "IV": -1, "V": 1, "VI": 3, "VII": 5}, "m": {"I": 0, "II": 2, "III": -3, "IV": -1, "V": 1, "VI": -4, "VII": -2}}
MINOR_STEPS = {"M": ["II", "III", "VI", "VII"], "m": ["II", "IV", "V", "#VI", "#VII"]}
#: An irregular entry: flat VII of minor.
FLAT_SEVENTH_OF_MINOR = -13


def tonicization_to_key(secondary: Column, key: Column, case_matters: bool = False, simplify: bool = True, told_mode: Column | None = None) -> Column:
    """The key that a secondary degree makes a tonic of. Its mode is `told_mode` where that is M or m, else follows the
    degree's case where `case_matters`, else the scale. Degrees that are none leave the key as it is."""
    signs, numeral = F.regexp_extract(secondary, "^([b#]?)([IViv]+)$", 1), F.upper(F.regexp_extract(secondary, "^([b#]?)([IViv]+)$", 2))
    own = get_mode(key)

    def by_mode(f):
        return F.when(own == "M", f("M")).otherwise(f("m"))

    base = by_mode(lambda m: F.try_element_at(F.create_map(*(F.lit(x) for pair in STEPS[m].items() for x in pair)), numeral))
    offset = F.when((own == "m") & (signs == "b") & (numeral == "VII"), FLAT_SEVENTH_OF_MINOR).otherwise(base + F.when(signs == "b", -7).when(signs == "#", 7).otherwise(0))
    plain_tonic = (signs == "") & (numeral == "I")
    table = by_mode(lambda m: F.when(F.concat(signs, numeral).isin(MINOR_STEPS[m]), "m").otherwise("M"))
    mode = F.when(F.right(secondary, F.lit(1)).rlike("[a-z]"), "m").otherwise("M") if case_matters else table
    mode = mode if told_mode is None else F.when(told_mode.isin("M", "m"), told_mode).otherwise(mode)
    place = F.struct((spelling_to_line_of_fifths(key) + offset).alias("at"), mode.alias("mode"))

    def named(x: Column) -> Column:
        if simplify:
            return _named(F.pmod((x["at"] - 1) * 7, F.lit(12)), x["mode"])
        return let(line_of_fifths_to_spelling(x["at"]), lambda n: F.when(x["mode"] == "M", n).otherwise(F.concat(F.lower(F.substring(n, 1, 1)), F.substring(n, 2, 1000))))

    return F.coalesce(F.when(~plain_tonic, let(place, named)), key)


def key_signature_of(pc: Column, mode: Column) -> Column:
    """Sharps (flats below zero) of the key on a pitch class, -5 to 6; minor keys have those of the major key
    a minor third above. Null if either is null."""
    around = F.pmod(F.pmod(pc + F.when(mode == "m", 3).otherwise(0), F.lit(12)) * 7, F.lit(12)).cast("int")
    return F.when(mode.isNotNull(), F.when(around > 6, around - 12).otherwise(around))
