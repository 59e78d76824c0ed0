"""Roman numerals against spelled pitches, as Column expressions over the line of fifths.

A numeral is counted from the scale of its key, natural minor for minor keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.keys import STEPS, get_mode, let, line_of_fifths_to_spelling, spelling_to_line_of_fifths

#: Numerals in the order of the line of fifths, from the tonic.
BY_FIFTHS = ["I", "V", "II", "VI", "III", "VII", "IV"]
NUMERAL = r"\A([#b]*)([IViv]+)\z"


def _signs(n: Column) -> Column:
    """'##' for 2, 'b' for -1."""
    return F.when(n >= 0, F.repeat(F.lit("#"), n.cast("int"))).otherwise(F.repeat(F.lit("b"), (-n).cast("int")))


def pitch_fifths(pitch: Column) -> Column:
    """Place of a spelled pitch on the line of fifths; flats may be written b or -."""
    return let(F.replace(pitch, F.lit("-"), F.lit("b")), spelling_to_line_of_fifths)


def fifths_to_rn(fifths: Column, key: Column, mode: Column) -> Column:
    """The numeral of a place on the line of fifths in a key, in lower case where `mode` is 'm'."""
    scale = {m: F.array(*(F.lit(STEPS[m][n]) for n in BY_FIFTHS)) for m in "Mm"}

    def told(x: Column) -> Column:
        at = (F.pmod(x["offset"], F.lit(7)) + 1).cast("int")
        base = F.when(x["minor"], F.element_at(scale["m"], at)).otherwise(F.element_at(scale["M"], at))
        numeral = F.element_at(F.array(*map(F.lit, BY_FIFTHS)), at)
        return F.concat(let((x["offset"] - base) / 7, _signs), F.when(x["mode"] == "m", F.lower(numeral)).otherwise(numeral))

    place = F.struct((fifths - spelling_to_line_of_fifths(key)).alias("offset"), (get_mode(key) == "m").alias("minor"), mode.alias("mode"))
    return F.when(fifths.isNotNull() & key.isNotNull(), let(place, told))


def spelled_pitch_to_rn(pitch: Column, key: Column, mode: Column) -> Column:
    """'Eb' in C to 'bIII', in lower case where `mode` is 'm'. Flats may be written b or -."""
    return fifths_to_rn(pitch_fifths(pitch), key, mode)


def split_alteration(rn: Column) -> tuple[Column, Column]:
    """'bVII' to ('b', 'VII'); without signs ('_', ..)."""
    signs = F.regexp_extract(rn, r"\A([#b]*)", 1)
    return F.when(signs == "", "_").otherwise(signs), F.regexp_extract(rn, r"\A[#b]*(.*)\z", 1)


def rn_to_fifths(rn: Column, key: Column) -> Column:
    """Place of a numeral's root on the line of fifths. Of the sixth and seventh step of minor, capitals
    mean the lower one and small letters the raised one; a sign that says so again changes
    nothing. Null for no numeral."""
    def table(mode: str, numeral: Column) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for pair in STEPS[mode].items() for x in pair)), numeral)

    def place(x: Column) -> Column:
        up = F.upper(x["n"])
        moving, small = x["minor"] & up.isin("VI", "VII"), x["n"] == F.lower(x["n"])
        turns = F.char_length(F.regexp_replace(x["s"], "b", "")) - F.char_length(F.regexp_replace(x["s"], "#", ""))
        turns = F.when(moving & small, F.when(x["s"] == "#", 1).otherwise(turns + 1)).when(moving & (x["s"] == "b"), 0).otherwise(turns)
        return F.when(x["minor"], table("m", up)).otherwise(table("M", up)) + 7 * turns

    parts = F.struct(F.regexp_extract(rn, NUMERAL, 1).alias("s"), F.regexp_extract(rn, NUMERAL, 2).alias("n"), (get_mode(key) == "m").alias("minor"))
    return spelling_to_line_of_fifths(key) + let(parts, place)


def rn_to_spelled_pitch(rn: Column, key: Column, flat: str = "-") -> Column:
    """'bIII' in C to 'E-'."""
    return let(rn_to_fifths(rn, key), lambda i: F.replace(line_of_fifths_to_spelling(i), F.lit("b"), F.lit(flat)))


def get_mode_from_rn_str(rn: Column) -> Column:
    return F.when(F.right(rn, F.lit(1)).rlike("[IV]"), "M").when(F.right(rn, F.lit(1)).rlike("[iv]"), "m")


def match_pitch_case_to_rn_mode(rn: Column, pitch: Column) -> Column:
    """The pitch as a key's name: in lower case after a numeral in lower case."""
    return F.when(get_mode_from_rn_str(rn) == "M", F.concat(F.upper(F.substring(pitch, 1, 1)), F.lower(F.substring(pitch, 2, 1000)))).otherwise(F.lower(pitch))


def handle_nested_secondary_rns(token: Column, mode_or_key: Column) -> Column:
    """'V/V/V' in major ('M', or a key) to 'VI': a numeral of numerals as one of the key, folded from the right. The
    case of the first part stays. A leading slash is allowed, no text is 'I'; null where a part is no numeral."""
    key = F.when(mode_or_key == "M", "C").when(mode_or_key == "m", "c").otherwise(mode_or_key)

    def fold(state: Column, part: Column) -> Column:
        inner = match_pitch_case_to_rn_mode(state["rn"], rn_to_spelled_pitch(state["rn"], state["key"], "b"))
        mode = get_mode_from_rn_str(part)
        rn = let(F.struct(inner.alias("inner"), mode.alias("mode")), lambda x: fifths_to_rn(rn_to_fifths(part, x["inner"]), state["key"], x["mode"]))
        return F.struct(rn.alias("rn"), state["key"].alias("key"))

    def whole(parts: Column) -> Column:
        start = F.struct(F.element_at(parts, 1).alias("rn"), key.alias("key"))
        return F.aggregate(F.slice(parts, 2, F.size(parts)), start, fold)["rn"]

    text = F.ltrim(token, F.lit("/"))
    return F.when(text == "", "I").otherwise(let(F.reverse(F.split(text, "/")), whole))


def _translated(part: Column) -> Column:
    sixth, plain = r"\AA6(Ger|Fr|It)(.*)\z", r"\A([b#]*)([IV]+)(.*)\z"
    signs, degree, rest = (F.regexp_extract(part, plain, k) for k in (1, 2, 3))
    first = F.substring(rest, 1, 1)
    numeral = F.when(first.isin("m", "o"), F.lower(degree)).otherwise(degree)
    figure = F.when(first.isin("M", "m"), F.substring(rest, 2, 1000)).otherwise(rest)
    return (
        F.when(part.rlike(sixth), F.concat(F.regexp_extract(part, sixth, 1), F.regexp_extract(part, sixth, 2)))
        .when(part == "xaug665", "Ger65").when(part == "xaug643", "Fr43").when(part.startswith("xaug6"), "It6")
        .when(part.rlike(plain), F.concat(signs, numeral, figure)).when(part.rlike(r"\A[b#]*[iv]"), None).otherwise(part)
    )


def translate_rns(rn: Column) -> Column:
    """Numerals in capitals with their quality told ('IVm6/bIIm') to numerals whose case tells it ('iv6/bii'). Augmented
    sixths ('A6Ger65', 'xaug643') to their names. Parts in small letters are mal-formed: the whole is null; what is
    no numeral stays."""
    parts = F.transform(F.split(rn, "/"), lambda p: _translated(p))
    return let(parts, lambda x: F.when(F.forall(x, lambda p: p.isNotNull()), F.array_join(x, "/")))
