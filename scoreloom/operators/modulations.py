"""Rewriting of keys in chord tables: long tonicizations, short modulations, phantom keys.

A table has score_id, onset, key, and either degree ('V/bIII', 'V/IIm') or split columns
primary_degree, secondary_degree with, as it may be, primary_alteration, secondary_alteration
and secondary_mode. Missing keys are those before. Each result has the input's columns, in
the split form a column degree too, written from the split ones.

Everything is a window over a score in the order of its onsets, or over a run of it: one
exchange, by score. Rows of no degree (null or 'na') keep it. Where the table has chord_pcs ('047a'), chords of one key that hold each
other's pitch classes count as one, which is a fold over the chords of a run of one key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.degrees import fifths_to_rn, rn_to_fifths, spelled_pitch_to_rn, split_alteration
from scoreloom.functions.keys import get_mode, key_sharps_interval, tonicization_to_key
from scoreloom.operators.chords import NO_TONIC, replace_spurious_tonics

SPLIT = ["primary_degree", "primary_alteration", "secondary_degree", "secondary_alteration", "secondary_mode"]


def _order() -> Window:
    return Window.partitionBy("score_id").orderBy("onset")


def _so_far() -> Window:
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def split_with_mode(chords: DataFrame) -> DataFrame:
    """Adds the five split columns; signs and modes not there are '_', no second degree is 'I', a
    null degree is 'na' in all of them. Figures ('VIIo6') stay with the first degree."""
    none = F.col("degree").isNull() | (F.col("degree") == "na")
    first, second = F.split_part("degree", F.lit("/"), F.lit(1)), F.regexp_extract("degree", r"\A[^/]*/(.*)\z", 1)
    def part(of: Column, pattern: str, group: int, default: str) -> Column:
        found = F.regexp_extract(of, pattern, group)
        return F.when(none, "na").otherwise(F.when(found == "", default).otherwise(found))
    one, two = r"\A([b#]*)(.*)\z", r"([b#]*)([IViv]+)([mM]?)"
    return chords.withColumns({
        "primary_degree": part(first, one, 2, ""), "primary_alteration": part(first, one, 1, "_"),
        "secondary_degree": part(second, two, 2, "I"), "secondary_alteration": part(second, two, 1, "_"), "secondary_mode": part(second, two, 3, "_"),
    })


def reconstruct_degree(has: set[str]) -> Column:
    """The degree as text from the split columns that are there; '/I' is left out unless its mode says something new."""
    def alt(c: str) -> Column:
        return F.when(F.col(c).isin("_", "-"), "").otherwise(F.col(c)) if c in has else F.lit("")

    mode = F.coalesce("secondary_mode", F.lit("_")) if "secondary_mode" in has else F.lit("_")
    tonic = F.col("secondary_degree") == "I"
    if "secondary_alteration" in has:
        tonic = tonic & F.coalesce(F.col("secondary_alteration").isin("_", "-"), F.lit(False))
    if "key" in has:
        tonic = tonic & ((mode == "_") | (mode == get_mode(F.col("key"))))
    second = F.concat(F.lit("/"), alt("secondary_alteration"), "secondary_degree", F.replace(mode, F.lit("_"), F.lit("")))
    return F.concat(alt("primary_alteration"), "primary_degree", F.when(F.coalesce(tonic, F.lit(False)), "").otherwise(second))


def _rewriting(chords: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Split where needed, rewrite, and back to the columns that came in."""
    joined = not {"primary_degree", "secondary_degree"} <= set(chords.columns)
    if joined and "degree" not in chords.columns:
        raise ValueError("a chord table needs degree, or primary_degree and secondary_degree")
    s = split_with_mode(chords) if joined else chords.withColumn("secondary_degree", F.coalesce("secondary_degree", F.lit("I")))
    if "secondary_mode" in s.columns:
        s = s.withColumn("secondary_mode", F.coalesce("secondary_mode", F.lit("_")))
    s = s.withColumn("key", F.last("key", ignorenulls=True).over(_so_far()))
    s = replace_spurious_tonics(rewrite(s))
    shown = [c for c in s.columns if not (joined and c == "secondary_mode")]
    degree = reconstruct_degree(set(shown))
    s = s.withColumn("degree", F.when(F.col("degree").isNull() | (F.col("degree") == "na"), F.col("degree")).otherwise(degree) if joined else degree)
    return s.select(*chords.columns, *([] if "degree" in chords.columns else ["degree"]))


def _changed(columns: list[str]) -> Column:
    """Whether a row differs from the one before; nulls differ from everything."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lag(c).over(_order()) != F.col(c), F.lit(True))
    return out


def _harmony(columns: list[str]) -> list[str]:
    return ["primary_degree", "secondary_degree", "key"] + [c for c in ("primary_alteration", "secondary_alteration", "secondary_mode", "quality") if c in columns]


def with_new_harmony(chords: DataFrame, name: str = "new_harmony") -> DataFrame:
    """Adds whether a chord is another harmony than the one before: another label (inversions do
    not count), or, with chord_pcs, another key or pitch classes that neither hold nor are
    held by all those of the harmony so far."""
    if "chord_pcs" not in chords.columns:
        return chords.withColumn(name, _changed(_harmony(chords.columns)))
    pcs = F.filter(F.transform(F.split(F.lower("chord_pcs"), ""), lambda x: F.conv(x, 16, 10).cast("int")), lambda x: x.between(0, 11))
    mask = F.aggregate(F.coalesce(pcs, F.array().cast("array<int>")), F.lit(0), lambda a, x: a.bitwiseOR(F.pow(F.lit(2), x).cast("int")))
    s = chords.withColumn("__m", mask).withColumn("__k", _changed(["key"]).cast("int")).withColumn("__k", F.sum("__k").over(_so_far()))
    rows = s.groupBy("score_id", "__k").agg(F.array_sort(F.collect_list(F.struct("onset", "__m", F.struct(*chords.columns).alias("c")))).alias("rows"))
    start = F.struct(F.lit(-1).alias("held"), F.lit("").alias("marks"))

    def fold(state: Column, row: Column) -> Column:
        both = state["held"].bitwiseAND(row["__m"])
        same = (state["held"] >= 0) & ((both == state["held"]) | (both == row["__m"]))
        return F.struct(F.when(same, state["held"].bitwiseOR(row["__m"])).otherwise(row["__m"]).alias("held"), F.concat(state["marks"], F.when(same, "0").otherwise("1")).alias("marks"))

    marked = rows.select(F.aggregate("rows", start, fold)["marks"].alias("marks"), "rows").select("marks", F.posexplode("rows").alias("at", "row"))
    return marked.select("row.c.*", (F.substr("marks", F.col("at") + 1, F.lit(1)) == "1").alias(name))


def _expanded(s: DataFrame) -> DataFrame:
    """A harmony whose degree the harmony before or after has as second degree becomes I of it; V
    needs both. Repeated chords are one harmony; the first degree's signs stay as they are."""
    has = set(s.columns)
    theirs = [c for c in ("secondary_degree", "key", "secondary_alteration", "secondary_mode") if c in has]
    s = s.withColumn("__new", _changed(_harmony(s.columns)))
    s = s.withColumn("__run", F.sum(F.col("__new").cast("int")).over(_so_far())).withColumns({"__lag": F.struct(*(F.lag(c).over(_order()).alias(c) for c in theirs)), "__lead": F.struct(*(F.lead(c).over(_order()).alias(c) for c in theirs)), "__last": F.coalesce(F.lead("__new").over(_order()), F.lit(True))})
    run = Window.partitionBy("score_id", "__run")
    s = s.withColumns({"__before": F.max(F.when(F.col("__new"), F.col("__lag"))).over(run), "__after": F.max(F.when(F.col("__last"), F.col("__lead"))).over(run)})
    bare = lambda c: F.coalesce(c.isin("_", "-", ""), F.lit(False))
    mode = F.when(F.col("quality").isin("M", "m"), F.col("quality")) if "quality" in has else None

    def matches(side: str) -> Column:
        other = F.col(side)
        ok = (F.col("primary_degree") == other["secondary_degree"]) & (F.col("key") == other["key"])
        if {"primary_alteration", "secondary_alteration"} <= has:
            ok = ok & ((bare(F.col("primary_alteration")) & bare(other["secondary_alteration"])) | (F.col("primary_alteration") == other["secondary_alteration"]))
        if mode is not None and "secondary_mode" in has:
            ok = ok & (mode == other["secondary_mode"])
        return F.coalesce(ok, F.lit(False))

    hit = (F.col("secondary_degree") == "I") & F.when(F.col("primary_degree") == "V", matches("__before") & matches("__after")).otherwise(matches("__before") | matches("__after"))
    if mode is not None:
        hit = hit & ~F.coalesce(F.col("quality").rlike(NO_TONIC), F.lit(False))
    new = {"secondary_degree": F.col("primary_degree"), "primary_degree": F.lit("I")}
    if {"primary_alteration", "secondary_alteration"} <= has:
        new["secondary_alteration"] = F.col("primary_alteration")
    if "secondary_mode" in has:
        last = F.right("primary_degree", F.lit(1))
        new["secondary_mode"] = mode if mode is not None else F.when(last.rlike(r"\p{Lu}"), "M").when(last.rlike(r"\p{Ll}"), "m").otherwise(F.col("secondary_mode"))
    s = s.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    return s.withColumns({c: F.when(F.col("__hit"), x).otherwise(F.col(c)) for c, x in new.items()}).drop("__new", "__run", "__lag", "__lead", "__last", "__before", "__after", "__hit")


def _with_alteration(has: set[str]) -> Column:
    if "secondary_alteration" not in has:
        return F.col("secondary_degree")
    alt = F.coalesce(F.when(F.col("secondary_alteration").isin("_", "-", ""), "").otherwise(F.col("secondary_alteration")), F.lit(""))
    return F.concat(alt, "secondary_degree")


def _runs(s: DataFrame, columns: list[str]) -> tuple[DataFrame, Window]:
    """Adds __run, __first, __last of runs equal in `columns`, and the window of a run."""
    s = s.withColumn("__first", _changed(columns))
    s = s.withColumns({"__run": F.sum(F.col("__first").cast("int")).over(_so_far()), "__last": F.coalesce(F.lead("__first").over(_order()), F.lit(True))})
    return s, Window.partitionBy("score_id", "__run")


def remove_long_tonicizations(
    chords: DataFrame, max_duration: float | None = None, max_chords: int | None = None, min_removal_duration: float | None = None, min_removal_chords: int | None = None,
    case_matters: bool = False, simplify: bool = True, ignore_oscillations: bool = True,
) -> DataFrame:
    """Tonicizations longer than `max_duration`, or of more than `max_chords` harmonies, become keys.

    Chords next to a tonicization of their own degree belong to it. A tonicization ends where the
    next begins; the last of a score has no end and counts as long. Those of tonic and dominants
    alone, of three chords or more, are not removed for their number of chords. A removal by
    number needs `min_removal_duration`, one by duration `min_removal_chords`, where given."""
    if max_duration is None and max_chords is None:
        raise ValueError("give max_duration or max_chords")
    if max_chords is not None and min_removal_chords is not None and min_removal_chords > max_chords:
        raise ValueError("min_removal_chords lies above max_chords")
    if max_duration is not None and min_removal_duration is not None and min_removal_duration > max_duration:
        raise ValueError("min_removal_duration lies above max_duration")

    def rewrite(s: DataFrame) -> DataFrame:
        s = with_new_harmony(_expanded(s), "__new")
        has = set(s.columns)
        s, run = _runs(s, ["secondary_degree", "key"] + (["secondary_alteration"] if "secondary_alteration" in has else []))
        modes = F.max(F.when(F.col("__first"), F.col("secondary_mode"))).over(run) if "secondary_mode" in has else F.lit(None).cast("string")
        s = s.withColumn("__after", F.lead("onset").over(_order())).withColumns({
            "__mode": F.when(modes.isin("M", "m"), modes),
            "__n": F.sum((F.col("__new") | F.col("__first")).cast("int")).over(run),
            "__rows": F.count(F.lit(1)).over(run),
            "__long": F.max(F.when(F.col("__last"), F.col("__after"))).over(run) - F.min("onset").over(run),
        })
        minor = F.coalesce(F.col("__mode"), get_mode(F.col("key"))) == "m"
        plain = F.coalesce(F.col("primary_alteration"), F.lit("_")).isin("_", "") if "primary_alteration" in has else F.lit(True)
        sharp = F.coalesce(F.col("primary_alteration") == "#", F.lit(False)) if "primary_alteration" in has else F.lit(False)
        tonic = (F.col("primary_degree") == "I") & plain
        dominant = ((F.col("primary_degree") == "V") & plain) | ((F.col("primary_degree") == "VII") & F.when(minor, sharp).otherwise(plain))
        s = s.withColumns({"__tonic": F.coalesce(tonic, F.lit(False)), "__dominant": F.coalesce(dominant, F.lit(False))})
        swings = (F.col("__rows") >= 3) & F.bool_and(F.col("__tonic") | F.col("__dominant")).over(run) & F.bool_or("__tonic").over(run) & F.bool_or("__dominant").over(run)
        lasts = F.coalesce(F.col("__long"), F.lit(float("inf")))
        gone = F.lit(False)
        if max_chords is not None:
            many = (F.col("__n") > max_chords) & (~swings if ignore_oscillations else F.lit(True))
            gone = gone | (many & (lasts >= min_removal_duration) if min_removal_duration is not None else many)
        if max_duration is not None:
            long = lasts > max_duration
            gone = gone | (long & (F.col("__n") >= min_removal_chords) if min_removal_chords is not None else long)
        s = s.withColumn("__gone", (F.col("secondary_degree") != "I") & gone)
        new = {"key": tonicization_to_key(_with_alteration(has), F.col("key"), case_matters, simplify, F.col("__mode")), "secondary_degree": F.lit("I")}
        new |= {c: F.lit(x) for c, x in (("secondary_alteration", "-"), ("secondary_mode", "_")) if c in has}
        return s.withColumns({c: F.when(F.col("__gone"), x).otherwise(F.col(c)) for c, x in new.items()})

    return _rewriting(chords, rewrite)


def remove_short_modulations(chords: DataFrame, min_duration: float | None = None, min_chords: int | None = None, max_removal_duration: float | None = None, max_removal_chords: int | None = None) -> DataFrame:
    """Modulations shorter than `min_duration`, or of fewer than `min_chords` harmonies, between two
    stretches of one key become tonicizations of that key. The last of a score has no end. A
    removal by number needs a duration of at most `max_removal_duration`, one by duration at
    most `max_removal_chords`, where given.

    Modulations are taken in order, and each sees the ones before it as they have become. After
    a removal the key before the next one is the key it has itself, so it stays: of a row of
    modulations that could all go, the first, third, fifth and so on do."""
    if min_duration is None and min_chords is None:
        raise ValueError("give min_duration or min_chords")
    if min_chords is not None and max_removal_chords is not None and min_chords > max_removal_chords:
        raise ValueError("max_removal_chords lies below min_chords")
    if min_duration is not None and max_removal_duration is not None and min_duration > max_removal_duration:
        raise ValueError("max_removal_duration lies below min_duration")

    def rewrite(s: DataFrame) -> DataFrame:
        s = with_new_harmony(s, "__new")
        has = set(s.columns)
        s, run = _runs(s, ["key"])
        s = s.withColumns({"__lag": F.lag("key").over(_order()), "__lead": F.lead("key").over(_order()), "__after": F.lead("onset").over(_order())})
        s = s.withColumns({
            "__outer": F.max(F.when(F.col("__first"), F.col("__lag"))).over(run), "__next": F.max(F.when(F.col("__last"), F.col("__lead"))).over(run),
            "__long": F.max(F.when(F.col("__last"), F.col("__after"))).over(run) - F.min("onset").over(run), "__n": F.sum(F.col("__new").cast("int")).over(run),
        })
        lasts, short = F.coalesce(F.col("__long"), F.lit(float("inf"))), F.lit(False)
        if min_chords is not None:
            few = F.col("__n") < min_chords
            short = short | (few & (lasts <= max_removal_duration) if max_removal_duration is not None else few)
        if min_duration is not None:
            brief = lasts < min_duration
            short = short | (brief & (F.col("__n") <= max_removal_chords) if max_removal_chords is not None else brief)
        s = s.withColumn("__could", F.coalesce(short & (F.col("__outer") == F.col("__next")), F.lit(False)))
        stays = F.max(F.when(~F.col("__could"), F.col("__run"))).over(_so_far())
        s = s.withColumn("__gone", F.col("__could") & ((F.col("__run") - stays) % 2 == 1))
        nested = F.col("secondary_degree") != "I"
        own = spelled_pitch_to_rn(F.col("key"), F.col("__outer"), get_mode(F.col("key")))
        inner = fifths_to_rn(rn_to_fifths(_with_alteration(has), F.col("key")), F.col("__outer"), F.lit("M"))
        s = s.withColumn("__rn", F.when(nested, inner).otherwise(own)).withColumn("__nested", nested)
        alt, bare = split_alteration(F.col("__rn"))
        new = {"secondary_degree": F.coalesce(F.upper(bare), F.col("secondary_degree")), "key": F.col("__outer")}
        if "secondary_alteration" in has:
            new["secondary_alteration"] = F.coalesce(alt, F.col("secondary_alteration"))
        if "secondary_mode" in has:
            new["secondary_mode"] = F.when(F.col("__nested"), "M").otherwise(get_mode(F.col("key")))
        return s.withColumns({c: F.when(F.col("__gone"), x).otherwise(F.col(c)) for c, x in new.items()})

    return _rewriting(chords, rewrite)


def remove_phantom_keys(chords: DataFrame, case_matters: bool = False, simplify: bool = True) -> DataFrame:
    """Keys in which every chord is tonicized are given to the keys around them.

    Of a stretch of such keys, the chords up to a point between two tonicized keys go to the key
    before and the rest to the key after, so that the distances on the circle of fifths add up
    to least; of equal points the last. Second degrees are told anew in those keys. A stretch
    with no key before goes to the one after and the other way round; with neither it stays."""

    def rewrite(s: DataFrame) -> DataFrame:
        has = set(s.columns)
        s, run = _runs(s, ["key"])
        s = s.withColumn("__phantom", ~F.bool_or(F.coalesce(F.col("secondary_degree") == "I", F.lit(False))).over(run)).drop("__run", "__first", "__last")
        s, run = _runs(s, ["__phantom"])
        mode = F.when(F.col("secondary_mode").isin("M", "m"), F.col("secondary_mode")) if "secondary_mode" in has else F.lit(None).cast("string")
        s = s.withColumns({"__lag": F.lag("key").over(_order()), "__lead": F.lead("key").over(_order()), "__tonic": tonicization_to_key(_with_alteration(has), F.col("key"), case_matters, simplify, mode)})
        s = s.withColumns({"__before": F.max(F.when(F.col("__first"), F.col("__lag"))).over(run), "__after": F.max(F.when(F.col("__last"), F.col("__lead"))).over(run), "__next": F.lead("__tonic").over(_order())})
        gain = F.abs(key_sharps_interval(F.col("__before"), F.col("__tonic"))) - F.abs(key_sharps_interval(F.col("__after"), F.col("__tonic")))
        s = s.withColumn("__gain", F.coalesce(gain, F.lit(0)))
        s = s.withColumn("__sum", F.sum("__gain").over(run.orderBy("onset").rowsBetween(Window.unboundedPreceding, 0)))
        # a block of one tonicized key ends at its last chord; cutting before the first block costs nothing more or less
        ends = F.col("__last") | F.coalesce(F.col("__next") != F.col("__tonic"), F.lit(True))
        s = s.withColumn("__cut", F.max(F.when(ends, F.struct((-F.col("__sum")).alias("gain"), F.col("onset").alias("at")))).over(run))
        to_before = (F.col("__cut.gain") >= 0) & (F.col("onset") <= F.col("__cut.at"))
        neighbour = F.when(F.col("__after").isNull(), F.col("__before")).when(F.col("__before").isNull(), F.col("__after")).when(to_before, F.col("__before")).otherwise(F.col("__after"))
        s = s.withColumn("__to", F.when(F.col("__phantom"), neighbour))
        s = s.withColumn("__rn", spelled_pitch_to_rn(F.col("__tonic"), F.col("__to"), get_mode(F.col("__tonic"))))
        alt, bare = split_alteration(F.col("__rn"))
        own = F.upper(bare) == "I"
        new = {"secondary_degree": F.upper(bare), "key": F.col("__to")}
        if "secondary_alteration" in has:
            new["secondary_alteration"] = F.when(own, "_").otherwise(alt)
        if "secondary_mode" in has:
            new["secondary_mode"] = F.when(own, "_").otherwise(get_mode(F.col("__tonic")))
        return s.withColumns({c: F.when(F.col("__rn").isNotNull(), x).otherwise(F.col(c)) for c, x in new.items()})

    return _rewriting(chords, rewrite)
