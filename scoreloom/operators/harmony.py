"""Figures, key changes, comparison and validation of chord tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import keys as K
from scoreloom.functions.figures import inversion_number_to_figure  # noqa: F401  part of this module too
from scoreloom.functions.numerals import chord_pitch_classes
from scoreloom.operators.chords import runs
from scoreloom.operators.joins import label_notes_with_chords
from scoreloom.operators.order import ffill


def change_rn_mode(numeral: Column, mode: Column) -> Column:
    """A Roman numeral in the case of `mode`; signs before it stay."""
    signs, rest = F.regexp_extract(numeral, r"^([b#]*)", 1), F.regexp_extract(numeral, r"^[b#]*(.*)$", 1)
    return F.concat(signs, F.when(mode == "M", F.upper(rest)).otherwise(F.lower(rest)))


def strip_inversion(numeral: Column) -> Column:
    return F.regexp_replace(numeral, r"[0-9]+$", "")


def extract_key_df(chords: DataFrame) -> DataFrame:
    """score_id, key, onset, release: one row for each run of a key; null and 'na' are left out, the last run ends with the score."""
    r = runs(chords, ["key"]).groupBy("score_id", "run", "key").agg(F.min("onset").alias("onset"), F.max("release").alias("__r"))
    per = Window.partitionBy("score_id").orderBy("onset")
    end = F.coalesce(F.lead("onset").over(per), F.max("__r").over(Window.partitionBy("score_id")))
    return r.withColumn("release", end).where("key is not null and key <> 'na'").select("score_id", "key", "onset", "release")


def key_changes(keys: DataFrame) -> DataFrame:
    """`keys` (score_id, onset, key) with key_change (id of the step from the key before, the key itself on the first row),
    from_previous and from_first (semitones in -6 .. 5)."""
    per = Window.partitionBy("score_id").orderBy("onset")
    before, first = F.lag("key").over(per), F.first("key").over(per)
    k = keys.withColumn("__before", before).withColumn("__first", first)
    step = lambda c: K.key_pc_interval(F.col(c), F.col("key")).cast("int")
    return k.withColumn("key_change", F.coalesce(K.key_change_id(F.col("__before"), F.col("key")), "key")).withColumn("from_previous", step("__before")).withColumn("from_first", step("__first")).drop("__before", "__first")


def _beside(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("score_id").orderBy("onset"))
    one, two = (d.select("score_id", place.alias("k"), F.struct(*columns).alias(n)) for d, n in ((a, "a"), (b, "b")))
    return one.join(two, ["score_id", "k"], "full")


def compare_chords(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """score_id, n_rows, n_different: rows of two chord tables at one place of a score that differ in any column. A null differs
    from everything; rows that only one table has differ."""
    shared = [c for c in ("key", "degree", "quality", "inversion") if c in a.columns and c in b.columns]
    columns = columns or shared
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return _beside(a, b, columns).groupBy("score_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).alias("n_different"))


def compare_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """score_id, n_different, n_regions: rows whose keys, filled forward, differ, and stretches of rows with the same pair of
    keys that do."""
    per = Window.partitionBy("score_id").orderBy("k")
    both = _beside(a, b, ["key"]).withColumn("x", ffill("a.key", per)).withColumn("y", ffill("b.key", per)).withColumn("__d", (~F.col("x").eqNullSafe(F.col("y"))).cast("int"))
    moved = ~(F.lag("x").over(per).eqNullSafe(F.col("x")) & F.lag("y").over(per).eqNullSafe(F.col("y")))
    return both.withColumn("__new", (moved | (F.row_number().over(per) == 1)).cast("int") * F.col("__d")).groupBy("score_id").agg(F.sum("__d").alias("n_different"), F.sum("__new").alias("n_regions"))


def label_pc_matches(notes: DataFrame, chords: DataFrame, name: str = "is_chord_match") -> DataFrame:
    """`name`: whether the pitch class of a note is one of its chord's (chord_pcs); null outside chords. Notes should be sliced at chords."""
    labelled = label_notes_with_chords(notes, chords.withColumn("__end", F.col("release")), ("chord_pcs", "__end"))
    hit = F.array_contains("chord_pcs", F.pmod(F.col("pitch").cast("int"), F.lit(12)))
    return labelled.withColumn(name, F.when(F.col("onset") < F.col("__end"), hit)).drop("chord_pcs", "__end")


#: Checks of `validate_chord_df`, true on rows that break them.
RULES = {
    "key": "key is not null and key <> 'na' and not key rlike '^[A-Ga-g](#{0,2}|b{0,2})$'",
    "degree": "degree is not null and degree <> 'na' and not degree rlike '^[b#]*(I|II|III|IV|V|VI|VII|i|ii|iii|iv|v|vi|vii)(/[b#]*(I|II|III|IV|V|VI|VII|i|ii|iii|iv|v|vi|vii))*$'",
    "inversion": "inversion is not null and inversion not in (0, 1, 2, 3)",
    "release": "release < onset",
    "order": "onset < __before",
    "first_key": "__place = 1 and (key is null or key = '')",
}


def validate_chord_df(chords: DataFrame) -> DataFrame:
    """One row for each rule: rule, n_bad and an example (score and place of its first row), in one pass. Places count by row_id if there is one."""
    per = Window.partitionBy("score_id").orderBy("row_id" if "row_id" in chords.columns else "onset")
    rows = chords.withColumn("__before", F.lag("onset").over(per)).withColumn("__place", F.row_number().over(per))
    broken = F.array_compact(F.array(*(F.when(F.expr(x), F.lit(n)) for n, x in RULES.items())))
    counts = rows.select("score_id", F.col("__place").alias("place"), F.explode(broken).alias("rule"))
    few = counts.groupBy("rule", "score_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    found = few.groupBy("rule").agg(F.sum("n").alias("n_bad"), F.min(F.struct("score_id", "place")).alias("example"))
    rules = chords.sparkSession.createDataFrame([(n,) for n in RULES], "rule string")
    return F.broadcast(rules).join(found, "rule", "left").select("rule", F.coalesce("n_bad", F.lit(0)).alias("n_bad"), "example")


def softmax(logits: Column) -> Column:
    e = F.transform(logits, F.exp)
    return F.transform(e, lambda x: F.try_divide(x, F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def merge_logits(rows: DataFrame) -> DataFrame:
    """score_id, logits: of several predictions (score_id, logits, n) the mean by place, weighted with n."""
    flat = rows.select("score_id", "n", F.posexplode("logits").alias("k", "x")).groupBy("score_id", "k").agg(F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("x"))
    return flat.groupBy("score_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("logits"))


def add_chord_pcs(chords: DataFrame) -> DataFrame:
    """chord_pcs: pitch classes of each chord (degree, quality, inversion) from its bass up as hex digits, null where
    they can't be told; a null key is that of the chord before."""
    per = Window.partitionBy("score_id").orderBy("onset")
    s = chords.withColumn("key", ffill("key", per))
    pcs = chord_pitch_classes(F.col("degree"), F.col("quality"), F.col("inversion"), F.col("key"))
    return s.withColumn("chord_pcs", F.when(pcs.isNotNull(), K.pcs_to_hex(pcs)))
