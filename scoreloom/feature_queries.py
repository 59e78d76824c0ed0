"""Queries of the operators for features, harmony, augmentation and doublings, with the same in SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import keys as K
from scoreloom.operators import augment as G
from scoreloom.operators import doublings as D
from scoreloom.operators import features as E
from scoreloom.operators import harmony as H
from scoreloom.operators import joins as J
from scoreloom.operators import meter as B
from scoreloom.operators import slices as S
from scoreloom.plans import corpus
from scoreloom.queries import _notes, _with_pcs

_REGISTRY: dict[str, tuple] = {}
_PROGRAMS = {"view": 40, "click": 41, "purchase": 73}


def _query(sql: str | None = None):
    def add(f):
        _REGISTRY[f.__name__] = (f, f"WITH {corpus.SQL.strip()}{sql}" if sql else None)
        return f

    return add


@_query(" SELECT row_id, 96 AS velocity, CASE instrument WHEN 'view' THEN 40 WHEN 'click' THEN 41 WHEN 'purchase' THEN 73 ELSE 0 END AS midi_instrument, CASE WHEN instrument IS NULL OR channel IS NULL OR instrument = 'na' THEN 'na' ELSE instrument || channel::VARCHAR END AS instrument_channel FROM ev")
def default_features(spark, sf_dir):
    n = E.instruments_to_midi_instruments(E.add_default_velocity(_notes(spark, sf_dir)), _PROGRAMS)
    return E.concatenate_features(n, ["instrument", "channel"]).select("row_id", "velocity", "midi_instrument", "instrument_channel")


def _tracks(n: DataFrame) -> DataFrame:
    """Notes in three tracks; those of errors are program changes."""
    return n.withColumn("track", F.pmod("row_id", F.lit(3))).withColumn("program", F.col("pitch").cast("int")).withColumn("type", F.when(F.col("instrument") == "error", "program_change").otherwise("note"))


_TRACKS = """, tr AS (SELECT *, row_id % 3 AS track, CASE WHEN instrument = 'error' THEN pitch::INTEGER END AS program FROM ev), mi AS (SELECT *, coalesce(last_value(program IGNORE NULLS) OVER (PARTITION BY score_id, track ORDER BY onset, instrument IS DISTINCT FROM 'error', row_id), 0) AS midi_instrument FROM tr)"""


@_query(_TRACKS + " SELECT row_id, midi_instrument FROM mi")
def instruments_of_tracks(spark, sf_dir):
    return E.make_instruments_explicit(_tracks(_notes(spark, sf_dir))).select("row_id", "midi_instrument")


@_query(_TRACKS + ", ch2 AS (SELECT *, lag(midi_instrument) OVER (PARTITION BY score_id, track, channel ORDER BY onset, row_id) AS p FROM mi WHERE instrument IS DISTINCT FROM 'error') SELECT score_id, track, onset, midi_instrument AS program FROM ch2 WHERE midi_instrument IS DISTINCT FROM p")
def program_changes(spark, sf_dir):
    return E.explicit_instruments_to_program_changes(E.make_instruments_explicit(_tracks(_notes(spark, sf_dir)))).select("score_id", "track", "onset", "program")


def _degrees(spark, sf_dir):
    n = _notes(spark, sf_dir)
    return E.decompose_scale_degrees(E.add_scale_degrees(J.label_notes_with_chords(n, corpus.chords(n)).withColumn("spelling", E.spell_pitch(F.col("pitch")))), 1)


_DEGREE = """, k AS (SELECT ev.row_id, ch.key, CASE WHEN (7 * pitch::INTEGER) % 12 + 1 > 8 THEN (7 * pitch::INTEGER) % 12 - 11 ELSE (7 * pitch::INTEGER) % 12 + 1 END
 - CASE ch.key WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'a' THEN 4 WHEN 'F' THEN 0 WHEN 'e' THEN 5 WHEN 'Bb' THEN -1 ELSE 3 END AS d, ch.key IN ('a', 'e', 'd') AS mi FROM ev ASOF JOIN ch ON ev.score_id = ch.score_id AND ev.onset >= ch.onset WHERE pitch IS NOT NULL),
x AS (SELECT row_id, CASE WHEN mi THEN d + 4 ELSE d + 1 END AS m, mi FROM k), y AS (SELECT row_id, floor(m / 7.0)::INTEGER AS s, CASE WHEN mi THEN [6, 3, 7, 4, 1, 5, 2] ELSE [4, 1, 5, 2, 6, 3, 7] END[(m % 7 + 7) % 7 + 1] AS step FROM x)
SELECT row_id, repeat(CASE WHEN s < 0 THEN 'b' ELSE '#' END, abs(s)) || step AS scale_degree, step::VARCHAR AS scale_degree_step, CASE WHEN s = 0 THEN '_' WHEN abs(s) > 1 THEN 'x' WHEN s < 0 THEN 'b' ELSE '#' END AS scale_degree_alteration FROM y"""


@_query(_DEGREE)
def scale_degrees(spark, sf_dir):
    return _degrees(spark, sf_dir).where("pitch is not null").select("row_id", "scale_degree", "scale_degree_step", "scale_degree_alteration")


@_query(" SELECT score_id, release, max(row_id) AS row_id FROM (SELECT *, rank() OVER (PARTITION BY score_id, release ORDER BY pitch DESC NULLS LAST) AS k FROM ev) WHERE k = 1 GROUP BY ALL")
def eligible_releases(spark, sf_dir):
    return E.get_eligible_releases(_notes(spark, sf_dir))


@_query(", l AS (SELECT row_id - row_id % 2 AS row_id, arg_max(instrument, ev.row_id) AS label FROM ev GROUP BY 1) SELECT ev.row_id, label FROM ev LEFT JOIN l USING (row_id)")
def label_rows(spark, sf_dir):
    """Every note gives a label to its own or the row before, so that each labelled row has two and the last stays."""
    n = _notes(spark, sf_dir)
    labels = n.select((F.col("row_id") - F.pmod("row_id", F.lit(2))).alias("row_id"), F.col("instrument").alias("label"), F.col("row_id").alias("place"))
    return E.label_df(n, labels, "label").select("row_id", "label")


@_query(", e AS (SELECT score_id, greatest(-5, ceil(36 - min(pitch)))::INTEGER AS a, least(6, floor(86 - max(pitch)))::INTEGER AS b FROM ev GROUP BY 1), t AS (SELECT score_id, unnest(range(a, b + 1)) AS k FROM e WHERE a <= b) SELECT score_id, k::INTEGER AS transposed_by, count(*) AS n, sum(pitch + k) AS total FROM ev JOIN t USING (score_id) GROUP BY ALL")
def transposed_copies(spark, sf_dir):
    return G.aug_within_range(_notes(spark, sf_dir), 36, 86).groupBy("score_id", "transposed_by").agg(F.count(F.lit(1)).alias("n"), F.sum("pitch").alias("total"))


@_query(", p AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY row_id) AS k, row_number() OVER (PARTITION BY score_id ORDER BY md5('7:' || row_id::VARCHAR), row_id) AS d FROM ev) SELECT a.row_id, b.pitch FROM p a JOIN p b ON a.score_id = b.score_id AND a.k = b.d")
def shuffled_pitches(spark, sf_dir):
    return G.shuffle_pitches(_notes(spark, sf_dir), 7).select("row_id", "pitch")


@_query(", m AS (SELECT score_id, avg(release - onset) AS a FROM ev GROUP BY 1), f AS (SELECT score_id, unnest(CASE WHEN a >= 2 THEN [1.0, 0.5, 0.25] ELSE [1.0, 2.0, 4.0] END) AS s FROM m) SELECT row_id, s::DOUBLE AS rhythms_scaled_by, onset * s::DOUBLE AS onset, release * s::DOUBLE AS release FROM ev JOIN f USING (score_id)")
def stretched_copies(spark, sf_dir):
    return G.aug_rhythms(_notes(spark, sf_dir), 3, 2.0).select("row_id", "rhythms_scaled_by", "onset", "release")


_TOKENS = """, tk AS (SELECT DISTINCT score_id, instrument, round_even(onset * 2, 0) AS o, round_even(release * 2, 0) AS r, pitch FROM ev WHERE pitch IS NOT NULL AND instrument IS NOT NULL), nu AS (SELECT *, row_number() OVER (PARTITION BY score_id, instrument ORDER BY o, r, pitch) AS k FROM tk),
me AS (SELECT a.score_id, a.instrument AS a, b.instrument AS b, a.o, a.r, a.pitch, a.k, a.k - b.k AS d FROM nu a JOIN nu b ON a.score_id = b.score_id AND a.o = b.o AND a.r = b.r AND a.pitch = b.pitch AND a.instrument < b.instrument), ru AS (SELECT *, k - row_number() OVER (PARTITION BY score_id, a, b, d ORDER BY k) AS run FROM me), le AS (SELECT *, count(*) OVER (PARTITION BY score_id, a, b, d, run) AS length FROM ru)"""


@_query(_TOKENS + " SELECT score_id, a, b, o, r, pitch, length FROM le WHERE length >= 1")
def unison_runs(spark, sf_dir):
    return D.unison_runs(_notes(spark, sf_dir), 1, 2).select("score_id", "a", "b", F.col("__o").alias("o"), F.col("__r").alias("r"), "pitch", "length")


@_query(_TOKENS + " SELECT row_id FROM ev ANTI JOIN (SELECT score_id, b AS instrument, o, r, pitch FROM le WHERE length >= 1) x ON x.score_id = ev.score_id AND x.instrument = ev.instrument AND x.pitch = ev.pitch AND x.o = round_even(onset * 2, 0) AND x.r = round_even(release * 2, 0)")
def dedouble_across_instruments(spark, sf_dir):
    return D.dedouble_unisons_across_instruments(_notes(spark, sf_dir), 1, 2).select("row_id")


@_query()
def remove_repeated_bars(spark, sf_dir):
    """The search is sequential; its SQL, a recursion, stands with the rewriting queries."""
    barred = B.make_bar_explicit(B.add_bar_durs(B.infer_barlines(corpus.with_meter(_notes(spark, sf_dir)))))
    return D.remove_repeated_bars(barred).select("score_id", "row_id", "type", "onset", "release")


_RUNS = ", r0 AS (SELECT *, coalesce(lag(key) OVER w <> key, true) AS c FROM ch WINDOW w AS (PARTITION BY score_id ORDER BY onset)), r1 AS (SELECT *, sum(c::INTEGER) OVER (PARTITION BY score_id ORDER BY onset) AS run FROM r0), r2 AS (SELECT score_id, run, key, min(onset) AS onset, max(release) AS rel FROM r1 GROUP BY ALL)"


@_query(_RUNS + " SELECT score_id, key, onset, coalesce(lead(onset) OVER (PARTITION BY score_id ORDER BY onset), max(rel) OVER (PARTITION BY score_id)) AS release FROM r2")
def extract_keys(spark, sf_dir):
    return H.extract_key_df(corpus.chords(_notes(spark, sf_dir)))


_PC = "CASE key WHEN 'C' THEN 0 WHEN 'G' THEN 7 WHEN 'a' THEN 9 WHEN 'F' THEN 5 WHEN 'e' THEN 4 WHEN 'Bb' THEN 10 ELSE 2 END"


@_query(_RUNS + f", p AS (SELECT score_id, onset, key, {_PC} AS pc, CASE WHEN key IN ('a', 'e', 'd') THEN 'm' ELSE 'M' END AS md FROM r2), q AS (SELECT *, lag(pc) OVER w AS b, lag(md) OVER w AS bm, first_value(pc) OVER w AS f FROM p WINDOW w AS (PARTITION BY score_id ORDER BY onset)) SELECT score_id, onset, key, (pc - b + 18) % 12 - 6 AS from_previous, (pc - f + 18) % 12 - 6 AS from_first, coalesce(((pc - b + 18) % 12 - 6)::VARCHAR || bm || md, key) AS key_change FROM q")
def key_changes(spark, sf_dir):
    return H.key_changes(H.extract_key_df(corpus.chords(_notes(spark, sf_dir))).drop("release"))


def _altered(c: DataFrame) -> DataFrame:
    """Every third chord in C and without degree where it was V."""
    third = F.pmod(F.floor(F.col("onset") / corpus.CHORD), F.lit(3)) == 0
    return c.withColumn("key", F.when(third, "C").otherwise(F.col("key"))).withColumn("degree", F.when(F.col("degree") != "V", F.col("degree")))


_ALT = ", al AS (SELECT score_id, onset, CASE WHEN (onset / 8)::BIGINT % 3 = 0 THEN 'C' ELSE key END AS key, CASE WHEN degree <> 'V' THEN degree END AS degree, quality, inversion FROM ch)"


@_query(_ALT + " SELECT score_id, count(*) AS n_rows, count(*) FILTER (NOT coalesce(ch.key = al.key AND ch.degree = al.degree, false)) AS n_different FROM ch JOIN al USING (score_id, onset) GROUP BY ALL")
def compare_chords(spark, sf_dir):
    c = corpus.chords(_notes(spark, sf_dir))
    return H.compare_chords(c, _altered(c))


@_query(_ALT + ", z AS (SELECT score_id, onset, ch.key AS x, al.key AS y FROM ch JOIN al USING (score_id, onset)), z2 AS (SELECT *, x <> y AS d, coalesce(x = lag(x) OVER w AND y = lag(y) OVER w, false) AS same FROM z WINDOW w AS (PARTITION BY score_id ORDER BY onset)) SELECT score_id, count(*) FILTER (d) AS n_different, count(*) FILTER (d AND NOT same) AS n_regions FROM z2 GROUP BY ALL")
def compare_keys(spark, sf_dir):
    c = corpus.chords(_notes(spark, sf_dir))
    return H.compare_keys(c, _altered(c))


@_query(" SELECT row_id, list_contains(CASE quality WHEN 'M' THEN [0, 4, 7] WHEN 'm' THEN [0, 3, 7] WHEN 'Mm7' THEN [0, 4, 7, 10] ELSE [0, 3, 6, 9] END, pitch::INTEGER % 12) AS is_chord_match FROM ev ASOF JOIN ch ON ev.score_id = ch.score_id AND ev.onset >= ch.onset")
def chord_match_of_notes(spark, sf_dir):
    n = _notes(spark, sf_dir)
    return H.label_pc_matches(n, _with_pcs(corpus.chords(n))).select("row_id", "is_chord_match")


@_query(" SELECT score_id, onset, CASE WHEN quality IN ('Mm7', 'o7') THEN (['7', '65', '43', '42'])[inversion::INTEGER + 1] ELSE coalesce((['', '6', '64'])[inversion::INTEGER + 1], '?') END AS figure, CASE WHEN quality IN ('M', 'Mm7') THEN upper(degree) ELSE lower(degree) END AS cased FROM ch")
def figures(spark, sf_dir):
    c = corpus.chords(_notes(spark, sf_dir))
    mode = F.when(F.col("quality").isin("M", "Mm7"), "M").otherwise("m")
    return c.select("score_id", "onset", H.inversion_number_to_figure(F.col("inversion"), F.col("quality")).alias("figure"), H.change_rn_mode(F.col("degree"), mode).alias("cased"))


@_query(" SELECT rule, n_bad::BIGINT AS n_bad FROM (SELECT count(*) FILTER (quality = 'm') AS k, count(*) FILTER (quality = 'M' AND onset > 0) AS d FROM ch), LATERAL (VALUES ('key', k), ('degree', 0), ('inversion', 0), ('release', d), ('order', 0), ('first_key', 0)) v(rule, n_bad)")
def validate_chords(spark, sf_dir):
    c = corpus.chords(_notes(spark, sf_dir))
    broken = c.withColumn("key", F.when(F.col("quality") == "m", "H#").otherwise(F.col("key"))).withColumn("release", F.when((F.col("quality") == "M") & (F.col("onset") > 0), 0.0).otherwise(F.col("release")))
    return H.validate_chord_df(broken).select("rule", "n_bad")


@_query(", mo AS (SELECT score_id, onset AS t FROM ev UNION SELECT score_id, release FROM ev), sl AS (SELECT mo.score_id, mo.t AS onset, list_sort(list(DISTINCT pitch)) AS ps FROM mo JOIN ev ON ev.score_id = mo.score_id AND ev.onset <= t AND t < ev.release GROUP BY ALL), z AS (SELECT *, (ps IS DISTINCT FROM lag(ps) OVER (PARTITION BY score_id ORDER BY onset))::INTEGER AS c FROM sl) SELECT score_id, onset, sum(c) OVER (PARTITION BY score_id ORDER BY onset)::BIGINT - 1 AS distinct_slice_id FROM z")
def distinct_slices(spark, sf_dir):
    return E.add_distinct_slice_ids(S.salami_slice(_notes(spark, sf_dir))).select("score_id", "onset", "distinct_slice_id").distinct()


@_query(", x AS (SELECT score_id, row_id, unnest([pitch / 12, (release - onset), 1.0]) AS l, unnest([1, 2, 3]) AS k, row_id % 4 + 1 AS n FROM ev) SELECT score_id, k, round(sum(l * n) / sum(n), 6) AS logit FROM x GROUP BY ALL")
def merged_logits(spark, sf_dir):
    n = _notes(spark, sf_dir).select("score_id", F.array(F.col("pitch") / 12, F.col("release") - F.col("onset"), F.lit(1.0)).alias("logits"), (F.pmod("row_id", F.lit(4)) + 1).alias("n"))
    return H.merge_logits(n).select("score_id", F.posexplode("logits").alias("k", "logit")).withColumn("k", F.col("k") + 1).withColumn("logit", F.round("logit", 6))


@_query(f", s AS (SELECT *, nullif(split_part(degree, '/', 2), '') AS sec, {_PC} AS pc, key IN ('a', 'e', 'd') AS mi FROM ch) SELECT score_id, onset, CASE WHEN sec IS NULL THEN key WHEN sec = 'V' AND NOT mi THEN (['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B'])[(pc + 7) % 12 + 1] ELSE (['c', 'c#', 'd', 'eb', 'e', 'f', 'f#', 'g', 'g#', 'a', 'bb', 'b'])[(pc + CASE sec WHEN 'V' THEN 7 ELSE 2 END) % 12 + 1] END AS local_key FROM s")
def tonicized_keys(spark, sf_dir):
    c = corpus.chords(_notes(spark, sf_dir))
    return c.select("score_id", "onset", K.tonicization_to_key(F.split_part("degree", F.lit("/"), F.lit(2)), F.col("key")).alias("local_key"))


@_query(" SELECT row_id, onset, release FROM ev")
def absolute_time_and_back(spark, sf_dir):
    n = _notes(spark, sf_dir)
    tempi = n.where("instrument = 'error'").select("score_id", "onset", (F.lit(60.0) * (1 + F.pmod("row_id", F.lit(3)))).alias("tempo"))
    back = B.from_absolute_time(B.to_absolute_time(n, tempi), tempi)
    return back.select("row_id", F.round("onset", 6).alias("onset"), F.round("release", 6).alias("release"))


def queries() -> dict:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
