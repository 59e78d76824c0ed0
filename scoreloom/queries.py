"""Queries over the score view of the provided tables, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import keys as K
from scoreloom.operators import chords as C
from scoreloom.operators import joins as J
from scoreloom.operators import merges as M
from scoreloom.operators import meter as B
from scoreloom.operators import order as O
from scoreloom.operators import slices as S
from scoreloom.operators import stats as A
from scoreloom.plans import corpus

_REGISTRY: dict[str, tuple] = {}


def _query(sql: str | None = None):
    def add(f):
        _REGISTRY[f.__name__] = (f, f"WITH {corpus.SQL.strip()}{sql}" if sql else None)
        return f

    return add


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.scores(spark, sf_dir)


@_query(", s AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY onset, CASE type WHEN 'time_signature' THEN 0 ELSE 4 END, type, pitch NULLS LAST, release NULLS LAST, row_id) AS seq FROM ms) SELECT score_id, row_id, type, onset, seq FROM s")
def sort_scores(spark, sf_dir):
    return O.sort_df(corpus.with_meter(_notes(spark, sf_dir))).select("score_id", "row_id", "type", "onset", "seq")


@_query(" SELECT score_id, row_id, round_even(onset * 2, 0) / 2 AS onset, CASE WHEN round_even(onset * 2, 0) = round_even(rel * 2, 0) THEN (round_even(rel * 2, 0) + 1) / 2 ELSE round_even(rel * 2, 0) / 2 END AS release FROM (SELECT *, CASE WHEN onset = 0 THEN release ELSE coalesce(release, onset + 0.125) END AS rel FROM ms)")
def quantize(spark, sf_dir):
    """Notes and time signatures, of which the second has almost no length and the first no release."""
    df = corpus.with_meter(_notes(spark, sf_dir))
    df = df.withColumn("release", F.when(F.col("onset") == 0, F.col("release")).otherwise(F.coalesce("release", F.col("onset") + 0.125)))
    return B.quantize_df(df, 2).select("score_id", "row_id", "onset", "release")


_MOMENTS = ", mo AS (SELECT score_id, t, lead(t) OVER (PARTITION BY score_id ORDER BY t) AS nx FROM (SELECT score_id, onset AS t FROM ev UNION SELECT score_id, release FROM ev)), sl AS (SELECT ev.score_id, row_id, type, instrument, channel, pitch, t AS onset, nx AS release FROM ev JOIN mo ON mo.score_id = ev.score_id AND t >= onset AND t < release)"


@_query(_MOMENTS + " SELECT score_id, row_id, pitch, onset, release, dense_rank() OVER (PARTITION BY score_id ORDER BY onset) - 1 AS slice_id FROM sl")
def salami_slice(spark, sf_dir):
    return S.salami_slice(_notes(spark, sf_dir), False).select("score_id", "row_id", "pitch", "onset", "release", "slice_id")


@_query(" SELECT score_id, row_id, onset, release FROM ev")
def undo_salami_slice(spark, sf_dir):
    return S.undo_salami_slice(S.salami_slice(_notes(spark, sf_dir))).select("score_id", F.col("original_note_id").alias("row_id"), "onset", "release")


@_query(" SELECT row_id, greatest(onset, k * 1.0) AS onset, least(release, (k + 1) * 1.0) AS release FROM (SELECT *, unnest(range(floor(onset)::BIGINT, ceil(release)::BIGINT)) AS k FROM ev)")
def subdivide_notes(spark, sf_dir):
    return S.subdivide_notes(_notes(spark, sf_dir), 1.0).select("row_id", "onset", "release")


@_query(" SELECT row_id, CASE WHEN k = 0 THEN onset ELSE onset + (k - 1) * 0.5 END AS onset, CASE WHEN k = 0 THEN release ELSE onset + k * 0.5 END AS release FROM (SELECT *, unnest(range(0, greatest(ceil((release - onset) / 0.5)::BIGINT, 1))) AS k FROM ev)")
def slice_into_uniform_steps(spark, sf_dir):
    return S.slice_into_uniform_steps(_notes(spark, sf_dir), 0.5).select("row_id", F.col("onset").cast("double").alias("onset"), F.col("release").cast("double").alias("release"))


_CUTS = ", bd(b) AS (SELECT unnest(range(0, 400)) * 2.0), cr AS (SELECT ev.*, b FROM ev JOIN bd ON b > onset AND b < release)"


@_query(_CUTS + " SELECT row_id, onset, b AS release, 'before' AS sliced FROM cr UNION ALL SELECT row_id, b, release, 'after' FROM cr UNION ALL SELECT row_id, onset, release, 'no' FROM ev WHERE row_id NOT IN (SELECT row_id FROM cr)")
def slice_at_boundaries(spark, sf_dir):
    return S.slice_df(_notes(spark, sf_dir), [2.0 * k for k in range(400)]).select("row_id", "onset", "release", "sliced")


_BARS = ", en AS (SELECT score_id, max(release) AS r, max(onset) AS o FROM ev GROUP BY 1), sp AS (SELECT score_id, 0.0::DOUBLE AS a, 64.0::DOUBLE AS z, 4.0::DOUBLE AS d FROM en UNION ALL SELECT score_id, 64.0, least(r, o + 12), 3.0 FROM en), bo AS (SELECT score_id, a + k * d AS onset FROM (SELECT *, unnest(range(0, greatest(ceil((z - a) / d)::BIGINT, 0))) AS k FROM sp)), ba AS (SELECT score_id, onset, coalesce(lead(onset) OVER (PARTITION BY score_id ORDER BY onset), least(r, o + CASE WHEN onset >= 64 THEN 12 ELSE 16 END)) AS release, row_number() OVER (PARTITION BY score_id ORDER BY onset) AS bar_number FROM bo JOIN en USING (score_id))"


def _barred(spark, sf_dir):
    return B.infer_barlines(corpus.with_meter(_notes(spark, sf_dir)))


@_query(_BARS + " SELECT score_id, onset, release, bar_number FROM ba")
def infer_barlines(spark, sf_dir):
    return B.number_bars(_barred(spark, sf_dir)).where("type = 'bar'").select("score_id", "onset", "release", "bar_number")


@_query(_BARS + " SELECT row_id, coalesce(bar_number, -1) AS bar_number, coalesce(ev.onset - ba.onset, 0.0) AS bar_relative_onset, CASE WHEN ev.onset >= 64 THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END AS ts_numerator, CASE WHEN ev.onset >= 64 THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END AS time_sig_dur FROM ev ASOF LEFT JOIN ba ON ev.score_id = ba.score_id AND ev.onset >= ba.onset")
def bars_of_notes(spark, sf_dir):
    df = B.add_time_sig_dur(B.get_bar_relative_onset(B.make_bar_explicit(_barred(spark, sf_dir))))
    return df.where("type = 'note'").select("row_id", "bar_number", "bar_relative_onset", "ts_numerator", "time_sig_dur")


@_query(_BARS + " SELECT score_id, onset, coalesce(lead(onset) OVER (PARTITION BY score_id ORDER BY onset), greatest((SELECT max(release) FROM ev WHERE ev.score_id = ba.score_id), release)) - onset AS bar_dur FROM ba")
def bar_durations(spark, sf_dir):
    return B.add_bar_durs(_barred(spark, sf_dir)).where("type = 'bar'").select("score_id", "onset", "bar_dur")


@_query(_BARS + ", li AS (SELECT score_id, onset AS t FROM ba UNION SELECT score_id, release FROM ba), pt AS (SELECT ev.score_id, row_id, onset AS t, release FROM ev UNION ALL SELECT ev.score_id, row_id, t, release FROM ev JOIN li ON li.score_id = ev.score_id AND t > onset AND t < release) SELECT row_id, t AS onset, coalesce(lead(t) OVER w, release) AS release, lag(t) OVER w IS NOT NULL AS tie_to_prev, lead(t) OVER w IS NOT NULL AS tie_to_next FROM pt WINDOW w AS (PARTITION BY score_id, row_id ORDER BY t)")
def split_notes_at_barlines(spark, sf_dir):
    return S.split_notes_at_barlines(_barred(spark, sf_dir)).where("type = 'note'").select("row_id", "onset", "release", "tie_to_prev", "tie_to_next")


@_query(", a AS (SELECT *, max(release) OVER (PARTITION BY score_id, pitch ORDER BY onset, release, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev), b AS (SELECT *, sum(CASE WHEN reach IS NULL OR onset > reach THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, pitch ORDER BY onset, release, row_id) AS g FROM a) SELECT score_id, pitch, min(onset) AS onset, max(release) AS release, count(*) AS n_merged FROM b GROUP BY score_id, pitch, g")
def merge_notes(spark, sf_dir):
    return M.merge_notes(_notes(spark, sf_dir)).select("score_id", "pitch", "onset", "release", F.size("merged_ids").cast("long").alias("n_merged"))


_REPEAT = """, t AS (SELECT DISTINCT score_id, onset AS t FROM ev), x AS (SELECT t.score_id, t, min(pitch) AS lo, max(pitch) AS hi FROM t JOIN ev ON ev.score_id = t.score_id AND channel <> 9 AND onset <= t AND t < release GROUP BY ALL),
fl AS (SELECT ev.*, coalesce(channel <> 9 AND pitch = lo, false) AS l, coalesce(channel <> 9 AND pitch = hi, false) AS h FROM ev LEFT JOIN x ON ev.score_id = x.score_id AND onset = t),
a AS (SELECT *, lag(release) OVER w AS pr, lag(onset) OVER w AS po, lag(l) OVER w AS pl, lag(h) OVER w AS ph FROM fl WINDOW w AS (PARTITION BY score_id, instrument, channel, pitch ORDER BY onset, release, row_id)),
b AS (SELECT *, coalesce({cond} pl = l AND ph = h AND (onset - pr <= 1e-6 OR (onset - pr <= {gap} AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.score_id = a.score_id AND x.instrument = a.instrument AND x.channel = a.channel AND x.onset >= a.pr AND x.onset < a.onset))), false) AS j FROM a),
c AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY score_id, instrument, channel, pitch ORDER BY onset, release, row_id) AS g FROM b)
SELECT score_id, instrument, pitch, min(onset) AS onset, arg_max(release, (onset, release, row_id)) AS release FROM c GROUP BY score_id, instrument, channel, pitch, g"""


@_query(_REPEAT.format(cond="", gap="2.0"))
def merge_repeated_notes(spark, sf_dir):
    return M.merge_repeated_notes(_notes(spark, sf_dir), max_gap=2.0).select("score_id", "instrument", "pitch", "onset", "release")


@_query(_REPEAT.format(cond="pr - po <= 3.0 AND", gap="1.0"))
def detremolo(spark, sf_dir):
    return M.detremolo(_notes(spark, sf_dir), 3.0, 1.0).select("score_id", "instrument", "pitch", "onset", "release")


@_query(" SELECT score_id, pitch, instrument, channel, round_even(onset * 0.5, 0) AS o, count(*) AS n_doubled, min(row_id) AS some FROM ev GROUP BY score_id, pitch, instrument, channel, round_even(onset * 0.5, 0), round_even(release * 0.5, 0)")
def dedouble(spark, sf_dir):
    kept = M.dedouble(_notes(spark, sf_dir).withColumn("onset", F.col("onset") * 0.5).withColumn("release", F.col("release") * 0.5).withColumn("key", F.lit(0)), 1)
    first = _notes(spark, sf_dir).groupBy("score_id", "pitch", "instrument", "channel", F.rint(F.col("onset") * 0.5).alias("o"), F.rint(F.col("release") * 0.5).alias("r")).agg(F.min("row_id").alias("some"))
    return kept.withColumn("o", F.rint("onset")).withColumn("r", F.rint("release")).join(first, ["score_id", "pitch", "instrument", "channel", "o", "r"]).select("score_id", "pitch", "instrument", "channel", "o", "n_doubled", "some")


@_query(", a AS (SELECT *, max(release) OVER (PARTITION BY score_id ORDER BY onset, release, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev) SELECT score_id, reach AS onset, onset AS release FROM a WHERE onset - reach > 1e-7")
def rests(spark, sf_dir):
    """Bars lie over the notes and fill no rest."""
    return M.return_rests(_barred(spark, sf_dir))


@_query(""", t AS (SELECT DISTINCT score_id, onset AS t FROM ev), e2 AS (SELECT * REPLACE (CASE WHEN row_id % 2 = 0 AND channel = 0 THEN NULL ELSE channel END AS channel), coalesce(channel <> 9, true) AS tuned FROM ev),
x AS (SELECT t.score_id, t, min(pitch) AS lo, max(pitch) AS hi, arg_min(row_id, (pitch, row_id)) AS lo_id FROM t JOIN e2 ON e2.score_id = t.score_id AND tuned AND onset <= t AND t < release GROUP BY ALL) SELECT row_id, coalesce(tuned AND pitch = lo, false) AS is_lowest, coalesce(tuned AND pitch = hi, false) AS is_highest, lo AS sounding_bass, lo_id AS sounding_bass_id FROM e2 LEFT JOIN x ON e2.score_id = x.score_id AND onset = t""")
def outer_voices(spark, sf_dir):
    """Half of the notes tell no channel."""
    n = _notes(spark, sf_dir)
    n = n.withColumn("channel", F.when((F.col("row_id") % 2 == 0) & (F.col("channel") == 0), None).otherwise(F.col("channel")))
    return J.add_sounding_bass(M.outer_voice_flags(n)).select("row_id", "is_lowest", "is_highest", "sounding_bass", "sounding_bass_id")


@_query()
def homophonic_layers(spark, sf_dir):
    return M.homophonic_layers(_notes(spark, sf_dir)).select("row_id", "layer")


@_query(" SELECT row_id, key, degree, quality, inversion FROM ev ASOF JOIN ch ON ev.score_id = ch.score_id AND ev.onset >= ch.onset")
def label_with_chords(spark, sf_dir):
    n = _notes(spark, sf_dir)
    return J.label_notes_with_chords(n, corpus.chords(n)).select("row_id", "key", "degree", "quality", "inversion")


_PCS = "CASE quality WHEN 'M' THEN [0, 4, 7] WHEN 'm' THEN [0, 3, 7] WHEN 'Mm7' THEN [0, 4, 7, 10] ELSE [0, 3, 6, 9] END"


def _with_pcs(c: DataFrame) -> DataFrame:
    q = lambda name, *pcs: (F.col("quality") == name, F.array(*map(F.lit, pcs)))
    return c.withColumn("chord_pcs", F.when(*q("M", 0, 4, 7)).when(*q("m", 0, 3, 7)).when(*q("Mm7", 0, 4, 7, 10)).otherwise(F.array(*map(F.lit, (0, 3, 6, 9)))))


@_query(f", p AS (SELECT ch.score_id, ch.onset AS chord_onset, pitch, {_PCS} AS pcs, least(ev.release, ch.release) - greatest(ev.onset, ch.onset) AS d FROM ev JOIN ch ON ev.score_id = ch.score_id AND ev.onset < ch.release AND ev.release > ch.onset) SELECT score_id, chord_onset, sum(CASE WHEN list_contains(pcs, pitch::INTEGER % 12) THEN d ELSE 0 END) / sum(d) AS match FROM p GROUP BY ALL")
def percent_chord_match(spark, sf_dir):
    n = _notes(spark, sf_dir)
    return J.percent_chord_match(n, _with_pcs(corpus.chords(n)))


@_query(_MOMENTS + ", lo AS (SELECT score_id, onset, min(pitch) AS pitch, min(release) AS release FROM sl GROUP BY 1, 2), p AS (SELECT ch.score_id, ch.onset AS chord_onset, pitch, least(lo.release, ch.release) - greatest(lo.onset, ch.onset) AS d FROM lo JOIN ch ON lo.score_id = ch.score_id AND lo.onset < ch.release AND lo.release > ch.onset) SELECT score_id, chord_onset, sum(CASE WHEN pitch::INTEGER % 12 = 0 THEN d ELSE 0 END) / sum(d) AS match FROM p GROUP BY ALL")
def percent_bass_match(spark, sf_dir):
    n = _notes(spark, sf_dir)
    return J.percent_bass_pc_match(n, _with_pcs(corpus.chords(n)))


_HIST = ", hi AS (SELECT score_id, list(coalesce(d, 0.0) ORDER BY pc) AS pcs FROM (SELECT score_id, pc, sum(release - onset) AS d FROM (SELECT DISTINCT score_id FROM ev) s CROSS JOIN range(12) r(pc) LEFT JOIN (SELECT score_id, pitch::INTEGER % 12 AS pc, onset, release FROM ev) USING (score_id, pc) GROUP BY ALL) GROUP BY score_id)"


@_query(", h AS (SELECT score_id, pitch::INTEGER % 12 AS pc, sum(release - onset) AS d FROM ev GROUP BY ALL) SELECT s.score_id, r.pc::INTEGER AS pc, coalesce(d, 0.0) AS dur FROM (SELECT DISTINCT score_id FROM ev) s CROSS JOIN range(12) r(pc) LEFT JOIN h ON h.score_id = s.score_id AND h.pc = r.pc")
def pc_distribution(spark, sf_dir):
    return A.pc_distribution(_notes(spark, sf_dir)).select("score_id", F.posexplode("pcs").alias("pc", "dur"))


def _key_sql(family: str) -> str:
    major, minor = A.PROFILES[family]
    rows = ", ".join(f"('{n if p is major else n.lower()}', {t}, {list(map(float, p))})" for p in (major, minor) for t, n in enumerate(A.NAMES))
    return f""", h AS (SELECT s.score_id, r.pc::INTEGER AS pc, coalesce(d, 0.0) AS d FROM (SELECT DISTINCT score_id FROM ev) s CROSS JOIN range(12) r(pc) LEFT JOIN (SELECT score_id, pitch::INTEGER % 12 AS pc, sum(release - onset) AS d FROM ev GROUP BY ALL) h ON h.score_id = s.score_id AND h.pc = r.pc),
pf(key, t, p) AS (VALUES {rows}), co AS (SELECT score_id, key, round(corr(d, p[(pc - t + 12) % 12 + 1]), 9) AS r FROM h, pf GROUP BY ALL)"""


@_query(_key_sql("krumhansl") + " SELECT score_id, key, r FROM co WHERE NOT isnan(r)")
def key_correlations(spark, sf_dir):
    return A.all_key_correlations(A.pc_distribution(_notes(spark, sf_dir))).where("r is not null").withColumn("r", F.round("r", 9))


for _family in A.PROFILES:
    def _best(spark, sf_dir, family=_family):
        return A.best_key(_notes(spark, sf_dir), family)

    _best.__name__ = f"best_key_{_family}"
    _query(_key_sql(_family) + " SELECT score_id, max(r) AS r, arg_min(key, (-r, key)) AS key FROM co WHERE NOT isnan(r) GROUP BY score_id")(_best)


@_query(", q AS (SELECT * FROM ev) , h0 AS (SELECT 1)" + _key_sql("krumhansl") + " SELECT score_id, max(r) AS r, arg_min(key, (-r, key)) AS key FROM co WHERE NOT isnan(r) GROUP BY score_id")
def flagship(spark, sf_dir):
    """Best key of each score from its quantized and sliced notes."""
    return A.best_key(S.salami_slice(B.quantize_df(_notes(spark, sf_dir), 16), False))


@_query(" SELECT score_id, sum(CASE WHEN pitch::INTEGER % 12 IN (0, 4, 7) THEN release - onset ELSE 0 END) / sum(release - onset) AS match FROM ev GROUP BY score_id")
def percent_pc_match(spark, sf_dir):
    return A.percent_pc_match(_notes(spark, sf_dir), [0, 4, 7])


@_query(" SELECT row_id, round(avg(pitch) OVER (PARTITION BY score_id, instrument), 6) AS pitch FROM ev")
def sync_by_instrument(spark, sf_dir):
    return A.sync_df(_notes(spark, sf_dir), ["instrument"], "pitch").select("row_id", F.round("pitch", 6).alias("pitch"))


@_query(_MOMENTS + " SELECT score_id, onset, release FROM sl GROUP BY ALL HAVING bool_or(channel = 9) AND bool_or(channel = 0)")
def simultaneous_feature(spark, sf_dir):
    return A.find_simultaneous_feature(S.salami_slice(_notes(spark, sf_dir), False), "channel", [0, 9])


@_query(_MOMENTS + ", m AS (SELECT score_id, onset, pitch, min(pitch) OVER (PARTITION BY score_id, onset) AS low FROM sl), d AS (SELECT DISTINCT score_id, onset, (pitch - low)::INTEGER % 12 AS pc FROM m) SELECT score_id, onset, string_agg(lower(to_hex(pc)), '' ORDER BY pc) AS figured_bass FROM d GROUP BY 1, 2")
def figured_bass(spark, sf_dir):
    return A.figured_bass_class(S.salami_slice(_notes(spark, sf_dir), False))


@_query(", p AS (SELECT DISTINCT score_id, onset, release FROM ev) SELECT score_id, count(*) = count(DISTINCT onset) AND count(*) = count(DISTINCT release) AS sliced FROM p GROUP BY 1")
def appears_sliced(spark, sf_dir):
    return A.appears_salami_sliced(_notes(spark, sf_dir))


_RUNS = ", r AS (SELECT *, coalesce(lag(key) OVER w <> key, true) AS n FROM ch WINDOW w AS (PARTITION BY score_id ORDER BY onset)), g AS (SELECT *, sum(n::INTEGER) OVER (PARTITION BY score_id ORDER BY onset) AS run FROM r), k AS (SELECT score_id, run, key, min(onset) AS onset, max(release) AS release, count(*) AS n_chords FROM g GROUP BY 1, 2, 3)"


@_query(_RUNS + " SELECT score_id, key, onset, n_chords, coalesce(lead(onset) OVER (PARTITION BY score_id ORDER BY onset), release) - onset AS duration FROM k")
def modulation_census(spark, sf_dir):
    return C.modulation_census(corpus.chords(_notes(spark, sf_dir)))


@_query(", s AS (SELECT *, CASE WHEN contains(degree, '/') THEN split_part(degree, '/', 2) ELSE 'I' END AS sd FROM ch), r AS (SELECT *, coalesce(lag(sd) OVER w <> sd OR lag(key) OVER w <> key, true) AS n FROM s WINDOW w AS (PARTITION BY score_id ORDER BY onset)), g AS (SELECT *, sum(n::INTEGER) OVER (PARTITION BY score_id ORDER BY onset) AS run FROM r), k AS (SELECT score_id, run, key, sd, min(onset) AS onset, max(release) AS release, count(*) AS n_chords FROM g GROUP BY ALL), z AS (SELECT *, coalesce(lead(onset) OVER (PARTITION BY score_id ORDER BY onset), release) - onset AS duration FROM k) SELECT score_id, key, sd AS secondary_degree, onset, n_chords, duration FROM z WHERE lower(sd) <> 'i'")
def tonicization_census(spark, sf_dir):
    return C.tonicization_census(corpus.chords(_notes(spark, sf_dir)))


@_query(" SELECT score_id, onset, degree AS joined_degree, split_part(degree, '/', 1) AS primary_degree, CASE WHEN contains(degree, '/') THEN split_part(degree, '/', 2) ELSE 'I' END AS secondary_degree FROM ch")
def split_and_join_degrees(spark, sf_dir):
    return C.join_degrees(C.split_degrees(corpus.chords(_notes(spark, sf_dir)))).select("score_id", "onset", "joined_degree", "primary_degree", "secondary_degree")


@_query(", s AS (SELECT *, split_part(degree, '/', 1) AS pd, CASE WHEN contains(degree, '/') THEN split_part(degree, '/', 2) END AS sd FROM ch), n AS (SELECT *, lag(sd) OVER w AS a, lead(sd) OVER w AS b, lag(key) OVER w AS ka, lead(key) OVER w AS kb FROM s WINDOW w AS (PARTITION BY score_id ORDER BY onset)) SELECT score_id, onset, CASE WHEN sd IS NULL AND pd <> 'I' AND NOT regexp_matches(quality, 'Mm7|It|Fr|Ger|aug6|o|[+]') AND (CASE WHEN pd = 'V' THEN coalesce(a = pd AND ka = key, false) AND coalesce(b = pd AND kb = key, false) ELSE coalesce(a = pd AND ka = key, false) OR coalesce(b = pd AND kb = key, false) END) THEN 'I/' || pd ELSE degree END AS degree FROM n")
def expand_tonicizations(spark, sf_dir):
    return C.expand_tonicizations(corpus.chords(_notes(spark, sf_dir))).select("score_id", "onset", "degree")


_ANNOTATION = """, r AS (SELECT *, split_part(degree, '/', 1) || replace(quality, '7', '') || CASE WHEN contains(quality, '7') THEN coalesce(['7', '65', '43', '42'][inversion::INTEGER + 1], '?') ELSE coalesce(['', '6', '64'][inversion::INTEGER + 1], '?') END
  || CASE WHEN contains(degree, '/') THEN '/' || split_part(degree, '/', 2) ELSE '' END AS rn FROM ch), p AS (SELECT *, lag(key) OVER w AS k0, lag(rn) OVER w AS r0 FROM r WINDOW w AS (PARTITION BY score_id ORDER BY onset))
SELECT score_id, onset, CASE WHEN k0 IS NULL OR k0 <> key THEN key || '.' || rn WHEN r0 IS NULL OR r0 <> rn THEN rn ELSE '' END AS annotation, CASE WHEN k0 IS NULL OR k0 <> key OR r0 IS NULL OR r0 <> rn THEN rn ELSE '' END AS without_key FROM p"""


@_query(_ANNOTATION)
def merge_annotations(spark, sf_dir):
    c = corpus.chords(_notes(spark, sf_dir))
    both = C.merge_annotations(C.merge_annotations(c, include_key=False).withColumnRenamed("annotation", "without_key"))
    return both.select("score_id", "onset", "annotation", "without_key")


@_query(" SELECT score_id, onset, CASE WHEN coalesce(lag(key) OVER w = key, false) THEN '' ELSE key END AS key FROM ch WINDOW w AS (PARTITION BY score_id ORDER BY onset)")
def keep_new_keys(spark, sf_dir):
    return C.keep_new_elements_only(corpus.chords(_notes(spark, sf_dir)), "key").select("score_id", "onset", "key")


@_query(", l AS (SELECT ev.score_id, ev.onset, max(ev.release) AS release, any_value(key) AS key, any_value(degree) AS degree, any_value(quality) AS quality, any_value(inversion) AS inversion FROM ev ASOF JOIN ch ON ev.score_id = ch.score_id AND ev.onset >= ch.onset GROUP BY 1, 2), n AS (SELECT *, coalesce(lag((key, degree, quality, inversion)) OVER w <> (key, degree, quality, inversion), true) AS n FROM l WINDOW w AS (PARTITION BY score_id ORDER BY onset)), g AS (SELECT score_id, onset, key, degree, quality, inversion FROM n WHERE n) SELECT score_id, onset, coalesce(lead(onset) OVER (PARTITION BY score_id ORDER BY onset), (SELECT max(release) FROM ev WHERE ev.score_id = g.score_id)) AS release, key, degree, quality, inversion FROM g")
def extract_chords(spark, sf_dir):
    n = _notes(spark, sf_dir)
    return C.extract_chord_df(J.label_notes_with_chords(n, corpus.chords(n)))


_SIG = "CASE key WHEN 'C' THEN 0 WHEN 'G' THEN 1 WHEN 'a' THEN 0 WHEN 'F' THEN -1 WHEN 'e' THEN 1 WHEN 'Bb' THEN -2 ELSE -1 END"
_PC = "CASE key WHEN 'C' THEN 0 WHEN 'G' THEN 7 WHEN 'a' THEN 9 WHEN 'F' THEN 5 WHEN 'e' THEN 4 WHEN 'Bb' THEN 10 ELSE 2 END"
_MODE = "CASE WHEN key = lower(key) THEN 'm' ELSE 'M' END"


@_query(f" SELECT score_id, onset, {_SIG} AS key_signature, {_PC} || {_MODE} AS chromatic_key, (({_PC} + 6) % 12 - 6) || 'M' || {_MODE} AS change_from_c, array_to_string(list_transform(CASE WHEN {_MODE} = 'M' THEN [0, 2, 4, 5, 7, 9, 11] ELSE [0, 2, 3, 5, 7, 8, 11] END, lambda x: lower(to_hex((x + {_PC}) % 12))), '') AS scale FROM ch")
def key_functions(spark, sf_dir):
    k = F.col("key")
    return corpus.chords(_notes(spark, sf_dir)).select("score_id", "onset", K.key_signature(k).cast("int").alias("key_signature"), K.chromatic_key(k).alias("chromatic_key"), K.key_change_id(F.lit("C"), k).alias("change_from_c"), K.pcs_to_hex(K.key_pitch_classes(k)).alias("scale"))


@_query(" SELECT row_id, CASE WHEN channel = 9 THEN pitch ELSE pitch + 5 END AS pitch, onset * 2 AS onset, release * 2 AS release FROM ev")
def transpose_and_scale(spark, sf_dir):
    n = B.scale_df(_notes(spark, sf_dir), 2.0)
    return n.select("row_id", K.chromatic_transpose(F.col("pitch"), F.col("channel"), 5).alias("pitch"), "onset", "release")


@_query(_BARS + """, al AS (SELECT score_id, row_id, type, onset, 4 AS k FROM ev UNION ALL SELECT score_id, row_id, type, onset, 0 FROM ms WHERE type = 'time_signature' UNION ALL SELECT score_id, NULL, 'bar', onset, 2 FROM ba), f AS (SELECT score_id, min(onset) AS f FROM ev WHERE onset >= 100 GROUP BY 1),
lb AS (SELECT score_id, max(onset) AS b FROM ba JOIN f USING (score_id) WHERE onset <= f GROUP BY 1) SELECT score_id, type, CASE WHEN type = 'time_signature' THEN b ELSE onset END AS onset, count(*) AS n FROM al JOIN f USING (score_id) JOIN lb USING (score_id)
WHERE onset > f OR (type = 'note' AND onset = f) OR (type = 'time_signature' AND onset = 64) OR (type = 'bar' AND onset = b) GROUP BY ALL""")
def crop(spark, sf_dir):
    return O.crop_df(_barred(spark, sf_dir), 100.0).groupBy("score_id", "type", "onset").agg(F.count(F.lit(1)).alias("n"))


@_query(" SELECT row_id, (pitch >= 48)::BIGINT + (pitch >= 60)::BIGINT AS part, floor(onset / 32)::BIGINT AS segment FROM ev UNION ALL SELECT row_id, p, floor(onset / 32)::BIGINT FROM ms, range(3) r(p) WHERE type <> 'note'")
def split_and_segment(spark, sf_dir):
    return O.segment_df_by_onset(O.split_df_by_pitch(corpus.with_meter(_notes(spark, sf_dir)), [48.0, 60.0]), 32.0).select("row_id", "part", "segment")


@_query(" SELECT row_id FROM ev WHERE onset < 200 AND release > 190")
def notes_sounding_during(spark, sf_dir):
    return O.get_notes_sounding_during(_notes(spark, sf_dir), 190.0, 200.0).select("row_id")


@_query(" SELECT row_id, CASE WHEN onset < 80 THEN onset ELSE 80 + (onset - 80) * 2 END AS onset, CASE WHEN release < 80 THEN release ELSE 80 + (release - 80) * 2 END AS release FROM ev")
def absolute_time(spark, sf_dir):
    n = _notes(spark, sf_dir)
    tempi = n.select("score_id").distinct().withColumn("onset", F.lit(80.0)).withColumn("tempo", F.lit(60.0))
    return B.to_absolute_time(n, tempi).select("row_id", "onset", "release")


def queries() -> dict:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
