"""Queries of operators for meter, cropping, segments, chords and comparison, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.functions import keys as K
from scoreloom.operators import chords as C
from scoreloom.operators import features as E
from scoreloom.operators import harmony as H
from scoreloom.operators import joins as J
from scoreloom.operators import merges as M
from scoreloom.operators import meter as B
from scoreloom.operators import order as O
from scoreloom.operators import slices as S
from scoreloom.operators import stats as A
from scoreloom.plans import corpus
from scoreloom.queries import _BARS, _MOMENTS, _barred, _notes

_REGISTRY: dict[str, tuple] = {}


def _query(sql: str):
    def add(f):
        _REGISTRY[f.__name__] = (f, f"WITH {corpus.SQL.strip()}{sql}")
        return f

    return add


_FACTOR = "CASE WHEN n % 2 = 0 THEN 2 WHEN n % 3 = 0 THEN 3 WHEN n % 5 = 0 THEN 5 WHEN n % 7 = 0 THEN 7 ELSE n END"
_REDUCED = ", x0 AS (SELECT row_id, 1 + row_id % 48 AS n, 1 << (row_id % 4)::INTEGER AS d FROM ev)" + "".join(f", x{k + 1} AS (SELECT row_id, CASE WHEN n > 2 * d THEN n // ({_FACTOR}) ELSE n END AS n, d FROM x{k})" for k in range(6))


@_query(_REDUCED + " SELECT row_id, n::BIGINT AS numerator, d::BIGINT AS denominator FROM x6")
def simplify_time_sigs(spark, sf_dir):
    """A time signature for each row: 1 to 48 over 1, 2, 4 or 8."""
    sign = F.to_json(F.struct((1 + F.pmod("row_id", F.lit(48))).alias("numerator"), F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), (F.pmod("row_id", F.lit(4)) + 1).cast("int")).alias("denominator")))
    done = E.simplify_time_sigs(_notes(spark, sf_dir).select("row_id", F.lit("time_signature").alias("type"), sign.alias("other")))
    return done.select("row_id", *(F.get_json_object("other", f"$.{c}").cast("long").alias(c) for c in ("numerator", "denominator")))


@_query(" SELECT score_id, row_id, (other->>'numerator')::BIGINT * CASE WHEN (other->>'denominator')::BIGINT < 8 THEN 8 // (other->>'denominator')::BIGINT ELSE 1 END AS numerator, greatest(1, (other->>'denominator')::BIGINT // 8) AS denominator FROM ms WHERE type = 'time_signature'")
def scale_time_sigs(spark, sf_dir):
    done = E.scale_time_sigs(corpus.with_meter(_notes(spark, sf_dir)), 8.0).where("type = 'time_signature'")
    return done.select("score_id", "row_id", *(F.get_json_object("other", f"$.{c}").cast("long").alias(c) for c in ("numerator", "denominator")))


@_query(" SELECT row_id, CASE WHEN onset < 40 THEN 120.0 WHEN onset < 80 THEN 90.0 ELSE 60.0 END AS tempo FROM ev")
def make_tempos_explicit(spark, sf_dir):
    """A tempo of 90 beats at 40, and one of a million microseconds a beat at 80."""
    n = _notes(spark, sf_dir).withColumn("other", F.lit(None).cast("string"))
    marks = n.select("score_id").distinct().withColumn("m", F.explode(F.array(*(F.struct(F.lit(-k).cast("long").alias("row_id"), F.lit(t).alias("type"), F.lit(at).alias("onset"), F.lit(f'{{"tempo": {v}}}').alias("other")) for k, t, at, v in ((1, "tempo", 40.0, 90), (2, "set_tempo", 80.0, 1_000_000))))))
    both = n.unionByName(marks.select("score_id", "m.*"), allowMissingColumns=True)
    return B.make_tempos_explicit(both).where("type = 'note'").select("row_id", "tempo")


@_query(", p AS (SELECT DISTINCT score_id, floor(onset) AS onset, floor(onset) + 1 AS release FROM ev), a AS (SELECT *, sum(CASE WHEN lag = onset THEN 0 ELSE 1 END) OVER (PARTITION BY score_id ORDER BY onset) AS g FROM (SELECT *, lag(release) OVER (PARTITION BY score_id ORDER BY onset) AS lag FROM p)) SELECT score_id, min(onset)::DOUBLE AS onset, max(release)::DOUBLE AS release FROM a GROUP BY score_id, g")
def merge_contiguous_durations(spark, sf_dir):
    spans = _notes(spark, sf_dir).select("score_id", F.floor("onset").cast("double").alias("onset")).distinct().withColumn("release", F.col("onset") + 1)
    return M.merge_contiguous_durations(spans)


_PICKUPS = """, p0 AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY onset) AS k FROM ba), p1 AS (SELECT * REPLACE (CASE WHEN k = 1 AND score_id % 2 = 0 THEN onset + 2 ELSE release END AS release) FROM p0),
p2 AS (SELECT score_id, max(release - onset) FILTER (k = 1) AS a, max(release - onset) FILTER (k = 2) AS b FROM p1 GROUP BY 1), pk AS (SELECT score_id, coalesce(a < CASE WHEN score_id % 3 = 0 THEN b ELSE 4 END, false) AS pickup FROM p2)"""


def _with_pickups(spark, sf_dir):
    """The first bar of every other score is two quarters long; each third score has no time signature."""
    first = F.row_number().over(Window.partitionBy("score_id", "type").orderBy("onset")) == 1
    short = (F.col("type") == "bar") & F.col("first") & (F.col("score_id") % 2 == 0)
    df = _barred(spark, sf_dir).withColumn("first", first).withColumn("release", F.when(short, F.col("onset") + 2).otherwise(F.col("release")))
    return df.where((F.col("type") != "time_signature") | (F.col("score_id") % 3 != 0)).drop("first")


@_query(_BARS + _PICKUPS + " SELECT ev.row_id, p1.k - pickup::INTEGER AS bar_number, ev.release - p1.onset AS offset FROM ev ASOF JOIN p1 ON ev.score_id = p1.score_id AND ev.release >= p1.onset JOIN pk ON pk.score_id = ev.score_id")
def bar_and_offset(spark, sf_dir):
    """The bar and the place in it at which each note ends; pickups are bar 0."""
    bars = _with_pickups(spark, sf_dir)
    return E.bar_and_offset(bars, _notes(spark, sf_dir).select("score_id", "row_id", F.col("release").alias("t"))).select("row_id", "bar_number", "offset")


@_query(_BARS + _PICKUPS + " SELECT score_id, pickup FROM pk")
def has_pickup(spark, sf_dir):
    return E.has_pickup(_with_pickups(spark, sf_dir))


@_query(_BARS + ", lo AS (SELECT score_id, onset, release, CASE WHEN onset >= 64 THEN 3.0 ELSE 4.0 END / 2 AS d FROM ba) SELECT score_id, (onset + k * d)::DOUBLE AS onset, least(release, onset + (k + 1) * d)::DOUBLE AS release FROM (SELECT *, unnest(range(0, greatest(ceil((release - onset) / d)::BIGINT, 1))) AS k FROM lo)")
def split_long_bars(spark, sf_dir):
    """Bars cut to half their time signature."""
    half = B.add_time_sig_dur(_barred(spark, sf_dir)).withColumn("time_sig_dur", F.col("time_sig_dur") / 2)
    return E.split_long_bars(half).where("type = 'bar'").select("score_id", "onset", "release")


@_query(_BARS + " SELECT row_id, floor((bar_number - 1) / 3)::BIGINT AS bar_group FROM ev ASOF JOIN ba ON ev.score_id = ba.score_id AND ev.onset >= ba.onset")
def segment_df_by_bar(spark, sf_dir):
    return O.segment_df_by_bar(B.make_bar_explicit(_barred(spark, sf_dir)), 3).where("type = 'note'").select("row_id", "bar_group")


@_query(_BARS + ", nu AS (SELECT score_id, max(bar_number) AS b FROM ba WHERE onset <= 70 GROUP BY 1), nb AS (SELECT ev.score_id, ev.row_id, ba.bar_number FROM ev ASOF JOIN ba ON ev.score_id = ba.score_id AND ev.onset >= ba.onset) SELECT row_id FROM nb JOIN nu USING (score_id) WHERE bar_number BETWEEN b - 2 AND b + 1")
def get_context_bars(spark, sf_dir):
    """Notes of the bar at 70, of the two before and the one after."""
    return E.get_context_bars(B.make_bar_explicit(_barred(spark, sf_dir)), 70.0, 2, 1).where("type = 'note'").select("row_id")


@_query(" SELECT score_id, onset, arg_min(row_id, (pitch, release, row_id)) AS row_id FROM ev GROUP BY 1, 2")
def eligible_onsets(spark, sf_dir):
    return O.eligible_onsets(_notes(spark, sf_dir))


@_query(" SELECT score_id, row_id, CASE WHEN pitch IS NOT NULL AND row_number() OVER (PARTITION BY score_id, onset ORDER BY pitch NULLS LAST, row_id) = 1 THEN type ELSE '' END AS label FROM ms")
def unique_annotations_per_onset(spark, sf_dir):
    """Time signatures at the onset of a note have no pitch and no label."""
    df = corpus.with_meter(_notes(spark, sf_dir)).withColumn("label", F.col("type"))
    return A.unique_annotations_per_onset(df, "label").select("score_id", "row_id", "label")


@_query(" SELECT type, count(*) AS n, sum(onset) AS total FROM (SELECT type, onset FROM ev UNION ALL SELECT type, onset FROM ms WHERE type <> 'note') GROUP BY 1")
def merge_df(spark, sf_dir):
    """Two halves of the notes, each with all time signatures, put together."""
    df = corpus.with_meter(_notes(spark, sf_dir))
    half = lambda k: df.where((F.col("type") != "note") | (F.pmod("row_id", F.lit(2)) == k))
    return J.merge_df(half(0), half(1)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("onset").alias("total"))


@_query(", s AS (SELECT DISTINCT score_id, onset, pitch::INTEGER % 12 AS pc FROM ev), r AS (SELECT a.score_id, a.onset, a.pc, list((b.pc - a.pc + 12) % 12 ORDER BY (b.pc - a.pc + 12) % 12 DESC) AS back FROM s a JOIN s b USING (score_id, onset) GROUP BY ALL), m AS (SELECT score_id, onset, min(back) AS back FROM r GROUP BY 1, 2) SELECT score_id, onset, list_aggregate(list_reverse(back), 'string_agg', ' ') AS prime_form FROM m")
def prime_form(spark, sf_dir):
    sets = _notes(spark, sf_dir).groupBy("score_id", "onset").agg(F.collect_set(A.pitch_class()).alias("pcs"))
    return sets.select("score_id", "onset", F.array_join(E.prime_form(F.col("pcs")), " ").alias("prime_form"))


@_query(", x AS (SELECT row_id, [pitch / 32, onset / 128, release / 256] AS l FROM ev) SELECT row_id, round(exp(l[1]) / (exp(l[1]) + exp(l[2]) + exp(l[3])), 9) AS p FROM x")
def softmax(spark, sf_dir):
    logits = F.array(F.col("pitch") / 32, F.col("onset") / 128, F.col("release") / 256)
    return _notes(spark, sf_dir).select("row_id", F.round(H.softmax(logits)[0], 9).alias("p"))


@_query(_MOMENTS + " SELECT score_id, onset, arg_min(row_id, (pitch, row_id)) AS row_id FROM sl GROUP BY 1, 2")
def unique_slices(spark, sf_dir):
    return A.unique_slices(S.salami_slice(_notes(spark, sf_dir), False)).select("score_id", "onset", "row_id")


@_query(" SELECT row_id, (row_id % 12) * 7 % 12 - CASE WHEN (row_id % 12) * 7 % 12 > 6 THEN 12 ELSE 0 END AS major, (row_id % 12 + 3) * 7 % 12 - CASE WHEN (row_id % 12 + 3) * 7 % 12 > 6 THEN 12 ELSE 0 END AS minor FROM ev")
def key_signature_of_pc_and_mode(spark, sf_dir):
    pc = F.pmod("row_id", F.lit(12))
    return _notes(spark, sf_dir).select("row_id", *(K.key_signature_of(pc, F.lit(m)).cast("long").alias(name) for m, name in (("M", "major"), ("m", "minor"))))


@_query(" SELECT score_id, onset, CASE WHEN split_part(degree, '/', 1) = 'I' AND contains(degree, '/') THEN upper(split_part(degree, '/', 2)) ELSE split_part(degree, '/', 1) END AS primary_degree, CASE WHEN contains(degree, '/') AND split_part(degree, '/', 1) <> 'I' THEN split_part(degree, '/', 2) ELSE 'I' END AS secondary_degree FROM (SELECT * REPLACE (replace(degree, 'V/V', 'I/V') AS degree) FROM ch)")
def replace_spurious_tonics(spark, sf_dir):
    c = corpus.chords(_notes(spark, sf_dir)).withColumn("degree", F.replace("degree", F.lit("V/V"), F.lit("I/V")))
    return C.replace_spurious_tonics(C.split_degrees(c)).select("score_id", "onset", "primary_degree", "secondary_degree")


@_query(" SELECT score_id, onset, regexp_replace(degree || inversion::INTEGER, '[0-9]+$', '') AS numeral, list_aggregate(list_transform([inversion::INTEGER, 11, inversion::INTEGER + 4], lambda x: lower(to_hex((x + 5) % 12))), 'string_agg', '') AS pcs FROM ch")
def strings_of_chords(spark, sf_dir):
    """Numerals without their inversion, and hex pitch classes moved by a fourth."""
    c, i = corpus.chords(_notes(spark, sf_dir)), F.col("inversion").cast("int")
    text = K.pcs_to_hex(F.array(i, F.lit(11), i + 4))
    return c.select("score_id", "onset", H.strip_inversion(F.concat("degree", i.cast("string"))).alias("numeral"), K.pcs_to_hex(K.transpose_pcs(K.hex_to_pcs(text), 5)).alias("pcs"))


@_query(" SELECT instrument, count(*) AS n_notes, (SELECT count(*) FROM ms WHERE type <> 'note') AS n_marks FROM ev WHERE instrument IN ('view', 'error') GROUP BY 1")
def split_by_instrument(spark, sf_dir):
    """Notes of two instruments, each part with all marks."""
    parts = O.split_by(corpus.with_meter(_notes(spark, sf_dir)), "instrument", ["view", "error"], with_marks=True)
    counted = [p.groupBy().agg(F.lit(v).alias("instrument"), F.count_if(F.col("type") == "note").alias("n_notes"), F.count_if(F.col("type") != "note").alias("n_marks")) for v, p in parts.items()]
    return counted[0].unionByName(counted[1])


@_query(" SELECT (row_id // 2) % 3 AS track, channel, count(*) AS n, sum(row_id)::BIGINT AS row_ids FROM ev WHERE row_id % 7 <> 0 GROUP BY ALL")
def split_musicdf(spark, sf_dir):
    """Every seventh note tells no track, and no time signature does."""
    track = F.when((F.col("type") == "note") & (F.col("row_id") % 7 != 0), F.floor(F.col("row_id") / 2) % 3)
    parts = O.split_musicdf(corpus.with_meter(_notes(spark, sf_dir)).withColumn("track", track))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("row_ids")).select("part.*", "n", "row_ids")


@_query(", q AS (SELECT score_id, row_id, round_even(onset * 2, 0) / 2 AS o, CASE WHEN round_even(onset * 2, 0) = round_even(release * 2, 0) THEN (round_even(release * 2, 0) + 1) / 2 ELSE round_even(release * 2, 0) / 2 END AS r, onset, release FROM ev) SELECT score_id, count(*) AS n_before, count(*) FILTER (o < 100) AS n_after, count(*) FILTER (o >= 100) AS n_removed, 0::BIGINT AS n_added, count(*) FILTER (o < 100 AND (o <> onset OR r <> release)) AS n_changed FROM q GROUP BY 1")
def edit_counts(spark, sf_dir):
    """What quantizing and then cutting at 100 does to the notes."""
    n = _notes(spark, sf_dir)
    return O.edit_counts(n, B.quantize_df(n, 2).where("onset < 100"), ["onset", "release"])


_CHORD_PCS = """, a AS (SELECT score_id, onset, quality, inversion::INTEGER AS i, CASE key WHEN 'C' THEN 0 WHEN 'G' THEN 7 WHEN 'a' THEN 9 WHEN 'F' THEN 5 WHEN 'e' THEN 4 WHEN 'Bb' THEN 10 ELSE 2 END AS k, key IN ('a', 'e', 'd') AS mi, split_part(degree, '/', 1) AS d, CASE WHEN contains(degree, '/') THEN split_part(degree, '/', 2) END AS t FROM ch),
b AS (SELECT *, k + CASE WHEN t = 'V' THEN 7 WHEN t = 'ii' THEN 2 ELSE 0 END AS tonic, CASE WHEN t = 'V' THEN false WHEN t = 'ii' THEN true ELSE mi END AS own FROM a),
c AS (SELECT *, tonic + CASE d WHEN 'I' THEN 0 WHEN 'V' THEN 7 WHEN 'IV' THEN 5 WHEN 'ii' THEN 2 ELSE CASE WHEN own AND quality IN ('M', 'Mm7') THEN 8 ELSE 9 END END AS root FROM b),
e AS (SELECT *, list_transform(CASE quality WHEN 'M' THEN [0, 4, 7] WHEN 'm' THEN [0, 3, 7] WHEN 'Mm7' THEN [0, 4, 7, 10] ELSE [0, 3, 6, 9] END, lambda x: (x + root) % 12) AS p FROM c)
SELECT score_id, onset, CASE WHEN i < len(p) THEN list_aggregate(list_transform(list_concat(p[i + 1:], p[:i]), lambda x: lower(to_hex(x))), 'string_agg', '') END AS chord_pcs FROM e"""


@_query(_CHORD_PCS)
def add_chord_pcs(spark, sf_dir):
    """Keys stand only where they are new, and are carried on."""
    c = C.keep_new_elements_only(corpus.chords(_notes(spark, sf_dir)), "key", None)
    return H.add_chord_pcs(c).select("score_id", "onset", "chord_pcs")


def queries() -> dict:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items()}
