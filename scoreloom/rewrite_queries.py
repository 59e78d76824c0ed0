"""Queries of the operators that rewrite keys and numerals, check chords, transpose, drop octave doublings, cut scores by rows and tell differences, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions import degrees as D
from scoreloom.functions import keys as K
from scoreloom.operators import augment as G
from scoreloom.operators import checks as H
from scoreloom.operators import dictionaries as V
from scoreloom.operators import differences as X
from scoreloom.operators import doublings as U
from scoreloom.operators import meter as B
from scoreloom.operators import modulations as M
from scoreloom.operators import octaves as O
from scoreloom.operators import order
from scoreloom.operators import segments as S
from scoreloom.operators import slices as L
from scoreloom.operators import spelling as P
from scoreloom.plans import corpus
from scoreloom.queries import _BARS

_REGISTRY: dict[str, tuple] = {}


def _query(sql: str):
    def add(f):
        _REGISTRY[f.__name__] = (f, f"WITH RECURSIVE {corpus.SQL.strip()}{sql}")
        return f

    return add


#: Keys and degrees of chords for these queries, by the number of a chord and of its group of four.
KEYS = ["C", "G", "C", "a", "C", "F", "C", "Ab", "c", "Eb", "c"]
DEGREES = ["I", "V/V", "V", "V/V", "IV/V", "VII/VI", "II/VI", "VI", "V/bIII", "I/bIII", "I/IV", "V", "II/V", "IV", "#VI/II", "VIIo6"]
#: Parts of a quarter that `snapped_times` divides times by.
TUPLETS = [1, 3, 5, 7, 6]
AWAY = ["V/V", "II/V", "V/IV", "I/IV", "V/bVII", "VII/VI"]


def modulating_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_id, onset, key, degree: one chord for every eight quarters with a note; each third group of four is all tonicized."""
    at = corpus.chords(corpus.scores(spark, sf_dir)).select("score_id", "onset", F.floor(F.col("onset") / corpus.CHORD).alias("b"))
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), F.pmod(k, F.lit(len(values))).cast("int"))
    group = F.floor(F.col("b") / 4)
    degree = F.when(F.pmod(group + F.col("score_id"), F.lit(3)) == 0, pick(AWAY, F.col("score_id") + F.floor(F.col("b") / 2))).otherwise(pick(DEGREES, F.col("score_id") * 3 + F.col("b")))
    return at.select("score_id", "onset", pick(KEYS, F.col("score_id") + group).alias("key"), degree.alias("degree"))


def _fifths(key: str) -> str:
    return f"(instr('FCGDAEB', upper({key}[1])) - 1 + 7 * (len(replace({key}[2:], 'b', '')) - len(replace({key}[2:], '#', ''))))"


def _mode(key: str) -> str:
    return f"CASE WHEN {key}[1] = upper({key}[1]) THEN 'M' ELSE 'm' END"


def _named(fifths: str, mode: str) -> str:
    pc = f"((({fifths}) - 1) * 7 % 12 + 12) % 12 + 1"
    return f"CASE WHEN {mode} = 'M' THEN (['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B'])[{pc}] ELSE (['c', 'c#', 'd', 'eb', 'e', 'f', 'f#', 'g', 'g#', 'a', 'bb', 'b'])[{pc}] END"


def _list(values: list[str]) -> str:
    return "([" + ", ".join(repr(v) for v in values) + "])"


#: The chords; steps of the scale by mode; what a second degree makes a key of; numerals in a key by distance in fifths.
_TABLES = f""", mo AS (SELECT score_id, CAST(b * 8 AS DOUBLE) AS onset, {_list(KEYS)}[(score_id + b // 4) % {len(KEYS)} + 1] AS key,
  CASE WHEN (b // 4 + score_id) % 3 = 0 THEN {_list(AWAY)}[(score_id + b // 2) % {len(AWAY)} + 1] ELSE {_list(DEGREES)}[(score_id * 3 + b) % {len(DEGREES)} + 1] END AS degree FROM cb),
sp AS (SELECT score_id, onset, key, regexp_extract(split_part(degree, '/', 1), '^([b#]*)(.*)$', 1) AS pa, regexp_extract(split_part(degree, '/', 1), '^([b#]*)(.*)$', 2) AS pd,
  regexp_extract(split_part(degree, '/', 2), '([b#]*)([IViv]+)', 1) AS sa, coalesce(nullif(regexp_extract(split_part(degree, '/', 2), '([b#]*)([IViv]+)', 2), ''), 'I') AS sd FROM mo),
st(mode, num, base) AS (VALUES ('M', 'I', 0), ('M', 'II', 2), ('M', 'III', 4), ('M', 'IV', -1), ('M', 'V', 1), ('M', 'VI', 3), ('M', 'VII', 5), ('m', 'I', 0), ('m', 'II', 2), ('m', 'III', -3), ('m', 'IV', -1), ('m', 'V', 1), ('m', 'VI', -4), ('m', 'VII', -2)),
sg(sig, d) AS (VALUES ('bb', -14), ('b', -7), ('', 0), ('#', 7), ('##', 14)),
rn AS (SELECT mode, sig || num AS rn, base + d AS off FROM st, sg),
tz AS (SELECT mode, sig || num AS rn, CASE WHEN mode = 'm' AND sig = 'b' AND num = 'VII' THEN -13 ELSE base + d END AS off,
  CASE WHEN list_contains(CASE mode WHEN 'M' THEN ['II', 'III', 'VI', 'VII'] ELSE ['II', 'IV', 'V', '#VI', '#VII'] END, sig || num) THEN 'm' ELSE 'M' END AS tmode FROM st, sg WHERE length(sig) < 2 AND (sig || num) <> 'I')"""

#: From ep (score_id, onset, key, pa, pd, sa, sd) to degrees: I of a second degree becomes that degree.
_SPURIOUS = """, rs AS (SELECT score_id, onset, key, CASE WHEN pd = 'I' AND sd <> 'I' THEN sa || upper(sd) ELSE pa || pd END AS one, CASE WHEN (pd = 'I' AND sd <> 'I') OR (sd = 'I' AND sa = '') THEN '' ELSE '/' || sa || sd END AS two FROM ep)
SELECT score_id, onset, key, one || two AS degree FROM rs"""


def _long(max_duration: str, max_chords: str) -> str:
    return _TABLES + f"""
, a1 AS (SELECT *, CASE WHEN lag((pd, sd, key, pa, sa)) OVER o = (pd, sd, key, pa, sa) THEN 0 ELSE 1 END AS new FROM sp WINDOW o AS (PARTITION BY score_id ORDER BY onset)),
a2 AS (SELECT *, sum(new) OVER (PARTITION BY score_id ORDER BY onset) AS g FROM a1),
hm AS (SELECT DISTINCT score_id, g, key, pa, pd, sa, sd FROM a2),
nb AS (SELECT h.score_id, h.g, coalesce(h.pd = b.sd AND h.key = b.key AND h.pa = b.sa, false) AS l, coalesce(h.pd = n.sd AND h.key = n.key AND h.pa = n.sa, false) AS r
  FROM hm h LEFT JOIN hm b ON b.score_id = h.score_id AND b.g = h.g - 1 LEFT JOIN hm n ON n.score_id = h.score_id AND n.g = h.g + 1),
a3 AS (SELECT a2.*, sd = 'I' AND CASE WHEN pd = 'V' THEN l AND r ELSE l OR r END AS hit FROM a2 JOIN nb USING (score_id, g)),
a4 AS (SELECT score_id, onset, key, pa, CASE WHEN hit THEN 'I' ELSE pd END AS pd, CASE WHEN hit THEN pa ELSE sa END AS sa, CASE WHEN hit THEN pd ELSE sd END AS sd, CASE WHEN hit AND pd[-1] IN ('I', 'V') THEN 'M' ELSE '_' END AS sm FROM a3),
a5 AS (SELECT *, CASE WHEN lag((pd, sd, key, pa, sa, sm)) OVER o = (pd, sd, key, pa, sa, sm) THEN 0 ELSE 1 END AS new, CASE WHEN lag((sd, key, sa)) OVER o = (sd, key, sa) THEN 0 ELSE 1 END AS t FROM a4 WINDOW o AS (PARTITION BY score_id ORDER BY onset)),
a6 AS (SELECT *, sum(t) OVER (PARTITION BY score_id ORDER BY onset) AS run FROM a5),
fs AS (SELECT score_id, run, any_value(key) AS key, any_value(sa || sd) AS rn, any_value(sd) AS sd, min(onset) AS t0, arg_min(sm, onset) AS sm, sum(greatest(new, t)) AS n, count(*) AS n_rows FROM a6 GROUP BY ALL),
os AS (SELECT a6.score_id, a6.run, bool_and(f OR v) AND bool_or(f) AND bool_or(v) AS swings FROM a6 JOIN fs USING (score_id, run),
  LATERAL (SELECT a6.pd = 'I' AND pa = '' AS f, (a6.pd = 'V' AND pa = '') OR (a6.pd = 'VII' AND pa = CASE WHEN CASE WHEN fs.sm = '_' THEN {_mode('fs.key')} ELSE fs.sm END = 'm' THEN '#' ELSE '' END) AS v) GROUP BY ALL),
dc AS (SELECT fs.*, coalesce(lead(t0) OVER (PARTITION BY score_id ORDER BY run) - t0, 'inf'::DOUBLE) AS lasts, n_rows >= 3 AND swings AS swings FROM fs JOIN os USING (score_id, run)),
gn AS (SELECT score_id, run, {_named(_fifths('key') + ' + off', "CASE WHEN sm = '_' THEN tmode ELSE sm END")} AS new_key FROM dc JOIN tz ON tz.mode = {_mode('key')} AND tz.rn = dc.rn WHERE sd <> 'I' AND ((n > {max_chords} AND NOT swings) OR lasts > {max_duration})),
ep AS (SELECT score_id, onset, coalesce(new_key, key) AS key, pa, pd, CASE WHEN new_key IS NULL THEN sa ELSE '' END AS sa, CASE WHEN new_key IS NULL THEN sd ELSE 'I' END AS sd FROM a6 LEFT JOIN gn USING (score_id, run))""" + _SPURIOUS


@_query(_long("40", "1"))
def remove_long_tonicizations(spark, sf_dir):
    """Tonicizations of more than one harmony, or longer than five chords without a gap."""
    return M.remove_long_tonicizations(modulating_chords(spark, sf_dir), max_duration=40.0, max_chords=1).select("score_id", "onset", "key", "degree")


_SHORT = _TABLES + f"""
, b1 AS (SELECT *, CASE WHEN lag(key) OVER o = key THEN 0 ELSE 1 END AS k, CASE WHEN lag((pd, sd, key, pa, sa)) OVER o = (pd, sd, key, pa, sa) THEN 0 ELSE 1 END AS new FROM sp WINDOW o AS (PARTITION BY score_id ORDER BY onset)),
b2 AS (SELECT *, sum(k) OVER (PARTITION BY score_id ORDER BY onset) AS run FROM b1),
kr AS (SELECT score_id, run, any_value(key) AS key, min(onset) AS t0, sum(new) AS n FROM b2 GROUP BY ALL),
kd AS (SELECT *, lead(key) OVER (PARTITION BY score_id ORDER BY run) AS nxt, n < 4 OR coalesce(lead(t0) OVER (PARTITION BY score_id ORDER BY run) - t0, 'inf'::DOUBLE) < 40 AS short FROM kr),
wk AS (SELECT score_id, run, key, key AS now FROM kd WHERE run = 1
  UNION ALL SELECT kd.score_id, kd.run, kd.key, CASE WHEN kd.short AND kd.nxt = wk.now THEN wk.now ELSE kd.key END FROM wk JOIN kd ON kd.score_id = wk.score_id AND kd.run = wk.run + 1),
b3 AS (SELECT b2.*, now, CASE WHEN sd = 'I' THEN {_fifths('b2.key')} ELSE {_fifths('b2.key')} + rn.off END AS root FROM b2 JOIN wk USING (score_id, run) LEFT JOIN rn ON rn.mode = {_mode('b2.key')} AND rn.rn = CASE WHEN {_mode('b2.key')} = 'm' AND sa || sd IN ('bVI', 'bVII') THEN sd ELSE sa || sd END),
ep AS (SELECT score_id, onset, now AS key, pa, pd, CASE WHEN now = b3.key THEN sa ELSE regexp_extract(rn.rn, '^([b#]*)', 1) END AS sa, CASE WHEN now = b3.key THEN sd ELSE regexp_extract(rn.rn, '([IV]+)$', 1) END AS sd
  FROM b3 LEFT JOIN rn ON rn.mode = {_mode('now')} AND rn.off = root - {_fifths('now')})""" + _SPURIOUS


@_query(_SHORT)
def remove_short_modulations(spark, sf_dir):
    """Modulations of fewer than four harmonies or 40 quarters; in SQL by a walk over the keys of each score."""
    return M.remove_short_modulations(modulating_chords(spark, sf_dir), min_duration=40.0, min_chords=4).select("score_id", "onset", "key", "degree")


_PHANTOM = _TABLES + f"""
, c1 AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY score_id ORDER BY onset) = key THEN 0 ELSE 1 END AS k FROM sp),
c2 AS (SELECT *, sum(k) OVER (PARTITION BY score_id ORDER BY onset) AS seg FROM c1),
sg2 AS (SELECT score_id, seg, any_value(key) AS key, NOT bool_or(sd = 'I') AS away FROM c2 GROUP BY ALL),
sg3 AS (SELECT *, CASE WHEN away AND lag(away) OVER o THEN 0 ELSE 1 END AS s FROM sg2 WINDOW o AS (PARTITION BY score_id ORDER BY seg)),
sg4 AS (SELECT *, sum(s) OVER (PARTITION BY score_id ORDER BY seg) AS region FROM sg3),
rg AS (SELECT score_id, region, min(seg) AS a, max(seg) AS b FROM sg4 WHERE away GROUP BY ALL),
nk AS (SELECT rg.*, p.key AS before, n.key AS after FROM rg LEFT JOIN sg4 p ON p.score_id = rg.score_id AND p.seg = a - 1 LEFT JOIN sg4 n ON n.score_id = rg.score_id AND n.seg = b + 1),
ch3 AS (SELECT c2.*, region, before, after, {_named(_fifths('c2.key') + ' + off', 'tmode')} AS tonic FROM c2 JOIN sg4 USING (score_id, seg) JOIN nk USING (score_id, region) JOIN tz ON tz.mode = {_mode('c2.key')} AND tz.rn = sa || sd),
ch4 AS (SELECT *, {_fifths('tonic')} - CASE WHEN {_mode('tonic')} = 'm' THEN 3 ELSE 0 END AS sh, CASE WHEN lag(tonic) OVER (PARTITION BY score_id, region ORDER BY onset) = tonic THEN 0 ELSE 1 END AS t FROM ch3),
ch5 AS (SELECT *, sum(t) OVER (PARTITION BY score_id, region ORDER BY onset) AS blk FROM ch4),
bl AS (SELECT score_id, region, blk, any_value(before) AS before, any_value(after) AS after, sh, count(*) AS n FROM ch5 GROUP BY score_id, region, blk, sh),
ds AS (SELECT *, abs((sh - ({_fifths('before')} - CASE WHEN {_mode('before')} = 'm' THEN 3 ELSE 0 END) + 606) % 12 - 6) * n AS cb1, abs((sh - ({_fifths('after')} - CASE WHEN {_mode('after')} = 'm' THEN 3 ELSE 0 END) + 606) % 12 - 6) * n AS ca FROM bl),
kk AS (SELECT DISTINCT score_id, region, before, after, unnest(range(0, (SELECT max(blk)::BIGINT + 1 FROM ds))) AS cut FROM ds),
co AS (SELECT kk.score_id, kk.region, kk.cut, any_value(kk.before) AS before, any_value(kk.after) AS after, sum(CASE WHEN blk <= cut THEN cb1 ELSE ca END) AS cost, max(blk) AS m FROM kk JOIN ds USING (score_id, region) GROUP BY kk.score_id, kk.region, kk.cut),
be AS (SELECT score_id, region, CASE WHEN any_value(before) IS NULL THEN 0 WHEN any_value(after) IS NULL THEN max(m) ELSE arg_min(cut, (cost, -cut)) END AS cut FROM co WHERE cut <= m GROUP BY ALL),
to1 AS (SELECT ch5.score_id, ch5.onset, tonic, CASE WHEN blk <= cut THEN before ELSE after END AS dest FROM ch5 JOIN be USING (score_id, region) WHERE before IS NOT NULL OR after IS NOT NULL),
to2 AS (SELECT score_id, onset, dest, rn.rn FROM to1 JOIN rn ON rn.mode = {_mode('dest')} AND rn.off = {_fifths('tonic')} - {_fifths('dest')}),
ep AS (SELECT c2.score_id, c2.onset, coalesce(dest, key) AS key, pa, pd, CASE WHEN dest IS NULL THEN sa WHEN regexp_extract(rn, '([IV]+)$', 1) = 'I' THEN '' ELSE regexp_extract(rn, '^([b#]*)', 1) END AS sa, CASE WHEN dest IS NULL THEN sd ELSE regexp_extract(rn, '([IV]+)$', 1) END AS sd
  FROM c2 LEFT JOIN to2 USING (score_id, onset))""" + _SPURIOUS


@_query(_PHANTOM)
def remove_phantom_keys(spark, sf_dir):
    """In SQL every cut of every stretch is priced."""
    return M.remove_phantom_keys(modulating_chords(spark, sf_dir)).select("score_id", "onset", "key", "degree")


@_query(_TABLES + f""", pt AS (SELECT score_id, onset, key, CASE WHEN pd = 'VIIo6' THEN 'VII' ELSE pd END AS num, pa FROM sp),
ro AS (SELECT score_id, onset, pt.key, {_fifths('pt.key')} + off AS root FROM pt JOIN rn ON rn.mode = {_mode('pt.key')} AND rn.rn = CASE WHEN {_mode('pt.key')} = 'm' AND pa || num IN ('bVI', 'bVII') THEN num ELSE pa || num END)
SELECT score_id, onset, (['F', 'C', 'G', 'D', 'A', 'E', 'B'])[(root % 7 + 7) % 7 + 1] || CASE WHEN root >= 0 THEN repeat('#', (root // 7)::BIGINT) ELSE repeat('-', ((6 - root) // 7)::BIGINT) END AS root_pitch, rn.rn AS in_c FROM ro JOIN rn ON rn.mode = 'M' AND rn.off = root - 1""")
def numerals_and_pitches(spark, sf_dir):
    """Roots of chords as spelled pitches, and as numerals of C."""
    s = M.split_with_mode(modulating_chords(spark, sf_dir))
    numeral = F.concat(F.when(F.col("primary_alteration") == "_", "").otherwise(F.col("primary_alteration")), F.regexp_extract("primary_degree", "^([IV]+)", 1))
    s = s.withColumn("root_pitch", D.rn_to_spelled_pitch(numeral, F.col("key")))
    return s.select("score_id", "onset", "root_pitch", D.spelled_pitch_to_rn(F.col("root_pitch"), F.lit("C"), F.lit("M")).alias("in_c"))


#: Stretches of this many quarters are doubled in turn.
DOUBLED = 32


def doubled_lines(spark: SparkSession, sf_dir: str, within: bool = False) -> DataFrame:
    """One line for each instrument, doubled an octave up (two in each third stretch): within the instrument; or, of
    clicks by the part 'yy' and, in the other stretches, of views by the part 'zz', which has a note below too."""
    n = corpus.scores(spark, sf_dir).select("score_id", "row_id", "type", "instrument", "pitch", "onset", "release")
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("score_id", "instrument", "onset").orderBy("row_id"))).where("k = 1").drop("k")
    stretch = F.floor(F.col("onset") / DOUBLED)
    up = n.withColumn("pitch", F.col("pitch") + F.when(stretch % 3 == 0, 24).otherwise(12)).withColumn("row_id", F.col("row_id") + (1 << 40))
    if within:
        return n.unionByName(up.where(stretch % 2 == 0))
    yy = up.where((F.col("instrument") == "click") & (stretch % 2 == 0)).withColumn("instrument", F.lit("yy"))
    zz = up.where((F.col("instrument") == "view") & (stretch % 2 == 1)).withColumn("instrument", F.lit("zz"))
    below = zz.withColumns({"pitch": F.lit(30.0), "release": F.col("onset") + 0.125, "row_id": F.col("row_id") + (1 << 41)})
    return n.unionByName(yy).unionByName(zz).unionByName(below)


_LINES = f""", l0 AS (SELECT score_id, row_id, instrument, pitch, onset, release, floor(onset / {DOUBLED})::BIGINT AS s FROM ev QUALIFY row_number() OVER (PARTITION BY score_id, instrument, onset ORDER BY row_id) = 1),
up AS (SELECT score_id, row_id + (1::BIGINT << 40) AS row_id, instrument, pitch + CASE WHEN s % 3 = 0 THEN 24 ELSE 12 END AS pitch, onset, release, s FROM l0)"""
_LOW = "lo AS (SELECT t.score_id, t.t, min(n.pitch) AS low FROM (SELECT DISTINCT score_id, onset AS t FROM nt) t JOIN nt n ON n.score_id = t.score_id AND n.onset <= t.t AND n.release > t.t GROUP BY ALL)"


@_query(_LINES + f""", nt AS (SELECT * FROM l0 UNION ALL SELECT * FROM up WHERE s % 2 = 0), {_LOW},
onum AS (SELECT DISTINCT score_id, instrument, onset, dense_rank() OVER (PARTITION BY score_id, instrument ORDER BY onset) AS k FROM nt),
pr AS (SELECT a.score_id, a.instrument, (b.pitch - a.pitch)::INTEGER AS i, k, a.pitch <= low AS is_low, a.row_id AS lid, b.row_id AS hid, a.pitch FROM nt a JOIN nt b ON b.score_id = a.score_id AND b.instrument = a.instrument AND b.onset = a.onset AND b.release = a.release AND b.pitch - a.pitch IN (12, 24, 36)
  JOIN onum ON onum.score_id = a.score_id AND onum.instrument = a.instrument AND onum.onset = a.onset JOIN lo ON lo.score_id = a.score_id AND lo.t = a.onset),
ps AS (SELECT *, CASE WHEN k - lag(k) OVER o = 1 AND abs(pitch - lag(pitch) OVER o) <= 12 THEN 0 ELSE 1 END AS new FROM pr WINDOW o AS (PARTITION BY score_id, instrument, i ORDER BY k)),
pg AS (SELECT *, sum(new) OVER (PARTITION BY score_id, instrument, i ORDER BY k) AS g FROM ps),
ls AS (SELECT score_id, CASE WHEN bool_or(is_low) OVER w THEN hid ELSE lid END AS row_id FROM pg WINDOW w AS (PARTITION BY score_id, instrument, i, g) QUALIFY count(*) OVER w >= 3)
SELECT score_id, row_id, instrument, pitch FROM nt ANTI JOIN ls USING (score_id, row_id)""")
def dedouble_octaves_within_instrument(spark, sf_dir):
    """Lines with one octave at an onset at most, so that streaks are islands in SQL."""
    return O.dedouble_octaves_within_instrument(doubled_lines(spark, sf_dir, True)).select("score_id", "row_id", "instrument", "pitch")


@_query(_LINES + f""", zz AS (SELECT * REPLACE ('zz' AS instrument) FROM up WHERE instrument = 'view' AND s % 2 = 1),
nt AS (SELECT * FROM l0 UNION ALL SELECT * REPLACE ('yy' AS instrument) FROM up WHERE instrument = 'click' AND s % 2 = 0 UNION ALL FROM zz UNION ALL SELECT * REPLACE (30.0 AS pitch, onset + 0.125 AS release, row_id + (1::BIGINT << 41) AS row_id) FROM zz), {_LOW},
nq AS (SELECT *, row_number() OVER (PARTITION BY score_id, instrument ORDER BY onset, pitch, row_id) AS k, pitch % 12 AS pc FROM nt),
me AS (SELECT a.score_id, a.instrument AS a, b.instrument AS b, a.k, a.k - b.k AS d, a.pitch AS ap, b.pitch AS bp, a.row_id AS ai, b.row_id AS bi, low FROM nq a JOIN nq b ON b.score_id = a.score_id AND b.onset = a.onset AND round(b.release * 16) = round(a.release * 16) AND b.pc = a.pc AND a.instrument < b.instrument JOIN lo ON lo.score_id = a.score_id AND lo.t = a.onset),
mg AS (SELECT *, k - row_number() OVER (PARTITION BY score_id, a, b, d ORDER BY k) AS g FROM me),
l1 AS (SELECT DISTINCT score_id, CASE WHEN CASE WHEN bool_or(least(ap, bp) <= low) OVER w THEN avg(ap) OVER w > avg(bp) OVER w ELSE avg(ap) OVER w < avg(bp) OVER w END THEN ai ELSE bi END AS row_id FROM mg WINDOW w AS (PARTITION BY score_id, a, b, d, g) QUALIFY count(*) OVER w >= 3),
rt AS (SELECT * FROM nt ANTI JOIN l1 USING (score_id, row_id)),
cd AS (SELECT DISTINCT score_id, instrument FROM nt GROUP BY score_id, instrument, onset HAVING count(*) > 1),
sh AS (SELECT a.score_id, a.instrument AS a, b.instrument AS b, a.onset, row_number() OVER (PARTITION BY a.score_id, a.instrument, b.instrument ORDER BY a.onset) AS k FROM (SELECT DISTINCT score_id, instrument, onset FROM rt) a
  JOIN (SELECT DISTINCT score_id, instrument, onset FROM rt) b ON b.score_id = a.score_id AND b.onset = a.onset AND a.instrument < b.instrument),
pr AS (SELECT sh.score_id, a, b, k, abs(x.pitch - y.pitch)::INTEGER AS i, CASE WHEN x.pitch < y.pitch THEN x.row_id ELSE y.row_id END AS lid, CASE WHEN x.pitch < y.pitch THEN y.row_id ELSE x.row_id END AS hid, least(x.pitch, y.pitch) <= low AS is_low
  FROM sh JOIN rt x ON x.score_id = sh.score_id AND x.instrument = a AND x.onset = sh.onset JOIN rt y ON y.score_id = sh.score_id AND y.instrument = b AND y.onset = sh.onset AND y.release = x.release AND abs(y.pitch - x.pitch) IN (12, 24, 36)
  JOIN lo ON lo.score_id = sh.score_id AND lo.t = sh.onset WHERE EXISTS (FROM cd WHERE cd.score_id = sh.score_id AND cd.instrument IN (a, b))),
pg AS (SELECT *, k - row_number() OVER (PARTITION BY score_id, a, b, i ORDER BY k) AS g FROM pr),
l2 AS (SELECT score_id, CASE WHEN bool_or(is_low) OVER w THEN hid ELSE lid END AS row_id FROM pg WINDOW w AS (PARTITION BY score_id, a, b, i, g) QUALIFY count(*) OVER w >= 3)
SELECT score_id, row_id, instrument, pitch FROM rt ANTI JOIN l2 USING (score_id, row_id)""")
def dedouble_octaves(spark, sf_dir):
    return O.dedouble_octaves(doubled_lines(spark, sf_dir)).select("score_id", "row_id", "instrument", "pitch")


def _leq(marks: str, value: str, least: str) -> str:
    return f"coalesce(list_max(list_filter({marks}, lambda x: x >= {least} AND x <= {value})), list_min(list_filter({marks}, lambda x: x >= {least})))"


@_query(f""", nq AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY onset, pitch, release, row_id) - 1 AS i FROM ev),
el AS (SELECT score_id, list(i ORDER BY i) AS e FROM (SELECT score_id, min(i) AS i FROM nq GROUP BY score_id, onset) GROUP BY 1),
rl AS (SELECT score_id, list(i ORDER BY i) AS r FROM (SELECT score_id, arg_max(i, (pitch, i)) AS i FROM nq GROUP BY score_id, release) GROUP BY 1),
wk AS (SELECT score_id, e, r, e[1] AS a, {_leq('r', 'e[1] + 11', 'greatest(e[1] + 1, r[1])')} AS b FROM el JOIN rl USING (score_id)
  UNION ALL SELECT score_id, e, r, a2 AS a, {_leq('r', 'a2 + 11', 'greatest(a2 + 1, b + 1)')} AS b FROM (SELECT *, {_leq('e', 'b + 1', 'a + 1')} AS a2 FROM wk WHERE b < list_max(r)) WHERE a2 IS NOT NULL)
SELECT score_id, a AS start, b + 1 AS stop, count(*) AS n_rows, sum(row_id)::BIGINT AS row_ids FROM wk JOIN nq USING (score_id) WHERE i BETWEEN a AND b GROUP BY 1, 2, 3""")
def segment_df(spark, sf_dir):
    """Segments of about twelve notes; in SQL by a walk."""
    cut = S.segment_df(order.sort_df(corpus.scores(spark, sf_dir)), 12)
    return cut.groupBy("score_id", "segment").agg((F.min("seq") - 1).cast("long").alias("start"), F.max("seq").cast("long").alias("stop"), F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("row_ids")).drop("segment")


PARTS = ["V", "ii", "IV", "bIII", "iii", "I", "#iv"]
TOKENS = {"Im": "i", "VM": "V", "IVm6": "iv6", "VIIo642": "viio642", "III+": "III+", "xaug665": "Ger65", "xaug643": "Fr43", "xaug63": "It6", "A6Ger65": "Ger65", "bVIIM": "bVII", "VM/Vm": "V/v", "IVm/bIIm": "iv/bii", "#VIo7": "#vio7", "na": "na", "V": "V"}


def _case(part: str) -> str:
    return f"CASE WHEN {part}[-1] IN ('i', 'v') THEN 'm' ELSE 'M' END"


@_query(_TABLES + f""", nt AS (SELECT mo.*, {_list(PARTS)}[(score_id + b) % 7 + 1] AS p1, {_list(PARTS)}[b // 2 % 7 + 1] AS p2, {_list(PARTS)}[b // 3 % 7 + 1] AS p3 FROM (SELECT *, (onset / 8)::BIGINT AS b FROM mo) mo),
n3 AS (SELECT nt.*, rn.off AS r3 FROM nt JOIN rn ON rn.mode = 'M' AND upper(rn.rn) = upper(p3) AND length(rn.rn) = length(p3)), n2 AS (SELECT n3.*, r3 + rn.off AS r2 FROM n3 JOIN rn ON rn.mode = {_case('p3')} AND upper(rn.rn) = upper(p2)),
n1 AS (SELECT n2.*, r2 + rn.off AS r1 FROM n2 JOIN rn ON rn.mode = {_case('p2')} AND upper(rn.rn) = upper(p1))
SELECT score_id, onset, regexp_extract(rn.rn, '^([b#]*)', 1) || CASE WHEN p1[-1] IN ('i', 'v') THEN lower(regexp_extract(rn.rn, '([IV]+)$', 1)) ELSE regexp_extract(rn.rn, '([IV]+)$', 1) END AS nested,
  {_list(list(TOKENS.values()))}[(score_id + b) % {len(TOKENS)} + 1] AS translated FROM n1 JOIN (SELECT rn, off FROM rn WHERE mode = 'M' UNION ALL SELECT 'bbb' || num, base - 21 FROM st WHERE mode = 'M' UNION ALL SELECT '###' || num, base + 21 FROM st WHERE mode = 'M') rn ON rn.off = r1""")
def nested_and_translated_numerals(spark, sf_dir):
    """Numerals of three parts in major, and numerals with their quality."""
    c = modulating_chords(spark, sf_dir).withColumn("b", (F.col("onset") / corpus.CHORD).cast("long"))
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), F.pmod(k, F.lit(len(values))).cast("int"))
    token = F.concat_ws("/", pick(PARTS, F.col("score_id") + F.col("b")), pick(PARTS, F.floor(F.col("b") / 2)), pick(PARTS, F.floor(F.col("b") / 3)))
    return c.select("score_id", "onset", D.handle_nested_secondary_rns(token, F.lit("M")).alias("nested"), D.translate_rns(pick(list(TOKENS), F.col("score_id") + F.col("b"))).alias("translated"))


@_query(""", q AS (SELECT score_id, round_even(onset * 2, 0) / 2 AS onset, round_even(release * 2, 0) / 2 AS release, pitch FROM ev WHERE round_even(onset * 2, 0) <> round_even(release * 2, 0)),
u AS (SELECT score_id, onset, release, pitch, 1 AS n FROM ev UNION ALL SELECT *, -1 FROM q)
SELECT score_id, onset, release, pitch, sum(n)::BIGINT AS n FROM u GROUP BY ALL HAVING sum(n) <> 0""")
def note_differences(spark, sf_dir):
    """What quantizing to halves and dropping what gets no length does."""
    n = corpus.scores(spark, sf_dir)
    return X.note_differences(n, B.quantize_df(n, 2, "drop"))


@_query(", l AS (SELECT score_id, pitch, onset, count(*) AS n FROM ev WHERE round_even(onset, 0) = round_even(release, 0) GROUP BY ALL) SELECT ev.score_id, onset, release, pitch FROM ev JOIN l USING (score_id, pitch, onset) QUALIFY row_number() OVER (PARTITION BY ev.score_id, pitch, onset ORDER BY row_id) <= n")
def quantize_differences(spark, sf_dir):
    return X.quantize_differences(corpus.scores(spark, sf_dir), 1)


@_query(", p AS (SELECT score_id, row_id, instrument, avg(pitch) OVER w AS a, avg(release) OVER w AS b FROM ev WINDOW w AS (PARTITION BY score_id, onset)) SELECT score_id, instrument, min(row_id) AS row, arg_min(a, row_id) AS a, arg_min(b, row_id) AS b FROM p GROUP BY 1, 2")
def pooled_arrays(spark, sf_dir):
    """Arrays of pitch and release, pooled by onset; those of each instrument's first row."""
    n = corpus.scores(spark, sf_dir).withColumn("x", F.array("pitch", "release"))
    return X.unique_of_array(n, "x", ("instrument",), ("onset",)).select("score_id", "instrument", "row", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


@_query(f""", tk AS (SELECT row_id, score_id % 9 - 4 AS sig, pitch, channel, {_list(KEYS)}[row_id % {len(KEYS)} + 1] AS key FROM ev), tf AS (SELECT *, ((3 - sig) * 7 % 12 + 12) % 12 AS around, {_fifths('key')} + 3 - sig AS f FROM tk),
tn AS (SELECT *, (['F', 'C', 'G', 'D', 'A', 'E', 'B'])[(f % 7 + 7) % 7 + 1] || CASE WHEN f >= 0 THEN repeat('#', (f // 7)::BIGINT) ELSE repeat('b', ((6 - f) // 7)::BIGINT) END AS name FROM tf)
SELECT row_id, CASE WHEN channel = 9 THEN pitch WHEN around > 6 THEN pitch + around - 12 ELSE pitch + around END AS pitch, CASE WHEN {_mode('key')} = 'M' THEN name ELSE lower(name[1]) || name[2:] END AS key, (pitch::BIGINT + around) % 12 AS pc, 3 - sig AS moved,
  f - 1 - CASE WHEN {_mode('key')} = 'm' THEN 3 ELSE 0 END AS key_signature FROM tn""")
def transpose_to_key(spark, sf_dir):
    """Scores of nine signatures moved to three sharps, with their keys and pitch classes; the new keys' signatures."""
    n = corpus.scores(spark, sf_dir).withColumns({"global_key_sig": F.col("score_id") % 9 - 4, "key": F.get(F.array(*map(F.lit, KEYS)), (F.col("row_id") % len(KEYS)).cast("int")), "pc": F.col("pitch").cast("long")})
    done = H.add_key_signature(H.transpose_to_key(n, 3, spelled_columns=("key",), pc_columns=("pc",)))
    return done.select("row_id", "pitch", "key", "pc", F.col("transposed_by_n_sharps").alias("moved"), "key_signature")


@_query(""", bd AS (SELECT *, CASE WHEN score_id % 5 = 0 THEN 'H' ELSE key END AS k2, CASE WHEN onset = 16 THEN 'V/V/V' ELSE degree END AS d2, inversion + CASE WHEN score_id % 7 = 0 THEN 1 ELSE 0 END AS i2, CASE WHEN score_id % 4 = 0 THEN onset - 1 ELSE release END AS r2 FROM ch)
SELECT 'error' AS severity, 'key' AS "column", count(*) AS n_bad FROM bd WHERE k2 = 'H' UNION ALL SELECT 'error', 'degree', count(*) FROM bd WHERE d2 = 'V/V/V' UNION ALL SELECT 'error', 'inversion', count(*) FROM bd WHERE i2 > 3 UNION ALL SELECT 'warning', 'release', count(*) FROM bd WHERE r2 < onset""")
def check_chords(spark, sf_dir):
    """Chords of which some have another key, degree, inversion or release than they may."""
    c = corpus.chords(corpus.scores(spark, sf_dir))
    damaged = c.withColumns({
        "key": F.when(F.col("score_id") % 5 == 0, "H").otherwise(F.col("key")), "degree": F.when(F.col("onset") == 16, "V/V/V").otherwise(F.col("degree")),
        "inversion": F.col("inversion") + F.when(F.col("score_id") % 7 == 0, 1).otherwise(0), "release": F.when(F.col("score_id") % 4 == 0, F.col("onset") - 1).otherwise(F.col("release")),
    })
    return H.check_chords(damaged).select("severity", "column", "n_bad")


#: Half tones of the degrees of `ch` above their tonic, and the chords' notes; all in C or c.
_VOCABULARY = """, vo AS (SELECT *, CASE WHEN key IN ('a', 'e', 'd') THEN 'm' ELSE 'M' END AS mode, split_part(degree, '/', 1) AS pd, CASE WHEN contains(degree, '/') THEN split_part(degree, '/', 2) ELSE 'I' END AS sd FROM ch),
vn AS (SELECT *, CASE sd WHEN 'V' THEN 7 WHEN 'ii' THEN 2 ELSE 0 END AS up, CASE sd WHEN 'V' THEN 'M' WHEN 'ii' THEN 'm' ELSE mode END AS own, CASE quality WHEN 'M' THEN [0, 4, 7] WHEN 'm' THEN [0, 3, 7] WHEN 'o7' THEN [0, 3, 6, 9] ELSE [0, 4, 7, 10] END AS steps FROM vo),
vr AS (SELECT *, up + CASE pd WHEN 'V' THEN 7 WHEN 'IV' THEN 5 WHEN 'ii' THEN 2 WHEN 'vi' THEN CASE WHEN own = 'M' OR quality IN ('m', 'o7') THEN 9 ELSE 8 END ELSE 0 END AS root FROM vn)"""


@_query(_VOCABULARY + """ SELECT mode, pd AS primary_degree, sd AS secondary_degree, quality, count(*) AS n_chords, count(DISTINCT score_id) AS n_scores, list_aggregate(list_transform(steps, lambda x: lower(to_hex((x + root) % 12))), 'string_agg', '') AS chord_pcs FROM vr GROUP BY mode, pd, sd, quality, steps, root""")
def chord_dictionary(spark, sf_dir):
    return V.chord_dict(corpus.chords(corpus.scores(spark, sf_dir))).select("mode", "primary_degree", "secondary_degree", "quality", "n_chords", "n_scores", "chord_pcs")


@_query(_VOCABULARY + """ SELECT mode, pd AS primary_degree, sd AS secondary_degree, quality, inversion::INTEGER AS inversion, count(*) AS n_chords, lower(to_hex((steps[inversion::INTEGER + 1] + root) % 12)) AS bass FROM vr GROUP BY mode, pd, sd, quality, steps, root, inversion""")
def bass_dictionary(spark, sf_dir):
    return V.bass_dict(corpus.chords(corpus.scores(spark, sf_dir))).select("mode", "primary_degree", "secondary_degree", "quality", "inversion", "n_chords", "bass")


@_query(""", dr AS (SELECT score_id, t FROM (SELECT DISTINCT score_id FROM ev), (SELECT unnest(range(-5, 7)) AS t) QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY md5('3:' || score_id || ':' || t)) <= 4),
rg AS (SELECT score_id, min(pitch) AS a, max(pitch) AS b FROM ev GROUP BY 1) SELECT row_id, t::INTEGER AS transposed_by, pitch + t AS pitch FROM ev JOIN dr USING (score_id) JOIN rg USING (score_id) WHERE a + t >= 33 AND b + t <= 88""")
def drawn_transpositions(spark, sf_dir):
    """Four transpositions drawn for each score, where it stays in the range."""
    return G.aug_by_trans(corpus.scores(spark, sf_dir), 4, 33, 88, 3).select("row_id", "transposed_by", "pitch")


@_query(""", mo2 AS (SELECT score_id, t, lead(t) OVER (PARTITION BY score_id ORDER BY t) AS nx FROM (SELECT score_id, onset AS t FROM ev UNION SELECT score_id, release FROM ev)), sl AS (SELECT ev.score_id, row_id, t AS onset, nx AS release FROM ev JOIN mo2 ON mo2.score_id = ev.score_id AND t >= onset AND t < release),
sp2 AS (SELECT score_id, onset, max(release) AS release FROM sl GROUP BY 1, 2), re AS (SELECT score_id, release AS onset, nx AS release FROM (SELECT *, lead(onset) OVER (PARTITION BY score_id ORDER BY onset) AS nx FROM sp2) WHERE nx > release),
la AS (SELECT *, release - onset AS d, sum(release - onset) OVER (PARTITION BY score_id ORDER BY md5('5:' || score_id || ':' || onset::VARCHAR), onset) AS upto FROM (FROM sp2 UNION ALL FROM re))
SELECT sl.score_id, row_id, sl.onset AS was, upto - d AS onset, upto AS release FROM sl JOIN la USING (score_id, onset)""")
def shuffled_slices(spark, sf_dir):
    """Slices and rests of each score in drawn order."""
    sliced = L.salami_slice(corpus.scores(spark, sf_dir), False).withColumn("was", F.col("onset"))
    return G.shuffle_slices(sliced, 5).select("score_id", "row_id", "was", "onset", "release")


@_query(f""", kk AS (SELECT row_id, pitch, {_list(KEYS)}[row_id % {len(KEYS)} + 1] AS key FROM ev), kf AS (SELECT *, {_fifths('key')} AS f, {_mode('key')} AS mode FROM kk), k5 AS (SELECT *, f + 5 AS g, f - 1 - CASE WHEN mode = 'm' THEN 3 ELSE 0 END AS sig FROM kf),
kn AS (SELECT *, (['F', 'C', 'G', 'D', 'A', 'E', 'B'])[(g % 7 + 7) % 7 + 1] || CASE WHEN g >= 0 THEN repeat('#', (g // 7)::BIGINT) ELSE repeat('b', ((6 - g) // 7)::BIGINT) END AS name FROM k5)
SELECT row_id, CASE WHEN mode = 'M' THEN name ELSE lower(name[1]) || name[2:] END AS moved_key, pitch - 1 AS moved_pitch, (2 - sig + 606) % 12 - 6 AS from_d, CASE WHEN (sig + 120) % 12 > 6 THEN (sig + 120) % 12 - 12 ELSE (sig + 120) % 12 END AS enharmonic, {_named('f', 'mode')} AS usual FROM kn""")
def moved_keys(spark, sf_dir):
    """Keys and pitches moved by five fifths, distances to D, signatures of at most six signs, usual names by pitch class and mode."""
    n = corpus.scores(spark, sf_dir).withColumn("key", F.get(F.array(*map(F.lit, KEYS)), (F.col("row_id") % len(KEYS)).cast("int")))
    key = F.col("key")
    return n.select("row_id", K.transpose_spelling(key, 5).alias("moved_key"), K.transpose_fifths(F.col("pitch"), 5).alias("moved_pitch"), K.key_sharps_interval(key, F.lit("D")).alias("from_d"), K.enharmonic_key_signature(key).alias("enharmonic"), K.pc_and_mode_to_key(K.chromatic_key(key)).alias("usual"))


@_query(""", ln AS (SELECT score_id, instrument, row_id, onset, least(release, coalesce(lead(onset) OVER (PARTITION BY score_id, instrument ORDER BY onset), release)) AS release FROM (SELECT * FROM ev WHERE instrument IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY score_id, instrument, onset ORDER BY row_id) = 1)),
mt AS (SELECT score_id, t, lead(t) OVER (PARTITION BY score_id ORDER BY t) AS nx FROM (SELECT score_id, onset AS t FROM ln UNION SELECT score_id, release FROM ln)) SELECT ln.row_id, t AS onset, nx AS release FROM ln JOIN mt ON mt.score_id = ln.score_id AND t >= onset AND t < release""")
def aligned_onsets(spark, sf_dir):
    """The lines of two instruments cut at each other's onsets and releases."""
    n = corpus.scores(spark, sf_dir).select("score_id", "row_id", "instrument", "onset", "release")
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("score_id", "instrument", "onset").orderBy("row_id"))).where("k = 1").drop("k")
    after = F.lead("onset").over(Window.partitionBy("score_id", "instrument").orderBy("onset"))
    n = n.withColumn("release", F.least("release", F.coalesce(after, "release")))
    one, two = U.align_onsets(n.where("instrument = 'view'"), n.where("instrument = 'click'"))
    return one.unionByName(two).select("row_id", "onset", "release")


@_query(""", od AS (SELECT *, (row_number() OVER (PARTITION BY score_id ORDER BY onset, pitch, release, row_id) - 1) // 32 AS c, (7 * pitch::BIGINT + 1) % 12 AS f FROM ev),
st AS (SELECT score_id, c, list(DISTINCT f) AS fs FROM od GROUP BY 1, 2), ca AS (SELECT score_id, c, s, list_transform(fs, lambda f: s + ((f - s) % 12 + 12) % 12) AS xs FROM st, range(-14, 10) t(s)),
be AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY score_id, c ORDER BY list_max(xs) - list_min(xs), abs(list_sum(xs) - 3 * len(xs)), s) = 1),
pl AS (SELECT row_id, pitch::BIGINT AS pitch, s + ((f - s) % 12 + 12) % 12 AS x FROM od JOIN be USING (score_id, c)), si AS (SELECT row_id, pitch, (['F', 'C', 'G', 'D', 'A', 'E', 'B'])[(x % 7 + 7) % 7 + 1] AS letter, floor(x / 7)::BIGINT AS n FROM pl),
oc AS (SELECT *, (pitch - n) // 12 - 1 AS o FROM si)
SELECT row_id, letter || CASE WHEN n >= 0 THEN repeat('#', n) ELSE repeat('b', -n) END AS spelling, CASE WHEN o >= 4 THEN repeat(lower(letter), o - 3) ELSE repeat(letter, 4 - o) END || CASE WHEN n >= 0 THEN repeat('#', n) ELSE repeat('-', -n) END AS humdrum_spelling FROM oc""")
def spelled_in_context(spark, sf_dir):
    """Notes spelled in stretches of 32 rows, as letters and in kern."""
    s = P.spell_in_context(corpus.scores(spark, sf_dir))
    return P.spell_df(s).select("row_id", "spelling", "humdrum_spelling")


@_query(f""", dn AS (SELECT d FROM range(1, 97) t(d) WHERE list_contains((SELECT list((2::BIGINT ** a * 3 ** b * 5 ** c * 7 ** e)::BIGINT) FROM range(7) q(a), range(5) r(b), range(3) s(c), range(3) u(e)), d)),
tm AS (SELECT row_id, k, CASE WHEN k = 0 THEN onset ELSE release END / {_list([str(n) for n in TUPLETS])}[row_id % {len(TUPLETS)} + 1]::DOUBLE + 0.00001 AS v FROM ev, range(2) w(k)),
sn AS (SELECT row_id, k, round_even(v * d, 0) / d AS x FROM tm, dn QUALIFY row_number() OVER (PARTITION BY row_id, k ORDER BY abs(round_even(v * d, 0) / d - v), d) = 1)
SELECT row_id, max(x) FILTER (k = 0) AS onset, max(x) FILTER (k = 1) AS release FROM sn GROUP BY 1""")
def snapped_times(spark, sf_dir):
    """Times of notes in tuplets, drifted off, and snapped to musical fractions again."""
    part = F.get(F.array(*map(F.lit, map(float, TUPLETS))), (F.col("row_id") % len(TUPLETS)).cast("int"))
    n = corpus.scores(spark, sf_dir).select("row_id", *((F.col(c) / part + 0.00001).alias(c) for c in ("onset", "release")))
    return B.snap_times(n)


@_query(_BARS + """, al AS (SELECT score_id, type, onset FROM ms UNION ALL SELECT score_id, 'bar', onset FROM ba), f AS (SELECT score_id, min(onset) AS f FROM ev WHERE onset >= 30 GROUP BY 1),
lb AS (SELECT score_id, f, (SELECT max(onset) FROM ba WHERE ba.score_id = f.score_id AND onset <= f) AS b FROM f)
SELECT score_id, type, onset, count(*) AS n FROM (SELECT score_id, type, onset FROM al JOIN f USING (score_id) WHERE onset > f OR (type = 'note' AND onset = f)
  UNION ALL SELECT score_id, 'bar', b FROM lb UNION ALL SELECT score_id, 'time_signature', b FROM lb) GROUP BY ALL""")
def crop_without_bars(spark, sf_dir):
    """Scores that have time signatures alone, from the first note at or after 30 quarters on: bars are inferred first."""
    return order.crop_df(corpus.with_meter(corpus.scores(spark, sf_dir)), 30.0).groupBy("score_id", "type", "onset").agg(F.count(F.lit(1)).alias("n"))


# SQL of two older queries whose walks need recursion.
LAYERS_SQL = f"WITH RECURSIVE {corpus.SQL.strip()}" + """, nk AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY onset, pitch, release, row_id) AS k FROM ev),
st AS (SELECT DISTINCT score_id, 0::BIGINT AS k, []::STRUCT(o DOUBLE, r DOUBLE)[] AS ls, NULL::BIGINT AS row_id, NULL::BIGINT AS layer FROM nk
  UNION ALL SELECT score_id, k, ls[:i - 1] || [{'o': onset, 'r': release}] || ls[i + 1:], row_id, i - 1 FROM (SELECT nk.score_id, nk.k, ls, nk.row_id, onset, release,
    coalesce(list_position(list_transform(ls, lambda x: nk.onset >= x.r OR (x.o = nk.onset AND x.r = nk.release)), true), len(ls) + 1)::BIGINT AS i FROM st JOIN nk ON nk.score_id = st.score_id AND nk.k = st.k + 1))
SELECT row_id, layer FROM st WHERE k > 0"""
REPEATED_BARS_SQL = f"WITH RECURSIVE {corpus.SQL.strip()}{_BARS}" + """, bx AS (SELECT score_id, onset, coalesce(lead(onset) OVER (PARTITION BY score_id ORDER BY onset), greatest(max(release) OVER (PARTITION BY score_id), (SELECT max(release) FROM ev WHERE ev.score_id = ba.score_id))) AS release, bar_number AS b FROM ba),
fb AS (SELECT bx.score_id, b, any_value(bx.release - bx.onset) AS dur, list((instrument, pitch, ev.onset - bx.onset, ev.release - bx.onset)::VARCHAR ORDER BY instrument, pitch, ev.onset, ev.release) FILTER (row_id IS NOT NULL)::VARCHAR AS n
  FROM bx LEFT JOIN ev ON ev.score_id = bx.score_id AND ev.onset >= bx.onset AND ev.onset < CASE WHEN b = (SELECT max(b) FROM bx x WHERE x.score_id = bx.score_id) THEN 'inf'::DOUBLE ELSE bx.release END GROUP BY ALL),
pl AS (SELECT score_id, list(dur::VARCHAR || coalesce(n, '') ORDER BY b) AS f, list(b ORDER BY b) AS bs FROM fb GROUP BY 1),
wk AS (SELECT score_id, f, bs, 0::BIGINT AS i, false AS changed FROM pl
  UNION ALL SELECT score_id, CASE WHEN k IS NULL THEN f ELSE f[:i + k] || f[i + k * t + 1:] END, CASE WHEN k IS NULL THEN bs ELSE bs[:i + k] || bs[i + k * t + 1:] END, CASE WHEN i >= len(f) THEN 0 WHEN k IS NULL THEN i + 1 ELSE i END, CASE WHEN i >= len(f) THEN false ELSE changed OR k IS NOT NULL END
  FROM (SELECT *, CASE WHEN k IS NOT NULL THEN list_min(list_filter(range(1, len(f) + 2), lambda x: f[i + k * x + 1:i + k * (x + 1)] <> f[i + 1:i + k])) END AS t
    FROM (SELECT *, list_min(list_filter(range(1, (len(f) - i) // 2 + 1), lambda x: f[i + 1:i + x] = f[i + x + 1:i + 2 * x])) AS k FROM wk WHERE i < len(f) OR changed))),
en2 AS (SELECT score_id, bs FROM wk WHERE i >= len(f) AND NOT changed),
kp AS (SELECT fb.*, list_contains(bs, b) AS kept FROM fb JOIN en2 USING (score_id)),
sh AS (SELECT *, coalesce(sum(CASE WHEN kept THEN 0 ELSE dur END) OVER (PARTITION BY score_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mv FROM kp),
al AS (SELECT score_id, row_id, type, onset, release FROM ms UNION ALL SELECT score_id, NULL, 'bar', onset, release FROM bx),
nb AS (SELECT al.*, (SELECT max(b) FROM bx WHERE bx.score_id = al.score_id AND bx.onset + CASE WHEN al.type = 'time_signature' THEN 1e-9 ELSE 0 END <= al.onset) AS b FROM al)
SELECT nb.score_id, row_id, type, onset - coalesce(mv, 0) AS onset, release - coalesce(mv, 0) AS release FROM nb LEFT JOIN sh USING (score_id, b) WHERE coalesce(kept, true)"""


def queries() -> dict:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items()} | {"homophonic_layers": LAYERS_SQL, "remove_repeated_bars": REPEATED_BARS_SQL}
