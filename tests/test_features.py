"""Feature, harmony, augmentation and doubling operators, sources, transforms and streams."""

import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from scoreloom import feature_queries as Q
from scoreloom.functions import keys as K
from scoreloom.operators import augment as G
from scoreloom.operators import doublings as D
from scoreloom.operators import features as E
from scoreloom.operators import harmony as H
from scoreloom.operators import slices as S
from scoreloom.plans import transforms as T
from scoreloom.sources import midi, musicxml, read, tables
from scoreloom.streaming import windows as W
from tests.test_scores import NOTE, SF, notes, plain


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = Q.queries()[name](spark, SF)
    names = ", ".join(f'"{c}"' for c in sorted(got.columns))
    assert plain(got.select(*sorted(got.columns)).collect()) == plain(con.sql(f"SELECT {names} FROM ({Q.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("n, d", [(4, 4), (128, 256), (12, 4), (18, 4), (27, 4), (25, 2), (0, 4)])
def test_reduced_time_signature(spark, n, d):
    def brute(n, d):
        while d > 64 and n % 2 == 0 and d % 2 == 0:
            n, d = n // 2, d // 2
        while n > 2 * d:
            n //= next(x for x in range(2, n + 1) if n % x == 0)
        return n, d

    got = spark.range(1).select(E.reduced_time_signature(F.lit(n), F.lit(d)).alias("s")).first().s
    assert (got.n, got.d) == brute(n, d)


def test_scaled_signature_and_long_bars(spark):
    df = spark.createDataFrame([(1, "time_signature", 0.0, None, '{"numerator": 3, "denominator": 2}', 6.0), (1, "bar", 0.0, 14.0, None, 6.0), (1, "note", 1.0, 2.0, None, 6.0)], "score_id long, type string, onset double, release double, other string, time_sig_dur double")
    assert E.scale_time_sigs(df, 4.0).where("other is not null").first().other == '{"numerator":6,"denominator":1}'
    with pytest.raises(ValueError):
        E.scale_time_sigs(df, 3.0)
    bars = E.split_long_bars(df).where("type = 'bar'").orderBy("onset").collect()
    assert [(b.onset, b.release) for b in bars] == [(0, 6), (6, 12), (12, 14)] and E.split_long_bars(df).count() == 5
    assert not E.has_pickup(df).first().pickup and E.has_pickup(df.withColumn("release", F.lit(2.0))).first().pickup


def test_bar_offsets_and_context(spark):
    rows = [(1, "time_signature", 0.0, None, -1), *((1, "bar", 4.0 * i, 4.0 * i + 4, i + 1) for i in range(5)), *((1, "note", float(i), i + 1.0, i // 4 + 1) for i in range(20))]
    df = spark.createDataFrame(rows, "score_id long, type string, onset double, release double, bar_number int")
    got = E.bar_and_offset(df, spark.createDataFrame([(1, 9.5), (1, -1.0)], "score_id long, t double")).orderBy("t").collect()
    assert [(r.bar_number, r.offset) for r in got] == [(None, None), (3, 1.5)]
    near = E.get_context_bars(df, 9.5).collect()
    assert sorted(r.onset for r in near if r.type == "bar") == [4, 8, 12] and [r.onset for r in near if r.type == "time_signature"] == [4] and sum(r.type == "note" for r in near) == 12


def test_prime_form(spark):
    def brute(pcs):
        s = sorted({p % 12 for p in pcs})
        return min((sorted((x - a) % 12 for x in s) for a in s), key=lambda r: r[::-1]) if s else None

    for pcs in ([0, 4, 7], [11, 2, 7], [0, 3, 6, 9], [5], [60, 61, 65], []):
        assert spark.range(1).select(E.prime_form(F.array(*map(F.lit, pcs)).cast("array<int>")).alias("p")).first().p == brute(pcs)


def test_kept_bars():
    cases = {"AA": "A", "ABAB": "AB", "ABABAB": "AB", "AABB": "AB", "ABC": "ABC", "": "", "A": "A", "AABAAB": "AB"}
    for bars, want in cases.items():
        assert "".join(bars[i] for i in D.kept_bars(list(bars))) == want
    rng = random.Random(1)
    for _ in range(50):
        bars = [rng.choice("AB") for _ in range(30)]
        left = [bars[i] for i in D.kept_bars(bars)]
        assert not any(left[i : i + k] == left[i + k : i + 2 * k] for k in range(1, 16) for i in range(len(left) - 2 * k + 1))


def test_kept_bars_compares_few():
    """Periods are tried only where the first bar comes again, so bars without repeats are not compared with all others."""
    asked = [0]

    class Bar:
        def __init__(self, k):
            self.k = k

        def __hash__(self):
            return self.k

        def __eq__(self, other):
            asked[0] += 1
            return self.k == other.k

    assert D.kept_bars([Bar(k) for k in range(512)]) == [*range(512)] and asked[0] < 10 * 512
    assert D.kept_bars([Bar(k % 100) for k in range(512)]) == [*range(100), *range(500, 512)]


def test_remove_repeated_bars(spark):
    rows = [r for i, p in enumerate([60, 62, 60, 62, 64]) for r in ((1, 2 * i, "bar", None, 0, None, 4.0 * i, 4.0 * i + 4, i + 1), (1, 2 * i + 1, "note", "p", 0, float(p), 4.0 * i + 1, 4.0 * i + 2, i + 1))]
    df = spark.createDataFrame([(1, -1, "tempo", None, 0, None, -1.0, None, -1), *rows], NOTE + ", bar_number int")
    got = D.remove_repeated_bars(df).orderBy("onset", "row_id").collect()
    assert [(r.type, r.onset) for r in got] == [("tempo", -1), ("bar", 0), ("note", 1), ("bar", 4), ("note", 5), ("bar", 8), ("note", 9)] and got[-1].pitch == 64
    assert D.remove_repeated_bars(df, 2).where("type = 'bar'").count() == 5
    assert D.remove_repeated_bars(df.limit(0)).count() == 0


def test_unisons_keep_first_instrument(spark):
    df = notes(spark, [(60, 0, 1), (62, 1, 2), (64, 2, 3)])
    both = df.unionByName(df.withColumn("instrument", F.lit("q")).withColumn("row_id", F.col("row_id") + 10)).unionByName(df.limit(1))
    assert {r.instrument for r in D.dedouble_unisons_across_instruments(both).collect()} == {"p"}
    assert D.dedouble_unisons_across_instruments(both, 4).count() == 7


def test_align_onsets(spark):
    a, b = D.align_onsets(notes(spark, [(60, 0, 2), (62, 3, 4)]), notes(spark, [(50, 1, 4)]))
    assert [(r.pitch, r.onset, r.release) for r in a.orderBy("onset").collect()] == [(60, 0, 1), (60, 1, 2), (62, 3, 4)]
    assert [(r.onset, r.release) for r in b.orderBy("onset").collect()] == [(1, 2), (2, 3), (3, 4)]


def test_augmentations(spark):
    df = notes(spark, [(60, 0, 1), (64, 1, 2), (67, 3, 4)])
    assert G.aug_by_trans(df, 4).select("transposed_by").distinct().count() == 4
    assert sorted(r.pitch for r in G.shuffle_pitches(df, 3).collect()) == [60, 64, 67]
    got = G.shuffle_slices(S.salami_slice(df), 5).collect()
    assert sorted(r.release - r.onset for r in got) == [1, 1, 1] and max(r.release for r in got) <= 4 and len({r.onset for r in got}) == 3
    assert G.aug_rhythms(df.withColumn("other", F.lit(None).cast("string")), 2).count() == 6


def test_harmony_columns(spark):
    rows = [(1.0, "M", "6"), (3.0, "M", "?"), (3.0, "Ger", "42"), (0.0, "x", ""), (None, "m", "?")]
    got = spark.createDataFrame(rows, "i double, q string, w string").select(H.inversion_number_to_figure(F.col("i"), F.col("q")).alias("f"), "w").collect()
    assert [r.f for r in got] == [r.w for r in got]
    r = spark.range(1).select(H.change_rn_mode(F.lit("bVII"), F.lit("m")).alias("a"), H.strip_inversion(F.lit("V65")).alias("b"), H.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("c")).first()
    assert (r.a, r.b, r.c) == ("bvii", "V", [0.5, 0.5])


def test_transforms(spark):
    df = notes(spark, [(60, 0.1, 1), (60, 1, 2)])
    assert T.apply_transforms(df, [{"quantize_df": {"tpq": 1}}, {"merge_notes": {}}]).count() == 1
    assert T.get_transform_params("quantize_df") == ["tpq", "zero_dur_action", "ticks_out"]
    with pytest.raises(KeyError):
        T.apply_transforms(df, [{"none": {}}])
    with pytest.raises(ValueError):
        T.apply_transforms(df, [{"sort_df": {}, "merge_notes": {}}])
    with pytest.raises(ValueError):
        T.transform(T.TRANSFORMS["sort_df"])


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",type,pitch,onset,release,other,tie_to_next,color\n0,time_signature,,0,4,\"{'numerator': 3, 'denominator': 4}\",,\n1,note,60.0,1/3,1.5,,True,red\n2,bar,,0,4,None,False,\n")
    got = {r.type: r for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert abs(got["note"].onset - 1 / 3) < 1e-12 and got["note"].release == 1.5 and got["note"].tie_to_next and got["bar"].release is None and got["bar"].color == ""
    assert got["time_signature"].other == '{"numerator": 3, "denominator": 4}' and "_c0" not in got["bar"].asDict()


def test_annotated_notes(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("mc\tquarterbeats\tduration_qb\tmidi\ttimesig\n1\t0\t1.0\t60\t3/4\n1\t\t1.0\t61\t3/4\n2\t3\t0\t62\t3/4\n2\t7/2\t1.0\t63\t2/4\n")
    rows = tables.read_annotated_notes(spark, str(tmp_path / "a.tsv")).orderBy("type", "onset").collect()
    assert [(r.type, r.onset, r.release) for r in rows] == [("bar", 0, 3), ("bar", 3, 4.5), ("note", 0, 1), ("note", 3.5, 4.5), ("time_signature", 0, None), ("time_signature", 3.5, None)]


def test_midi_round_trip(spark, tmp_path):
    rows = [("a", "note", 0, 0, 60.0, 90, 0.0, 1.0, None), ("a", "note", 0, 0, 60.0, 80, 1.0, 1.5, None), ("a", "note", 1, 9, 38.0, None, 0.5, 300.25, None), ("a", "tempo", 0, None, None, None, 0.0, None, '{"tempo": 100.0}'), ("a", "time_signature", 0, None, None, None, 0.0, None, '{"numerator": 6, "denominator": 8}')]
    df = spark.createDataFrame(rows, "score_id string, type string, track int, channel int, pitch double, velocity int, onset double, release double, other string")
    (tmp_path / "a.mid").write_bytes(bytes(midi.render_midi(df).first().content))
    (tmp_path / "b.mid").write_bytes(b"no music")
    got = midi.read_midi(spark, str(tmp_path)).collect()
    assert sorted((r.track, r.channel, r.pitch, r.velocity, r.onset, r.release) for r in got if r.type == "note") == [(0, 0, 60, 80, 1, 1.5), (0, 0, 60, 90, 0, 1), (1, 9, 38, 64, 0.5, 300.25)]
    assert {r.other for r in got if r.type in ("tempo", "time_signature")} == {'{"tempo": 100.0}', '{"numerator": 6, "denominator": 8}'}
    assert [r.error for r in got if r.type == "error"] == ["not a MIDI file"] and midi.read_midi(spark, str(tmp_path), True).count() == 4


def test_streams(spark, tmp_path):
    base = notes(spark, [(60, 0, 1), (60, 1, 2), (60, 1, 2), (62, 9, 10), (64, 100, 101)]).withColumn("ts", F.timestamp_seconds(F.col("onset") + 1_000_000))
    base.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))

    def run(df, mode):
        name = f"t{abs(hash(str(tmp_path)))}{random.randrange(10**9)}"
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.n_notes for r in run(W.segment_counts(stream(), "4 seconds"), "complete")) == [1, 1, 3]
    assert sum(r.n_notes for r in run(W.segment_counts(stream(), "4 seconds", slide="2 seconds"), "complete")) == 10
    assert sorted((r.pitch, r.n_notes) for r in run(W.merge_repeated(stream(), "2 seconds"), "complete")) == [(60, 3), (62, 1), (64, 1)]
    assert len(run(W.dedouble(stream()), "append")) == 4
    chords = spark.createDataFrame([(1, 0.0, 1.5, "C", "I", "M", 0.0), (1, 1.5, 9.5, "C", "V", "M", 0.0)], "score_id long, onset double, release double, key string, degree string, quality string, inversion double")
    assert sorted((r.pitch, r.degree or "") for r in run(W.label_with_chords(stream(), chords), "append")) == [(60, "I"), (60, "I"), (60, "I"), (62, "V"), (64, "")]


def test_stateful_streams(spark, tmp_path):
    rows = [(1, 0.0, "C"), (1, 1.0, None), (2, 0.0, None), (2, 1.0, "a")], [(1, 2.0, None), (1, 3.0, "G"), (2, 5.0, None), (1, 4.0, None), (3, 6.0, None)]
    schema = "score_id long, onset double, key string"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.col("onset") * 60 + (0 if k == 0 else -7200) * (F.col("score_id") - 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))

    def run(f):
        name = f"s{random.randrange(10**9)}"
        src = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        f(src).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(spark.table(name).collect(), key=lambda r: (r.score_id, r.onset))

    assert [r.key for r in run(lambda s: W.fill_forward(s, "key"))] == ["C", "C", "C", "G", "G", None, "a", "a", None]
    # score 3 begins in the second trigger, behind the watermark that the others have set
    assert [r.is_late for r in run(W.late_counts)] == [False] * 7 + [True, True]


def test_chord_pitch_classes(spark):
    chords = [("i", "m", 0, "b", "b26"), ("V", "M", 0, "b", "6a1"), ("V/V", "M", 0, "f#", "803"), ("vii", "o7", 0, "a", "8b25"), ("VII", "M", 0, "a", "7b2"), ("V", "Mm7", 2, "Eb", "58a2"), ("x", "Ger", 0, "C", "8036"), ("bII", "M", 1, "e", "90" + "5"), ("V/vi", "Mm7", 0, "C", "48b2"), ("IV", "M", 3, "C", None), (None, "M", 0, "C", None), ("I", "odd", 0, "C", None)]
    df = spark.createDataFrame([(1, float(i), d, q, float(n), k) for i, (d, q, n, k, _) in enumerate(chords)], "score_id long, onset double, degree string, quality string, inversion double, key string")
    assert [r.chord_pcs for r in H.add_chord_pcs(df).orderBy("onset").collect()] == [c[-1] for c in chords]


@pytest.mark.parametrize("f", [E.add_default_velocity, E.get_eligible_releases, D.unison_runs, D.dedouble_unisons_across_instruments, G.shuffle_pitches, G.aug_rhythms])
def test_empty_tables(spark, f):
    assert f(notes(spark, [])).count() == 0


def test_key_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    key = lambda s, k, **o: one(K.tonicization_to_key(F.lit(s), F.lit(k), **o))
    assert [key("V", "C"), key("ii", "C"), key("bVI", "C"), key("#IV", "C"), key("V", "a"), key("III", "a"), key("#VII", "a"), key("I", "d"), key("x", "d"), key("", "d")] == ["G", "d", "Ab", "Gb", "e", "C", "g#", "d", "d", "d"]
    assert (key("iv", "C", case_matters=True), key("#IV", "C", simplify=False)) == ("f", "F#")
    assert (one(K.pc_and_mode_to_key(F.lit("6.0M"))), one(K.simplify_enharmonic_key(F.lit("C#"))), one(K.transpose_spelling(F.lit("f#"), -7)), one(K.transpose_spelling(F.lit("na"), 1)), one(K.transpose_fifths(F.lit(60), 1))) == ("Gb", "Db", "f", "na", 55)


SCORE = """<score-partwise><part id="P1"><measure number="1"><attributes><divisions>2</divisions><time><beats>3</beats><beat-type>4</beat-type></time><transpose><chromatic>-2</chromatic></transpose></attributes>
<sound tempo="90"/><note><grace/><pitch><step>D</step><octave>4</octave></pitch></note><note><pitch><step>C</step><octave>4</octave></pitch><duration>4</duration><voice>1</voice></note><note><chord/><pitch><step>F</step><alter>1</alter><octave>4</octave></pitch><duration>4</duration><tie type="start"/></note><note><rest/><duration>2</duration></note>
<backup><duration>2</duration></backup><note><pitch><step>F</step><alter>1</alter><octave>4</octave></pitch><duration>2</duration><tie type="stop"/></note></measure>
<measure number="2"><forward><duration>2</duration></forward><note><pitch><step>B</step><alter>-1</alter><octave>3</octave></pitch><duration>4</duration></note></measure></part></score-partwise>"""


def test_musicxml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(SCORE)
    with zipfile.ZipFile(tmp_path / "b.mxl", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="s.xml"/></rootfiles></container>')
        z.writestr("s.xml", SCORE)
    (tmp_path / "c.xml").write_text("<score-partwise><part>")
    (tmp_path / "d.xml").write_text("<score-timewise/>")
    rows = musicxml.read_musicxml(spark, str(tmp_path)).collect()
    for name in ("a.xml", "b.mxl"):
        mine = [r for r in rows if r.score_id.endswith(name)]
        assert sorted((r.pitch, r.onset, r.release, r.spelling) for r in mine if r.type == "note") == [(56, 4, 6, "Bb"), (58, 0, 2, "C"), (64, 0, 3, "F#")]
        assert sorted((r.onset, r.release) for r in mine if r.type == "bar") == [(0, 3), (3, 6)]
        assert {r.type: r.other for r in mine if r.other} == {"tempo": '{"tempo": 90.0}', "time_signature": '{"numerator": 3, "denominator": 4}'}
    assert sum(r.type == "error" for r in rows) == 2
    assert read.read_scores(spark, str(tmp_path / "a.xml"), [{"sort_df": {}}]).where("seq = 1").first().type == "time_signature"
    with pytest.raises(ValueError):
        read.read_scores(spark, "x.pdf")
