"""Octave doublings: cases worked by hand, and random scores against a plain version."""

import random

from scoreloom.operators import octaves as O

SCHEMA = "score_id long, row_id long, type string, instrument string, pitch double, onset double, release double"


def frame(spark, cases):
    """A score for each case: (instrument, pitch, onset, release) of its notes."""
    rows = [(s, i, "note", str(t), float(p), float(o), float(r)) for s, case in enumerate(cases) for i, (t, p, o, r) in enumerate(case)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.score_id, []).append((r.instrument, r.pitch))
    return {k: sorted(v) for k, v in out.items()}


def line(track, pitches, start=0, length=1):
    return [(track, p, start + i, start + i + length) for i, p in enumerate(pitches)]


def test_octaves_between_instruments(spark):
    cases = [
        line(1, [60, 62, 64]) + line(2, [72, 74, 76]),  # the bass stays
        line(1, [64, 65, 67]) + line(2, [76, 77, 79]) + line(3, [38, 39, 42]),  # a lower part sounds: the upper voice stays
        line(1, [60, 62]) + line(2, [72, 74]),  # too short
        line(1, [60, 62, 64]) + line(2, [72, 75, 76]),  # another tune
        line(1, [60, 62, 64]) + line(2, [60, 62, 64]),  # in unison the first instrument stays
        line(1, [64, 65, 67, 69]) + line(2, [76, 77, 79, 81]) + [(3, 40, 0, 4)],  # a held bass
        # chords: the upper voice of 1 is doubled by 4
        line(1, [38, 40, 42]) + line(1, [45, 47, 49]) + line(4, [57, 59, 61]),
        line(1, [36, 38, 40]) + line(1, [43, 45, 47]) + line(2, [50, 52, 54]) + line(2, [55, 57, 59]),
    ]
    got = kept(O.dedouble_octaves(frame(spark, cases)))
    assert got[0] == [("1", 60), ("1", 62), ("1", 64)]
    assert got[1] == [("2", 76), ("2", 77), ("2", 79), ("3", 38), ("3", 39), ("3", 42)]
    assert len(got[2]) == 4 and len(got[3]) == 6
    assert got[4] == [("1", 60), ("1", 62), ("1", 64)]
    assert got[5] == [("2", 76), ("2", 77), ("2", 79), ("2", 81), ("3", 40)]
    assert got[6] == [("1", 38), ("1", 40), ("1", 42), ("4", 57), ("4", 59), ("4", 61)]
    assert got[7] == [("1", 36), ("1", 38), ("1", 40), ("2", 50), ("2", 52), ("2", 54), ("2", 55), ("2", 57), ("2", 59)]
    assert len(kept(O.dedouble_octaves(frame(spark, cases[2:3]), min_length=2))[0]) == 2


def test_octaves_within_an_instrument(spark):
    both = lambda low, k=12: line(1, low) + line(1, [p + k for p in low])
    cases = [
        both([60, 62, 64]), both([60, 62]), both([60, 62, 64], 24),
        both([60, 62, 64]) + line(1, [67, 69, 71]),
        both([64, 65, 67]) + line(2, [40, 41, 43]),
        both([39, 41, 43]) + both([58, 60, 62]),  # two registers, each with its voice
        line(1, [60, 62, 64]) + line(1, [72, 74, 76], length=2),  # other ends
        line(1, [60, 62, 64, 65, 67]) + [(1, 72, 0, 1), (1, 74, 1, 2), (1, 77, 3, 4), (1, 79, 4, 5)],  # nothing at the third onset
        line(1, [60, 62, 64]) + [(2, 72, 0, 1), (2, 74, 1, 2), (2, 76, 2, 3)],  # not within one
    ]
    df = frame(spark, cases)
    got = kept(O.dedouble_octaves_within_instrument(df))
    pitches = {k: [p for _, p in v] for k, v in got.items()}
    assert pitches[0] == [60, 62, 64] and len(pitches[1]) == 4 and pitches[2] == [60, 62, 64] and pitches[3] == [60, 62, 64, 67, 69, 71]
    assert pitches[4] == [76, 77, 79, 40, 41, 43] and pitches[5] == [39, 41, 43, 70, 72, 74]
    assert len(pitches[6]) == 6 and len(pitches[7]) == 9 and len(pitches[8]) == 6
    loose = kept(O.dedouble_octaves_within_instrument(df, match_releases=False, max_gap=1))
    assert [p for _, p in loose[6]] == [60, 62, 64] and [p for _, p in loose[7]] == [60, 62, 64, 65, 67]
    assert len(kept(O.dedouble_octaves_within_instrument(df, intervals=(12,)))[2]) == 6
    bars = frame(spark, cases[:1]).unionByName(spark.createDataFrame([(0, 99, "bar", None, None, 0.0, 4.0)], SCHEMA))
    assert O.dedouble_octaves_within_instrument(bars).count() == 4 and O.dedouble_octaves(bars.limit(0)).count() == 0


def plain_within(notes, max_gap, most=12):
    """Streaks by a walk over the onsets of each instrument."""
    lost = set()
    at = lambda n: round(n["onset"] * 16)
    end = lambda n: round(n["release"] * 16)
    low = {t: min((n["pitch"] for n in notes if at(n) <= t < end(n)), default=999) for t in map(at, notes)}
    for inst in {n["inst"] for n in notes}:
        mine = sorted((n for n in notes if n["inst"] == inst), key=lambda n: (n["pitch"], n["id"]))
        for k in O.OCTAVES:
            running, over = [], []
            for t in sorted({at(n) for n in mine}):
                here = [n for n in mine if at(n) == t]
                pairs = [(a, b) for a in here for b in here if b["pitch"] - a["pitch"] == k and end(a) == end(b)]
                going = []
                for s in running:
                    best = min(((abs(p[0]["pitch"] - s["last"]), i) for i, p in enumerate(pairs) if p and abs(p[0]["pitch"] - s["last"]) <= most), default=None)
                    if best:
                        s["pairs"].append(pairs[best[1]])
                        s["last"], s["gap"], pairs[best[1]] = pairs[best[1]][0]["pitch"], 0, None
                        going.append(s)
                    else:
                        s["gap"] += 1
                        (going if s["gap"] <= max_gap else over).append(s)
                running = going + [{"pairs": [p], "last": p[0]["pitch"], "gap": 0} for p in pairs if p]
            for s in over + running:
                if len(s["pairs"]) >= 3:
                    bass = any(a["pitch"] <= low[at(a)] for a, _ in s["pairs"])
                    lost |= {(b if bass else a)["id"] for a, b in s["pairs"]}
    return sorted(n["id"] for n in notes if n["id"] not in lost)


def test_within_an_instrument_against_a_plain_walk(spark):
    rng = random.Random(2)
    cases = []
    for _ in range(40):
        case = []
        for t in range(rng.randint(3, 14)):
            for _ in range(rng.randint(1, 4)):
                p, inst = rng.choice([40, 41, 43, 45, 52, 53]), rng.choice("xy")
                case += [(inst, p, t, t + 1)] + [(inst, p + k, t, t + rng.choice([1, 1, 1, 2])) for k in O.OCTAVES if rng.random() < 0.5]
        cases.append(case)
    df = frame(spark, cases)
    for gap in (0, 1):
        got = {}
        for r in O.dedouble_octaves_within_instrument(df, max_gap=gap).collect():
            got.setdefault(r.score_id, []).append(r.row_id)
        dropped = 0
        for s, case in enumerate(cases):
            notes = [{"id": i, "inst": t, "pitch": float(p), "onset": o, "release": r} for i, (t, p, o, r) in enumerate(case)]
            assert sorted(got[s]) == plain_within(notes, gap)
            dropped += len(case) - len(got[s])
        assert dropped > 50
