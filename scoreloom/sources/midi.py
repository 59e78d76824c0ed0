"""Standard MIDI files as a source and a sink: one file is one score, files are spread over tasks."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "score_id string, row_id long, type string, track int, channel int, pitch double, velocity int, onset double, release double, other string, error string"
ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])


def _length(data: bytes, at: int) -> tuple[int, int]:
    """A number of 7-bit groups, and the place behind it."""
    value = 0
    while True:
        byte = data[at]
        at, value = at + 1, value << 7 | byte & 127
        if byte < 128:
            return value, at


def _events(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """tick, status (meta events: 256 plus their kind), data of each event of a track."""
    tick = status = 0
    while at < end:
        step, at = _length(data, at)
        tick += step
        if data[at] >= 128:
            status, at = data[at], at + 1
        if status == 0xFF:
            kind = data[at]
            size, at = _length(data, at + 1)
            yield tick, 256 + kind, data[at : at + size]
        elif status in (0xF0, 0xF7):
            size, at = _length(data, at)
        else:
            size = 1 if status >> 4 in (12, 13) else 2
            yield tick, status, data[at : at + size]
        at += size


def parse(data: bytes) -> list[dict]:
    """Rows of one file; a note ends with the next note-off of its channel and pitch, notes left open end with their track."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, _, n, per_quarter = struct.unpack(">IHHH", data[4:14])
    if per_quarter & 0x8000 or not per_quarter:
        raise ValueError("times in frames are not supported")
    rows, at, track = [], 8 + size, 0
    while at + 8 <= len(data):
        kind, length = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        start, at = at + 8, at + 8 + length
        if kind != b"MTrk":
            continue
        sounding, last = {}, 0
        for tick, status, x in _events(data, start, min(at, len(data))):
            when, last = tick / per_quarter, tick / per_quarter
            row = {"track": track, "onset": when}
            channel = status & 15 if status < 256 else None
            if status >> 4 == 9 and x[1]:
                row |= {"type": "note", "channel": channel, "pitch": float(x[0]), "velocity": x[1]}
                sounding.setdefault((channel, x[0]), []).append(row)
            elif status >> 4 in (8, 9):
                for r in sounding.pop((channel, x[0]), []):
                    r["release"] = when
                continue
            elif status >> 4 == 12:
                row |= {"type": "program_change", "channel": channel, "other": json.dumps({"program": x[0]})}
            elif status >> 4 == 11:
                row |= {"type": "control_change", "channel": channel, "other": json.dumps({"control": x[0], "value": x[1]})}
            elif status >> 4 == 14:
                row |= {"type": "pitchwheel", "channel": channel, "other": json.dumps({"pitch": (x[1] << 7 | x[0]) - 8192})}
            elif status == 256 + 0x51:
                row |= {"type": "tempo", "other": json.dumps({"tempo": 6e7 / int.from_bytes(x, "big")})}
            elif status == 256 + 0x58:
                row |= {"type": "time_signature", "other": json.dumps({"numerator": x[0], "denominator": 1 << x[1]})}
            elif status == 256 + 0x59:
                row |= {"type": "key_signature", "other": json.dumps({"sharps": struct.unpack("b", x[:1])[0], "minor": bool(x[1])})}
            elif status == 256 + 6:
                row |= {"type": "marker", "other": json.dumps({"text": x.decode("utf-8", "replace")})}
            else:
                continue
            rows.append(row)
        for open_notes in sounding.values():
            for r in open_notes:
                r["release"] = last
        track += 1
    return rows


def read_midi(spark: SparkSession, path: str | list[str], notes_only: bool = False) -> DataFrame:
    """Events of all files. A file that can't be read gives one row of type 'error', which tells why;
    one without any content gives none, as Spark skips it."""
    def rows(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = parse(content)
                except (ValueError, IndexError, struct.error) as e:
                    found = [{"type": "error", "error": str(e) or type(e).__name__}]
                out += [{"score_id": name, "row_id": i, **r} for i, r in enumerate(found)]
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    events = files.mapInArrow(rows, SCHEMA)
    return events.where("type in ('note', 'error')") if notes_only else events


def _number(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def render(rows: list[dict], per_quarter: int = 480) -> bytes:
    """One file: tempi, time signatures and notes (null velocity: 64), one chunk for each track."""
    tracks: dict[int, list] = {0: []}
    tick = lambda t: int(t * per_quarter)
    for r in rows:
        track, other = tracks.setdefault(int(r["track"] or 0), []), json.loads(r["other"] or "{}")
        if r["type"] == "note" and r["pitch"] is not None and r["release"] is not None:
            status = int(r["channel"] or 0)
            track.append((tick(r["onset"]), 2, bytes([0x90 | status, int(r["pitch"]), 64 if r["velocity"] is None else int(r["velocity"])])))
            track.append((tick(r["release"]), 1, bytes([0x80 | status, int(r["pitch"]), 0])))
        elif r["type"] == "tempo":
            tracks[0].append((tick(r["onset"]), 0, b"\xff\x51\x03" + round(6e7 / other["tempo"]).to_bytes(3, "big")))
        elif r["type"] == "time_signature":
            tracks[0].append((tick(r["onset"]), 0, b"\xff\x58\x04" + bytes([other["numerator"], other["denominator"].bit_length() - 1, 24, 8])))
    out = b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), per_quarter)
    for _, events in sorted(tracks.items()):
        body, before = b"", 0
        for when, _, data in sorted(events, key=lambda e: e[:2]):
            body, before = body + _number(when - before) + data, when
        body += b"\0\xff\x2f\0"
        out += b"MTrk" + struct.pack(">I", len(body)) + body
    return out


def render_midi(events: DataFrame, per_quarter: int = 480) -> DataFrame:
    """score_id, content: the bytes of a file for each score. One score is one group, as its file is one value."""
    wanted = ["type", "track", "channel", "pitch", "velocity", "onset", "release", "other"]
    row = F.struct("onset", *(c for c in wanted if c != "onset"))

    @F.pandas_udf("binary")
    def content(rows: pd.Series) -> pd.Series:
        return pd.Series([render([dict(r) if isinstance(r, dict) else r.asDict() for r in x], per_quarter) for x in rows])

    return events.groupBy("score_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("score_id", content("rows").alias("content"))
