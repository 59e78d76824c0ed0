"""MusicXML files, plain or compressed, as a source: one file is one score, files are spread over tasks.

Sounding notes with ties joined, bars, time signatures and tempi. Rests and grace notes are left out. Repeats are not
played out: each bar comes once.
"""

from __future__ import annotations

import io
import json
import zipfile
from fractions import Fraction
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "score_id string, row_id long, type string, part string, voice string, instrument string, pitch double, spelling string, onset double, release double, other string, error string"
ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
#: Semitones of the natural steps above C.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def _root(data: bytes) -> ElementTree.Element:
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            files = ElementTree.fromstring(z.read("META-INF/container.xml")).iter()
            name = next(e.get("full-path") for e in files if e.tag.endswith("rootfile"))
            data = z.read(name)
    root = ElementTree.fromstring(data)
    if root.tag != "score-partwise":
        raise ValueError("not a score by parts")
    return root


class _Part:
    """The running time of one part."""

    def __init__(self, name: str, instrument: str | None):
        self.name, self.instrument = name, instrument
        self.now, self.divisions, self.transpose, self.chord = Fraction(0), 1, 0, Fraction(0)
        self.rows: list[dict] = []
        self.tied: dict[tuple, dict] = {}

    def add(self, kind: str, **columns) -> dict:
        row = {"type": kind, "part": self.name, "instrument": self.instrument, "onset": float(self.now)} | columns
        self.rows.append(row)
        return row

    def length(self, e: ElementTree.Element) -> Fraction:
        return Fraction(e.findtext("duration", "0").strip()) / self.divisions

    def attributes(self, e: ElementTree.Element) -> None:
        self.divisions = int(e.findtext("divisions", str(self.divisions)))
        if (t := e.find("transpose")) is not None:
            self.transpose = int(t.findtext("chromatic", "0")) + 12 * int(t.findtext("octave-change", "0"))
        for t in e.findall("time"):
            if t.find("beats") is not None:
                beats = sum(int(b) for b in t.findtext("beats").split("+"))
                self.add("time_signature", other=json.dumps({"numerator": beats, "denominator": int(t.findtext("beat-type"))}))

    def note(self, e: ElementTree.Element) -> None:
        if e.find("grace") is not None or e.find("cue") is not None:
            return
        length = self.length(e)
        onset = self.chord if e.find("chord") is not None else self.now
        self.chord, self.now = onset, max(self.now, onset + length) if e.find("chord") is not None else self.now + length
        if (p := e.find("pitch")) is None:
            return
        step, alter, octave = p.findtext("step"), round(float(p.findtext("alter", "0"))), int(p.findtext("octave"))
        pitch = float(12 * (octave + 1) + STEPS[step] + alter + self.transpose)
        ties, release = {t.get("type") for t in e.findall("tie")}, onset + length
        before = self.tied.pop((pitch, onset), None) if "stop" in ties else None
        if before is None:
            before = self.add("note", voice=e.findtext("voice"), pitch=pitch, spelling=step + ("#" * alter if alter > 0 else "b" * -alter), onset=float(onset))
        before["release"] = float(release)
        if "start" in ties:
            self.tied[pitch, release] = before


def parse(data: bytes) -> list[dict]:
    """Rows of one file. Bars, time signatures and tempi are taken once, from the first part that has them at their place.
    A tie's end belongs to the note of its pitch that ends where it begins; one without such a note stands alone."""
    root = _root(data)
    names = {p.get("id"): p.findtext("part-name") for p in root.iter("score-part")}
    rows, once = [], set()
    for part in root.findall("part"):
        p = _Part(part.get("id"), names.get(part.get("id")))
        for measure in part.findall("measure"):
            start = latest = p.now
            bar = p.add("bar")
            for e in measure:
                if e.tag == "attributes":
                    p.attributes(e)
                elif e.tag == "note":
                    p.note(e)
                elif e.tag == "backup":
                    p.now -= p.length(e)
                elif e.tag == "forward":
                    p.now += p.length(e)
                for s in [e] if e.tag == "sound" else e.findall("sound") if e.tag == "direction" else []:
                    if s.get("tempo"):
                        p.add("tempo", other=json.dumps({"tempo": float(s.get("tempo"))}))
                p.now = max(p.now, start)
                latest = max(latest, p.now)
            p.now = latest
            bar["release"] = float(latest)
        for r in p.rows:
            mark = (r["type"], r["onset"])
            if r["type"] == "note" or mark not in once:
                rows.append(r if r["type"] == "note" else r | {"part": None, "instrument": None})
                once.add(mark)
    return rows


def read_musicxml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of all files. A file that can't be read gives one row of type 'error', which tells why;
    one without any content gives none, as Spark skips it."""
    def rows(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = parse(content)
                except (ElementTree.ParseError, zipfile.BadZipFile, ValueError, KeyError, TypeError, StopIteration) as e:
                    found = [{"type": "error", "error": str(e) or type(e).__name__}]
                out += [{"score_id": name, "row_id": i, **r} for i, r in enumerate(found)]
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, SCHEMA)
