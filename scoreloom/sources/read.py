"""One entry for all formats of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreloom.plans.transforms import apply_transforms
from scoreloom.sources.midi import read_midi
from scoreloom.sources.musicxml import read_musicxml
from scoreloom.sources.tables import read_annotated_notes, read_csv

READERS = {"mid": read_midi, "midi": read_midi, "xml": read_musicxml, "musicxml": read_musicxml, "mxl": read_musicxml, "csv": read_csv, "tsv": read_annotated_notes}


def read_scores(spark: SparkSession, path: str, transforms: list[dict[str, dict]] | None = None, **options) -> DataFrame:
    """Scores at `path` (a file or a glob that ends in the format's suffix), with transforms applied in turn."""
    reader = READERS.get(path.rsplit(".", 1)[-1].lower())
    if reader is None:
        raise ValueError(f"no reader for {path}")
    return apply_transforms(reader(spark, path, **options), transforms or [])
