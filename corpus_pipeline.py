"""A corpus pipeline: quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as
the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import packing, pii, quality, simhash
from scoreloom.llm.scratch import stored, unused


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Counts of the raw corpus are over all of `docs`."""
    row = unused(docs, "row")
    whole = docs.select(*docs.columns, F.struct(*docs.columns).alias(row))
    return quality.judge(whole, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=[row]).where("kept").select(f"{row}.*")


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one that was first in the input."""
    return simhash.deduplicate(docs)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text."""
    done = pii.pseudonymise(docs, pii.session_key(spark), count_col=unused(docs, "n_entities"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.packed_pieces(docs)


STAGES = [("quality rules", _quality), ("SimHash near-dedup", _near_dedup), ("PII surrogates", _pii), ("packing", _packing)]

#: Tokenizers, fingerprints and surrogates can't be expressed in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
