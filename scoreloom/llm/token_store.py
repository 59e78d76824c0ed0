"""Token ids of a corpus as binary shards, each a wavelet matrix in one file."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.arrowtext import slices
from scoreloom.llm.scratch import new_folder, stored
from scoreloom.llm.tokens import TEXT_BYTES, encoder
from scoreloom.llm.wavelet import WaveletMatrix, build

#: Ids after which a shard is closed; a shard takes about two bytes an id.
SHARD_IDS = 4_000_000


def _put(folder: str, name: str, data: bytes) -> str:
    """Write a file of the shared folder; it gets its name when complete. A repeated task finds the
    same file there and leaves it."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    new = f"{path}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(new) as f:
        f.write(data)
    if files.get_file_info(f"{path}/{name}").type == fs.FileType.File:
        files.delete_file(new)
    else:
        files.move(new, f"{path}/{name}")
    return f"{folder}/{name}"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every document (null text: empty), `end_id` after each, in ascending id order
    (null first; rows of one id by a hash of their text) and write shards to `folder`.

    Returns the manifest, which is stored: part, shard (both ascending), path, n_docs, n_tokens.
    Documents are dealt by ranges of (id, text hash), so no task gets more than its share."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, parts, lengths = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal shard, doc_ids, parts, lengths
            ids, each = np.concatenate(parts), np.concatenate(lengths)
            path = _put(folder, f"shard-{part:06d}-{shard:05d}.wm", build(ids, doc_ids, each))
            row = pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (shard, pa.int32()), (path, pa.string()), (len(each), pa.int64()), (len(ids), pa.int64()))], names=["part", "shard", "path", "n_docs", "n_tokens"])
            doc_ids, parts, lengths, shard = [], [], [], shard + 1
            return row

        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                ids, bounds = enc.encode(b.column("text"), end_id)
                doc_ids += b.column("doc_id").to_pylist()
                parts.append(ids)
                lengths.append(np.diff(bounds))
                if sum(map(len, parts)) >= shard_ids:
                    yield close()
        if doc_ids:
            yield close()

    return stored(dealt.mapInArrow(write, "part int, shard int, path string, n_docs long, n_tokens long"), "manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32. The broadcast side has one row per shard."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"), before.alias("base"))
    if manifest.isEmpty():
        files = spark.createDataFrame([], "content binary, base long")
    else:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
        files = raw.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(base), "name").select("content", "base")
    schema = T.StructType([T.StructField("doc_id", id_type or T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column("content"), batch.column("base").to_pylist()):
                matrix = WaveletMatrix(content.as_buffer())
                doc_ids, lengths = matrix.documents()
                data = memoryview(matrix.all_ids().astype("<u4")).cast("B")
                first = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), lengths.tolist())]
                kind = pa.int64() if schema["doc_id"].dataType == T.LongType() else None
                yield pa.record_batch([pa.array(doc_ids, kind), pa.array(start + first), pa.array(lengths), pa.array(crc, pa.int64())], names=schema.names)

    # a file is a row: few rows to an Arrow batch keep a task's memory near that of one file
    return files.mapInArrow(read, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` encoded, written as shards and read back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "shards")
    manifest = write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_shards(spark, folder, manifest, docs.schema["doc_id"].dataType)
