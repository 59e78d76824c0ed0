"""Packing by concatenate and cut.

Pass 1 turns every document into ids and numbers its place among the ids of its own
partition; the ids are kept in the shared folder. The totals of the partitions (one row
each) are summed up to global offsets. Pass 2 cuts the endless id stream at multiples of
the window. A window that lies in one batch of a task is whole there; the others come as boundary
records (parts of a window), which alone are shuffled and joined. Ids are kept as bytes, little-endian,
two to an id where the vocabulary allows it, else four.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.arrowtext import slices
from scoreloom.llm.scratch import stored
from scoreloom.llm.tokens import TEXT_BYTES, encoder


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of an id."""
    return 2 if max(encoder(tokenizer).tok.get_vocab_size() - 1, end_id) < 1 << 16 else 4


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass 1, one row per document: part, local_start (ids before it in the part), doc_id,
    n_tokens, ids (bytes). Null text is an empty one; null and repeated ids are kept as they are,
    row by row; columns other than these two are left out."""
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()),
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])
    width = id_width(tokenizer, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                ids, bounds = enc.encode(b.column("text"), end_id)
                n = np.diff(bounds)
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(at + bounds[:-1]), b.column("doc_id"), pa.array(n), data], names=schema.names)
                at += int(bounds[-1])

    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema), "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """Tokens with their global start. The broadcast side has one row per partition of pass 1."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("part", before.alias("base"))
    return tokens.join(F.broadcast(base), "part").withColumn("global_start", F.col("base") + F.col("local_start"))


def _id_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and their bounds."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8), ends - ends[0]


def windows(tokens: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """Pass 2, the packed sequences: sequence_id, n_tokens (without padding), width (bytes of an
    id), input_ids (bytes), parts (in order, the documents' parts in it: doc_id, start, length, doc_tokens).

    Only the last sequence can be short; it is padded to the window unless its length is a power of
    two. Whole windows leave their task as they are; boundary records are grouped by sequence (at
    most `window` ids a group)."""
    doc = T.StructType([tokens.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens"))])
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("parts", T.ArrayType(doc))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, ends = _id_bytes(b.column("ids"))
            n, g = b.column("n_tokens").to_numpy(), b.column("global_start").to_numpy()
            width = int(ends[1] // n[0])
            # pieces: parts of one document in one window
            count = (g + n - 1) // window - g // window + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = g[row] // window + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            lo, hi = np.maximum(seq * window, g[row]), np.minimum((seq + 1) * window, (g + n)[row])
            # records: pieces of one window that follow each other
            new = np.ones(len(row), bool)
            new[1:] = (seq[1:] != seq[:-1]) | (lo[1:] != hi[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            at = (np.cumsum(n) - n)[row] + lo - g[row]
            bounds = np.append(at[first], n.sum()) * width
            record = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            parts = pa.StructArray.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(lo - g[row]), pa.array(hi - lo), pa.array(n[row])], names=doc.names)
            yield pa.record_batch([pa.array(seq[first]), pa.array(lo[first] - seq[first] * window), pa.array(hi[last] - lo[first]), pa.array(np.full(len(first), width, np.int32)), record, pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), parts)], names=schema.names)

    cuts = stored(placed(tokens).select("doc_id", "n_tokens", "global_start", "ids").mapInArrow(cut, schema), "windows")
    records = cuts.where(F.col("n") < window).groupBy("sequence_id", "width").agg(F.sort_array(F.collect_list(F.struct("offset", "n", "ids", "parts"))).alias("r"))
    joined = records.select("sequence_id", F.expr("aggregate(r.n, 0L, (a, x) -> a + x)").alias("n_tokens"), "width", F.expr("aggregate(r.ids, X'', (a, x) -> concat(a, x))").alias("ids"), F.flatten("r.parts").alias("parts"))
    n = F.col("n_tokens")
    pad = F.when(F.col("width") == 2, F.lit(pad_id.to_bytes(4, "little")[:2].hex())).otherwise(F.lit(pad_id.to_bytes(4, "little").hex()))
    short = (n < window) & (n.bitwiseAND(n - 1) != 0)
    padded = F.when(short, F.concat("ids", F.unhex(F.repeat(pad, (F.lit(window) - n).cast("int"))))).otherwise(F.col("ids"))
    whole = cuts.where(F.col("n") == window).select("sequence_id", F.col("n").alias("n_tokens"), "width", "ids", "parts")
    return whole.unionByName(joined).select("sequence_id", "n_tokens", "width", padded.alias("input_ids"), "parts")


def sequences(tokens: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """The packed sequences with their ids as numbers: sequence_id, n_tokens, input_ids."""
    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                data, ends = _id_bytes(b.column("input_ids"))
                width = b.column("width")[0].as_py()
                lists = pa.ListArray.from_arrays(pa.array((ends // width).astype(np.int32)), pa.array(np.frombuffer(data.tobytes(), f"<u{width}").astype(np.int32)))
                yield pa.record_batch([b.column("sequence_id"), b.column("n_tokens"), lists], names=["sequence_id", "n_tokens", "input_ids"])

    return windows(tokens, window, pad_id).select("sequence_id", "n_tokens", "width", "input_ids").mapInArrow(numbers, "sequence_id long, n_tokens long, input_ids array<int>")


def pieces(tokens: DataFrame, window: int = 4096) -> DataFrame:
    """The pieces in the packed sequences, read from these: doc_id, start (ids of the document
    before the piece), length, ids_crc32, doc_tokens, sequence_id, offset. Every id is in one piece."""
    schema = T.StructType([tokens.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, ends = _id_bytes(b.column("input_ids"))
            width, parts = b.column("width")[0].as_py(), b.column("parts")
            count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            doc_id, start, length, doc_tokens = parts.flatten().flatten()
            size, row = length.to_numpy(), np.repeat(np.arange(b.num_rows), count)
            upto = np.cumsum(size) - size
            offset = upto - np.repeat(upto[np.cumsum(count) - count], count)
            at = ends[row] // width + offset
            raw = memoryview(np.frombuffer(data.tobytes(), f"<u{width}").astype("<u4")).cast("B")
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), size.tolist())), np.int64, len(size))
            yield pa.record_batch([doc_id, start, length, pa.array(crc), doc_tokens, b.column("sequence_id").take(pa.array(row)), pa.array(offset)], names=schema.names)

    return windows(tokens, window).mapInArrow(told, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """All `documents` packed into windows of 4096 ids; one row per piece."""
    return packed_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """`pieces` of all documents in windows of 4096 ids. A null or empty text has its end id alone; repeated rows
    and rows of one or a null id are documents of their own; columns other than doc_id and text are left out; no documents give no rows."""
    import public_tokenizers

    return pieces(token_table(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))
