"""SentencePiece encoding and decoding over a relational lattice.

The lattice: the corpus's distinct words are exploded to their substrings of bounded length, which
are joined to the piece table; the edges found are grouped by word, and a higher-order aggregate
folds them. Two folds: ``viterbi`` takes the path with the best sum of scores, which is what a
unigram model means; ``merges`` is the rule of a BPE model on the same lattice: in each
step the edge with the best score that joins two neighbouring symbols (of equal ones the
leftmost) becomes one symbol. If no merge makes room for a better one, which is known from the
pieces alone (``late``), the fold goes once over a word's edges, best first; else it searches them anew for each merge. The public model is a BPE model, for which a Viterbi path over its
scores gives other ids than the model's own (README), so op7 folds by merges.

A text is cut wherever no piece of the model holds the two signs that meet there; no piece and
no merge can cross such a place. Each partition of the texts gives its distinct words once,
each distinct word of the corpus is folded once, and the encodings come back as one
dictionary folder per partition in the shared folder, with which the partition's texts are encoded.
Words too long for the bit sets of the fold, and words that a partition did not give when it was
read first, are merged by the same rule in Python.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.arrowtext import ranges, slices
from scoreloom.llm.scratch import new_folder, stored

SPACE = "▁"
#: Longest word, in signs, that is folded in the bits of a long.
MOST_SIGNS = 60
#: Rows that a piece table may have to be broadcast (ids and ranks have 20 bits).
MOST_PIECES = 1_000_000
#: Text handled at once inside a task.
TEXT_BYTES = 2 << 20


class Model:
    """Pieces of a model file: ordinary pieces with their scores, and ids of byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        self.names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = {p: (i, sp.get_score(i)) for i, p in enumerate(self.names) if not special[i]}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.pieces))
        self.signs_of = np.array([0 if x else len(p) for p, x in zip(self.names, special)], np.int32)
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        self.raw, self.raw_length = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, n)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        # Whether two bytes of a text may meet inside a word; spaces stand for SPACE here. Bytes of signs
        # beyond ASCII always may, but a space begins a word except behind a space.
        self.meet = np.zeros((256, 256), bool)
        self.meet[128:, :], self.meet[:, 128:] = True, True
        for p in self.pieces:
            for x, y in zip(p.replace(SPACE, " "), p.replace(SPACE, " ")[1:]):
                if x < "\x80" and y < "\x80":
                    self.meet[ord(x), ord(y)] = True
        if not any(x != SPACE and y == SPACE for p in self.pieces for x, y in zip(p, p[1:])):
            self.meet[128:, 32] = False
        self.meet = self.meet.ravel()

    def sign(self, c: str) -> list[int]:
        if c in self.pieces:
            return [self.pieces[c][0]]
        return [self.bytes.get(b, self.unknown) for b in c.encode()] if self.bytes else [self.unknown]

    def merge(self, word: str) -> list[int]:
        """The same rule with a heap, for words of any length."""
        sym, left, right = list(word), list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap: list = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (hit := self.pieces.get(sym[i] + sym[j])):
                heapq.heappush(heap, (-hit[1], i, j, len(sym[i]) + len(sym[j])))

        for i in range(len(sym)):
            offer(i)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not sym[i] or not sym[j] or right[i] != j or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i], sym[j], right[i] = sym[i] + sym[j], "", right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [x for s in sym if s for x in ([self.pieces[s][0]] if s in self.pieces else self.sign(s))]


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=2)
def late(m: Model) -> frozenset[str]:
    """Pieces that their own signs reach only over a merge whose score is no better. Only they can come up after
    worse edges were taken: while an edge has both its ends, what merges inside it merges as in its piece alone."""
    out = set()
    for piece in m.pieces:
        sym, worst = list(piece), float("inf")
        while len(sym) > 1:
            score, k = max(((hit[1], -k) for k, xy in enumerate(zip(sym, sym[1:])) if (hit := m.pieces.get(xy[0] + xy[1]))), default=(None, 0))
            if score is None:
                break
            if len(sym) == 2 and score >= worst:
                out.add(piece)
            worst = min(worst, score)
            sym[-k : 2 - k] = [sym[-k] + sym[1 - k]]
    return frozenset(out)


def cut(texts: pa.Array, m: Model) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all texts: codes, distinct words (with spaces), bounds of each text. Each non-empty
    text gets a space in front, as the model wants it."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
    texts = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " "), texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))
    if not ends[-1]:
        return np.empty(0, np.int64), pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    _, offsets, data = texts.buffers()
    first = np.frombuffer(offsets, np.int32)[texts.offset]
    data = np.frombuffer(data, np.uint8)[first : first + ends[-1]]
    start = np.ones(len(data), bool)
    start[1:] = ~m.meet[data[:-1].astype(np.uint16) << 8 | data[1:]]
    start[ends[:-1][size > 0]] = True
    at = np.flatnonzero(start)
    coded = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.searchsorted(at, ends)


def edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """The lattice: word to one row per piece in it, columns word, s (place), t (end), and those of
    `pieces` but its column piece. `pieces` is broadcast. No shuffle."""
    starts = words.select("word", F.char_length("word").alias("n")).withColumn("s", F.explode(F.expr("sequence(0, n - 1)")))
    spans = starts.withColumn("t", F.explode(F.expr(f"sequence(s + 1, least(n, s + {longest}))"))).withColumn("piece", F.expr("substring(word, s + 1, t - s)"))
    return spans.join(F.broadcast(pieces), "piece").drop("piece", "n")


def merges(lattice: DataFrame) -> DataFrame:
    """Edges (word, s, t, id, rank, late) to word, starts (place of each piece, null if they cover the word), ids, by the BPE rule."""
    # an edge is one long, rank first: 20 bits each for rank and id, 6 each for place and length
    edge = F.expr("shiftleft(cast(rank as bigint), 32) | shiftleft(cast(s as bigint), 26) | shiftleft(cast(t - s as bigint), 20) | id").alias("e")
    grouped = lattice.select("word", edge, "late").groupBy("word").agg(F.sort_array(F.collect_list("e")).alias("packed"), F.bool_or("late").alias("late"))
    place = "cast(shiftright(e, 26) & 63 as int)"
    stop = f"{place} + cast(shiftright(e, 20) & 63 as int)"
    told = f"transform(packed, e -> named_struct('s', {place}, 'n', cast(shiftright(e, 20) & 63 as int), 'ends', shiftleft(1L, {place}) | shiftleft(1L, {stop}), 'inner', (shiftleft(1L, {stop}) - 1) & ~(shiftleft(1L, {place} + 1) - 1), 'id', cast(e & 1048575 as int)))"
    grouped = grouped.withColumn("edges", F.expr(told))
    # an edge is free if it spans two symbols, which it joins: with no late edge one turn over all does, else each step takes the first free one
    all_ends, free = "shiftleft(1L, char_length(word) + 1) - 1", "(b & e.ends) = e.ends AND bit_count(b & e.inner) = 1"
    once = f"aggregate(edges, {all_ends}, (b, e) -> if({free}, b & ~e.inner, b))"
    anew = f"aggregate(sequence(1, greatest(char_length(word) - 1, 1)), {all_ends}, (b, k) -> b & ~coalesce(get(filter(edges, e -> {free}), 0).inner, 0L))"
    bits = f"if(late, {anew}, {once})"
    found = "array_sort(transform(filter(edges, e -> (bits & e.ends) = e.ends AND (bits & e.inner) = 0), e -> struct(e.s, e.id, e.n)))"
    done = grouped.withColumn("bits", F.expr(bits)).withColumn("found", F.expr(found))
    whole = F.expr("aggregate(found, 0, (a, x) -> a + x.n) = char_length(word)")
    # signs that no piece covers are written as bytes later, by place
    return done.select("word", F.when(~whole, F.expr("transform(found, x -> x.s)")).alias("starts"), F.expr("transform(found, x -> x.id)").alias("ids"))


def viterbi(lattice: DataFrame) -> DataFrame:
    """Edges (word, s, t, id, score) to word, ids: the path of all of the word with the best sum of
    scores, of equal ones that with the smaller ids from the back; null if there is none."""
    grouped = lattice.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("t", "s", "id", "score"))).alias("edges"))
    # best[p]: score of the best path to place p and the edge by which it comes there
    state = "transform(sequence(0, char_length(word)), p -> struct(if(p = 0, 0.0D, double('-Infinity')) AS score, cast(null as int) AS s, cast(null as int) AS id))"
    better = "get(b, e.s).score + e.score > get(b, e.t).score"
    step = f"(b, e) -> if({better}, transform(b, (x, p) -> if(p = e.t, struct(get(b, e.s).score + e.score AS score, e.s AS s, e.id AS id), x)), b)"
    back = "aggregate(sequence(1, char_length(word)), struct(char_length(word) AS at, cast(array() as array<int>) AS ids), (a, k) -> if(a.at = 0, a, struct(get(best, a.at).s AS at, concat(array(get(best, a.at).id), a.ids) AS ids)))"
    done = grouped.withColumn("best", F.expr(f"aggregate(edges, {state}, {step})"))
    reached = F.expr("get(best, char_length(word)).score > double('-Infinity')")
    return done.select("word", F.when(reached, F.expr(f"{back}.ids")).alias("ids"))


def piece_table(spark: SparkSession, m: Model) -> DataFrame:
    """piece, id, score, rank (0: the best score), late."""
    order = {s: k for k, s in enumerate(sorted({s for _, s in m.pieces.values()}, reverse=True))}
    ids, scores = zip(*m.pieces.values())
    return spark.createDataFrame(pa.table({"piece": list(m.pieces), "id": pa.array(ids, pa.int32()), "score": pa.array(scores, pa.float64()), "rank": pa.array([order[s] for s in scores], pa.int32()), "late": [p in late(m) for p in m.pieces]}))


def _assemble(m: Model, word: str, starts: list[int], ids: list[int]) -> list[int]:
    """Ids with the bytes of signs that no piece covers."""
    out, at = [], 0
    for s, i in zip(starts, ids):
        while at < s:
            out += m.sign(word[at])
            at += 1
        out.append(i)
        at = s + len(m.names[i])
    for c in word[at:]:
        out += m.sign(c)
    return out


class _Dictionary:
    """Words of a partition and their ids."""

    def __init__(self, m: Model, path: str):
        from pyarrow import dataset, fs

        self.m, self.words = m, pa.array([], pa.string())
        self.start, self.length, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        files, path = fs.FileSystem.from_uri(path)
        if files.get_file_info(path).type != fs.FileType.Directory:
            return
        table = dataset.dataset(path, filesystem=files, format="parquet").to_table(columns=["word", "starts", "ids"]).combine_chunks()
        words = pc.replace_substring(table["word"], SPACE, " ").combine_chunks()
        ids = table["ids"].combine_chunks()
        part = np.flatnonzero(table["starts"].is_valid().to_numpy(zero_copy_only=False))
        some = table.take(pa.array(part)).to_pydict()
        self._add(words, pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
        self._replace(part, [_assemble(m, *x) for x in zip(some["word"], some["starts"], some["ids"])])

    def _add(self, words: pa.Array, length: np.ndarray, flat: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(length) - length))
        self.length, self.pool = np.concatenate((self.length, length)), np.concatenate((self.pool, flat))
        self.words = pa.concat_arrays([self.words, words])

    def _replace(self, places: np.ndarray, ids: list[list[int]]) -> None:
        each = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start[places], self.length[places] = len(self.pool) + np.cumsum(each) - each, each
        self.pool = np.concatenate((self.pool, np.fromiter((i for x in ids for i in x), np.int32, int(each.sum()))))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The place of each word; words that are new are merged here."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = words.filter(at.is_null())
            ids = [self.m.merge(w.replace(" ", SPACE)) for w in new.to_pylist()]
            self._add(new, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), np.int32))
            at = pc.index_in(words, value_set=self.words)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)


def encoder(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text"):
    """Prepares the dictionaries; (rows, function): the function maps the rows' Arrow batches to
    batches of doc_id, ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    folder = new_folder(spark, "dictionary")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = model(model_file), pa.array([], pa.string())
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                seen = pc.unique(pa.concat_arrays([seen, cut(b.column("text"), m)[1]]))
        short = seen.filter(pc.less_equal(pc.utf8_length(seen), MOST_SIGNS))
        for lo in range(0, len(short), 100_000):
            words = pc.replace_substring(short.slice(lo, 100_000), " ", SPACE)
            yield pa.record_batch([pa.array(np.full(len(words), TaskContext.get().partitionId(), np.int32)), words], names=["part", "word"])

    given = rows.select("text").mapInArrow(distinct, "part int, word string")
    # a list has one number for each partition of the texts at most
    by_word = stored(given.groupBy("word").agg(F.collect_list("part").alias("parts")), "words")
    n, m = int(spark.conf.get("spark.sql.shuffle.partitions")), model(model_file)
    folded = merges(edges(by_word.select("word").repartition(n, "word"), piece_table(spark, m).drop("score"), m.longest))
    back = by_word.repartition(n, "word").join(folded.hint("merge"), "word", "left")
    back = back.select(F.explode("parts").alias("part"), "word", F.coalesce("starts", F.when(F.col("ids").isNull(), F.expr("cast(array() as array<int>)"))).alias("starts"), F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids"))
    back.repartition(n, "part").write.option("compression", "zstd").partitionBy("part").parquet(folder)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        known = _Dictionary(m, f"{folder}/part={TaskContext.get().partitionId()}")
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                codes, words, bounds = cut(b.column("text"), m)
                number = known.numbers(words)[codes]
                size = known.length[number]
                ends = np.concatenate(([0], np.cumsum(size)))[bounds]
                yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(known.pool[ranges(known.start[number], size)]))], names=["doc_id", "ids"])

    return rows, apply


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every text. Null and empty texts have no ids; rows are kept one by one,
    other columns are left out."""
    rows, apply = encoder(docs, model_file, id_col, text_col)
    return rows.mapInArrow(apply, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _texts(ids: pa.ListArray, m: Model) -> pa.Array:
    """Texts of lists of ids: pieces joined, byte pieces put together, the front space taken off."""
    lists = pc.fill_null(ids, pa.scalar([], ids.type))
    flat, n = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    size, first = m.raw_length[flat], np.cumsum(n) - n
    start = m.raw_start[flat]
    some = first[n > 0]
    cut = np.zeros(len(flat), bool)
    cut[some] = (size[some] > 0) & (m.raw[np.minimum(start[some], len(m.raw) - 1)] == 32)
    data, length = m.raw[ranges(start + cut, size - cut)], size - cut
    ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate((first, [len(flat)]))].astype(np.int32)
    out = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:  # ids of no text: bytes that are no UTF-8 are replaced
        out = pa.array([x.decode("utf-8", "replace") for x in out.cast(pa.binary()).to_pylist()], pa.string())
    return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.string()))


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with the column text (null for null; a column of this name is replaced)."""
    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        return pd.Series(_texts(pa.array(ids, pa.list_(pa.int32())), model(model_file)).to_pylist(), dtype=object)

    return encoded.withColumn("text", text(ids_col))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`: doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), and of the
    text decoded from the ids n_chars and text_md5. Encoding and decoding share one Python worker."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, apply = encoder(docs, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in apply(batches):
            ids = b.column("ids")
            text, n = _texts(ids, model(path)), pc.list_value_length(ids)
            data, ends = memoryview(ids.flatten().to_numpy().astype("<u4")).cast("B"), ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends.tolist(), ends[1:].tolist())]
            md5 = [hashlib.md5(t).hexdigest() for t in text.cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column("doc_id"), n.cast(pa.int64()), pa.array(crc, pa.int64()), pc.utf8_length(text).cast(pa.int64()), pa.array(md5, pa.string())], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_pieces", "ids_crc32", "n_chars")), T.StructField("text_md5", T.StringType())])
    return rows.mapInArrow(digest, schema)
