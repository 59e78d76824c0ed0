"""Quality rules and a log-likelihood ratio of hashed character n-grams.

Every three characters in a row, white space included, are hashed to one of BUCKETS bins.
Two multinomials over the bins are counted: of all documents, and of a bounded sample of
trusted ones. An n-gram's weight is the log of its trusted count over the count that the raw
corpus lets expect, both with PRIOR added, so that rare n-grams tell little. A document's
score is its mean weight. Weights are whole millionths, so sums are exact and do not depend on
the order of work. A fixed threshold decides on every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.arrowtext import Words, slices, words

#: Text judged at once inside a task; arrays take about fifty times as much.
TEXT_BYTES = 1 << 20
BUCKETS = 1 << 16
#: Trusted documents that the target is counted on: those with the smallest hashes of their ids.
TRUSTED = 20_000
PRIOR = 5
#: Least mean weight, in millionths.
THRESHOLD = -550_000
SYMBOLS = "[#*$%&|<>]"


def _bins(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each trigram of the texts, and how many each text has."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in pc.fill_null(texts, "").to_pylist()]
    c = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
    n = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
    if len(c) < 3:
        return np.empty(0, np.int64), np.zeros(len(n), np.int64)
    last = np.ones(len(c), bool)  # the last two characters of a text begin no trigram
    ends = np.cumsum(n)
    last[(ends - 1)[n > 0]] = last[(ends - 2)[n > 1]] = False
    h = (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) * 2654435761 % (1 << 32) >> 16
    return h[last[:-2]], np.maximum(n - 2, 0)


def trusted_ids(labels: DataFrame, bound: int = TRUSTED, id_col: str = "doc_id") -> DataFrame:
    """At most `bound` distinct ids of documents labelled as good, the same at every run."""
    good = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id")).distinct()
    return good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(bound)


def ngram_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, raw, target: n-grams of all documents and of the trusted ones. Each task sends
    one row per bin; `trusted` is broadcast and has at most TRUSTED rows."""
    flagged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(trusted.withColumn("good", F.lit(True))), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                bins, n = _bins(b.column("text"))
                good = np.repeat(pc.fill_null(b.column("good"), False).to_numpy(zero_copy_only=False), n)
                raw += np.bincount(bins, minlength=BUCKETS)
                target += np.bincount(bins[good], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return flagged.select("text", "good").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(counts: DataFrame) -> np.ndarray:
    """Weight of each bin in millionths; all zero without trusted documents. At most BUCKETS rows reach the driver."""
    rows = counts.toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows.bucket], target[rows.bucket] = rows.raw, rows.target
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    return np.rint(1e6 * np.log((target + PRIOR) / (raw * target.sum() / raw.sum() + PRIOR))).astype(np.int64)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """One number for each distinct combination of keys."""
    out = keys[0].astype(np.int64)
    for k in keys[1:]:
        out = np.unique(out * (int(k.max(initial=0)) + 1) + k, return_inverse=True)[1]
    return out


def _repeated(w: Words, row: np.ndarray) -> np.ndarray:
    """For each word whether it stands in a 5-word window that its text holds twice or more."""
    n = len(w.codes)
    if n < 5:
        return np.zeros(n, bool)
    c = w.codes.astype(np.int64)
    key = _dense(row[: n - 4], *(c[k : n - 4 + k] for k in range(5)))
    own = row[: n - 4] == row[4:]
    hit = own & (np.bincount(key[own], minlength=int(key.max()) + 1)[key] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[: n - 4] += hit
    edge[5 : n + 1] -= hit
    return np.cumsum(edge)[:n] > 0


def score(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """One row per document: counts of the base rules, base_failed, llr_sum (millionths),
    n_ngrams, kept. Null text has no words and so fails the base rules. `keep` names input
    columns to be passed on, under the names ``in_<name>`` if a result has the name already."""
    keep = keep or []
    own = {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_sum", "n_ngrams", "base_failed", "kept"}
    put = [T.StructField(f"in_{c}" if c.lower() in own else c, docs.schema[c].dataType) for c in keep]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_sum", "n_ngrams")] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")] + put)
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        for batch in batches:
            for b in slices(batch, "__text", TEXT_BYTES):
                texts = b.column("__text")
                w = words(texts)
                n, m = np.diff(w.bounds), b.num_rows
                row = np.repeat(np.arange(m), n)
                add = lambda x: np.bincount(row, x, minlength=m).astype(np.int64)  # noqa: E731  exact below 2 ** 53
                chars = pc.utf8_length(w.distinct).to_numpy(zero_copy_only=False)
                symbols = pc.count_substring_regex(w.distinct, SYMBOLS).to_numpy(zero_copy_only=False)
                lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
                flat = lines.flatten()
                line_row = np.repeat(np.arange(m), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
                wordy = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
                code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                first = np.unique(line_row[wordy].astype(np.int64) * (len(flat) + 1) + code[wordy]) // (len(flat) + 1)
                dup = np.bincount(line_row[wordy], minlength=m) - np.bincount(first, minlength=m)
                bins, grams = _bins(texts)
                llr = np.bincount(np.repeat(np.arange(m), grams), ratio[bins], minlength=m).astype(np.int64)
                repeat = add(_repeated(w, row))
                failed = (n < 10) | (100 * repeat > 20 * n)
                kept = ~failed & (llr >= threshold * grams)
                out = [n, add(chars[w.codes]) if len(chars) else 0 * n, add(symbols[w.codes]) if len(chars) else 0 * n, dup, repeat, llr, grams, failed, kept]
                yield pa.record_batch([b.column("__id"), *map(pa.array, out), *b.columns[2:]], names=schema.names)

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *keep).mapInArrow(apply, schema)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Both passes over all documents. Repeated rows are judged alike, each on its own, and so are rows of a null id;
    null, empty and wordless texts fail the base rules. Columns other than doc_id, text and those of `keep` are left
    out. No documents give no rows; without trusted labels all weights are 0."""
    return score(docs, weights(ngram_counts(docs, trusted_ids(labels))), keep=keep)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE2 = r"""
WITH good AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20000),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, i, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS win
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ch AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT doc_id, string_split(text, '') AS cs FROM d WHERE text <> '')),
t3 AS (SELECT doc_id, unicode(c)::BIGINT AS a, lead(unicode(c)) OVER o AS b, lead(unicode(c), 2) OVER o AS e FROM ch WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, ((a * 961 + b * 31 + e) * 2654435761 % 4294967296) // 65536 AS b FROM t3 WHERE e IS NOT NULL),
c AS (SELECT b, count(*) AS raw, count(good.doc_id) AS target FROM f LEFT JOIN good USING (doc_id) GROUP BY b),
tot AS (SELECT sum(raw)::DOUBLE AS r, sum(target)::DOUBLE AS t FROM c),
lw AS (SELECT b, CASE WHEN t = 0 THEN 0 ELSE round(1e6 * ln((target + 5) / (raw * t / r + 5)))::BIGINT END AS lw FROM c, tot),
llr AS (SELECT doc_id, sum(lw)::BIGINT AS llr_sum, count(*) AS n_ngrams FROM f JOIN lw USING (b) GROUP BY doc_id),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) > 1 AS hit FROM g WHERE win IS NOT NULL),
rw AS (SELECT g.doc_id, g.i FROM g JOIN rep ON rep.doc_id = g.doc_id AND rep.hit AND g.i BETWEEN rep.i AND rep.i + 4 GROUP BY ALL),
rc AS (SELECT doc_id, count(*) AS n_repeat_words FROM rw GROUP BY doc_id),
st AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
j AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(llr_sum, 0) AS llr_sum, coalesce(n_ngrams, 0) AS n_ngrams
  FROM d LEFT JOIN st USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rc USING (doc_id) LEFT JOIN llr USING (doc_id)),
k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT *, NOT base_failed AND llr_sum >= -550000 * n_ngrams AS kept FROM k
"""
