"""URL filter: sorted arrays of 64-bit digests, memory-mapped in every worker.

A rule is a host and the beginning of a path, written as one string (``com/en/``). The
digests of all rules are kept sorted in one file, the strings in a second. A URL is probed
for each suffix of its host and each beginning of its path whose length some rule has; all
probes of a batch are searched at once, and every hit is confirmed against the stored string.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.scratch import unused

#: Rules that one array may hold: eight bytes and a string each, read by memory map.
MOST_RULES = 50_000_000

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def build_array(rules: dict[str, str]) -> bytes:
    """Count, number of path lengths, most labels of a rule's host; sorted digests, verdicts, ends of the
    strings, path lengths that occur, strings."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; split them by digest")
    names, verdict = [r.encode() for r in rules], list(rules.values())
    digest = np.array([xxhash.xxh64_intdigest(r) for r in names], "<u8")
    order = np.argsort(digest, kind="stable")
    ends = np.cumsum([len(names[i]) for i in order], dtype="<i8")
    verdicts = np.array([verdict[i] == "block" for i in order], "<u8")
    lengths = np.array(sorted({len(r[r.index("/") :]) for r in rules}), "<u8")
    labels = max((r.partition("/")[0].count(".") + 1 for r in rules), default=0)
    head = np.array([len(names), len(lengths), labels], "<u8")
    return b"".join([head.tobytes(), digest[order].tobytes(), verdicts.tobytes(), ends.tobytes(), lengths.tobytes(), *(names[i] for i in order)])


class DigestArray:
    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, m, self.labels = (int(x) for x in data[:24].view("<u8"))
        cuts = np.cumsum([24, 8 * n, 8 * n, 8 * n, 8 * m])
        self.digest, self.blocks, self.ends, self.lengths = (data[a:b].view(k) for a, b, k in zip(cuts, cuts[1:], ("<u8", "<u8", "<i8", "<u8")))
        self.text = data[cuts[-1] :]

    def string(self, i: int) -> bytes:
        return self.text[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key its place in the array, or -1. Equal digests stand together, so
        collisions are told apart by the full strings."""
        digest = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digest, digest)
        found = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero((at < len(self.digest)) & (self.digest[np.minimum(at, max(len(self.digest) - 1, 0))] == digest) if len(self.digest) else []):
            k = int(at[i])
            while k < len(self.digest) and self.digest[k] == digest[i]:
                if self.string(k) == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found


@lru_cache(maxsize=4)
def _array(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def judge(pages: DataFrame, rules: dict[str, str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict; columns of these names are replaced, all others stay.

    Host and path follow the first ``://`` (null or none: both empty). The longest fitting
    rule decides; a URL that no rule fits gets `default`. No suffix of a host with more labels than any rule has
    is probed, as none can fit. Repeated rows are judged alike. Nothing is shuffled; the array
    goes to each machine once as a file."""
    spark = pages.sparkSession
    name = f"digests-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp()  # executors fetch the file from here when they first need it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(build_array(rules))
    spark.sparkContext.addFile(os.path.join(folder, name))

    @F.pandas_udf("rule string, verdict string")
    def rule_of(hosts, paths):
        import pandas as pd

        array, keys, owner = _array(name), [], []
        lengths = [int(x) for x in array.lengths]
        for i, (host, path) in enumerate(zip(hosts, paths)):
            raw, labels = path.encode(), host.split(".")[-array.labels :] if array.labels else []
            starts = [raw[:k] for k in lengths if k <= len(raw)]
            for s in {".".join(labels[j:]).encode() for j in range(len(labels))}:
                keys += [s + p for p in starts]
                owner += [i] * len(starts)
        best, verdict = [None] * len(hosts), [default] * len(hosts)
        for k, place in enumerate(array.find(keys).tolist()):
            if place >= 0:
                rule, i = keys[k].decode(), owner[k]
                if best[i] is None or (len(rule), rule) > (len(best[i]), best[i]):
                    best[i], verdict[i] = rule, "block" if array.blocks[place] else "allow"
        return pd.DataFrame({"rule": pd.Series(best, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    known = pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    judged = unused(known, "judged")
    known = known.withColumn(judged, rule_of("host", "path"))
    return known.withColumn("rule", F.col(f"{judged}.rule")).withColumn("verdict", F.col(f"{judged}.verdict")).drop(judged)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every `pages` URL judged by the fixed rules; what no rule fits is allowed."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE6 = r"""
WITH rest AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS r FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rule, h, p, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT hp.page_id, host, path, best.rule, coalesce(rules.verdict, 'allow') AS verdict
FROM hp LEFT JOIN best USING (page_id) LEFT JOIN rules ON best.rule = rules.rule
"""
