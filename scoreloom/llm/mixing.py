"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size gives each of its documents the same expected number of
copies. Whole copies are taken for sure; what is left over is a probability, kept as a mass of
words. Two documents with open masses exchange words, at random but fair on the mean, until
one of them has none or all of its size; the other goes on to meet the next. So a source's
mass never changes. Groups of about FAN documents are folded by `aggregate` and leave one open
document each; these are grouped and folded again, level by level, until a source has one,
which goes to its nearer end. A source so misses its target by half a document at most.

Random numbers are hashes of the documents that meet and of the seed, and groups follow from
hashes of ids, so that reruns and other partitionings agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.scratch import small_side, stored

#: Weights of the sources in order, repeating; share of all words to be taken; most copies.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
#: Documents folded at once.
FAN = 128
#: Masses are kept as whole parts of a word.
PARTS = 1 << 20
#: Repeated rows written from one row at once.
ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source_key, size, n_rows: words of each document; rows alike in all of them are
    one row. A null text has no words. The key of a null source comes last."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("source_key"), size.alias("size")).groupBy("doc_id", "source_key", "size").agg(F.count(F.lit(1)).alias("n_rows"))


def _ranked(df: DataFrame, order: str) -> DataFrame:
    """`rank` from 0 in the order of a distinct column: ranges of it are ranked each, after
    the rows of all ranges before."""
    parts = stored(df.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranked")
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("own", own).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source_key, source_size, n_docs, target, from `sized` rows: `share` of all words by weight,
    no source above `most` times its size, the excess shared again. The factor of the weights
    is found by a few sums over the sources, each of which counts those that the last one fills."""
    sources = sizes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(_ranked(sources, "source_key").withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).drop("rank"), "sources")
    total, factor, last = None, 0.0, None
    while factor != last:
        full = F.col("cap") <= F.col("weight") * F.lit(factor)
        words, filled, open_weight = sources.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        total = share * (words or 0) if total is None else total
        last, factor = factor, max(factor, (total - (filled or 0.0)) / open_weight) if open_weight else factor
    return sources.select("source_key", "source_size", "n_docs", F.least("cap", F.col("weight") * F.lit(factor)).alias("target"))


def _meeting(seed: int) -> Callable[[Column, Column], Column]:
    """Fold: the open document of the state meets the next one."""

    def settled(u: Column) -> Column:
        return (u["mass"] == 0) | (u["mass"] == u["full"])

    def with_mass(u: Column, mass: Column) -> Column:
        return u.withField("mass", mass)

    def meet(state: Column, b: Column) -> Column:
        a = state["open"]
        up, down = F.least(a["full"] - a["mass"], b["mass"]), F.least(a["mass"], b["full"] - b["mass"])
        draw = F.pmod(F.xxhash64(a["h"], b["h"], F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
        # a gains `up` words from b with the chance down / (up + down), else loses `down` to it
        moved = _let(F.struct(up.alias("up"), down.alias("down")), lambda m: F.when(draw * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]))
        pair = _let(moved, lambda m: F.struct(with_mass(a, a["mass"] + m).alias("a"), with_mass(b, b["mass"] - m).alias("b")))
        return _let(pair, lambda p: F.when(settled(p["a"]), F.struct(p["b"].alias("open"), F.array_append(state["done"], p["a"]).alias("done"))).otherwise(F.struct(p["a"].alias("open"), F.array_append(state["done"], p["b"]).alias("done"))))

    return meet


def rounded(units: DataFrame, seed: int, most_units: int, fan: int) -> DataFrame:
    """`units` (source_key, n_docs, u: struct with h, mass, full and more) with each mass zero or full.

    Sums of masses of a source stay, but for its last open one."""
    out, groups = [], float(fan)
    while True:
        chunk = F.pmod(F.xxhash64("u.h", F.lit(groups)), F.ceil(F.col("n_docs") / groups))
        lists = units.groupBy("source_key", "n_docs", chunk.alias("chunk")).agg(F.array_sort(F.collect_list("u")).alias("us"))
        start = F.struct(F.col("us")[0].alias("open"), F.slice("us", 1, 0).alias("done"))
        folded = stored(lists.select("source_key", "n_docs", F.aggregate(F.slice("us", 2, F.greatest(F.size("us"), F.lit(1))), start, _meeting(seed)).alias("f")), "rounded")
        out.append(folded.select("source_key", F.explode("f.done").alias("u")))
        units = folded.select("source_key", "n_docs", F.col("f.open").alias("u"))
        if groups >= most_units:
            break
        groups *= fan
    last = F.when(F.col("u.mass") * 2 >= F.col("u.full"), F.col("u.full")).otherwise(F.lit(0).cast("long"))
    done = units.select("source_key", F.col("u").withField("mass", last).alias("u"))
    for part in out:
        done = done.unionByName(part)
    return done


def mix(docs: DataFrame, seed: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of `docs`.

    `taken` is size * copies, copies between 0 and `most`. A null text, or one without words,
    has size 0 and is taken as 0 words; null sources are one source, the last; rows alike in id,
    source and size share their copies out evenly; null ids are an id like others. An empty
    table gives no rows. Other columns of `docs` have no effect."""
    sizes = stored(sized(docs, id_col, text_col, source_col), "sizes")
    sources = small_side(targets(sizes, weights, share, most), "targets")
    most_units = sources.agg(F.max("n_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = sizes.join(sources, "source_key").withColumn("copies", rate * F.col("n_rows")).withColumn("sure", F.floor("copies"))
    full = F.col("size") * PARTS
    mass = F.least(F.round((F.col("copies") - F.col("sure")) * F.col("size") * float(PARTS)).cast("long"), full)
    fields = [F.xxhash64("doc_id", "size", F.lit(seed)).alias("h"), "doc_id", "size", "n_rows", "sure", "source_size", "target", full.alias("full"), mass.alias("mass")]
    units = units.select("source_key", "n_docs", F.struct(*fields).alias("u"))
    is_open = (F.col("u.mass") > 0) & (F.col("u.mass") < F.col("u.full"))
    done = rounded(units.where(is_open), seed, most_units, FAN).unionByName(units.where(~is_open).select("source_key", "u"))
    copies = F.col("u.sure") + F.when((F.col("u.mass") > 0), 1).otherwise(0)
    each = done.select("u.*", copies.alias("all_copies")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / ROWS))))
    k = F.explode(F.sequence(F.col("block") * ROWS, F.least((F.col("block") + 1) * ROWS, F.col("n_rows")) - 1))
    each = each.withColumn("k", k)
    own = F.floor(F.col("all_copies") / F.col("n_rows")) + (F.col("k") < F.col("all_copies") % F.col("n_rows")).cast("long")
    return each.withColumn("copies", own).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
