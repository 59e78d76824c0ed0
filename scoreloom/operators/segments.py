"""Nearest items of sorted tables, and segments of about so many rows.

`marks` are tables of score_id and i. A search sorts rows and marks of a score together once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.plans.stages import staged


def _nearest(rows: DataFrame, marks: DataFrame, at: Column, name: str, below: bool) -> DataFrame:
    """Adds the greatest mark at or below `at`, or the least at or above it; null where there is none."""
    asked = rows.select("score_id", at.alias("__at"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"))
    both = asked.unionByName(marks.select("score_id", F.col("i").alias("__at"), F.lit(0).alias("__side"), F.col("i").alias("__i")), allowMissingColumns=True)
    order = Window.partitionBy("score_id").orderBy(F.col("__at").asc_nulls_first() if below else F.col("__at").desc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(name, F.last("__i", ignorenulls=True).over(order)).where("__side = 1")
    return found.select("__row.*", name)


def item_leq(rows: DataFrame, marks: DataFrame, value: Column, name: str, least: Column | None = None) -> DataFrame:
    """Adds the greatest mark at or below `value`. With `least`, marks below it do not count, and if none is left the least
    mark at or above `least` is taken."""
    if least is None:
        return _nearest(rows, marks, value, name, True)
    found = _nearest(rows, marks, F.greatest(value, least), name, True)
    found = _nearest(found, marks, least, "__up", False)
    return found.withColumn(name, F.when(F.col(name) >= least, F.col(name)).otherwise(F.col("__up"))).drop("__up")


def item_geq(rows: DataFrame, marks: DataFrame, value: Column, name: str, most: Column | None = None) -> DataFrame:
    """Adds the least mark at or above `value`; `most` bounds it as `least` does above."""
    if most is None:
        return _nearest(rows, marks, value, name, False)
    found = _nearest(rows, marks, F.least(value, most), name, False)
    found = _nearest(found, marks, most, "__down", True)
    return found.withColumn(name, F.when(F.col(name) <= most, F.col(name)).otherwise(F.col("__down"))).drop("__down")


def _met(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    """An inner join of two tables that both grow with the scores: sorted and merged, as a table of few bytes on disk may have
    millions of rows and would be gathered by the driver to be broadcast."""
    return a.join(b.hint("merge"), on)


def segment_indices(onsets: DataFrame, releases: DataFrame, target_len: int) -> DataFrame:
    """score_id, start, stop of segments of about `target_len` rows: each begins at a mark of `onsets` and ends behind one of
    `releases`, the last that keeps it within the length, or else the next; it begins where the one before
    ended, or at the last onset before that. Releases before the first onset are left out.

    What follows a segment depends on its end and on whether it began at the last onset so far, so
    for each release there are two states and each has one successor. From this table the states
    that a score comes to are found by doubling: after k rounds all within 2 ** k steps."""
    onsets, releases = (m.select("score_id", F.col("i").cast("long").alias("i")).distinct() for m in (onsets, releases))
    last = releases.groupBy("score_id").agg(F.max("i").alias("last"), F.min("i").alias("first_release"))

    def ends(rows: DataFrame) -> DataFrame:
        """Adds the end of a segment that begins at `start`, after one that ended at `before`, and its state."""
        found = item_leq(rows, releases, F.col("start") + target_len - 1, "end", F.greatest(F.col("start"), F.col("before")) + 1)
        return item_leq(found, onsets, F.col("end") + 1, "newest").where("end is not null").withColumn("stuck", F.col("newest") == F.col("start")).drop("newest")

    first = _met(onsets.groupBy("score_id").agg(F.min("i").alias("start")), last, "score_id").select("score_id", "start", (F.col("first_release") - 1).alias("before"))
    reached = staged(ends(first).select("score_id", "start", "end", "stuck"))
    nodes = _met(releases, last, "score_id").where("i < last").select("score_id", F.col("i").alias("from"))
    nodes = item_geq(item_leq(nodes, onsets, F.col("from") + 1, "newest"), onsets, F.col("from") + 2, "coming")
    nodes = nodes.withColumn("was", F.explode(F.array(F.lit(False), F.lit(True)))).select("score_id", "from", "was", F.when(F.col("was"), F.col("coming")).otherwise(F.col("newest")).alias("start"), F.col("from").alias("before")).where("start is not null")
    steps = staged(ends(nodes).select("score_id", "from", "was", "start", "end", "stuck"))
    while True:
        at = reached.select("score_id", F.col("end").alias("from"), F.col("stuck").alias("was"))
        more = staged(_met(at, steps, ["score_id", "from", "was"]).select("score_id", "start", "end", "stuck"))
        if more.isEmpty():
            break
        reached = staged(reached.unionByName(more).distinct())
        then = steps.select("score_id", F.col("from").alias("end"), F.col("was").alias("stuck"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("stuck").alias("__k"))
        steps = staged(_met(steps, then, ["score_id", "end", "stuck"]).select("score_id", "from", "was", F.col("__s").alias("start"), F.col("__e").alias("end"), F.col("__k").alias("stuck")))
    return reached.select("score_id", "start", (F.col("end") + 1).alias("stop"))


def segment_df(df: DataFrame, target_len: int) -> DataFrame:
    """Rows with segment (0, 1, ..) of about `target_len` rows: notes of one onset begin a segment together, those of one release
    end it together. `df` needs seq, a row's number in its score from 1. Where segments overlap
    a row is in each; rows after the last end are in none."""
    i = F.col("seq").cast("long") - 1
    onsets = df.groupBy("score_id", "onset").agg(F.min(i).alias("i"))
    releases = df.where("type = 'note' and release is not null").groupBy("score_id", "release").agg(F.max(F.struct("pitch", i.alias("i"))).alias("m")).select("score_id", F.col("m.i").alias("i"))
    cuts = segment_indices(onsets, releases, target_len).withColumn("segment", F.row_number().over(Window.partitionBy("score_id").orderBy("start", "stop")) - 1)
    # each segment meets the rows of its own range: ranges are spread over blocks of rows
    block = lambda c: F.floor(c / target_len)
    spread = cuts.withColumn("__b", F.explode(F.sequence(block(F.col("start")), block(F.col("stop") - 1))))
    return _met(df.withColumn("__b", block(i)), spread, ["score_id", "__b"]).where((i >= F.col("start")) & (i < F.col("stop"))).select(*df.columns, "segment")
