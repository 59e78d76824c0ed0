"""What operators did to the notes of a score, as bags of notes; arrays pooled by their rows' times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTE = ("onset", "release", "pitch")


def note_differences(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = NOTE) -> DataFrame:
    """score_id, the columns, n: notes that one side has oftener than the other, n times more before (above zero) or after
    (below). Equal notes are counted, nulls are equal; one exchange, with counts per task before it."""
    side = lambda df, n: df.where("type = 'note'").select("score_id", *columns, F.lit(n).alias("n"))
    both = side(before, 1).unionByName(side(after, -1)).groupBy("score_id", *columns).agg(F.sum("n").alias("n"))
    return both.where("n <> 0")


def quantize_differences(before: DataFrame, tpq: int = 4) -> DataFrame:
    """Notes that quantizing to 1/tpq and removing what gets no length takes away: score_id, onset, release, pitch. For each
    note lost one of its pitch and onset is told, the first that no other stands for."""
    at = Window.partitionBy("score_id", "pitch", "onset")
    lost = F.rint(F.col("onset") * tpq) == F.rint(F.col("release") * tpq)
    told = before.where("type = 'note'").withColumn("__n", F.count_if(lost).over(at)).withColumn("__k", F.row_number().over(at.orderBy("row_id")))
    return told.where("__k <= __n").select("score_id", *NOTE)


def sync_array(df: DataFrame, column: str, by: tuple[str, ...] = ("onset",), pool: str = "mean") -> DataFrame:
    """`column`, an array on each row, as the mean (or min, max, sum) place by place of the arrays of all rows of the score
    alike in `by`. Rows with a null in `by` keep theirs. Groups meet as partial sums, never as lists of arrays."""
    how = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[pool]
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    flat = df.where(known).select("score_id", *by, F.posexplode(column).alias("__at", "__x"))
    pooled = flat.groupBy("score_id", *by, "__at").agg(how("__x").alias("__x")).groupBy("score_id", *by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__x"))), lambda p: p["__x"]).alias("__pooled"))
    return df.join(pooled, ["score_id", *by], "left").withColumn(column, F.coalesce("__pooled", F.col(column))).select(*df.columns)


def unique_of_array(df: DataFrame, column: str, by: tuple[str, ...] = ("onset",), sync_by: tuple[str, ...] | None = None, pool: str = "mean", order: Column | str = "row_id") -> DataFrame:
    """score_id, the columns of `by`, row (the first row's `order`) and `column` of the first row of each group; pooled before by
    `sync_by`, if given."""
    s = df if sync_by is None else sync_array(df, column, sync_by, pool)
    key = F.col(order) if isinstance(order, str) else order
    return s.groupBy("score_id", *by).agg(F.min(key).alias("row"), F.min_by(column, key).alias(column))
