"""Row order, cropping and segmenting of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of event types at one onset; all others rank 3.
RANKS = {"time_signature": 0, "tempo": 1, "bar": 2, "note": 4}


def rank(kind: str = "type") -> Column:
    out = F.lit(3)
    for name, k in RANKS.items():
        out = F.when(F.col(kind) == name, k).otherwise(out)
    return out


def order(df: DataFrame) -> Window:
    """The canonical order of a score's rows; nulls last, ties by row_id."""
    keys = [F.asc_nulls_last("onset"), rank(), F.asc_nulls_last("type")] + [F.asc_nulls_last(c) for c in ("pitch", "release", "row_id") if c in df.columns]
    return Window.partitionBy("score_id").orderBy(*keys)


def sort_df(df: DataFrame) -> DataFrame:
    """Adds seq, the place of each row in its score."""
    return df.withColumn("seq", F.row_number().over(order(df)).cast("long"))


def unused(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ffill(column: str | Column, over: Window) -> Column:
    return F.last(column, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def crop_df(df: DataFrame, start_time: float | None = None, start_row: int | None = None, end_row: int | None = None, infer_bars: bool = True) -> DataFrame:
    """Rows of each score, in canonical order, from the first note at or after `start_time` (or from the
    note `start_row`) to the row `end_row`, both included. The last time signature and bar before the first
    note come along, the time signature moved to the bar's onset. Scores without such a first
    note give no rows. Where a start is given, scores with time signatures (column other) but no bars get bars
    first (row_id null); without `infer_bars` they keep the time signature's onset, as scores without either do."""
    if start_time is not None and start_row is not None:
        raise ValueError("start_time or start_row, not both")
    whole, columns = Window.partitionBy("score_id"), df.columns
    if infer_bars and "other" in columns and not (start_time is None and start_row is None):
        from scoreloom.operators.meter import infer_barlines

        # bars of scores without time signatures go after the sort, which then serves all windows below: numbers of rows only order them
        given, signs = unused(df, "given"), unused(df, "signs")
        s = infer_barlines(df.withColumn(given, F.lit(True))).withColumn("__seq", F.row_number().over(order(df)))
        s = s.withColumn(signs, F.max(F.col("type") == "time_signature").over(whole)).where(F.col(given) | F.col(signs)).drop(given, signs)
    else:
        s = df.withColumn("__seq", F.row_number().over(order(df)))
    if start_time is None and start_row is None:
        s = s.withColumn("__first", F.lit(1))
    else:
        begins = (F.col("type") == "note") & (F.col("onset") >= start_time) if start_row is None else F.col("row_id") == start_row
        s = s.withColumn("__first", F.min(F.when(begins, F.col("__seq"))).over(whole))
    if end_row is not None:
        s = s.withColumn("__end", F.max(F.when(F.col("row_id") == end_row, F.col("__seq"))).over(whole)).where("__seq <= __end")
    before = lambda kind: F.max(F.when((F.col("type") == kind) & (F.col("__seq") < F.col("__first")), F.struct("__seq", "onset"))).over(whole)
    s = s.withColumn("__bar", before("bar")).withColumn("__sig", before("time_signature"))
    carried = F.col("__seq") == F.col("__sig.__seq")
    kept = s.where((F.col("__seq") >= F.col("__first")) | carried | (F.col("__seq") == F.col("__bar.__seq")))
    return kept.withColumn("onset", F.when(F.coalesce(carried, F.lit(False)), F.coalesce("__bar.onset", "onset")).otherwise(F.col("onset"))).select(*columns)


def segment_df_by_onset(df: DataFrame, segment_dur: float) -> DataFrame:
    return df.withColumn("segment", F.floor(F.col("onset") / segment_dur).cast("long"))


def segment_df_by_bar(df: DataFrame, n_bars: int = 1) -> DataFrame:
    """Needs bar_number."""
    return df.withColumn("bar_group", F.floor((F.col("bar_number") - 1) / n_bars).cast("long"))


def split_df_by_pitch(df: DataFrame, split_points: list[float]) -> DataFrame:
    """Adds part: for notes the number of split points at or below their pitch; other rows go to every part."""
    part = sum((F.when(F.col("pitch") >= p, 1).otherwise(0) for p in split_points), F.lit(0))
    parts = F.when(F.col("type") == "note", F.array(part)).otherwise(F.array(*map(F.lit, range(len(split_points) + 1))))
    return df.withColumn("part", F.explode(parts)).withColumn("part", F.col("part").cast("long"))


def get_notes_sounding_during(df: DataFrame, onset: float, release: float) -> DataFrame:
    return df.where((F.col("type") == "note") & (F.col("onset") < release) & (F.col("release") > onset))


def eligible_onsets(df: DataFrame) -> DataFrame:
    """First row of every distinct onset of a score's notes: score_id, onset, row_id."""
    return df.where("type = 'note'").groupBy("score_id", "onset").agg(F.min(F.struct("pitch", "release", "row_id")).alias("r")).select("score_id", "onset", F.col("r.row_id").alias("row_id"))


def split_by(df: DataFrame, column: str, values: list, with_marks: bool = False) -> dict:
    """A frame for each of the given values of `column` with the rows that have it, notes or not; `with_marks` gives all rows that
    are no notes to each frame as well, so that a part keeps its meter."""
    mark = F.coalesce(F.col("type") != "note", F.lit(True)) if with_marks else F.lit(False)
    return {v: df.where(mark | (F.col(column) == F.lit(v))) for v in values}


def split_musicdf(df: DataFrame, by_track: bool = True, by_channel: bool = True) -> DataFrame:
    """Adds part, a struct of track and channel (those of them asked for and there; channel alone does without track, both
    do without channel). Rows with a null in it are in no part. Without the columns all rows are one part, null."""
    if not by_track and not by_channel:
        raise ValueError("split by track, channel or both")
    asked = ["track"] * by_track + ["channel"] * (by_channel and (not by_track or "channel" in df.columns))
    if not set(asked) <= set(df.columns):
        return df.withColumn("part", F.lit(None).cast("struct<track: long, channel: long>"))
    return df.dropna(subset=asked).withColumn("part", F.struct(*asked))


def drop_columns(df: DataFrame, columns: tuple[str, ...] = ("key", "degree", "quality", "inversion", "primary_degree", "primary_alteration", "secondary_degree", "secondary_alteration", "secondary_mode", "chord_pcs")) -> DataFrame:
    """`df` without those of the harmony columns that it has."""
    return df.drop(*columns)


def edit_counts(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """What an operator did to the notes of each score: n_before, n_after, n_removed, n_added, n_changed (rows by row_id
    whose `columns` differ); both sides are partitioned by score and row once."""
    told = lambda df, side: df.where("type = 'note'").select("score_id", "row_id", F.struct(*columns).alias(side))
    both = told(before, "a").join(told(after, "b"), ["score_id", "row_id"], "full")
    n = lambda cond: F.count_if(cond)
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.groupBy("score_id").agg(n(a).alias("n_before"), n(b).alias("n_after"), n(a & ~b).alias("n_removed"), n(b & ~a).alias("n_added"), n(a & b & ~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"))
