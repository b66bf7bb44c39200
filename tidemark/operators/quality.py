"""Auditing bars: invalid rows, counts, zero-volume runs, missing minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import indexed

#: What can be wrong with a row, in the order in which reasons are listed.
FLAGS = {
    "null_required": "ts IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL",
    "open_non_positive": "open <= 0",
    "high_non_positive": "high <= 0",
    "low_non_positive": "low <= 0",
    "close_non_positive": "close <= 0",
    "high_below_low": "high < low",
    "high_below_open": "high < open",
    "high_below_close": "high < close",
    "low_above_open": "low > open",
    "low_above_close": "low > close",
    "negative_volume": "volume < 0",
}
_FATAL = ("duplicate_count", "missing_minute_count", "non_monotonic_count", "null_required_count", "invalid_row_count", "negative_volume_count")


def _true(sql: str) -> Column:
    return F.coalesce(F.expr(sql), F.lit(False))


def invalid_rows(bars: DataFrame) -> DataFrame:
    """Rows with something wrong, and reasons: the names of what it is, joined by semicolons."""
    reasons = F.concat_ws(";", *[F.when(_true(sql), F.lit(name)) for name, sql in FLAGS.items()])
    return bars.withColumn("reasons", reasons).where("reasons <> ''")


def duplicate_rows(bars: DataFrame) -> DataFrame:
    """All rows whose time another row of the series has too."""
    again = bars.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return bars.join(again, ["symbol", "ts"], "left_semi")


def missing_minutes(bars: DataFrame) -> DataFrame:
    """(symbol, minute) of minutes without a bar between a series' first and last: each gap is told by the next bar."""
    day = F.floor(F.col("minute") / 1440)
    days = bars.groupBy("symbol", day.alias("day")).agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
    between = Window.partitionBy("symbol").orderBy("day")
    across = days.select("symbol", F.lag("last").over(between).alias("minute"), F.col("first").alias("next")).where("minute IS NOT NULL")
    inside = bars.select("symbol", "minute", F.lead("minute").over(Window.partitionBy("symbol", day).orderBy("minute")).alias("next"))
    gaps = inside.unionByName(across).where("next - minute > 1")
    return gaps.select("symbol", F.explode(F.sequence(F.col("minute") + 1, F.col("next") - 1)).alias("minute"))


#: Rows of a chunk in which runs are found.
RUN_CHUNK = 10_000


def zero_volume_runs(rows: DataFrame) -> DataFrame:
    """(symbol, start_minute, end_minute, length) of maximal runs of rows, neighbours by idx, without volume.

    Runs are found within chunks of rows; those that touch an edge of their chunk, two a chunk at most, are joined to
    their neighbours'.
    """
    chunk = F.floor((F.col("idx") - 1) / RUN_CHUNK)
    zero = rows.where("volume = 0").select("symbol", "minute", "idx", chunk.alias("chunk"))
    inside = Window.partitionBy("symbol", "chunk").orderBy("idx")
    pieces = zero.withColumn("run", F.col("idx") - F.row_number().over(inside)).groupBy("symbol", "chunk", "run").agg(
        F.min("minute").alias("start_minute"), F.max("minute").alias("end_minute"), F.count(F.lit(1)).alias("length"), F.min("idx").alias("first"), F.max("idx").alias("last")
    )
    edge = (F.col("first") == F.col("chunk") * RUN_CHUNK + 1) | (F.col("last") == (F.col("chunk") + 1) * RUN_CHUNK)
    order = Window.partitionBy("symbol").orderBy("first")
    touching = pieces.where(edge).withColumn("new", F.when(F.col("first") - F.lag("last").over(order) == 1, 0).otherwise(1))
    touching = touching.withColumn("joined", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("symbol", "joined").agg(
        F.min("start_minute").alias("start_minute"), F.max("end_minute").alias("end_minute"), F.sum("length").alias("length")
    )
    columns = ("symbol", "start_minute", "end_minute", "length")
    return pieces.where(~edge).select(*columns).unionByName(touching.select(*columns))


def report(bars: DataFrame) -> dict[str, DataFrame]:
    """The tables of a quality report: the summary, and the rows behind each of its counts."""
    unique = bars.dropDuplicates(["symbol", "minute"])
    return {
        "summary": audit(bars), "invalid_rows": invalid_rows(bars), "duplicate_rows": duplicate_rows(bars), "missing_minutes": missing_minutes(unique),
        "zero_volume_rows": bars.where("volume = 0"), "zero_volume_runs": zero_volume_runs(indexed(unique)), "negative_volume_rows": bars.where("volume < 0"),
    }


def out_of_order(bars: DataFrame) -> DataFrame:
    """One row, non_monotonic_count: rows whose time is not after that of the row before them in the input. Within blocks of
    files, rows are compared by a window; from block to block, by the first and last of each, which are few."""
    at = F.col("input_pos")
    rows = bars.where("minute IS NOT NULL").select("symbol", "minute", at, at["file"].alias("file"), at["block"].alias("block"))
    inside = Window.partitionBy("symbol", "file", "block").orderBy("input_pos")
    rows = rows.withColumn("late", F.col("minute") <= F.lag("minute").over(inside))
    ends = rows.groupBy("symbol", "file", "block").agg(F.count_if("late").alias("n"), F.min_by("minute", "input_pos").alias("a"), F.max_by("minute", "input_pos").alias("z"))
    across = Window.partitionBy("symbol").orderBy("file", "block")
    joint = F.coalesce((F.col("a") <= F.lag("z").over(across)).cast("long"), F.lit(0))
    return ends.select((F.col("n") + joint).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("non_monotonic_count"))


def audit(bars: DataFrame) -> DataFrame:
    """One row: counts of what is wrong, the span, and passed, which zero volume does not spoil.

    Rows count as out of order where they do not follow the one before in input order (column input_pos if there is
    one, else order of time, where only ties do)."""
    if "input_pos" not in bars.columns:
        late = bars.groupBy("symbol", "ts").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("non_monotonic_count"))
    else:
        late = out_of_order(bars)
    bad = _true(" OR ".join(f"({sql})" for sql in FLAGS.values()))
    one = bars.agg(
        F.count(F.lit(1)).alias("row_count"), F.min("minute").alias("start_minute"), F.max("minute").alias("end_minute"),
        F.count_if(_true(FLAGS["null_required"])).alias("null_required_count"), F.count_if(bad).alias("invalid_row_count"),
        F.count_if(_true("volume < 0")).alias("negative_volume_count"), F.count_if(_true("volume = 0")).alias("zero_volume_count"),
    )
    again = duplicate_rows(bars).agg(F.count(F.lit(1)).alias("duplicate_count"))
    missing = missing_minutes(bars.dropDuplicates(["symbol", "minute"])).agg(F.count(F.lit(1)).alias("missing_minute_count"))
    out = one.crossJoin(again).crossJoin(missing).crossJoin(late)
    passed = F.lit(True)
    for c in _FATAL:
        passed = passed & (F.col(c) == 0)
    return out.withColumn("passed", passed)
