"""Ordered work on long series: row numbers, chunks with halos, closed higher-timeframe bars, exponential means.

A window over a whole series is one task. Here rows get their place in the series from counts per day, chunks of rows
take along the rows before them that their windows need (the halo), and windows then run within chunks.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.moving import seen
from tidemark.functions.sheet import Sheet

#: Rows of a chunk without its halo, and minutes of the blocks that rows are counted in.
CHUNK, BLOCK = 4_000, 1440
#: Minutes of a span, about, in which rows of all timeframes meet.
SPAN = 4 * BLOCK
#: Periods of a chunk of the series that the last closed bar is carried along.
CARRY = 5_000
#: Rows of a chunk of exponential means at most, and decimal digits that a power of their weights may reach.
EWM_CHUNK, WEIGHT_DIGITS = 1_000, 100


def indexed(bars: DataFrame) -> DataFrame:
    """bars with idx: the row's number in its series by minute, from 1. Only counts of blocks are ordered as a whole."""
    blocked = bars.withColumn("__block", F.floor(F.col("minute") / BLOCK))
    counts = blocked.groupBy("symbol", "__block").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("symbol").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    inside = Window.partitionBy("symbol", "__block").orderBy("minute")
    joined = blocked.join(counts, ["symbol", "__block"])
    return joined.withColumn("idx", (F.col("__before") + F.row_number().over(inside)).cast("long")).drop("__block", "__before")


def chunked(bars: DataFrame, halo: int, chunk: int = CHUNK) -> DataFrame:
    """Indexed bars with a chunk, rows repeated in the next chunks that need them as context; own tells the rows apart."""
    first = F.floor((F.col("idx") - 1) / chunk).cast("int")
    last = F.floor((F.col("idx") - 1 + halo) / chunk).cast("int")
    out = bars.withColumn("__own", first).withColumn("chunk", F.explode(F.sequence(first, last)))
    return out.withColumn("own", F.col("chunk") == F.col("__own")).drop("__own")


def with_sheet(bars: DataFrame, sheet: Sheet, keep: tuple[str, ...] = ("symbol", "minute"), chunk: int = CHUNK, only: Column | None = None) -> DataFrame:
    """The sheet's columns for each bar, or for those that `only` is true for. Values are those of one window over the
    whole series: the halo covers the longest chain of windows."""
    halo = sheet.depth()
    rows = chunked(indexed(bars), halo, max(chunk, 4 * halo))
    if only is not None:
        rows = rows.withColumn("own", F.col("own") & F.coalesce(only, F.lit(False)))
    return sheet.apply(rows, keep, "own")


def ahead(df: DataFrame, window: WindowSpec, columns: dict[str, str], counts: tuple[int, ...]) -> DataFrame:
    """df with <column>_<n>: the largest or smallest (columns: name to max or min) of the n rows from each row on, in the
    window's order; NULL if one of them is unknown or not there. Runs of powers of two overlap to make any number, so
    that the cost of a row does not grow with n."""
    def two(f: str, name: str, there: int) -> Column:
        here, then = F.col(name), F.lead(name, there).over(window)
        return F.when(here.isNotNull() & then.isNotNull(), (F.greatest if f == "max" else F.least)(here, then))

    df = df.withColumns({f"__{c}_1": F.col(c) for c in columns})
    size = 1
    while size * 2 <= max(counts):
        df = df.withColumns({f"__{c}_{2 * size}": two(f, f"__{c}_{size}", size) for c, f in columns.items()})
        size *= 2
    largest = {n: 1 << n.bit_length() - 1 for n in counts}
    df = df.withColumns({f"{c}_{n}": two(f, f"__{c}_{k}", n - k) if n > k else F.col(f"__{c}_{k}") for c, f in columns.items() for n, k in largest.items()})
    return df.drop(*[x for x in df.columns if x.startswith("__") and any(x.startswith(f"__{c}_") for c in columns)])


def extremes(bars: DataFrame, levels: tuple[int, ...], block: int = BLOCK) -> DataFrame:
    """(symbol, level, minute, high, low): highest high and lowest low of the 2**level minutes from each minute on, where
    each of them has a bar with known prices. Two such rows, which may overlap, tell the extremes of any path: a look-up
    instead of the path's minutes."""
    sizes = tuple(1 << k for k in levels)
    if not sizes:
        return bars.select("symbol", F.lit(0).alias("level"), "minute", "high", "low").limit(0)
    day = F.floor(F.col("minute") / block)
    spread = bars.select("symbol", "minute", "high", "low").withColumn("__day", F.explode(F.sequence(F.floor((F.col("minute") - max(sizes) + 1) / block), day)))
    w = Window.partitionBy("symbol", "__day").orderBy("minute")
    seen = ahead(spread, w, {"high": "max", "low": "min"}, sizes)
    runs = [
        F.when(F.col("minute") + n - 1 == (F.lead("minute", n - 1).over(w) if n > 1 else F.col("minute")), F.struct(F.lit(k).alias("level"), F.col(f"high_{n}").alias("high"), F.col(f"low_{n}").alias("low"))).alias(f"__r{k}")
        for k, n in zip(levels, sizes)
    ]
    seen = seen.select("symbol", "minute", "__day", day.alias("__own"), *runs).where("__day = __own")
    each = seen.select("symbol", "minute", F.explode(F.array_compact(F.array(*[f"__r{k}" for k in levels]))).alias("r"))
    return each.select("symbol", "r.level", "minute", "r.high", "r.low").where("high IS NOT NULL AND low IS NOT NULL")


def resampled(bars: DataFrame, minutes: int) -> DataFrame:
    """Closed bars of `minutes`, anchored at the epoch; buckets without rows are not there. bucket is the number of the
    period, close_minute its end."""
    bucket = F.floor(F.col("minute") / minutes).cast("long")
    known = {c: F.struct(F.col("minute"), F.col(c)) for c in ("open", "close")}
    out = bars.groupBy("symbol", bucket.alias("bucket")).agg(
        F.min(F.when(F.col("open").isNotNull(), known["open"]))["open"].alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max(F.when(F.col("close").isNotNull(), known["close"]))["close"].alias("close"),
        F.sum("volume").alias("volume"),
    )
    out = out.where("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    return out.withColumn("close_minute", (F.col("bucket") + 1) * minutes)


def last_closed(bars: DataFrame, closed: DataFrame, minutes: int, columns: list[str], minutes_of: DataFrame | None = None) -> DataFrame:
    """bars with `columns` of the last bar of `closed` that had closed by the row's minute.

    A row lies in one period; the last closed one is the period before it among those that have a row of `closed`, so
    that an equi-join on periods does, after a look at the neighbour in the short series. The whole row is taken over,
    NULLs included. minutes_of is a cheaper table with the same (symbol, minute), if bars is itself computed at length.
    """
    periods = (bars if minutes_of is None else minutes_of).select("symbol", F.floor(F.col("minute") / minutes).cast("long").alias("bucket")).distinct()
    short = periods.join(closed.select("symbol", "bucket", F.struct(*columns).alias("__row")), ["symbol", "bucket"], "left")
    # within chunks of periods, and from chunk to chunk by the last bar of each: no window holds a whole series
    short = short.withColumn("__chunk", F.floor(F.col("bucket") / CARRY))
    ends = short.groupBy("symbol", "__chunk").agg(F.max(F.when(F.col("__row").isNotNull(), F.struct("bucket", "__row")))["__row"].alias("__end"))
    earlier = Window.partitionBy("symbol").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "__chunk", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    inside = Window.partitionBy("symbol", "__chunk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("__row", F.last("__row", ignorenulls=True).over(inside)).join(ends, ["symbol", "__chunk"])
    short = short.select("symbol", "bucket", F.coalesce("__row", "__before").alias("__row"))
    out = bars.withColumn("bucket", F.floor(F.col("minute") / minutes).cast("long")).join(short, ["symbol", "bucket"], "left")
    return out.select(*bars.columns, *[F.col("__row")[c].alias(c) for c in columns])


def _span(tfs: tuple[int, ...]) -> int:
    """Minutes of a span: no period of any timeframe lies in two."""
    whole = math.lcm(*tfs)
    return whole * max(1, SPAN // whole)


def resampled_to_all(bars: DataFrame, tfs: tuple[int, ...]) -> DataFrame:
    """Closed bars of all timeframes as resampled() has them, of bars with one row a minute: (symbol, minute, open, ...),
    one series for each, whose symbol is <symbol>|<tf> and whose minute the number of the period. Minute rows are shuffled
    once, by spans that periods do not cross. Kept, as numbering the rows reads them more than once."""
    spans = bars.where("symbol IS NOT NULL").select("symbol", "minute", "open", "high", "low", "close", "volume", F.floor(F.col("minute") / _span(tfs)).alias("__span"))
    rows = spans.repartition("symbol", "__span").withColumn("tf", F.explode(F.array(*[F.lit(tf) for tf in tfs])))
    known = {c: F.when(F.col(c).isNotNull(), F.col("minute")) for c in ("open", "close")}
    out = rows.groupBy("symbol", "__span", "tf", F.floor(F.col("minute") / F.col("tf")).cast("long").alias("bucket")).agg(
        F.min_by("open", known["open"]).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", known["close"]).alias("close"),
        F.sum("volume").alias("volume"),
    )
    out = out.where("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    return out.select(F.concat_ws("|", "symbol", "tf").alias("symbol"), F.col("bucket").alias("minute"), "open", "high", "low", "close", "volume").persist()


def last_closed_of_all(rows: DataFrame, keep: tuple[str, ...], closed: DataFrame, values: DataFrame, tfs: tuple[int, ...], names: tuple[str, ...]) -> DataFrame:
    """(symbol, minute, keep..., t<tf>_<name>...): rows with the columns `names` of the last bar of each timeframe that had
    closed by the row's minute, as last_closed() has it. closed is what resampled_to_all() gives, values has the same rows.

    Minute rows and closed bars meet in spans of time, all timeframes at once, so that each is shuffled once, whatever the
    number of columns; joined one timeframe after the other, rows would carry the earlier ones' columns. The last bar
    before a span goes along with it; which that is, a look at the ends of the spans tells. keep and names are doubles.
    """
    span = _span(tfs)
    at = lambda df: df.select(
        F.regexp_replace("symbol", "[|][0-9]+$", "").alias("symbol"), F.substring_index("symbol", "|", -1).cast("int").alias("tf"), *[c for c in df.columns if c != "symbol"]
    ).withColumn("minute", (F.col("minute") + 1) * F.col("tf")).withColumn("__span", F.floor(F.col("minute") / span))
    ends = at(closed.select("symbol", "minute")).groupBy("symbol", "tf", "__span").agg(F.max("minute").alias("__end"))
    there = rows.select("symbol", F.floor(F.col("minute") / span).alias("__span")).distinct().select("symbol", F.explode(F.array(*[F.lit(tf) for tf in tfs])).alias("tf"), "__span")
    earlier = Window.partitionBy("symbol", "tf").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sent = there.withColumn("__there", F.lit(True)).join(ends, ["symbol", "tf", "__span"], "full").withColumn("minute", F.last("__end", ignorenulls=True).over(earlier))
    sent = sent.where("__there AND minute IS NOT NULL").groupBy("symbol", "tf", "minute").agg(F.collect_list("__span").alias("__to"))
    bars = at(values).join(sent, ["symbol", "tf", "minute"], "left")
    bars = bars.withColumn("__span", F.explode(F.when(F.col("__to").isNull(), F.array("__span")).otherwise(F.concat(F.array("__span"), "__to"))))
    width = max(len(keep), len(names))
    slots = lambda own: [(F.col(own[i]) if i < len(own) else F.lit(None)).cast("double").alias(f"v{i}") for i in range(width)]
    minutes = rows.select("symbol", F.lit(0).alias("tf"), "minute", F.floor(F.col("minute") / span).alias("__span"), *slots(keep))
    both = minutes.unionByName(bars.select("symbol", "tf", "minute", "__span", *slots(names)))
    both = both.repartition("symbol", "__span").sortWithinPartitions("__span", "symbol", "tf", "minute")
    out = [f"t{tf}_{n}" for tf in tfs for n in names]
    schema = T.StructType([rows.schema["symbol"], rows.schema["minute"], *[T.StructField(c, T.DoubleType()) for c in (*keep, *out)]])
    return both.mapInArrow(partial(seen, tfs=tfs, keep=len(keep), wanted=len(names), names=schema.names), schema)


def ewm(df: DataFrame, value: str, spans: dict[str, int], chunk: int = EWM_CHUNK) -> DataFrame:
    """df (symbol, idx, ...) with exponential means of a column without NULLs: y = (1 - a) y' + a x, a = 2 / (span + 1),
    starting from the first value; unknown before `span` values.

    In a chunk, the mean is the sum of values weighed by powers of 1 - a, of which one is taken out, plus what is left of
    the mean before the chunk. Chunks are so short that no power overflows. The mean before a chunk is the same sum over
    the ends of earlier chunks, as far back as they weigh more than 1e-20: a window of some dozen rows. No Python, and
    no window over a whole series.
    """
    keep, out = {n: 1 - 2.0 / (s + 1) for n, s in spans.items()}, df
    chunk = max(1, min([chunk, *[int(-WEIGHT_DIGITS / math.log10(k)) for k in keep.values() if k > 0]]))
    number = F.floor((F.col("idx") - 1) / chunk).cast("long")
    out = out.withColumn("__chunk", number).withColumn("__k", (F.col("idx") - 1 - number * chunk).cast("double"))
    inside = Window.partitionBy("symbol", "__chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("idx") == 1  # the series begins with its first value, as if that had always been there
    for n, k in keep.items():
        weighed = F.col(value) * F.when(first, 1.0).otherwise(1 - k) * F.pow(F.lit(k), -F.col("__k"))
        out = out.withColumn(f"__own_{n}", F.sum(weighed).over(inside) * F.pow(F.lit(k), F.col("__k")) if k > 0 else F.col(value))
    ends = out.groupBy("symbol", "__chunk").agg(F.max("__k").alias("__last"), *[F.max_by(f"__own_{n}", "idx").alias(f"__end_{n}") for n in spans])
    scales = {n: k**chunk if k > 0 else 0.0 for n, k in keep.items()}
    reach = max([math.ceil(-20 / math.log10(x)) for x in scales.values() if x > 0], default=1)
    back = F.col("__back") - 1
    left = {n: F.col(f"__end_{n}") * (F.pow(F.lit(x), back) if x > 0 else F.when(back == 0, 1.0).otherwise(0.0)) for n, x in scales.items()}
    sent = ends.withColumn("__back", F.explode(F.sequence(F.lit(1), F.lit(max(1, reach)))))
    sent = sent.select("symbol", (F.col("__chunk") + F.col("__back")).alias("__chunk"), *[x.alias(f"__e_{n}") for n, x in left.items()])
    starts = sent.groupBy("symbol", "__chunk").agg(*[F.sum(f"__e_{n}").alias(f"__start_{n}") for n in spans])
    out = out.join(starts, ["symbol", "__chunk"], "left")
    means = {
        n: F.when(F.col("idx") >= spans[n], F.col(f"__own_{n}") + F.coalesce(F.col(f"__start_{n}"), F.lit(0.0)) * F.pow(F.lit(k), F.col("__k") + 1))
        for n, k in keep.items()
    }
    return out.select(*df.columns, *[c.alias(n) for n, c in means.items()])
